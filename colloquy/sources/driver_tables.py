"""Maps the given test tables onto the engine's input schemas.

The mappings (act tags from word counts, logits from embeddings, calls from events) only give the
operators realistic-looking input of any size; every row derives from the tables.
"""
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy import constants as K
from colloquy.functions import hashing as H, text as T
from colloquy.operators.scale import chunk_scan

IDX_PER_TURN = 1 << 20      # sentences of one message stay below this
CHUNK_TURNS = 256           # chunk of a conversation, in messages
CHUNK_WIDTH = IDX_PER_TURN * CHUNK_TURNS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One given table, read as it is."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def utterances(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, idx, caller, act_tag, raw, text, norm, act, minor, claims) from conversations."""
    c = table(spark, sf, "conversations").where(F.col("role") != "system")
    marked = F.regexp_replace("text", r"([.!?])\s+", "$1\n")
    s = c.select("conv_id", "turn", "role", F.posexplode(F.split(marked, "\n")).alias("pos", "t")
                 ).where(F.trim("t") != "")
    n = F.size(F.split(F.trim("t"), r"\s+"))
    m = F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("pos")
    flip = F.col("pos") % 4 == 2
    caller = F.when((F.col("role") == "user") != flip, "B").otherwise("A")

    def pick(mod, *tags):
        out = None
        for i, t in enumerate(tags):
            out = F.when(m % mod == i, t) if out is None else out.when(m % mod == i, t)
        return out.otherwise(tags[-1])

    tag = (F.when(m % 7 == 0, "+")
           .when(n <= 2, pick(3, "b", "aa", "x"))
           .when(n <= 6, pick(4, "bk", "sd^e", "b", "b^m"))
           .otherwise(pick(5, "sd", "sv,b", "qy^d", "sd(^q)", "ba")))
    raw = F.concat("t", F.when(m % 5 <= 2, " /").when(m % 5 == 3, " -/").otherwise(""))
    place = F.when(F.col("pos") < IDX_PER_TURN, F.col("pos")).otherwise(F.raise_error(
        F.lit("a message has more sentences than positions")).cast("int"))
    return s.select(
        "conv_id", (F.col("turn") * IDX_PER_TURN + place).alias("idx"),
        caller.alias("caller"), tag.alias("act_tag"), raw.alias("raw"))


SQL_UTTERANCES = f"""
u0 AS (SELECT conv_id, turn, role, regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g') AS m
       FROM conversations WHERE role <> 'system'),
u1 AS (SELECT conv_id, turn, role, unnest(string_split(m, chr(10))) AS t,
              unnest(range(len(string_split(m, chr(10))))) AS pos FROM u0),
u2 AS (SELECT *, conv_id*7 + turn*3 + pos AS m, len(regexp_split_to_array(trim(t), '\\s+')) AS n
       FROM u1 WHERE trim(t) <> ''),
utt AS (SELECT conv_id, turn*{IDX_PER_TURN} + pos AS idx,
  CASE WHEN (role = 'user') <> (pos % 4 = 2) THEN 'B' ELSE 'A' END AS caller,
  CASE WHEN m % 7 = 0 THEN '+'
       WHEN n <= 2 THEN CASE m % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'aa' ELSE 'x' END
       WHEN n <= 6 THEN CASE m % 4 WHEN 0 THEN 'bk' WHEN 1 THEN 'sd^e' WHEN 2 THEN 'b' ELSE 'b^m' END
       ELSE CASE m % 5 WHEN 0 THEN 'sd' WHEN 1 THEN 'sv,b' WHEN 2 THEN 'qy^d' WHEN 3 THEN 'sd(^q)'
            ELSE 'ba' END END AS act_tag,
  t || CASE WHEN m % 5 <= 2 THEN ' /' WHEN m % 5 = 3 THEN ' -/' ELSE '' END AS raw FROM u2)"""


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """Decision rows from documents: id, group, split, label, kind, cue, company, text, norm."""
    d = table(spark, sf, "documents")
    grp = F.concat(F.lit("thread:"), F.floor(F.col("doc_id") / 4).cast("string"))
    return d.select(
        F.concat(F.lit("doc-"), T.padded(F.col("doc_id"), 8)).alias("id"),
        "doc_id", grp.alias("group"), F.col("lang").alias("label"), F.col("source").alias(
            "company"), "text").withColumn("split", H.assign_split(
                F.col("group"), K.SPLIT_SEED, K.SPLIT_FRACTIONS))


def split_sql(group: str) -> str:
    u = (f"(('0x' || substr(sha256('{K.SPLIT_SEED}:' || {group}), 1, 16))::UBIGINT::DOUBLE "
         "/ 18446744073709551616.0)")
    return (f"CASE WHEN {u} < 0.7 THEN 'train' WHEN {u} < {0.7 + 0.1!r} THEN 'calib' "
            "ELSE 'test' END")


SQL_EXAMPLES = f"""
ex0 AS (SELECT doc_id, 'doc-' || lpad(doc_id::VARCHAR, greatest(8, length(doc_id::VARCHAR))::INTEGER, '0') AS id,
  'thread:' || (doc_id // 4)::VARCHAR AS grp, lang AS label, source AS company, text
  FROM documents),
ex AS (SELECT *, {split_sql('grp')} AS split FROM ex0)"""


def sql_norm(x: str) -> str:
    """SQL twin of normalize_text (no look-around in RE2: apostrophes in two passes)."""
    s = f"translate({x}, '’‘ʼ`', '''''''''')"
    s = f"regexp_replace(lower({s}), '[^\\p{{L}}\\p{{N}}\\p{{M}}'']+', ' ', 'g')"
    s = f"regexp_replace({s}, '(^|[^\\p{{L}}\\p{{N}}])''+', '\\1 ', 'g')"
    s = f"regexp_replace({s}, '''+([^\\p{{L}}\\p{{N}}]|$)', ' \\1', 'g')"
    return f"trim(regexp_replace({s}, ' +', ' ', 'g'))"


def sql_words(norm: str) -> str:
    return f"(CASE WHEN {norm} = '' THEN []::VARCHAR[] ELSE string_split({norm}, ' ') END)"


def sql_clean(x: str) -> str:
    s = f"regexp_replace({x}, '<<[^<>]*>>', ' ', 'g')"
    s = f"regexp_replace({s}, '<[^<>]*>', ' ', 'g')"
    s = f"regexp_replace({s}, '\\{{[FDCEA]\\s', ' ', 'g')"
    s = f"regexp_replace({s}, '-/|--|/|#|\\(\\(|\\)\\)|[\\[\\]{{}}+]', ' ', 'g')"
    s = f"regexp_replace({s}, '(^|\\s)-(\\s|$)', ' ', 'g')"
    s = f"regexp_replace({s}, '\\s+([,.?!])', '\\1', 'g')"
    s = f"regexp_replace({s}, '(^|\\s)[,.]+(\\s|$)', ' ', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


PRED_K = 10


def predictions(spark: SparkSession, sf: str, model: str = "a", decision: str = "route10"
                ) -> DataFrame:
    """(model, decision, id, split, logits, y, hard) from embeddings.

    route10: ten classes, the last plays out_of_scope. turn_complete: two classes (label parity).
    barge_in: three classes (label mod 3). Model b reads other entries and a weaker signal.
    """
    shift, boost = (0, 3.0) if model == "a" else (10, 1.5)
    k = {"route10": 10, "turn_complete": 2, "barge_in": 3}[decision]
    e = table(spark, sf, "embeddings")
    y = (F.col("label") % k).cast("int")
    logits = F.array(*[
        F.get("embedding", F.lit(shift + i)).cast("double") * 10.0 + F.when(
            (y == i) & (F.col("vec_id") % 10 < 7), boost).otherwise(0.0) for i in range(k)])
    idc = F.concat(F.lit("vec-"), T.padded(F.col("vec_id"), 8))
    return e.select(
        F.lit(model).alias("model"), F.lit(decision).alias("decision"), idc.alias("id"),
        H.assign_split(idc, K.SPLIT_SEED, K.SPLIT_FRACTIONS).alias("split"),
        logits.alias("logits"), y.alias("y"), (F.col("vec_id") % 3 == 0).alias("hard"))


def sql_predictions(model: str = "a", decision: str = "route10", name: str = "pred") -> str:
    shift, boost = (0, 3.0) if model == "a" else (10, 1.5)
    k = {"route10": 10, "turn_complete": 2, "barge_in": 3}[decision]
    vid = "'vec-' || lpad(vec_id::VARCHAR, greatest(8, length(vec_id::VARCHAR))::INTEGER, '0')"
    return f"""
{name} AS (SELECT {vid} AS id, {split_sql('(' + vid + ')')} AS split, label % {k} AS y,
  vec_id % 3 = 0 AS hard,
  list_transform(range({k}), lambda i: embedding[i + 1 + {shift}]::DOUBLE * 10.0
    + CASE WHEN i = label % {k} AND vec_id % 10 < 7 THEN {boost} ELSE 0.0 END) AS logits
  FROM embeddings)"""


def sql_softmax(z: str, t: str = "1.0") -> str:
    e = f"list_transform({z}, lambda x: exp(x / {t} - list_max({z}) / {t}))"
    return f"list_transform({e}, lambda x: x / list_sum({e}))"


def sql_scored(model="a", decision="route10", name="s", t="1.0") -> str:
    """CTEs giving `name`(id, split, y, hard, logits, p, pred, conf)."""
    return sql_predictions(model, decision, name + "0") + f""",
{name}1 AS (SELECT *, {sql_softmax('logits', t)} AS p FROM {name}0),
{name} AS (SELECT *, list_position(p, list_max(p)) - 1 AS pred, list_max(p) AS conf
  FROM {name}1)"""


# -- messages -------------------------------------------------------------------------------------

def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Reply forest from documents: (id, author, inbound, text, parent_id)."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    brands = F.array(*[F.lit(b) for b in K.BANK_BRANDS])
    brand = F.element_at(brands, (F.floor(i / 4) % 8 + 1).cast("int"))
    author = F.when(i % 4 == 3, brand).otherwise(F.concat(F.lit("u"), (i % 50).cast("string")))
    parent = F.when((i > 0) & (i % 13 != 0), F.floor(i / 2))
    return d.select(i.alias("id"), author.alias("author"), (i % 4 != 3).alias("inbound"),
                    F.col("text"),
                    parent.alias("parent_id"))


SQL_MESSAGES = """
msg AS (SELECT doc_id AS id,
  CASE WHEN doc_id % 4 = 3 THEN ['BofA_Help','AskAmex','AskPayPal','ChaseSupport','Ask_WellsFargo',
    'AskCiti','askvisa','KeyBank_Help'][(doc_id // 4) % 8 + 1]
    ELSE 'u' || (doc_id % 50)::VARCHAR END AS author,
  doc_id % 4 <> 3 AS inbound, text,
  CASE WHEN doc_id > 0 AND doc_id % 13 <> 0 THEN doc_id // 2 END AS parent_id FROM documents)"""


# -- calls ----------------------------------------------------------------------------------------

CALL_DAYS, CALL_SCALE = 5, 20_000
CALL_CHUNK_MS = 500


def segments(spark: SparkSession, sf: str, clip: bool = True) -> DataFrame:
    """Call timelines from events: (call_id, seg, who, at_ms, dur_ms, end_ms, text).

    A call is five days of one user's events on a compressed clock. With `clip` a speaker's line
    ends where the same speaker's next line starts; of lines that start in the same millisecond,
    all but the last are empty. Lines are ordered and numbered in chunks of the call's clock.
    """
    e = table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)
    day5 = F.floor(us / (86_400_000_000 * CALL_DAYS))
    e = e.select(
        "event_id", (F.col("user_id") * 100 + day5).alias("call_id"),
        F.floor((us - day5 * 86_400_000_000 * CALL_DAYS) / 1000 / CALL_SCALE).alias("at_ms"),
        F.when(F.col("event_id") % 2 == 0, "user").otherwise("agent").alias("who"),
        (F.lit(600) + F.floor(F.col("value") * 20)).alias("dur_ms"), "event_type")
    # a scan reads its rows twice, so one after another would read them four times: both speakers' next lines come with the numbers
    speakers = ("user", "agent") if clip else ()
    one = chunk_scan(e, ["call_id"], ["at_ms", "event_id"], CALL_CHUNK_MS, cumsum={"_nth": F.lit(1).cast("bigint")},
                     next_after={f"_{who}": F.when(F.col("who") == who, F.col("at_ms")) for who in speakers})
    if clip:
        following = F.when(F.col("who") == "user", F.col("_user")).otherwise(F.col("_agent"))
        one = one.withColumn("dur_ms", F.least("dur_ms", following - F.col("at_ms")))
    n = (2 + F.col("event_id") % 7).cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        F.col("event_type"), i.cast("string"))), " ")
    return one.select(
        "call_id", (F.col("_nth") - 1).cast("int").alias("seg"), "who", "at_ms", "dur_ms",
        (F.col("at_ms") + F.col("dur_ms")).alias("end_ms"), text.alias("text"), "event_id")


def sql_segments(clip: bool = True) -> str:
    dur = ("least(dur_ms, lead(at_ms) OVER (PARTITION BY call_id, who ORDER BY at_ms, event_id) - at_ms)"
           if clip else "dur_ms")
    win = 86_400_000_000 * CALL_DAYS
    return f"""
e0 AS (SELECT event_id, user_id, epoch_us(ts) - 1704067200000000 AS us, value, event_type FROM events),
e1 AS (SELECT event_id, user_id * 100 + us // {win} AS call_id, event_type,
  floor((us - (us // {win}) * {win}) / 1000.0 / {CALL_SCALE})::BIGINT AS at_ms,
  CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'agent' END AS who,
  600 + floor(value * 20)::BIGINT AS dur_ms FROM e0),
e3 AS (SELECT * REPLACE ({dur} AS dur_ms) FROM e1),
seg AS (SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY at_ms, event_id) - 1 AS seg,
  who, at_ms, dur_ms, at_ms + dur_ms AS end_ms,
  array_to_string(list_transform(range(1, 3 + event_id % 7), lambda i: event_type || i::VARCHAR), ' ') AS text,
  event_id FROM e3)"""


def event_probs(seg: DataFrame) -> DataFrame:
    """Probabilities for every user segment, as a model's answers would be: keyed by the segment."""
    h = H.keyed_md5("probs", F.col("event_id"))
    u = [F.round(H.hex_int(h, 1 + 4 * i, 4) / 65536.0, 4) for i in range(6)]
    b = [x + 0.01 for x in (u[0], u[1], u[2])]
    total = b[0] + b[1] + b[2]
    return seg.where("who = 'user'").select(
        "call_id", "seg",
        F.array(*[x / total for x in b]).alias("p_barge"),
        u[3].alias("p_complete"), u[4].alias("p_escalate"),
        F.array(u[5] * 0.6, (1 - u[5]) * 0.6, F.lit(0.1), u[0] * 0.3,
                0.3 - u[0] * 0.3).alias("p_route"))


ROUTE5 = ("transfer", "balance", "pay_bill", "routing", "out_of_scope")


def sql_event_probs() -> str:
    h = "md5('probs:' || event_id::VARCHAR)"
    u = [f"round(('0x' || substr({h}, {1 + 4 * i}, 4))::INT / 65536.0::DOUBLE, 4)"
         for i in range(6)]
    return f"""
q0 AS (SELECT call_id, seg, {', '.join(f'{x} AS u{i}' for i, x in enumerate(u))}
  FROM seg WHERE who = 'user'),
q1 AS (SELECT *, u0 + 0.01::DOUBLE AS b0, u1 + 0.01::DOUBLE AS b1, u2 + 0.01::DOUBLE AS b2 FROM q0),
probs AS (SELECT call_id, seg, [b0/(b0+b1+b2), b1/(b0+b1+b2), b2/(b0+b1+b2)] AS p_barge,
  u3 AS p_complete, u4 AS p_escalate,
  [u5*0.6::DOUBLE, (1-u5)*0.6::DOUBLE, 0.1::DOUBLE, u0*0.3::DOUBLE, 0.3::DOUBLE-u0*0.3::DOUBLE] AS p_route
  FROM q1)"""
