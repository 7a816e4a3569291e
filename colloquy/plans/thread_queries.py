"""Reply threads, packing and noise over all documents and conversations."""
from pyspark.sql import functions as F

from colloquy import constants as K
from colloquy.functions import text as T
from colloquy.operators import noise as N, packing as P, threads as O
from colloquy.operators.scale import written
from colloquy.plans.registry import query
from colloquy.plans.text_queries import SQL_ENGLISH, sql_clean_message, sql_cue
from colloquy.sources import driver_tables as D

SQL_ROOTS = f"""{D.SQL_MESSAGES},
par AS (SELECT m.id, CASE WHEN p.id IS NOT NULL THEN m.parent_id END AS parent_id FROM msg m LEFT JOIN msg p ON p.id = m.parent_id),
walk AS (SELECT id, id AS cur, 0 AS d FROM par UNION ALL SELECT w.id, p.parent_id, w.d + 1 FROM walk w JOIN par p ON p.id = w.cur WHERE p.parent_id IS NOT NULL),
roots AS (SELECT id, arg_max(cur, d) AS root FROM walk GROUP BY 1)"""


@query("thread_roots", f"WITH RECURSIVE {SQL_ROOTS} SELECT id, root FROM roots")
def thread_roots(spark, sf):
    return O.thread_roots(D.messages(spark, sf))


BRANDS = "(" + ",".join(f"'{b}'" for b in K.BANK_BRANDS) + ")"
SQL_BRAND = f"""{SQL_ROOTS}, brand AS (SELECT root, arg_min(author, id) AS brand FROM msg JOIN roots USING (id) WHERE author IN {BRANDS} GROUP BY 1)"""


@query("thread_brand", f"WITH RECURSIVE {SQL_BRAND} SELECT root, brand FROM brand")
def thread_brand(spark, sf):
    m = D.messages(spark, sf)
    return O.thread_brand(m, O.thread_roots(m))


CLEAN_U, CLEAN_A = sql_clean_message("text", "FALSE"), sql_clean_message("text", "TRUE")


def sql_context(points: str) -> str:
    return f"""
an0 AS (SELECT w.id AS cid, w.d, m.inbound, CASE WHEN m.inbound THEN {CLEAN_U} ELSE {CLEAN_A} END AS t FROM walk w JOIN {points} p USING (id) JOIN msg m ON m.id = w.cur WHERE w.d BETWEEN 1 AND 32),
an1 AS (SELECT *, coalesce(lag(inbound) OVER w <> inbound, TRUE)::INT AS nw FROM an0 WHERE t <> '' WINDOW w AS (PARTITION BY cid ORDER BY d DESC)),
an2 AS (SELECT *, sum(nw) OVER (PARTITION BY cid ORDER BY d DESC ROWS UNBOUNDED PRECEDING) AS g FROM an1),
an3 AS (SELECT cid, g, any_value(inbound) AS inbound, string_agg(t, ' ' ORDER BY d DESC) AS t FROM an2 GROUP BY 1, 2),
an4 AS (SELECT *, max(g) OVER (PARTITION BY cid) AS top, arg_max(inbound, g) OVER (PARTITION BY cid) AS last_in FROM an3),
an5 AS (SELECT *, CASE WHEN last_in THEN top ELSE top - 1 END AS rest FROM an4),
ctx AS (SELECT cid AS id, coalesce(max(t) FILTER (NOT last_in AND g = top), '') AS agent_last,
  coalesce(string_agg(CASE WHEN inbound THEN 'user:' ELSE 'agent:' END || t, ' | ' ORDER BY g) FILTER (g <= rest AND g > rest - 8), '') AS recent FROM an5 GROUP BY 1)"""


def flat(c):
    return F.array_join(F.transform(c, lambda t: F.concat_ws(":", t["speaker"], t["text"])), " | ")


@query("ancestor_context", f"""WITH RECURSIVE {SQL_ROOTS}, pts AS (SELECT id FROM msg WHERE inbound), {sql_context('pts')}
SELECT id, coalesce(agent_last, '') AS agent_last, coalesce(recent, '') AS recent FROM pts LEFT JOIN ctx USING (id)""")
def ancestor_context(spark, sf):
    m = D.messages(spark, sf)
    return O.ancestor_context(m.where("inbound").select("id"), m).select("id", "agent_last", flat("recent_turns").alias("recent"))


@query("message_candidates", f"""WITH RECURSIVE {SQL_BRAND}, c0 AS (SELECT id, {CLEAN_U} AS text FROM msg WHERE inbound),
c1 AS (SELECT *, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM c0 WHERE len(string_split(text, ' ')) BETWEEN 3 AND 60 AND text <> ''),
pts AS (SELECT id, text AS user_partial, root, brand FROM c1 JOIN roots USING (id) JOIN brand USING (root) WHERE {SQL_ENGLISH}), {sql_context('pts')}
SELECT id, user_partial, 'msg:' || root::VARCHAR AS "group", {D.split_sql("'msg:' || root::VARCHAR")} AS split, brand AS company, {sql_cue('user_partial')} AS cue,
 CASE WHEN {sql_cue('user_partial')} THEN 'cue' ELSE 'plain' END || '/' || CASE WHEN coalesce(agent_last, '') <> '' THEN 'reply' ELSE 'opener' END AS stratum,
 coalesce(agent_last, '') AS agent_last, coalesce(recent, '') AS recent FROM pts LEFT JOIN ctx USING (id)""")
def message_candidates(spark, sf):
    c = O.message_candidates(D.messages(spark, sf))
    return c.select("id", "user_partial", "group", "split", "company", "cue", "stratum", "agent_last", flat("recent_turns").alias("recent"))


INTENTS = ("transfer", "balance", "pay_bill")
_ARR = "['transfer','balance','pay_bill','travel','out_of_scope']"


@query("intent_examples", f"""WITH a AS (SELECT doc_id, text, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'calib' ELSE 'test' END AS split,
 {_ARR}[doc_id % 5 + 1] AS intent FROM documents), a1 AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1)::VARCHAR AS place FROM a WHERE intent <> 'travel'),
b AS (SELECT 'intent-' || split || '-' || lpad(place, greatest(5, length(place))::INTEGER, '0') AS id, split, {D.sql_norm('text')} AS n, intent AS label,
 CASE WHEN intent = 'out_of_scope' THEN 'oos' ELSE 'in_scope' END AS kind FROM a1)
SELECT id, split, label, kind, ['how can i help you today','what can i do for you','is there anything else i can help you with','sure what do you need',''][
 (('0x' || substr(sha256(id), 1, 8))::BIGINT % 5) + 1] AS agent_last FROM b WHERE split = 'train' OR n NOT IN (SELECT n FROM b WHERE split = 'train')""")
def intent_examples(spark, sf):
    i = F.col("doc_id")
    names = F.array(*[F.lit(x) for x in (*INTENTS, "travel", "out_of_scope")])
    r = D.table(spark, sf, "documents").select(
        F.when(i % 10 < 7, "train").when(i % 10 == 7, "calib").otherwise("test").alias("split"), i.alias("n"), "text",
        F.get(names, (i % 5).cast("int")).alias("intent"))
    return O.intent_examples(r, INTENTS).drop("text")


# -- packing --------------------------------------------------------------------------------------

def snapshots(spark, sf):
    """Messages with the previous one as the agent's and the three before as history."""
    c = D.table(spark, sf, "conversations")
    out = c.select("conv_id", "turn", F.col("text").alias("user_partial"))
    for k in range(1, 5):
        prev = c.select("conv_id", (F.col("turn") + k).alias("turn"), F.struct(
            F.when(F.col("role") == "user", "user").otherwise("agent").alias("speaker"), "text").alias(f"t{k}"))
        out = out.join(prev, ["conv_id", "turn"], "left")
    return out.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("turn") % 2 == 0, "turn_complete").otherwise("barge_in").alias("decision"),
        (F.col("turn") % 3 == 0).alias("agent_speaking"), "user_partial", F.coalesce("t1.text", F.lit("")).alias("agent_last"),
        F.array_compact(F.array("t4", "t3", "t2")).alias("recent_turns"))


BUDGET = 900
SQL_SNAPS = f"""
s0 AS (SELECT *, CASE WHEN role = 'user' THEN 'user' ELSE 'agent' END AS sp, {D.sql_norm('text')} AS n FROM conversations),
s1 AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS id, CASE WHEN turn % 2 = 0 THEN 'turn_complete' ELSE 'barge_in' END AS decision, turn % 3 = 0 AS speaking,
  text, {D.sql_words('n')} AS uw, coalesce({D.sql_words('lag(n, 1) OVER w')}, []) AS aw,
  list_filter([{{'s': lag(sp, 4) OVER w, 't': lag(n, 4) OVER w}}, {{'s': lag(sp, 3) OVER w, 't': lag(n, 3) OVER w}}, {{'s': lag(sp, 2) OVER w, 't': lag(n, 2) OVER w}}],
   lambda x: coalesce(x.t, '') <> '') AS turns FROM s0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def sql_tail(words: str, room: str) -> str:
    return (f"list_max(list_filter(range(0, len({words}) + 1), lambda k: length(array_to_string(list_slice({words}, len({words}) - k + 1, len({words})), ' ')) <= {room}))")


def sql_pack(budget: int, hist: str = "turns", agent: str = "aw") -> str:
    turn = "length(x.s) + length(x.t) + " + str(P.TURN_FRAME)
    return f"""
p1 AS (SELECT *, {len(P.EMPTY)} - speaking::INT AS base, {agent} AS pool, {hist} AS hist FROM s1),
p2 AS (SELECT *, {sql_tail('uw', f'{budget} - base')} AS ku FROM p1),
p3 AS (SELECT *, length(array_to_string(uw[len(uw) - ku + 1:len(uw)], ' ')) AS lu, CASE WHEN ku < len(uw) THEN []::VARCHAR[] ELSE pool END AS pa FROM p2),
p4 AS (SELECT *, {sql_tail('pa', f'{budget} - base - lu')} AS ka FROM p3),
p5 AS (SELECT *, length(array_to_string(pa[len(pa) - ka + 1:len(pa)], ' ')) AS la,
  CASE WHEN ku < len(uw) OR ka < len(pool) THEN list_filter(hist, lambda x: FALSE) ELSE hist END AS pt FROM p4),
p6 AS (SELECT *, list_max(list_filter(range(0, len(pt) + 1), lambda k: coalesce(list_sum(list_transform(list_slice(pt, len(pt) - k + 1, len(pt)), lambda x: {turn})), 0)
   + 2 * greatest(k - 1, 0) <= {budget} - base - lu - la)) AS kt FROM p5),
pk AS (SELECT id, decision, kt AS turns_kept, len(turns) - kt AS turns_dropped, len(aw) - ka AS agent_words_dropped, len(uw) - ku AS user_words_dropped,
  (base + lu + la + coalesce(list_sum(list_transform(list_slice(pt, len(pt) - kt + 1, len(pt)), lambda x: {turn})), 0) + 2 * greatest(kt - 1, 0))::BIGINT AS size FROM p6)"""


@query("pack_state", f"WITH {SQL_SNAPS}, {sql_pack(BUDGET)} SELECT * FROM pk")
def pack_state(spark, sf):
    return P.pack_chars(snapshots(spark, sf), BUDGET).select("id", "decision", "turns_kept", "turns_dropped", "agent_words_dropped", "user_words_dropped", "size")


@query("pack_size_is_text_length")
def pack_size_is_text_length(spark, sf):
    """The additive size must equal the length of the serialized state; rows that differ."""
    p = P.pack_chars(snapshots(spark, sf), BUDGET)
    return p.where(F.length(T.serialize_state(F.col("state"))) != F.col("size")).select("id", "size")


@query("pack_stats", f"""WITH {SQL_SNAPS}, {sql_pack(BUDGET)} SELECT decision, count(*) AS n_rows, round(avg((turns_dropped > 0)::INT::DOUBLE), 6) AS share_turns_dropped,
 round(avg((agent_words_dropped > 0)::INT::DOUBLE), 6) AS share_agent_trimmed, round(avg((user_words_dropped > 0)::INT::DOUBLE), 6) AS share_user_trimmed,
 round(avg(turns_kept::DOUBLE), 6) AS mean_turns_kept, {', '.join(f"round(quantile_cont(size::DOUBLE, {q}), 6) AS {n}" for q, n in ((0.5, 'p50'), (0.9, 'p90'), (0.99, 'p99'), (1.0, 'p100')))}
FROM pk GROUP BY 1""")
def pack_stats(spark, sf):
    s = P.pack_stats(P.pack_chars(snapshots(spark, sf), BUDGET))
    return s.select("decision", "n_rows", *[F.round(c, 6).alias(c) for c in s.columns if c not in ("decision", "n_rows")])


@query("state_overflow", f"WITH {SQL_SNAPS}, {sql_pack(BUDGET)} SELECT id, size FROM pk WHERE size > CASE decision WHEN 'turn_complete' THEN 842 ELSE 692 END")
def state_overflow(spark, sf):
    rooms = spark.createDataFrame([("turn_complete", "route", 850), ("turn_complete", "escalate", 900), ("barge_in", "barge_in", 700)],
                                  "event string, decision string, room int")
    p = P.pack_chars(snapshots(spark, sf), BUDGET).withColumnRenamed("decision", "event")
    return P.state_overflow(p, rooms).select("id", "size")


@query("ablation_variants", f"""WITH {SQL_SNAPS}, v AS (SELECT unnest(['full','no_history','no_agent','no_normalize']) AS variant)
SELECT id, variant, CASE WHEN variant = 'no_history' THEN 0 ELSE len(turns) END AS n_turns, CASE WHEN variant = 'no_agent' THEN TRUE ELSE len(aw) = 0 END AS agent_empty,
 variant <> 'no_normalize' AS normalize FROM s1, v""")
def ablation_variants(spark, sf):
    a = P.ablation_variants(snapshots(spark, sf))
    kept = F.filter("recent_turns", lambda t: T.normalize_text(t["text"]) != "")
    return a.select("id", "variant", F.size(kept).alias("n_turns"), (T.normalize_text(F.col("agent_last")) == "").alias("agent_empty"), "normalize")


# -- noise ----------------------------------------------------------------------------------------

SQL_VOCAB = f"""{D.SQL_EXAMPLES}, vw AS (SELECT unnest({D.sql_words(D.sql_norm('text'))}) AS word FROM ex WHERE split = 'train'),
vc AS (SELECT word, count(*) AS n FROM vw GROUP BY 1 ORDER BY n DESC, word LIMIT {K.NOISE_VOCAB}), vl AS (SELECT list(word ORDER BY n DESC, word) AS v FROM vc)"""


@query("top_vocab", f"WITH {SQL_VOCAB} SELECT word, n FROM vc")
def top_vocab(spark, sf):
    return N.top_vocab(D.examples(spark, sf).where("split = 'train'"), K.NOISE_VOCAB)


def sql_noise(words: str, rid: str, level: str, field: str) -> str:
    key = f"'{K.SPLIT_SEED}:' || {rid} || ':' || {level}::VARCHAR || ':' || {field} || ':'"
    h = f"md5({key} || (i - 1)::VARCHAR)"
    u = f"(('0x' || substr({h}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    pick = f"v[(('0x' || substr({h}, 9, 8))::BIGINT % len(v)) + 1]"
    kept = (f"list_filter(list_transform({words}, lambda w, i: CASE WHEN {u} < {level} / 2 THEN NULL WHEN {u} < {level} THEN {pick} ELSE w END), lambda w: w IS NOT NULL)")
    t = f"md5({key} || 'tail')"
    drop = (f"CASE WHEN len({kept}) > 0 AND ('0x' || substr({t}, 1, 8))::BIGINT / 4294967296.0::DOUBLE < {level} "
            f"THEN 1 + ('0x' || substr({t}, 9, 8))::BIGINT % greatest(least(2, len({kept})), 1) ELSE 0 END")
    return (f"CASE WHEN {level} <= 0 THEN array_to_string({words}, ' ') ELSE "
            f"array_to_string(list_slice({kept}, 1, len({kept}) - ({drop})), ' ') END")


SQL_CW = f"cw AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS id, {D.sql_words(D.sql_norm('text'))} AS w FROM conversations)"


@query("asr_noise", f"WITH {SQL_VOCAB}, {SQL_CW} SELECT id, {sql_noise('w', 'id', '0.2::DOUBLE', repr('user'))} AS noisy FROM cw, vl")
def asr_noise(spark, sf):
    from colloquy.operators.scale import attach_row

    c = D.table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    x = attach_row(c, N.vocab_row(N.top_vocab(D.examples(spark, sf).where("split = 'train'"), K.NOISE_VOCAB)))
    return x.select("id", N.asr_noise(F.col("text"), F.col("id"), F.lit(0.2), F.col("vocab"), K.SPLIT_SEED, "user").alias("noisy"))


@query("noisy_rows", f"""WITH {SQL_VOCAB}, c0 AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS id, role, {D.sql_words(D.sql_norm('text'))} AS w, text,
 lag(role) OVER o AS pr, lag(text) OVER o AS pt, lag({D.sql_words(D.sql_norm('text'))}) OVER o AS pw FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
lv AS (SELECT unnest([0.0::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE]) AS level)
SELECT id, level, {sql_noise('w', 'id', 'level', repr('user'))} AS user_partial,
 CASE WHEN pr IS NULL THEN '' WHEN pr = 'user' THEN 'user:' || {sql_noise('pw', 'id', 'level', repr('turn0'))} ELSE 'agent:' || pt END AS recent FROM c0, vl, lv""")
def noisy_rows(spark, sf):
    c = D.table(spark, sf, "conversations")
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.struct(
        F.when(F.col("role") == "user", "user").otherwise("agent").alias("speaker"), "text").alias("p"))
    e = c.join(prev, ["conv_id", "turn"], "left").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("user_partial"), F.array_compact(F.array("p")).alias("recent_turns"))
    n = N.noisy_rows(e, N.top_vocab(D.examples(spark, sf).where("split = 'train'"), K.NOISE_VOCAB))
    return n.select("id", "level", "user_partial", flat("recent_turns").alias("recent"))
