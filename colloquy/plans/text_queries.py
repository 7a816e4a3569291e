"""Text functions over whole tables."""
from pyspark.sql import functions as F

from colloquy import constants as K
from colloquy.functions import hashing as H, probs as P, text as T
from colloquy.plans.registry import query
from colloquy.sources import driver_tables as D

W = "[\\p{L}\\p{N}_]"


@query("normalize_text", f"SELECT doc_id, {D.sql_norm('text')} AS norm FROM documents")
def normalize_text(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", T.normalize_any(F.col("text")
                                                                             ).alias("norm"))


@query("clean_transcript", f"""WITH {D.SQL_UTTERANCES},
a AS (SELECT 'u' || conv_id::VARCHAR || '-' || idx::VARCHAR AS id, raw AS t FROM utt
 UNION ALL SELECT 'd' || doc_id::VARCHAR, '<<note>> {{F ' || text || ' , -- done / ' FROM documents)
SELECT id, {D.sql_clean('t')} AS clean FROM a""")
def clean_transcript(spark, sf):
    u = D.utterances(spark, sf).select(F.concat(F.lit("u"), F.col("conv_id"), F.lit("-"),
                                                F.col("idx")).alias("id"), F.col("raw").alias("t"))
    d = D.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("id"),
        F.concat(F.lit("<<note>> {F "), "text", F.lit(" , -- done / ")).alias("t"))
    return u.unionAll(d).select("id", T.clean_transcript(F.col("t")).alias("clean"))


def sql_clean_message(x: str, agent: str) -> str:
    s = x
    for name, char in T._ENTITIES:
        s = f"replace({s}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    s = f"replace({s}, '&amp', '&')"  # the one form without a semicolon that the tables hold
    s = f"regexp_replace({s}, 'https?://\\S+', ' ', 'g')"
    s = f"regexp_replace({s}, '@{W}+', ' ', 'g')"
    s = f"trim(regexp_replace(regexp_replace({s}, '__{W}+__', ' ', 'g'), '\\s+', ' ', 'g'))"
    return (f"trim(CASE WHEN {agent} THEN regexp_replace({s}, "
            f"'\\s[\\^*~]\\s?[A-Za-z]{{1,12}}\\s*$', '') ELSE {s} END)")


@query("clean_message", f"""
WITH a AS (SELECT page_id, page_id % 2 = 0 AS agent,
  '@bank_1 ' || html || ' __email__ ' || url || ' thanks ^Mia' AS t FROM pages)
SELECT page_id, {sql_clean_message('t', 'agent')} AS clean FROM a""")
def clean_message(spark, sf):
    p = D.table(spark, sf, "pages")
    t = F.concat(F.lit("@bank_1 "), "html", F.lit(" __email__ "), "url", F.lit(" thanks ^Mia"))
    return p.select("page_id", T.clean_message(t, F.col("page_id") % 2 == 0).alias("clean"))


def sql_act(x: str) -> str:
    tag = f"regexp_split_to_array({x}, '\\s*[,;]\\s*')[1]"
    base = f"regexp_replace(regexp_replace({tag}, '(.)\\^.*', '\\1'), '[()@*]', '', 'g')"
    merged = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.MERGED_TAGS.items())
    return (f"CASE WHEN {tag} IN ('qy^d','qw^d','b^m') THEN {tag} WHEN {tag} = 'nn^e' THEN 'ng' "
            f"WHEN {tag} = 'ny^e' THEN 'na' ELSE CASE {base} {merged} ELSE {base} END END")


def sql_minor(act: str, norm: str) -> str:
    return (f"({act} IN ('b','bh','x','%') OR ({act} IN ('aa','bk','ba','na','ny','b^m') AND "
            f"len({D.sql_words(norm)}) <= 3))")


SQL_MARKED = f"""{D.SQL_UTTERANCES},
utt1 AS (SELECT *, {sql_act('act_tag')} AS act, {D.sql_clean('raw')} AS text FROM utt),
utt2 AS (SELECT *, {D.sql_norm('text')} AS norm FROM utt1),
utt3 AS (SELECT *, {sql_minor('act', 'norm')} AS minor, rtrim(raw) LIKE '%/'
   AND rtrim(raw) NOT LIKE '%-/' AS ends_unit, rtrim(raw) LIKE '%-/' AS abandoned FROM utt2),
um AS (SELECT *, NOT minor AND norm <> '' AS claims FROM utt3)"""

TAG_FORMS = ("sd", "sd^e", "nn^e", "ny^e", "qy^d", "b^m", "fo", "aap", "sv,b", "qw ; x", "(sd@*)",
             "\"", "fc^t", "+", "oo(^q)")


@query("act_class", f"""WITH a AS (SELECT o_orderkey,
 {list(TAG_FORMS)}[(o_orderkey % {len(TAG_FORMS)}) + 1] AS tag FROM orders)
SELECT o_orderkey, {sql_act('tag')} AS act FROM a""".replace("'\"'", "'\"'"))
def act_class(spark, sf):
    tags = F.array(*[F.lit(t) for t in TAG_FORMS])
    tag = F.element_at(tags, (F.col("o_orderkey") % len(TAG_FORMS) + 1).cast("int"))
    return D.table(spark, sf, "orders").select("o_orderkey", T.act_class(tag).alias("act"))


def marked_utterances(spark, sf):
    """Utterances with act, text, norm and the floor flags."""
    u = D.utterances(spark, sf).withColumn("act", T.act_class(F.col("act_tag"))).withColumn(
        "text", T.clean_transcript(F.col("raw")))
    return mark(u)


def mark(u):
    u = u.withColumn("norm", T.normalize_text(F.col("text")))
    u = u.withColumn("minor", T.is_minor(F.col("act"), F.col("norm")))
    return u.withColumn("ends_unit", T.ends_unit(F.col("raw"))).withColumn(
        "abandoned", T.abandoned(F.col("raw"))).withColumn(
        "claims", T.claims_floor(F.col("minor"), F.col("norm")))


@query("is_minor", f"WITH {SQL_MARKED} SELECT conv_id, idx, act, minor FROM um")
def is_minor(spark, sf):
    return marked_utterances(spark, sf).select("conv_id", "idx", "act", "minor")


@query("floor_flags", f"WITH {SQL_MARKED} SELECT conv_id, idx, ends_unit, claims FROM um")
def floor_flags(spark, sf):
    return marked_utterances(spark, sf).select("conv_id", "idx", "ends_unit", "claims")


def _in(words):
    return "[" + ",".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"


SQL_ENGLISH = f"""CASE WHEN text = '' THEN FALSE ELSE
 length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text)::DOUBLE > 0.97
 AND len(list_filter(w, lambda x: list_contains({_in(K.ENGLISH_WORDS)}, x))) >= 1
 AND len(list_filter(w, lambda x: list_contains({_in(K.ENGLISH_WORDS)}, x)))
   > len(list_filter(w, lambda x: list_contains({_in(K.OTHER_LANGUAGE_WORDS)}, x))) END"""


@query("looks_english", f"""WITH a AS (SELECT doc_id, text,
 regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents)
SELECT doc_id, {SQL_ENGLISH} AS english FROM a""")
def looks_english(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", T.looks_english(F.col("text")
                                                                            ).alias("english"))


def sql_cue(x: str) -> str:
    body = K.ESCALATION_CUES.removeprefix(r"\b").removesuffix(r"\b|!!").replace(r"\w*", W + "*")
    return f"regexp_matches({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){body}([^\\p{{L}}\\p{{N}}_]|$)|!!')"


@query("cue_flag", f"SELECT doc_id, {sql_cue('text')} AS cue FROM documents")
def cue_flag(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", T.cue_flag(F.col("text")).alias("cue"))


@query("last_word", f"""WITH {SQL_MARKED} SELECT conv_id, idx,
 string_split(norm, ' ')[-1] AS last_word, norm = 'the' OR starts_with(norm, 'the ') AS opens FROM um""")
def last_word(spark, sf):
    u = marked_utterances(spark, sf)
    return u.select("conv_id", "idx", T.last_word(F.col("norm")).alias("last_word"),
                    T.opens_with(F.col("norm"), F.lit("the")).alias("opens"))


@query("first_words", """SELECT doc_id, array_to_string(string_split(trim(regexp_replace(text,
 '\\s+', ' ', 'g')), ' ')[1:12], ' ') AS opening FROM documents""")
def first_words(spark, sf):
    return D.table(spark, sf, "documents").select(
        "doc_id", T.first_words(F.col("text"), 12).alias("opening"))


SQL_FEATURES = f"""
cv AS (SELECT conv_id, turn, {D.sql_norm('text')} AS u,
  coalesce(lag({D.sql_norm('text')}) OVER (PARTITION BY conv_id ORDER BY turn), '') AS c
  FROM conversations),
cw AS (SELECT conv_id, turn, {D.sql_words('u')} AS uw, {D.sql_words('c')} AS cw FROM cv),
ft AS (SELECT conv_id, turn, list_concat(list_concat(uw,
   list_transform(range(1, greatest(len(uw), 1)), lambda i: uw[i] || ' ' || uw[i + 1])),
   list_transform(cw, lambda x: 'ctx:' || x)) AS f FROM cw)"""


def feature_rows(spark, sf):
    """(conv_id, turn, f): features of each message with the previous message as context."""
    c = D.table(spark, sf, "conversations").select("conv_id", "turn", T.normalize_any(
        F.col("text")).alias("u"))
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("u").alias("c"))
    j = c.join(prev, ["conv_id", "turn"], "left")   # turns are dense: an equality, not a window
    return j.select("conv_id", "turn", T.ngram_features(F.col("u"), F.coalesce("c", F.lit(""))
                                                        ).alias("f"))


@query("ngram_features", f"""WITH {SQL_FEATURES}
SELECT conv_id, turn, len(f) AS n, f[1] AS first, f[-1] AS last, md5(array_to_string(f, '|')) AS all_terms
FROM ft""")
def ngram_features(spark, sf):
    f = feature_rows(spark, sf)
    return f.select("conv_id", "turn", F.size("f").cast("bigint").alias("n"), F.get("f", F.lit(0)).alias(
        "first"), F.try_element_at("f", F.lit(-1)).alias("last"),
        F.md5(F.array_join("f", "|")).alias("all_terms"))


SQL_BRANCH = f"""CASE WHEN len(list_filter(w, lambda x: NOT list_contains({_in(K.FILLER_WORDS)}, x))) = 0
 THEN 'empty_or_filler' WHEN len(w) <= 3 AND len(list_filter(w,
 lambda x: NOT list_contains({_in(K.BACKCHANNEL_WORDS)}, x))) = 0 THEN 'backchannel_words' ELSE 'other' END"""


def spoken_types(col):
    """Event types read as short spoken answers, so that every branch occurs."""
    return (F.when(col == "view", "Yeah, right.").when(col == "click", "Um - uh...")
            .when(col == "error", "That is not what I asked").when(col == "signup", "...")
            .otherwise("okay"))


SQL_SPOKEN = """CASE event_type WHEN 'view' THEN 'Yeah, right.' WHEN 'click' THEN 'Um - uh...'
 WHEN 'error' THEN 'That is not what I asked' WHEN 'signup' THEN '...' ELSE 'okay' END"""


@query("lexical_branch", f"""WITH a AS (SELECT event_id, {D.sql_norm(f'({SQL_SPOKEN})')} AS n FROM events),
b AS (SELECT event_id, {D.sql_words('n')} AS w FROM a) SELECT event_id, {SQL_BRANCH} AS branch FROM b""")
def lexical_branch(spark, sf):
    n = T.normalize_text(spoken_types(F.col("event_type")))
    return D.table(spark, sf, "events").select("event_id", T.lexical_branch(n).alias("branch"))


@query("serialize_state", """SELECT conv_id, turn, '{"agent_speaking": false, "recent_turns": [{"speaker": "user", "text": "'
 || role || '"}], "agent_last_utterance": "", "user_partial": ' || to_json(text) || '}' AS state
FROM conversations""")
def serialize_state(spark, sf):
    c = D.table(spark, sf, "conversations")
    s = F.struct(
        F.lit(False).alias("agent_speaking"), F.array(F.struct(F.lit("user").alias("speaker"),
                                                              F.col("role").alias("text"))
                                                      ).alias("recent_turns"),
        F.lit("").alias("agent_last_utterance"), F.col("text").alias("user_partial"))
    return c.withColumn("s", s).select("conv_id", "turn", T.serialize_state(F.col("s")).alias("state"))


@query("opener_pick", f"""SELECT doc_id, {_in(K.AGENT_OPENERS)}[((('0x' || substr(
 sha256('row-' || doc_id::VARCHAR), 1, 8))::BIGINT) % 5) + 1] AS opener FROM documents""")
def opener_pick(spark, sf):
    rid = F.concat(F.lit("row-"), F.col("doc_id"))
    return D.table(spark, sf, "documents").select("doc_id", T.opener_pick(rid).alias("opener"))


@query("stratum", f"""SELECT doc_id, CASE WHEN {sql_cue('text')} THEN 'cue' ELSE 'plain' END || '/' ||
 CASE WHEN doc_id % 3 = 0 THEN 'opener' ELSE 'reply' END AS stratum FROM documents""")
def stratum(spark, sf):
    d = D.table(spark, sf, "documents")
    last = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    return d.select("doc_id", T.stratum(T.cue_flag(F.col("text")), last).alias("stratum"))


@query("softmax_t", f"""WITH {D.sql_predictions()}, a AS (SELECT id, {D.sql_softmax('logits', '1.7::DOUBLE')} AS p FROM pred)
SELECT id, i::INT AS class_idx, round(p[i + 1], 9) AS p FROM a, range(10) t(i)""")
def softmax_t(spark, sf):
    p = P.softmax(F.col("logits"), 1.7)
    return D.predictions(spark, sf).select("id", F.posexplode(p).alias("class_idx", "p")
                                           ).withColumn("p", F.round("p", 9))


@query("argmax_first", f"""WITH {D.sql_predictions()},
a AS (SELECT id, list_transform(logits, lambda x: round(x)) AS z FROM pred)
SELECT id, list_position(z, list_max(z)) - 1 AS top,
 list_position(list_transform(z, lambda x, i: CASE WHEN i <> 10 THEN x END), list_max(z[1:9])) - 1 AS in_scope FROM a""")
def argmax_first(spark, sf):
    z = F.transform("logits", lambda x: F.round(x))
    p = D.predictions(spark, sf).withColumn("z", z)
    return p.select("id", P.argmax_first(F.col("z")).alias("top"),
                    P.argmax_excluding(F.col("z"), 9).alias("in_scope"))


SQL_ANSWER = """'{"backchannel": ' || CASE WHEN event_id % 5 = 0 THEN '-0.2' ELSE round(value, 2)::VARCHAR END
 || ', "interruption": ' || CASE WHEN event_id % 7 = 0 THEN '"n/a"' ELSE '1.5' END || '}'"""


@query("stated_probs", """WITH a AS (SELECT event_id,
 CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE round(value, 2) END AS b,
 CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE 1.5 END AS i FROM events)
SELECT event_id, b + i > 0 AS valid, CASE WHEN b + i > 0 THEN round(b / (b + i), 9) ELSE round(1.0::DOUBLE / 3, 9) END AS p_b,
 CASE WHEN b + i > 0 THEN round(i / (b + i), 9) ELSE round(1.0::DOUBLE / 3, 9) END AS p_i,
 CASE WHEN b + i > 0 THEN 0.0 ELSE round(1.0::DOUBLE / 3, 9) END AS p_n FROM a""")
def stated_probs(spark, sf):
    e = D.table(spark, sf, "events")
    b = F.when(F.col("event_id") % 5 == 0, "-0.2").otherwise(F.round("value", 2).cast("string"))
    i = F.when(F.col("event_id") % 7 == 0, '"n/a"').otherwise("1.5")
    answer = F.concat(F.lit('{"backchannel": '), b, F.lit(', "interruption": '), i, F.lit("}"))
    p, ok = P.stated_probs(F.col("answer"), K.DECISION_LABELS["barge_in"])
    x = e.select("event_id", answer.alias("answer")).select("event_id", p.alias("p"), ok.alias("valid"))
    return x.select("event_id", "valid", *[F.round(F.get("p", F.lit(n)), 9).alias(c)
                                           for n, c in enumerate(("p_b", "p_i", "p_n"))])


@query("labeller_prompt", """WITH a AS (SELECT conv_id, turn, text, lag(text) OVER w AS p1, lag(role) OVER w AS r1,
 lag(text, 2) OVER w AS p2, lag(role, 2) OVER w AS r2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, 'Earlier turns:' || chr(10) || coalesce(CASE WHEN p2 IS NOT NULL THEN r2 || ': ' || p2 || chr(10) ELSE '' END
 || r1 || ': ' || p1, '(none)') || chr(10) || chr(10) || 'Agent''s last reply:' || chr(10) ||
 CASE WHEN turn % 2 = 0 THEN 'ok' ELSE '(none: the customer opened the thread)' END || chr(10) || chr(10)
 || 'Customer''s message:' || chr(10) || text AS prompt FROM a""")
def labeller_prompt(spark, sf):
    c = D.table(spark, sf, "conversations")
    # the two previous messages by equality on the dense turn number
    for k in (1, 2):
        prev = D.table(spark, sf, "conversations").select(
            "conv_id", (F.col("turn") + k).alias("turn"), F.struct(
                F.col("role").alias("speaker"), "text").alias(f"t{k}"))
        c = c.join(prev, ["conv_id", "turn"], "left")
    turns = F.array_compact(F.array("t2", "t1"))
    last = F.when(F.col("turn") % 2 == 0, "ok").otherwise("")
    return c.select("conv_id", "turn", T.labeller_prompt(turns, last, F.col("text")).alias("prompt"))


_Q = "\n\n".join(
    f'Question "{q}": {K.QUESTION_TEXT[q]}\nOptions:\n' + "\n".join(
        f"  - {a}: {b}" for a, b in zip(K.DECISION_LABELS[q], K.OPTION_TEXT[q]))
    for q in K.EVENT_QUESTIONS["user_speech_during_agent"]).replace("'", "''")


@query("baseline_prompt", f"""SELECT event_id, 'State:' || chr(10) || props || chr(10) || chr(10) || '{_Q}' AS prompt
FROM events""")
def baseline_prompt(spark, sf):
    return D.table(spark, sf, "events").select("event_id", T.baseline_prompt(
        F.col("props"), "user_speech_during_agent").alias("prompt"))


@query("smoothed_target", """SELECT vec_id, i::INT AS class_idx, round(0.01::DOUBLE +
 CASE WHEN i = label THEN 0.9::DOUBLE ELSE 0.0 END, 9) AS target FROM embeddings, range(10) t(i)""")
def smoothed_target(spark, sf):
    t = P.smoothed_target(F.col("label"), 10, 0.1)
    return D.table(spark, sf, "embeddings").select("vec_id", F.posexplode(t).alias(
        "class_idx", "target")).withColumn("target", F.round("target", 9))
