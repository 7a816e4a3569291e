"""Conversation operators over all conversations."""
from pyspark.sql import functions as F

from colloquy import constants as K
from colloquy.functions import hashing as H
from colloquy.operators import floor as O, lifecycle as L
from colloquy.operators.scale import written
from colloquy.plans.registry import query
from colloquy.plans.text_queries import SQL_MARKED, marked_utterances
from colloquy.sources import driver_tables as D

SQL_ANN = f"""{SQL_MARKED},
an0 AS (SELECT *, lag(caller) OVER w AS prev_caller, lead(caller) OVER w AS next_caller,
  last_value(CASE WHEN claims THEN caller END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_claimer,
  min(CASE WHEN claims THEN idx END) OVER (PARTITION BY conv_id ORDER BY idx
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_claim_idx,
  lead(idx) OVER o AS next_own_idx, lead(act) OVER o AS next_own_act
  FROM um WINDOW w AS (PARTITION BY conv_id ORDER BY idx), o AS (PARTITION BY conv_id, caller ORDER BY idx)),
an1 AS (SELECT *, (claims AND (prev_claimer IS NULL OR prev_claimer <> caller))::BIGINT AS new_turn FROM an0),
an2 AS (SELECT *, (sum((prev_caller IS NULL OR prev_caller <> caller)::BIGINT) OVER w)::BIGINT AS run_id,
  (sum(new_turn) OVER w)::BIGINT AS turn_no,
  CASE WHEN claims THEN caller ELSE prev_claimer END AS turn_caller
  FROM an1 WINDOW w AS (PARTITION BY conv_id ORDER BY idx)),
ann AS (SELECT a.*, turn_no - coalesce(turn_caller = caller, FALSE)::BIGINT AS stint, coalesce((SELECT max(x.idx) FROM um x
  WHERE x.conv_id = a.conv_id AND x.claims AND x.caller <> a.caller AND x.idx < a.idx), -1) AS anchor FROM an2 a),
turns AS (SELECT conv_id, turn_no, min(caller) AS caller, string_agg(text, ' ' ORDER BY idx) AS text,
  min(idx) AS first_idx, max(idx) AS last_idx FROM ann WHERE claims GROUP BY 1, 2)"""


def annotated(spark, sf):
    """Cleaned and annotated utterances, written once: every later step reads the stored table."""
    marked = written(marked_utterances(spark, sf).select(
        "conv_id", "idx", "caller", "act", "text", "claims", "ends_unit", "abandoned"))
    return written(O.annotate(marked, D.CHUNK_WIDTH))


def flat(turns):
    return F.array_join(F.transform(turns, lambda t: F.concat_ws(":", t["speaker"], t["text"])), " | ")


@query("speaker_runs", f"WITH {SQL_ANN} SELECT conv_id, idx, caller, run_id FROM ann")
def speaker_runs(spark, sf):
    return O.speaker_runs(marked_utterances(spark, sf), D.CHUNK_WIDTH).select(
        "conv_id", "idx", "caller", "run_id")


@query("floor_turns", f"WITH {SQL_ANN} SELECT * FROM turns")
def floor_turns(spark, sf):
    return O.floor_turns(annotated(spark, sf)).drop("parts")


@query("current_turn", f"""WITH {SQL_ANN} SELECT conv_id, idx, caller,
 coalesce(string_agg(CASE WHEN text <> '' THEN text END, ' ') OVER w, '') AS turn_text, min(idx) OVER w AS turn_start
 FROM ann WINDOW w AS (PARTITION BY conv_id, caller, anchor ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def current_turn(spark, sf):
    return O.current_turn(annotated(spark, sf)).select("conv_id", "idx", "caller", "turn_text",
                                                       "turn_start")


def sql_history(points: str, upto: str, split_agent: bool = True) -> str:
    """CTE hist(conv_id, idx, recent, agent_last) for points(conv_id, idx, caller, upto)."""
    agent = ("coalesce(arg_max(CASE WHEN t.caller <> p.caller THEN 'agent' ELSE 'user' END, t.turn_no), '')"
             if split_agent else "''")
    return f"""
h0 AS (SELECT p.conv_id, p.idx, {agent} AS last_role, max(t.turn_no) AS last_no, arg_max(t.text, t.turn_no) AS hist_text
  FROM {points} p LEFT JOIN turns t ON t.conv_id = p.conv_id AND t.turn_no <= p.{upto} GROUP BY 1, 2),
h1 AS (SELECT p.conv_id, p.idx, p.caller, CASE WHEN last_role = 'agent' THEN hist_text ELSE '' END AS agent_last,
  CASE WHEN last_role = 'agent' THEN last_no - 1 ELSE last_no END AS top FROM {points} p JOIN h0 USING (conv_id, idx)),
hist AS (SELECT h1.conv_id, h1.idx, any_value(agent_last) AS agent_last, coalesce(string_agg(
  CASE WHEN t.caller = h1.caller THEN 'user:' ELSE 'agent:' END || t.text, ' | ' ORDER BY t.turn_no), '') AS recent
  FROM h1 LEFT JOIN turns t ON t.conv_id = h1.conv_id AND t.turn_no BETWEEN top - 7 AND top GROUP BY 1, 2)"""


@query("history_before", f"""WITH {SQL_ANN}, pts AS (SELECT * FROM ann WHERE claims), {sql_history('pts', 'stint')}
SELECT conv_id, idx, recent, agent_last FROM hist""")
def history_before(spark, sf):
    return O.history_before(annotated(spark, sf)).select(
        "conv_id", "idx", flat("recent_turns").alias("recent"), "agent_last")


SQL_COMPLETE = f"""{SQL_ANN},
tc0 AS (SELECT *, next_claim_idx IS NOT NULL AND (next_own_idx IS NULL OR next_claim_idx < next_own_idx) AS answered
  FROM ann WHERE claims AND next_caller <> caller),
tc1 AS (SELECT *, CASE WHEN answered AND ends_unit THEN 'complete'
  WHEN NOT answered AND NOT ends_unit AND NOT abandoned AND next_own_act = '+' THEN 'continuation' END AS kind FROM tc0),
tc2 AS (SELECT p.conv_id, p.idx, p.caller, p.stint, p.anchor, p.kind, p.text AS last_text, coalesce(string_agg(
  CASE WHEN a.text <> '' THEN a.text END, ' ' ORDER BY a.idx), '') AS before
  FROM tc1 p LEFT JOIN ann a ON a.conv_id = p.conv_id AND a.caller = p.caller AND a.anchor = p.anchor AND a.idx < p.idx
  WHERE p.kind IS NOT NULL GROUP BY ALL),
tc AS (SELECT *, trim(before || ' ' || last_text) AS user_partial FROM tc2)"""


@query("turn_complete_examples", f"""WITH {SQL_COMPLETE}, {sql_history('tc', 'stint')}
SELECT conv_id, idx, kind, CASE kind WHEN 'complete' THEN 'true' ELSE 'false' END AS label, user_partial, agent_last, recent
FROM tc JOIN hist USING (conv_id, idx)""")
def turn_complete_examples(spark, sf):
    e = O.turn_complete_examples(annotated(spark, sf), D.CHUNK_WIDTH)
    return e.select("conv_id", "idx", "kind", "label", "user_partial", "agent_last",
                    flat("recent_turns").alias("recent"))


SQL_CUT = f"""{SQL_COMPLETE},
cut0 AS (SELECT conv_id, idx, before, string_split(last_text, ' ') AS w, ('0x' || substr(md5('{K.SPLIT_SEED}:cut:'
  || conv_id::VARCHAR || ':' || idx::VARCHAR), 1, 8))::BIGINT AS h FROM tc WHERE kind = 'complete'),
cut AS (SELECT conv_id, idx, trim(before || ' ' || array_to_string(w[1:1 + h % greatest(len(w) - 1, 1)], ' '))
  AS user_partial FROM cut0 WHERE len(w) >= 2)"""


@query("truncations", f"WITH {SQL_CUT} SELECT conv_id, idx, user_partial FROM cut")
def truncations(spark, sf):
    e = O.turn_complete_examples(annotated(spark, sf), D.CHUNK_WIDTH)
    return O.truncations(e).select("conv_id", "idx", "user_partial")


def _sql_in(tags):
    return "(" + ",".join(f"'{t}'" for t in tags) + ")"


SQL_RUNS = f"""
runs AS (SELECT conv_id, run_id, CASE WHEN bool_or(act IN {_sql_in(K.INTERRUPTION_TAGS)}) THEN 'interruption'
  WHEN bool_and(act IN ('b','bh')) THEN 'backchannel' WHEN bool_and(act IN ('x','%')) THEN 'noise' END AS label,
  coalesce(string_agg(CASE WHEN text <> '' THEN text END, ' ' ORDER BY idx), '') AS run_text FROM ann GROUP BY 1, 2),
tg0 AS (SELECT conv_id, run_id, act, min(idx) AS seen FROM ann GROUP BY 1, 2, 3),
tg AS (SELECT conv_id, run_id, array_to_string(list_slice(list(act ORDER BY seen), 1, 4), '+') AS kind FROM tg0 GROUP BY 1, 2)"""


@query("run_label", f"WITH {SQL_ANN}, {SQL_RUNS} SELECT conv_id, run_id, label, kind FROM runs JOIN tg USING (conv_id, run_id)")
def run_label(spark, sf):
    return O.run_tags(annotated(spark, sf)).select(
        "conv_id", "run_id", "label", F.array_join(F.slice("tags", 1, 4), "+").alias("kind"))


SQL_BARGE = f"""{SQL_ANN}, {SQL_RUNS},
b0 AS (SELECT conv_id, idx, caller, run_id, turn_no - new_turn AS agent_turn FROM ann
  WHERE prev_caller <> caller AND act <> '+' AND prev_claimer = prev_caller),
b1 AS (SELECT b0.*, label, kind, run_text, agent_turn - 1 AS before_turn FROM b0 JOIN runs USING (conv_id, run_id)
  JOIN tg USING (conv_id, run_id) WHERE label IS NOT NULL),
b2 AS (SELECT b.conv_id, b.idx, string_agg(a.text, ' ' ORDER BY a.idx) AS agent_now FROM b1 b JOIN ann a
  ON a.conv_id = b.conv_id AND a.turn_no = b.agent_turn AND a.claims AND a.idx < b.idx GROUP BY 1, 2),
{sql_history('b1', 'before_turn', False)},
barge AS (SELECT conv_id, idx, label, kind, array_to_string(string_split(run_text, ' ')[1:12], ' ') AS user_partial,
  agent_now AS agent_last, recent FROM b1 JOIN b2 USING (conv_id, idx) JOIN hist USING (conv_id, idx))"""


@query("barge_in_examples", f"WITH {SQL_BARGE} SELECT * FROM barge")
def barge_in_examples(spark, sf):
    e = O.barge_in_examples(annotated(spark, sf))
    return e.select("conv_id", "idx", "label", "kind", "user_partial", "agent_last",
                    flat("recent_turns").alias("recent"))


def with_split(e):
    g = F.concat(F.lit("conv:"), F.col("conv_id"))
    return e.withColumn("split", H.assign_split(g, K.SPLIT_SEED, K.SPLIT_FRACTIONS))


SQL_SPLITS3 = "(SELECT unnest(['train', 'calib', 'test']) AS split)"


@query("barge_in_card", f"""WITH {SQL_BARGE},
e AS (SELECT *, {D.split_sql("'conv:' || conv_id::VARCHAR")} AS split FROM barge),
s AS {SQL_SPLITS3}
SELECT split, count(e.label) AS n_rows, count(*) FILTER (e.label = 'backchannel') AS backchannel,
 count(*) FILTER (e.label = 'interruption') AS interruption, count(*) FILTER (e.label = 'noise') AS noise
FROM s LEFT JOIN e USING (split) GROUP BY split""")
def barge_in_card(spark, sf):
    e = with_split(O.barge_in_examples(annotated(spark, sf)))
    return L.label_card(e, K.DECISION_LABELS["barge_in"])


SQL_D1 = f"""{SQL_CUT},
d1a AS (SELECT conv_id, idx, kind, user_partial FROM tc UNION ALL SELECT conv_id, idx, 'truncation', user_partial FROM cut),
d1b AS (SELECT *, {D.split_sql("'conv:' || conv_id::VARCHAR")} AS split, {D.sql_norm('user_partial')} AS n FROM d1a),
d1 AS (SELECT *, string_split(n, ' ')[-1] AS word FROM d1b),
fw AS (SELECT word, count(*) FILTER (kind = 'complete') AS complete, count(*) FILTER (kind = 'truncation') AS cut
  FROM d1 WHERE split = 'train' GROUP BY 1 HAVING count(*) FILTER (kind = 'truncation') >= 1
  AND count(*) FILTER (kind = 'complete') >= count(*) FILTER (kind = 'truncation'))"""


def d1_examples(spark, sf):
    e = O.turn_complete_examples(annotated(spark, sf), D.CHUNK_WIDTH)
    return with_split(e.unionByName(O.truncations(e)))


@query("turn_final_words", f"WITH {SQL_D1} SELECT word, complete, cut, round(complete / cut::DOUBLE, 6) AS ratio FROM fw")
def turn_final_words(spark, sf):
    return O.turn_final_words(d1_examples(spark, sf), 1).withColumn("ratio", F.round("ratio", 6))


@query("turn_final_hard", f"""WITH {SQL_D1} SELECT split, kind, count(*) AS n,
 count(*) FILTER (kind = 'truncation' AND word IN (SELECT word FROM fw)) AS hard FROM d1 GROUP BY 1, 2""")
def turn_final_hard(spark, sf):
    e = d1_examples(spark, sf)
    m = O.mark_turn_final(e, O.turn_final_words(e, 1))
    return m.groupBy("split", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("hard").alias("hard"))


SQL_FORMS = f"""{SQL_BARGE},
d2 AS (SELECT conv_id, idx, label, {D.split_sql("'conv:' || conv_id::VARCHAR")} AS split, {D.sql_norm('user_partial')} AS n FROM barge),
fb AS (SELECT n AS form, count(*) AS n_b FROM d2 WHERE split = 'train' AND label = 'backchannel' AND n <> '' GROUP BY 1),
forms AS (SELECT form, n_b, count(*) AS n_i FROM fb JOIN d2 ON d2.split = 'train' AND d2.label = 'interruption'
  AND (d2.n = form OR starts_with(d2.n, form || ' ')) GROUP BY 1, 2
  HAVING least(n_b, count(*)) / (n_b + count(*))::DOUBLE >= 0.1)"""


@query("shared_forms", f"WITH {SQL_FORMS} SELECT form, n_b, n_i FROM forms")
def shared_forms(spark, sf):
    return O.shared_forms(with_split(O.barge_in_examples(annotated(spark, sf))), 1, 0.1)


@query("shared_hard", f"""WITH {SQL_FORMS} SELECT conv_id, idx, label, CASE label
 WHEN 'backchannel' THEN n IN (SELECT form FROM forms)
 WHEN 'interruption' THEN EXISTS (SELECT 1 FROM forms WHERE d2.n = form OR starts_with(d2.n, form || ' '))
 ELSE FALSE END AS hard FROM d2""")
def shared_hard(spark, sf):
    e = with_split(O.barge_in_examples(annotated(spark, sf)))
    return O.mark_shared(e, O.shared_forms(e, 1, 0.1), ["conv_id", "idx"]).select(
        "conv_id", "idx", "label", "hard")
