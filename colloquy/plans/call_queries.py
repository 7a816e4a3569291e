"""Policies and call timelines over all events."""
from pyspark.sql import functions as F

from colloquy import constants as K
from colloquy.operators import calls as O, policy as PO
from colloquy.operators.scale import written
from colloquy.plans.registry import query
from colloquy.sources import driver_tables as D

BUDGETS = {O.OVER: 44.25, O.PAUSE: 29.5}
SEG = D.sql_segments()
PROBS = D.sql_event_probs()
LABELS = "['backchannel','interruption','noise']"
R5 = str(list(D.ROUTE5))

SQL_PAUSE = f"""CASE WHEN p_complete >= 0.785::DOUBLE THEN 'respond' WHEN %s >= 2000 THEN 'respond_after_timeout' ELSE 'keep_listening' END"""
SQL_RESP = "(p_complete >= 0.785::DOUBLE OR %s >= 2000)"
SQL_ROUTE = f"CASE WHEN p_route[5] >= 0.45::DOUBLE THEN 'out_of_scope' ELSE {R5}[list_position(p_route, list_max(p_route[1:4]))] END"


def pause_cols(ms):
    return (f"{SQL_PAUSE % ms} AS action, {SQL_RESP % ms} AND p_escalate >= 0.505::DOUBLE AS escalate, "
            f"CASE WHEN {SQL_RESP % ms} THEN {SQL_ROUTE} END AS route")


SQL_BARGE_ACTION = f"""CASE WHEN p_escalate >= 0.505::DOUBLE OR p_barge[2] >= 0.09::DOUBLE THEN 'stop_and_listen'
 WHEN {LABELS}[list_position(p_barge, list_max(p_barge))] = 'noise' THEN 'ignore' ELSE 'keep_talking' END"""


def segments(spark, sf):
    return D.segments(spark, sf)


def stored(spark, sf):
    """Segments and their probabilities, stored once; acts, scores and points all read them."""
    seg = written(D.segments(spark, sf))
    return seg, written(D.event_probs(seg))


@query("pause_policy", f"WITH {SEG}, {PROBS} SELECT call_id, seg, {pause_cols('300')} FROM probs")
def pause_policy(spark, sf):
    p = D.event_probs(segments(spark, sf))
    d = PO.pause_policy(F.col("p_complete"), F.col("p_route"), F.col("p_escalate"), F.lit(300.0), D.ROUTE5)
    return p.withColumn("d", d).select("call_id", "seg", "d.action", "d.escalate", "d.route")


@query("after_silence", f"WITH {SEG}, {PROBS} SELECT call_id, seg, {pause_cols('2000')} FROM probs")
def after_silence(spark, sf):
    p = D.event_probs(segments(spark, sf))
    d = PO.pause_policy(F.col("p_complete"), F.col("p_route"), F.col("p_escalate"), F.lit(2000.0), D.ROUTE5)
    return p.withColumn("d", d).select("call_id", "seg", "d.action", "d.escalate", "d.route")


@query("barge_policy", f"WITH {SEG}, {PROBS} SELECT call_id, seg, {SQL_BARGE_ACTION} AS action, p_escalate >= 0.505::DOUBLE AS escalate FROM probs")
def barge_policy(spark, sf):
    p = D.event_probs(segments(spark, sf))
    d = PO.barge_policy(F.col("p_barge"), F.col("p_escalate"))
    return p.withColumn("d", d).select("call_id", "seg", "d.action", "d.escalate")


SQL_OVER = """
ov0 AS (SELECT u.call_id, u.seg, u.at_ms AS onset, u.end_ms AS user_end, min(l.seg) AS line FROM seg u JOIN seg l
  ON l.call_id = u.call_id AND u.who = 'user' AND l.who = 'agent' AND l.at_ms <= u.at_ms AND u.at_ms < l.end_ms GROUP BY 1, 2, 3, 4),
ov AS (SELECT o.*, l.at_ms AS line_at, l.end_ms AS line_end FROM ov0 o JOIN seg l ON l.call_id = o.call_id AND l.seg = o.line)"""


@query("speech_over_agent", f"WITH {SEG}, {SQL_OVER} SELECT * FROM ov")
def speech_over_agent(spark, sf):
    return O.speech_over_agent(segments(spark, sf))


EXPECT = """
exq AS (SELECT call_id, seg, event_id % 5 >= 2 AS over_agent,
  CASE WHEN event_id % 5 >= 2 THEN CASE WHEN event_id % 4 = 0 THEN 'stop_and_listen' ELSE 'keep_talking' END
    WHEN event_id % 4 = 0 THEN 'respond' ELSE 'keep_listening' END AS want,
  CASE WHEN event_id % 5 < 2 AND event_id % 12 = 0 THEN 'balance' END AS route,
  CASE WHEN event_id % 3 = 0 THEN FALSE END AS escalate FROM seg WHERE who = 'user' AND event_id % 5 < 4)"""


def expectations(seg):
    i = F.col("event_id")
    over = i % 5 >= 2
    return seg.where("who = 'user' AND event_id % 5 < 4").select(
        "call_id", "seg", over.alias("over_agent"),
        F.when(over, F.when(i % 4 == 0, "stop_and_listen").otherwise("keep_talking"))
        .otherwise(F.when(i % 4 == 0, "respond").otherwise("keep_listening")).alias("want"),
        F.when(~over & (i % 12 == 0), "balance").alias("route"),
        F.when(i % 3 == 0, F.lit(False)).alias("escalate"))


def sql_agent(a: str) -> str:
    """CTEs {a}_acts and {a}_lines for agent 'naive', 'policy' or 'wanted'."""
    start = {"naive": "onset::DOUBLE", "policy": "least(user_end, onset + 600)::DOUBLE",
             "wanted": "least(user_end, onset + 600)::DOUBLE"}[a]
    bo, bp = (0.0, 0.0) if a == "naive" else (BUDGETS[O.OVER], BUDGETS[O.PAUSE])
    action = {"naive": "'stop_and_listen'", "policy": SQL_BARGE_ACTION, "wanted": "coalesce(e.want, 'keep_talking')"}[a]
    esc = {"naive": "FALSE", "policy": "p_escalate >= 0.505::DOUBLE", "wanted": "coalesce(e.escalate, FALSE)"}[a]
    src = {"naive": "ov", "policy": "ov JOIN probs USING (call_id, seg)",
           "wanted": "ov LEFT JOIN exq e ON e.call_id = ov.call_id AND e.seg = ov.seg AND e.over_agent"}[a]
    net = "(p_complete < 0.785::DOUBLE AND (gap IS NULL OR gap >= 2000))"
    answers = "(gap IS NULL OR gap >= 800)"
    if a == "naive":
        pause = f"""SELECT call_id, seg, CASE WHEN {answers} THEN 'respond_after_timeout' ELSE 'keep_listening' END AS action, NULL::VARCHAR AS route,
   FALSE AS escalate, (end_ms + CASE WHEN {answers} THEN 800 ELSE gap END)::DOUBLE AS decided_at_ms,
   (end_ms + CASE WHEN {answers} THEN 800 ELSE gap END)::DOUBLE AS effective_ms, TRUE AS timer FROM {a}_pp"""
    elif a == "policy":
        late, now = pause_cols("2000"), pause_cols("300")
        pause = f"""SELECT call_id, seg, action, route, escalate, end_ms + 300::DOUBLE AS decided_at_ms, eff AS effective_ms, net AS timer FROM (
   SELECT call_id, seg, end_ms, TRUE AS net, end_ms + 2000::DOUBLE AS eff, {late} FROM {a}_pp JOIN probs USING (call_id, seg) WHERE {net}
   UNION ALL BY NAME SELECT call_id, seg, end_ms, FALSE AS net, end_ms + 300::DOUBLE + {bp}::DOUBLE AS eff, {now} FROM {a}_pp JOIN probs USING (call_id, seg) WHERE NOT {net})"""
    else:
        pause = f"""SELECT p.call_id, p.seg, coalesce(want, 'keep_listening') AS action, route, coalesce(escalate, FALSE) AS escalate,
   end_ms + 300::DOUBLE AS decided_at_ms, end_ms + 300::DOUBLE + {bp}::DOUBLE AS effective_ms, FALSE AS timer FROM {a}_pp p
   LEFT JOIN exq e ON e.call_id = p.call_id AND e.seg = p.seg AND NOT e.over_agent"""
    return f"""
{a}_c AS (SELECT ov.*, {start} AS decided, {start} + {bo}::DOUBLE AS eff, {action} AS action, {esc} AS esc,
  row_number() OVER (PARTITION BY ov.call_id, line ORDER BY onset, ov.seg) AS r FROM {src}),
{a}_f AS (SELECT DISTINCT call_id, line, 0::BIGINT AS r, line_end::DOUBLE AS cur, FALSE AS met, FALSE AS cut, -1::BIGINT AS seg FROM {a}_c
  UNION ALL SELECT c.call_id, c.line, c.r, CASE WHEN c.onset < f.cur AND c.action = 'stop_and_listen' THEN least(c.eff, c.line_end) ELSE f.cur END,
   c.onset < f.cur, f.cut OR (c.onset < f.cur AND c.action = 'stop_and_listen'), c.seg
  FROM {a}_f f JOIN {a}_c c ON c.call_id = f.call_id AND c.line = f.line AND c.r = f.r + 1),
{a}_cuts AS (SELECT call_id, line, arg_max(cur, r) AS spoken_end, arg_max(cut, r) AS was_cut FROM {a}_f GROUP BY 1, 2),
{a}_lines AS (SELECT s.call_id, s.seg AS line, s.at_ms AS line_at, coalesce(spoken_end, s.end_ms) AS line_end, coalesce(was_cut, FALSE) AS was_cut
  FROM seg s LEFT JOIN {a}_cuts k ON k.call_id = s.call_id AND k.line = s.seg WHERE s.who = 'agent'),
{a}_pp0 AS (SELECT u.call_id, u.seg, u.end_ms, (SELECT min(x.at_ms) FROM seg x WHERE x.call_id = u.call_id AND x.at_ms >= u.end_ms) - u.end_ms AS gap
  FROM seg u WHERE u.who = 'user' AND NOT EXISTS (SELECT 1 FROM {a}_lines l WHERE l.call_id = u.call_id AND l.line_at <= u.end_ms AND u.end_ms < l.line_end)),
{a}_pp AS (SELECT * FROM {a}_pp0 WHERE gap IS NULL OR gap >= 300),
{a}_acts AS (SELECT '{a}' AS agent, c.call_id, c.seg, '{O.OVER}' AS event, action, NULL::VARCHAR AS route, esc AS escalate, decided AS decided_at_ms,
   eff AS effective_ms, {bo}::DOUBLE AS budget_ms, FALSE AS timer FROM {a}_c c JOIN {a}_f f ON f.call_id = c.call_id AND f.seg = c.seg AND f.met
  UNION ALL BY NAME SELECT '{a}' AS agent, '{O.PAUSE}' AS event, {bp}::DOUBLE AS budget_ms, * FROM ({pause}))"""


BASE = f"RECURSIVE {SEG}, {PROBS}, {SQL_OVER}, {EXPECT}"
COLS = "agent, call_id, seg, event, action, route, escalate, decided_at_ms, effective_ms, budget_ms, timer"


@query("cut_lines", f"WITH {BASE}, {sql_agent('policy')} SELECT call_id, line, spoken_end, was_cut FROM policy_cuts")
def cut_lines(spark, sf):
    seg, probs = stored(spark, sf)
    over = O.speech_over_agent(seg).join(probs, ["call_id", "seg"])
    at = F.least(F.col("user_end"), F.col("onset") + K.BARGE_WINDOW_MS).cast("double")
    over = over.withColumn("effective_ms", at + BUDGETS[O.OVER]).withColumn("stops", PO.barge_policy(
        F.col("p_barge"), F.col("p_escalate"))["action"] == "stop_and_listen")
    return O.cut_lines(O.fold_onsets(over)).select("call_id", "line", "spoken_end", "was_cut")


@query("pause_points", f"""WITH {SEG} SELECT * FROM (SELECT u.call_id, u.seg, u.end_ms, (SELECT min(x.at_ms) FROM seg x
 WHERE x.call_id = u.call_id AND x.at_ms >= u.end_ms) - u.end_ms AS gap_ms FROM seg u WHERE u.who = 'user' AND NOT EXISTS (SELECT 1 FROM seg l
 WHERE l.call_id = u.call_id AND l.who = 'agent' AND l.at_ms <= u.end_ms AND u.end_ms < l.end_ms)) WHERE gap_ms IS NULL OR gap_ms >= 300""")
def pause_points(spark, sf):
    return O.pause_points(written(segments(spark, sf)))


@query("word_timing", f"""WITH {SEG}, w AS (SELECT *, string_split(text, ' ') AS ws FROM seg)
SELECT call_id, seg, j::INT AS word_no, ws[j + 1] AS word, round(at_ms + (j + 1) * (dur_ms / len(ws)::DOUBLE), 6) AS word_end_ms
FROM w, unnest(range(len(ws))) t(j)""")
def word_timing(spark, sf):
    return O.word_timing(segments(spark, sf)).withColumn("word_end_ms", F.round("word_end_ms", 6))


@query("policy_acts", f"WITH {BASE}, {sql_agent('policy')} SELECT {COLS} FROM policy_acts")
def policy_acts(spark, sf):
    seg, probs = stored(spark, sf)
    return O.policy_acts(seg, probs, D.ROUTE5, BUDGETS)[0].drop("reason")


@query("naive_acts", f"WITH {BASE}, {sql_agent('naive')} SELECT {COLS} FROM naive_acts")
def naive_acts(spark, sf):
    return O.naive_acts(written(segments(spark, sf)))[0].drop("reason")


SQL_SNAP = f"""{BASE}, {sql_agent('policy')},
sp AS (SELECT call_id, seg, event, decided_at_ms AS t FROM policy_acts),
sj AS (SELECT p.call_id, p.seg, p.event, p.t, s.seg AS i, s.who, s.at_ms, s.dur_ms, s.end_ms, string_split(s.text, ' ') AS ws, l.line_end,
  p.event = '{O.OVER}' AND s.seg = p.seg AS decided FROM sp p JOIN seg s ON s.call_id = p.call_id LEFT JOIN policy_lines l ON l.call_id = s.call_id AND l.line = s.seg),
sk AS (SELECT *, least(t, end_ms, coalesce(line_end, end_ms)) AS upto FROM sj WHERE at_ms < t OR decided),
sl AS (SELECT *, CASE WHEN upto <= at_ms THEN 0 ELSE least(floor(len(ws) * (upto - at_ms) / dur_ms + 1e-9::DOUBLE), len(ws)) END::BIGINT AS n0 FROM sk),
sm AS (SELECT *, CASE WHEN decided AND n0 = 0 THEN 1 ELSE n0 END AS n FROM sl),
sc AS (SELECT call_id, seg, event, t, i, who, 0 AS kind, j, at_ms + (j + 1) * (dur_ms / len(ws)::DOUBLE) AS "at", ws[j + 1] AS words
   FROM sm, unnest(range(n)) q(j) WHERE who = 'agent' AND n > 0
  UNION ALL SELECT call_id, seg, event, t, i, who, 1, 0, least(end_ms, t)::DOUBLE, array_to_string(ws[1:n], ' ') FROM sm WHERE who = 'user' AND n > 0),
sd AS (SELECT *, coalesce(lag(who) OVER w <> who, TRUE)::INT AS nw FROM sc WINDOW w AS (PARTITION BY call_id, seg, event ORDER BY "at", kind, i, j)),
se AS (SELECT *, sum(nw) OVER (PARTITION BY call_id, seg, event ORDER BY "at", kind, i, j ROWS UNBOUNDED PRECEDING) AS g FROM sd),
sg AS (SELECT call_id, seg, event, g, any_value(who) AS who, string_agg(words, ' ' ORDER BY "at", kind, i, j) AS text FROM se GROUP BY 1, 2, 3, 4),
sh AS (SELECT *, max(g) OVER w AS top, arg_max(who, g) OVER w AS last_who FROM sg WINDOW w AS (PARTITION BY call_id, seg, event)),
si AS (SELECT *, CASE WHEN last_who = 'user' THEN top - 1 ELSE top END AS rest FROM sh),
sn AS (SELECT call_id, seg, event, coalesce(max(text) FILTER (g = top AND who = 'user'), '') AS user_partial,
  coalesce(max(text) FILTER (g = rest AND who = 'agent'), '') AS agent_last,
  coalesce(string_agg(who || ':' || text, ' | ' ORDER BY g) FILTER (g < rest OR (g = rest AND who <> 'agent')), '') AS recent FROM si GROUP BY 1, 2, 3)"""


@query("snapshot_at", f"""WITH {SQL_SNAP} SELECT call_id, seg, event, coalesce(user_partial, '') AS user_partial, coalesce(agent_last, '') AS agent_last,
 coalesce(recent, '') AS recent, EXISTS (SELECT 1 FROM policy_lines l WHERE l.call_id = sp.call_id AND l.line_at <= sp.t AND sp.t < l.line_end) AS agent_speaking
FROM sp LEFT JOIN sn USING (call_id, seg, event)""")
def snapshot_at(spark, sf):
    seg, probs = stored(spark, sf)
    acts, lines = O.policy_acts(seg, probs, D.ROUTE5, BUDGETS)
    acts, lines = written(acts), written(lines)
    s = O.snapshot_at(acts.withColumn("t", F.col("decided_at_ms")), seg, lines)
    return s.select("call_id", "seg", "event", "user_partial", "agent_last", F.array_join(F.transform(
        "recent_turns", lambda t: F.concat_ws(":", t["speaker"], t["text"])), " | ").alias("recent"), "agent_speaking")


def sql_outcomes(a: str) -> str:
    return f"""{a}_out AS (SELECT x.*, want, e.route AS want_route, e.escalate AS want_escalate, CASE WHEN want IS NULL THEN NULL
  WHEN want = 'keep_listening' AND action = 'keep_listening' THEN TRUE
  ELSE (CASE WHEN want = 'respond' THEN action IN ('respond','respond_after_timeout') ELSE want = action END)
   AND (e.route IS NULL OR coalesce(x.route = e.route, FALSE)) AND (e.escalate IS NULL OR e.escalate = x.escalate) END AS ok
  FROM {a}_acts x LEFT JOIN exq e ON e.call_id = x.call_id AND e.seg = x.seg AND e.over_agent = (x.event = '{O.OVER}')),
{a}_miss AS (SELECT e.call_id, e.seg, over_agent, want, (SELECT max(line_end) FROM {a}_lines l WHERE l.call_id = e.call_id AND was_cut AND line_end <= s.at_ms) AS stopped
  FROM exq e JOIN seg s USING (call_id, seg) WHERE NOT EXISTS (SELECT 1 FROM {a}_acts x WHERE x.call_id = e.call_id AND x.seg = e.seg
   AND (x.event = '{O.OVER}') = e.over_agent)),
{a}_missed AS (SELECT call_id, seg, over_agent, want, CASE WHEN over_agent AND stopped IS NOT NULL THEN 'stopped' WHEN NOT over_agent THEN 'talking' ELSE 'none' END AS why,
  NOT (over_agent AND stopped IS NOT NULL AND want = 'stop_and_listen') AS counts FROM {a}_miss)"""


def both(spark, sf):
    """(seg, expect, {agent: (acts, lines, outcomes, missed)}) for the naive and deciding agents."""
    seg, probs = stored(spark, sf)
    expect = expectations(seg)
    known = O.before_acts(seg)
    out = {}
    for name, (acts, lines) in (("naive", O.naive_acts(seg, known=known)),
                                ("policy", O.policy_acts(seg, probs, D.ROUTE5, BUDGETS, known=known))):
        acts, lines = written(acts), written(lines)
        missed = O.missed_points(acts, lines, expect, seg).withColumn("agent", F.lit(name))
        out[name] = (acts, lines, O.score_acts(acts, expect), missed)
    return seg, expect, out


@query("score_acts", f"WITH {BASE}, {sql_agent('policy')}, {sql_outcomes('policy')} SELECT call_id, seg, event, action, want, want_route, want_escalate, ok FROM policy_out")
def score_acts(spark, sf):
    seg, probs = stored(spark, sf)
    acts, _ = O.policy_acts(seg, probs, D.ROUTE5, BUDGETS)
    return O.score_acts(acts, expectations(seg)).select("call_id", "seg", "event", "action", "want", "want_route", "want_escalate", "ok")


@query("missed_points", f"WITH {BASE}, {sql_agent('policy')}, {sql_outcomes('policy')} SELECT * FROM policy_missed")
def missed_points(spark, sf):
    _, _, out = both(spark, sf)
    why = F.when(F.col("why").startswith("agent silent"), "stopped").when(F.col("why").startswith("user covered"), "talking").otherwise("none")
    return out["policy"][3].drop("agent").withColumn("why", why)


AGENTS2 = f"{BASE}, {sql_agent('naive')}, {sql_agent('policy')}, {sql_outcomes('naive')}, {sql_outcomes('policy')}"
SQL_DIV = """au AS (SELECT * FROM naive_acts UNION ALL BY NAME SELECT * FROM policy_acts),
dv AS (SELECT call_id, seg, event FROM au GROUP BY 1, 2, 3 HAVING count(*) < 2 OR count(DISTINCT action || coalesce(route, '-') || escalate::VARCHAR) > 1)"""


@query("divergences", f"WITH {AGENTS2}, {SQL_DIV} SELECT * FROM dv")
def divergences(spark, sf):
    _, _, out = both(spark, sf)
    return O.divergences(out["naive"][0].unionByName(out["policy"][0]), 2)


SQL_SCORE = """sc0 AS (SELECT agent, call_id, ok::INT AS k FROM naive_out WHERE ok IS NOT NULL UNION ALL SELECT agent, call_id, ok::INT FROM policy_out WHERE ok IS NOT NULL
 UNION ALL SELECT 'naive', call_id, 0 FROM naive_missed WHERE counts UNION ALL SELECT 'policy', call_id, 0 FROM policy_missed WHERE counts)"""


@query("agent_score", f"""WITH {AGENTS2}, {SQL_SCORE} SELECT agent, call_id, GROUPING(call_id)::INT AS level, sum(k)::BIGINT AS ok, count(*) AS points
FROM sc0 GROUP BY GROUPING SETS ((agent), (agent, call_id))""")
def agent_score(spark, sf):
    _, _, out = both(spark, sf)
    return O.agent_score(out["naive"][2].unionByName(out["policy"][2]), out["naive"][3].unionByName(out["policy"][3]))


SQL_COMPUTE = "(floor(decided_at_ms) % 97) / 4.0::DOUBLE"


@query("replay_summary", f"""WITH {AGENTS2}, {SQL_SCORE}, {SQL_DIV}, cm AS (SELECT {SQL_COMPUTE} AS ms FROM policy_out)
SELECT agent, sum(k)::BIGINT AS ok, count(*) AS points, (SELECT count(*) FROM exq) AS expected, (SELECT count(*) FROM dv) AS divergences,
 CASE agent WHEN 'policy' THEN (SELECT count(*) FILTER (ms <> 0) FROM cm) ELSE 0 END AS passes,
 CASE agent WHEN 'policy' THEN (SELECT quantile_cont(ms, 0.5) FROM cm WHERE ms <> 0) END AS compute_p50,
 CASE agent WHEN 'policy' THEN (SELECT max(ms) FROM cm WHERE ms <> 0) END AS compute_max FROM sc0 GROUP BY 1""")
def replay_summary(spark, sf):
    """The naive agent runs no model; the policy's passes take a time derived from the call's clock."""
    _, expect, out = both(spark, sf)
    took = F.when(F.col("agent") == "policy", (F.floor("decided_at_ms") % 97) / 4.0)
    acts = out["naive"][2].unionByName(out["policy"][2]).withColumn("compute_ms", took)
    return O.replay_summary(acts, out["naive"][3].unionByName(out["policy"][3]),
                            O.divergences(out["naive"][0].unionByName(out["policy"][0]), 2), expect)


@query("consequences", f"""WITH {BASE}, {sql_agent('policy')}, {sql_outcomes('policy')}, nx AS (SELECT u.call_id, u.seg, u.end_ms,
 (SELECT min(x.at_ms) FROM seg x WHERE x.call_id = u.call_id AND x.at_ms >= u.end_ms) AS next_at,
 (SELECT arg_min(x.at_ms, x.seg) FROM seg x WHERE x.call_id = u.call_id AND x.seg > u.seg AND x.who = 'user') AS next_user FROM seg u WHERE u.who = 'user')
SELECT call_id, seg, event, CASE WHEN event = '{O.PAUSE}' THEN effective_ms - end_ms END AS after_ms,
 CASE WHEN event = '{O.PAUSE}' AND next_user = next_at AND effective_ms < next_user THEN next_user - effective_ms END AS before_next_ms,
 CASE WHEN event = '{O.OVER}' AND action = 'stop_and_listen' THEN line_end - effective_ms END AS unsaid_ms
FROM policy_out JOIN nx USING (call_id, seg) LEFT JOIN (SELECT call_id, seg, line_end FROM ov) o USING (call_id, seg)""")
def consequences(spark, sf):
    seg, probs = stored(spark, sf)
    acts, _ = O.policy_acts(seg, probs, D.ROUTE5, BUDGETS)
    o = O.consequences(O.score_acts(acts, expectations(seg)), seg)
    return o.select("call_id", "seg", "event", "after_ms", "before_next_ms", "unsaid_ms")


def sql_own(a: str) -> str:
    return f"max(action) FILTER (agent = '{a}') AS {a}, bool_or(ok) FILTER (agent = '{a}') AS {a}_ok, bool_or(counts) FILTER (agent = '{a}') AS {a}_missed"


@query("timeline_points", f"""WITH {AGENTS2}, tp0 AS (SELECT agent, call_id, seg, event, action, want, want_route, want_escalate, ok, decided_at_ms, NULL::BOOLEAN AS counts
  FROM (SELECT * FROM naive_out UNION ALL BY NAME SELECT * FROM policy_out)
 UNION ALL SELECT agent, call_id, seg, CASE WHEN over_agent THEN '{O.OVER}' ELSE '{O.PAUSE}' END, NULL, want, NULL, NULL, NULL, NULL, counts
  FROM (SELECT 'naive' AS agent, * FROM naive_missed UNION ALL SELECT 'policy', * FROM policy_missed)),
tp1 AS (SELECT call_id, seg, event, max(want) AS want, max(want_route) AS want_route, bool_or(want_escalate) AS want_escalate, min(decided_at_ms) AS first,
 {sql_own('naive')}, {sql_own('policy')} FROM tp0 GROUP BY 1, 2, 3),
tp2 AS (SELECT tp1.* EXCLUDE (first), coalesce(first, end_ms::DOUBLE) AS t_ms FROM tp1 JOIN seg USING (call_id, seg))
SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY t_ms, seg, CASE WHEN event = '{O.OVER}' THEN 0 ELSE 1 END) AS point FROM tp2""")
def timeline_points(spark, sf):
    seg, _, out = both(spark, sf)
    return O.timeline_points(out["naive"][2].unionByName(out["policy"][2]), out["naive"][3].unionByName(out["policy"][3]), seg, ("naive", "policy"))


@query("script_violations", f"""WITH {D.sql_segments(clip=False)}, {EXPECT}, v AS (
 SELECT call_id, seg, 'same speaker overlaps' AS rule FROM (SELECT *, lag(end_ms) OVER (PARTITION BY call_id, who ORDER BY seg) AS pe FROM seg) WHERE pe > at_ms
 UNION ALL SELECT a.call_id, a.seg, 'agent starts while the user speaks' FROM seg a WHERE a.who = 'agent' AND EXISTS (SELECT 1 FROM seg u WHERE u.who = 'user'
  AND u.call_id = a.call_id AND u.at_ms <= a.at_ms AND a.at_ms < u.end_ms)) SELECT * FROM v""")
def script_violations(spark, sf):
    seg = written(D.segments(spark, sf, clip=False))
    return O.script_violations(seg, expectations(seg))


SQL_TIMING = f"""{BASE}, {sql_agent('wanted')}, {sql_outcomes('wanted')},
nx AS (SELECT u.call_id, u.seg, u.end_ms, (SELECT min(x.at_ms) FROM seg x WHERE x.call_id = u.call_id AND x.at_ms >= u.end_ms) AS next_at FROM seg u WHERE u.who = 'user'),
nw AS (SELECT nx.*, (SELECT arg_min(x.who, x.seg) FROM seg x WHERE x.call_id = nx.call_id AND x.at_ms = nx.next_at) AS next_who, next_at - end_ms AS gap FROM nx),
tj AS (SELECT o.*, n.*, ov.onset, ov.line_end, l.at_ms + l.dur_ms / len(string_split(l.text, ' '))::DOUBLE AS first_word FROM wanted_out o JOIN nw n USING (call_id, seg)
 LEFT JOIN ov USING (call_id, seg) LEFT JOIN seg l ON l.call_id = ov.call_id AND l.seg = ov.line)"""


@query("timing_violations", f"""WITH {SQL_TIMING} SELECT call_id, seg, event, 'no expectation' AS problem FROM tj WHERE want IS NULL
 UNION ALL SELECT call_id, seg, event, 'before the agent''s first word' FROM tj WHERE want IS NOT NULL AND event = '{O.OVER}' AND onset < first_word
 UNION ALL SELECT call_id, seg, event, 'decision lands after the line' FROM tj WHERE want IS NOT NULL AND event = '{O.OVER}' AND effective_ms >= line_end
 UNION ALL SELECT call_id, seg, event, CASE WHEN next_at IS NULL OR next_who <> 'user' THEN 'the user must speak next' ELSE 'mid-thought gap out of range' END
  FROM tj WHERE event = '{O.PAUSE}' AND want = 'keep_listening' AND (next_at IS NULL OR next_who <> 'user' OR NOT (gap > 800 AND gap < 2000 AND gap >= {300 + BUDGETS[O.PAUSE]}))
 UNION ALL SELECT call_id, seg, event, CASE WHEN next_at IS NOT NULL AND next_who <> 'agent' THEN 'the agent must speak next' ELSE 'reply before max wait' END
  FROM tj WHERE event = '{O.PAUSE}' AND want = 'respond' AND ((next_at IS NOT NULL AND next_who <> 'agent') OR gap < 2000)
 UNION ALL SELECT call_id, seg, CASE WHEN over_agent THEN '{O.OVER}' ELSE '{O.PAUSE}' END, 'no decision point' FROM wanted_missed""")
def timing_violations(spark, sf):
    seg = written(segments(spark, sf))
    return O.timing_violations(seg, expectations(seg), BUDGETS)
