"""Label quality, spend, latency, lifecycle and report tables over labels, events and documents."""
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from colloquy import constants as K
from colloquy.functions import hashing as H
from colloquy.operators import bootstrap as B, grids as G, labels as L, latency as Q, lifecycle as C, report as R, sampling as S, scoring as M, spend as KP
from colloquy.plans.registry import SQL, query
from colloquy.plans.sampling_queries import SQL_EX, SQL_LABELS, examples, hand_labels, machine_labels
from colloquy.plans.scoring_queries import METRIC_COLS, SQL_BARGE3, SQL_BIN2, SQL_IC, SQL_S, SQL_YC, r6, rows, sql_table
from colloquy.sources import driver_tables as D

# -- labels ---------------------------------------------------------------------------------------

SQL_AB = f"""{SQL_EX}, {SQL_LABELS}, hd AS (SELECT id, label FROM lh WHERE label <> 'skip'),
mc AS (SELECT id, CASE label WHEN 'y' THEN 'true' WHEN 'n' THEN 'false' ELSE 'unsure' END AS label FROM machine),
ab AS (SELECT id, hd.label AS a, mc.label AS b FROM hd JOIN mc USING (id))"""


def hand_machine(spark, sf):
    h = S.latest_label(hand_labels(spark, sf)).where("label <> 'skip'").select("id", "label")
    m = machine_labels(spark, sf).select("id", L.to_bool(F.col("label")).alias("label"))
    return h, m


SQL_KAPPA = """(SELECT CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END FROM (SELECT avg((a = b)::INT::DOUBLE) AS po,
 sum((SELECT count(*) FROM {t} z WHERE z.b = x.a)) / (count(*)::DOUBLE * count(*)) AS pe FROM {t} x))"""


@query("cohen_kappa", f"WITH {SQL_AB} SELECT count(*) AS n, round({SQL_KAPPA.format(t='ab')}, 6) AS kappa FROM ab")
def cohen_kappa(spark, sf):
    h, m = hand_machine(spark, sf)
    pairs = h.select("id", F.col("label").alias("a")).join(m.select("id", F.col("label").alias("b")), "id")
    return r6(L.cohen_kappa(pairs), "kappa")


SQL_AGREE = f"""{SQL_AB}, sure AS (SELECT a, b FROM ab WHERE b <> 'unsure'), ag AS (SELECT count(*) AS n, (SELECT count(*) FROM ab WHERE b = 'unsure') AS unsure,
 round(avg((a = b)::INT::DOUBLE), 6) AS accuracy, round({SQL_KAPPA.format(t='sure')}, 6) AS kappa,
 round(count(*) FILTER (a = 'true' AND b = 'true') / greatest(1, count(*) FILTER (b = 'true'))::DOUBLE, 6) AS precision,
 round(count(*) FILTER (a = 'true' AND b = 'true') / greatest(1, count(*) FILTER (a = 'true'))::DOUBLE, 6) AS recall,
 count(*) FILTER (a = 'true' AND b = 'true') AS tt, count(*) FILTER (a = 'true' AND b = 'false') AS tf,
 count(*) FILTER (a = 'false' AND b = 'true') AS ft, count(*) FILTER (a = 'false' AND b = 'false') AS ff FROM sure)"""


@query("agreement", f"WITH {SQL_AGREE} SELECT * FROM ag")
def agreement(spark, sf):
    return r6(L.agreement(*hand_machine(spark, sf)), "accuracy", "kappa", "precision", "recall")


@query("stratum_agreement", f"""WITH {SQL_AB}, x AS (SELECT stratum, a, b FROM ab JOIN exs USING (id) WHERE b <> 'unsure')
SELECT stratum, GROUPING(stratum)::INT AS level, count(*) AS n, round(avg((a = b)::INT::DOUBLE), 6) AS accuracy FROM x GROUP BY GROUPING SETS ((), (stratum))""")
def stratum_agreement(spark, sf):
    return r6(L.stratum_agreement(*hand_machine(spark, sf), examples(spark, sf)), "accuracy")


@query("gate", f"""WITH {SQL_AGREE}, cf AS (SELECT count(DISTINCT model) = 1 AND count(DISTINCT prompt) = 1 AND max(model) = 'm1' AND max(prompt) = 'v3' AS same FROM machine)
SELECT same AND kappa >= 0.6 AND precision >= 0.7 AS accepted,
 CASE WHEN NOT same THEN 'calib was labelled and judged under another configuration' ELSE array_to_string(list_filter([CASE WHEN kappa IS NULL OR kappa < 0.6 THEN 'kappa is below 0.6' END,
 CASE WHEN precision < 0.7 THEN 'escalate precision is below 0.7' END], lambda x: x IS NOT NULL), '; ') END AS failures FROM ag, cf""")
def gate(spark, sf):
    served = L.served_config(machine_labels(spark, sf), ["model", "prompt"])
    return L.gate(L.agreement(*hand_machine(spark, sf)), served, {"model": "m1", "prompt": "v3"})


@query("disagreements", f"""WITH {SQL_AB} SELECT id, stratum, a AS hand, b AS machine FROM ab JOIN exs USING (id) WHERE b <> 'unsure' AND a <> b""")
def disagreements(spark, sf):
    return L.disagreements(examples(spark, sf), *hand_machine(spark, sf))


@query("label_progress", f"""WITH {SQL_EX}, {SQL_LABELS} SELECT split, count(*) FILTER (lh.label = 'true') AS "true", count(*) FILTER (lh.label = 'false') AS "false",
 count(*) FILTER (lh.label = 'skip') AS skip, count(*) FILTER (lh.label IS NULL) AS pending FROM exs LEFT JOIN lh USING (id) GROUP BY 1""")
def label_progress(spark, sf):
    return L.label_progress(examples(spark, sf), S.latest_label(hand_labels(spark, sf)))


@query("self_agreement", f"""WITH {SQL_LABELS}, a1 AS (SELECT id, label FROM hand WHERE "at" % 10 = 0 AND label <> 'skip'), b1 AS (SELECT id, label FROM hand WHERE "at" % 10 = 5),
t AS (SELECT a1.label AS a, b1.label AS b FROM a1 JOIN b1 USING (id)) SELECT count(*) AS n, round(avg((a = b)::INT::DOUBLE), 6) AS accuracy, round({SQL_KAPPA.format(t='t')}, 6) AS kappa FROM t""")
def self_agreement(spark, sf):
    h = hand_labels(spark, sf)
    return r6(L.agreement(h.where("at % 10 = 0 AND label <> 'skip'"), h.where("at % 10 = 5")), "accuracy", "kappa").select("n", "accuracy", "kappa")


@query("label_values_check", f"""WITH {SQL_LABELS} SELECT id, 'v2' AS guidelines, label FROM hand WHERE label = 'skip'""")
def label_values_check(spark, sf):
    return L.label_violations(hand_labels(spark, sf).withColumn("guidelines", F.lit("v2")))


# -- spend: events as model calls -----------------------------------------------------------------

SQL_CALLS = """
calls AS (SELECT event_id, event_type AS model, 'p' || (user_id % 3)::VARCHAR AS purpose, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'prov' || (user_id % 4)::VARCHAR END AS provider,
  floor(value * 10)::BIGINT AS prompt_tokens, event_id % 50 AS completion_tokens, CASE WHEN event_id % 3 <> 0 THEN round(value / 1e5, 8) END AS cost_usd FROM events),
prices AS (SELECT * FROM (VALUES ('view', 0.1::DOUBLE, 0.4::DOUBLE), ('click', 0.2, 0.5), ('purchase', 0.3, 0.6), ('signup', 0.4, 0.7), ('error', 0.5, 0.8)) t(model, pin, pout)),
costs AS (SELECT c.*, (prompt_tokens * pin + completion_tokens * pout) / 1e6 AS bound_usd, coalesce(cost_usd, (prompt_tokens * pin + completion_tokens * pout) / 1e6) AS spent_usd,
  CASE WHEN cost_usd IS NULL THEN 'upper_bound' ELSE 'reported' END AS cost_source FROM calls c JOIN prices USING (model))"""

PRICES = [("view", 0.1, 0.4), ("click", 0.2, 0.5), ("purchase", 0.3, 0.6), ("signup", 0.4, 0.7), ("error", 0.5, 0.8)]


def calls(spark, sf):
    u, i = F.col("user_id"), F.col("event_id")
    return D.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("model"), F.concat(F.lit("p"), u % 3).alias("purpose"),
        F.when(u % 4 != 0, F.concat(F.lit("prov"), u % 4)).alias("provider"), F.floor(F.col("value") * 10).alias("prompt_tokens"),
        (i % 50).alias("completion_tokens"), F.when(i % 3 != 0, F.round(F.col("value") / 1e5, 8)).alias("cost_usd"))


def costs(spark, sf):
    return KP.costed(calls(spark, sf), spark.createDataFrame(PRICES, "model string, in_per_m double, out_per_m double"))


@query("cost_upper_bound", f"WITH {SQL_CALLS} SELECT event_id, round(bound_usd, 9) AS bound_usd, round(spent_usd, 9) AS spent_usd, cost_source FROM costs")
def cost_upper_bound(spark, sf):
    return costs(spark, sf).select("event_id", F.round("bound_usd", 9).alias("bound_usd"), F.round("spent_usd", 9).alias("spent_usd"), "cost_source")


@query("spend_summary", f"""WITH {SQL_CALLS} SELECT purpose, model, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
 round(sum(spent_usd), 6) AS cost_usd, count(*) FILTER (cost_source = 'upper_bound') AS bound_calls FROM costs GROUP BY 1, 2""")
def spend_summary(spark, sf):
    return r6(KP.spend_summary(costs(spark, sf)), "cost_usd")


@query("calls_by_provider", f"WITH {SQL_CALLS} SELECT coalesce(provider, '?') AS provider, count(*) AS calls FROM calls GROUP BY 1")
def calls_by_provider(spark, sf):
    return KP.calls_by_provider(calls(spark, sf))


@query("budget_admission", f"""WITH {SQL_CALLS}, r AS (SELECT event_id, bound_usd AS w, sum(bound_usd) OVER (ORDER BY event_id) AS run FROM costs)
SELECT event_id, round(run, 9) AS running_usd, (SELECT sum(spent_usd) FROM costs WHERE purpose = 'p0') + run <= 0.75::DOUBLE * 0.95 AS admitted FROM r""")
def budget_admission(spark, sf):
    c = costs(spark, sf)
    a = KP.budget_admission(c.select("event_id", F.col("bound_usd").alias("worst_usd")), c.where("purpose = 'p0'"), "event_id", 4096, cap_usd=0.75)
    return a.select("event_id", F.round("running_usd", 9).alias("running_usd"), "admitted")


@query("prompt_token_estimate", "SELECT page_id, 16 + length(url) // 3 + 8 + length(html) // 3 + 8 AS tokens FROM pages")
def prompt_token_estimate(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", KP.prompt_token_estimate(F.array("url", "html")).alias("tokens"))


@query("project_spend", f"""WITH {SQL_CALLS}, p AS (SELECT purpose AS part, avg(spent_usd) AS c, CASE purpose WHEN 'p0' THEN 1000 WHEN 'p1' THEN 250 ELSE 1050 END AS n FROM costs GROUP BY 1)
SELECT part, round(c, 9) AS cost_per_call, n::BIGINT AS calls, round(c * n, 6) AS projected_usd FROM p UNION ALL SELECT 'total', NULL, sum(n)::BIGINT, round(sum(c * n), 6) FROM p""")
def project_spend(spark, sf):
    plan = spark.createDataFrame([("p0", 1000), ("p1", 250), ("p2", 1050)], "part string, calls bigint")
    p = KP.project_spend(costs(spark, sf).withColumnRenamed("purpose", "part"), plan)
    return p.select("part", F.round("cost_per_call", 9).alias("cost_per_call"), "calls", F.round("projected_usd", 6).alias("projected_usd"))


@query("invalid_answers", """SELECT event_type AS decision, count(*) FILTER (user_id % 3 = 0) AS invalid, round(avg((user_id % 3 = 0)::INT::DOUBLE), 6) AS share FROM events GROUP BY 1""")
def invalid_answers(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("event_type").alias("decision"), (F.col("user_id") % 3 != 0).alias("valid"))
    return r6(KP.invalid_answers(e), "share")


# -- latency: events as timed calls ---------------------------------------------------------------

SQL_SAMPLES = """smp AS (SELECT event_id AS i, user_id AS run_id, user_id % 3 AS chunk, event_type AS row, CASE WHEN user_id % 2 = 0 THEN 'stock' ELSE 'tuned' END AS arm,
 CASE WHEN event_type IN ('view','click') THEN 'cpu' ELSE 'cuda' END AS device, value AS total_ms, value * 0.25 AS pack_ms, value * 0.125 AS encode_ms, value * 0.5 AS forward_ms FROM events)"""


def samples(spark, sf):
    v = F.col("value")
    return D.table(spark, sf, "events").select(
        F.col("event_id").alias("i"), F.col("user_id").alias("run_id"), (F.col("user_id") % 3).alias("chunk"), F.col("event_type").alias("row"),
        F.when(F.col("user_id") % 2 == 0, "stock").otherwise("tuned").alias("arm"),
        F.when(F.col("event_type").isin("view", "click"), "cpu").otherwise("cuda").alias("device"),
        v.alias("total_ms"), (v * 0.25).alias("pack_ms"), (v * 0.125).alias("encode_ms"), (v * 0.5).alias("forward_ms"))


def sql_percentiles(keys: str, where: str = "TRUE") -> str:
    return f"""lp AS (SELECT {keys}, component, count(*) AS n, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95, quantile_cont(ms, 0.99) AS p99, avg(ms) AS mean, max(ms) AS max
 FROM (UNPIVOT smp ON total_ms, pack_ms, encode_ms, forward_ms INTO NAME component VALUE ms) WHERE {where} GROUP BY {keys}, component)"""


PCT = ("p50", "p95", "p99", "mean", "max")
SQL_PCT = ", ".join(f"round({c}, 9) AS {c}" for c in PCT)


@query("latency_percentiles", f'WITH {SQL_SAMPLES}, {sql_percentiles("row")} SELECT row, component, n, {SQL_PCT} FROM lp')
def latency_percentiles(spark, sf):
    p = Q.latency_percentiles(samples(spark, sf))
    return p.select("row", "component", "n", *[F.round(c, 9).alias(c) for c in PCT])


@query("latency_percentiles_approx", f"""WITH {SQL_SAMPLES} SELECT row, component, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99
FROM (UNPIVOT smp ON total_ms, pack_ms, encode_ms, forward_ms INTO NAME component VALUE ms) GROUP BY 1, 2""")
def latency_percentiles_approx(spark, sf):
    return Q.latency_percentiles_approx(samples(spark, sf))


@query("budget_verdict", f"""WITH {SQL_SAMPLES}, {sql_percentiles("row, device", "component = 'total_ms'")} SELECT row, device, round(p99, 6) AS p99,
 CASE device WHEN 'cuda' THEN 50.0::DOUBLE ELSE 100.0::DOUBLE END AS budget_ms, p99 <= CASE device WHEN 'cuda' THEN 50 ELSE 100 END AS fits FROM lp""")
def budget_verdict(spark, sf):
    p = Q.latency_percentiles(samples(spark, sf), ("row", "device"), ("total_ms",))
    return r6(Q.budget_verdict(p).select("row", "device", "p99", "budget_ms", "fits"), "p99")


@query("warmup_drop", f"WITH {SQL_SAMPLES} SELECT run_id, chunk, i FROM smp QUALIFY row_number() OVER (PARTITION BY run_id, chunk ORDER BY i) > 5")
def warmup_drop(spark, sf):
    return Q.warmup_drop(samples(spark, sf), 5).select("run_id", "chunk", "i")


SQL_LINES = """ln AS (SELECT event_id AS i, user_id AS run_id, CASE WHEN event_id % 4 = 0 THEN 'warmup' ELSE 'timed' END AS phase,
 CASE WHEN event_id % 29 = 0 THEN 'short, line' ELSE ts::VARCHAR || ', ' || (40 + event_id % 50)::VARCHAR || ', ' || CASE WHEN event_id % 17 = 0 THEN '[N/A]' ELSE (event_id % 2000)::VARCHAR END
 || ', 7000, 2100, ' || (event_id % 140)::VARCHAR || '.5, 140, P' || (event_id % 3)::VARCHAR || ', 0x0, ' || CASE WHEN event_id % 3 = 0 THEN 'Active' ELSE 'Not Active' END || ', '
 || CASE WHEN event_id % 101 = 0 THEN 'Active' ELSE 'Not Active' END || ', Not Active, Not Active, Not Active' END AS line FROM events),
tl AS (SELECT i, run_id, phase, list_transform(string_split(line, ','), lambda x: trim(x)) AS p FROM ln WHERE len(string_split(line, ',')) = 14),
tel AS (SELECT i, run_id, phase, TRY_CAST(p[2] AS DOUBLE) AS temperature_gpu, TRY_CAST(p[3] AS DOUBLE) AS clocks_sm, TRY_CAST(p[4] AS DOUBLE) AS clocks_mem, TRY_CAST(p[5] AS DOUBLE) AS clocks_max_sm, TRY_CAST(p[6] AS DOUBLE) AS power_draw, TRY_CAST(p[7] AS DOUBLE) AS power_limit,
 p[8] AS pstate, p[10] = 'Active' AS sw_power_cap, p[11] = 'Active' AS hw_slowdown,
 p[1] AS timestamp, p[9] AS events_active, p[12] = 'Active' AS hw_thermal_slowdown, p[13] = 'Active' AS sw_thermal_slowdown, p[14] = 'Active' AS hw_power_brake_slowdown FROM tl)"""


def telemetry(spark, sf):
    i = F.col("event_id")
    line = F.when(i % 29 == 0, "short, line").otherwise(F.concat(
        F.col("ts").cast("string"), F.lit(", "), 40 + i % 50, F.lit(", "), F.when(i % 17 == 0, "[N/A]").otherwise((i % 2000).cast("string")),
        F.lit(", 7000, 2100, "), i % 140, F.lit(".5, 140, P"), i % 3, F.lit(", 0x0, "), F.when(i % 3 == 0, "Active").otherwise("Not Active"), F.lit(", "),
        F.when(i % 101 == 0, "Active").otherwise("Not Active"), F.lit(", Not Active, Not Active, Not Active")))
    d = D.table(spark, sf, "events").select(i.alias("i"), F.col("user_id").alias("run_id"),
                                            F.when(i % 4 == 0, "warmup").otherwise("timed").alias("phase"), line.alias("line"))
    return Q.parse_telemetry(d)


@query("parse_telemetry", f"WITH {SQL_LINES} SELECT * EXCLUDE (timestamp) FROM tel")
def parse_telemetry(spark, sf):
    return telemetry(spark, sf).drop("timestamp")


@query("telemetry_summary", f"""WITH {SQL_LINES}, u AS (UNPIVOT (SELECT phase, temperature_gpu, clocks_sm, clocks_mem, clocks_max_sm, power_draw, power_limit FROM tel) ON temperature_gpu, clocks_sm, clocks_mem, clocks_max_sm, power_draw, power_limit INTO NAME gauge VALUE v)
SELECT phase, gauge, count(*) AS n, min(v) AS min, quantile_cont(v, 0.5) AS median, max(v) AS max FROM u GROUP BY 1, 2""")
def telemetry_summary(spark, sf):
    return Q.telemetry_summary(telemetry(spark, sf))


@query("telemetry_flags", f"""WITH {SQL_LINES} SELECT phase, count(*) AS samples, string_agg(DISTINCT pstate, ',' ORDER BY pstate) AS pstates, count(*) FILTER (hw_slowdown) AS hw_slowdown,
 count(*) FILTER (sw_power_cap) AS sw_power_cap, count(*) FILTER (hw_thermal_slowdown) AS hw_thermal_slowdown,
 count(*) FILTER (sw_thermal_slowdown) AS sw_thermal_slowdown, count(*) FILTER (hw_power_brake_slowdown) AS hw_power_brake_slowdown,
 CASE WHEN bool_or(hw_slowdown) THEN 'hw_slowdown' ELSE '' END AS throttled_by FROM tel GROUP BY 1""")
def telemetry_flags(spark, sf):
    return Q.telemetry_flags(telemetry(spark, sf))


SQL_RUNS = f"""{SQL_LINES}, fl AS (SELECT run_id, count(*) AS samples, CASE WHEN bool_or(hw_slowdown) THEN 'hw_slowdown' ELSE '' END AS throttled_by FROM tel WHERE phase = 'timed' GROUP BY 1),
rn AS (SELECT DISTINCT user_id AS run_id, 'row' || (user_id // 4)::VARCHAR AS row, (user_id % 4)::INT + 1 AS attempt, CASE WHEN user_id % 8 < 6 THEN 'cuda' ELSE 'cpu' END AS device FROM events),
rv AS (SELECT rn.*, CASE WHEN coalesce(samples, 0) = 0 THEN 'no samples in the timed phase, throttling unknown' WHEN device = 'cuda' AND throttled_by <> '' THEN 'throttling seen: ' || throttled_by END AS discarded
 FROM rn LEFT JOIN fl USING (run_id))"""


def run_table(spark, sf):
    u = F.col("user_id")
    return D.table(spark, sf, "events").select("user_id").distinct().select(
        u.alias("run_id"), F.concat(F.lit("row"), F.floor(u / 4)).alias("row"), (u % 4 + 1).cast("int").alias("attempt"),
        F.when(u % 8 < 6, "cuda").otherwise("cpu").alias("device"))


def run_flags(spark, sf):
    t = telemetry(spark, sf).where("phase = 'timed'")
    return t.groupBy("run_id").agg(F.count(F.lit(1)).alias("samples"), F.when(F.bool_or("hw_slowdown"), "hw_slowdown").otherwise("").alias("throttled_by"))


@query("run_verdict", f"""WITH {SQL_RUNS} SELECT run_id, row, attempt, device, discarded, coalesce(discarded IS NULL AND attempt <= 3 AND attempt =
 min(CASE WHEN discarded IS NULL AND attempt <= 3 THEN attempt END) OVER (PARTITION BY row), FALSE) AS kept FROM rv""")
def run_verdict(spark, sf):
    return Q.run_verdict(run_table(spark, sf), run_flags(spark, sf))


@query("overheat_alert", f"""WITH {SQL_LINES} SELECT run_id, i, max(temperature_gpu) OVER w AS hottest3, max(temperature_gpu) OVER w >= 85 AS alert FROM tel
WINDOW w AS (PARTITION BY run_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def overheat_alert(spark, sf):
    return Q.overheat_alert(telemetry(spark, sf), "i", 65_536).select("run_id", "i", "hottest3", "alert")


@query("session_power", f"""WITH {SQL_LINES}, r AS (SELECT run_id, min(power_limit) AS a, max(power_limit) AS b, quantile_cont(power_draw, 0.5) AS m, count(*) FILTER (sw_power_cap) AS c, count(*) AS n FROM tel WHERE phase = 'timed' GROUP BY 1)
SELECT run_id % 5 AS code, count(*) AS n_rows, min(a) AS limit_min, max(b) AS limit_max, min(m) AS draw_min, max(m) AS draw_max, round(sum(c) / sum(n)::DOUBLE, 6) AS capped_share FROM r GROUP BY 1""")
def session_power(spark, sf):
    from colloquy.operators.scale import exact_quantiles, written

    t = written(telemetry(spark, sf).where("phase = 'timed'"))
    med = exact_quantiles(t, ["run_id"], "power_draw", (0.5,)).select("run_id", F.get("q", F.lit(0)).alias("draw_median"))
    g = t.groupBy("run_id").agg(F.min("power_limit").alias("limit_min"), F.max("power_limit").alias("limit_max"),
                                F.count_if("sw_power_cap").alias("capped"), F.count(F.lit(1)).alias("samples")).join(med, "run_id")
    return r6(Q.session_power(g.withColumn("code", F.col("run_id") % 5)), "capped_share")


@query("relative_change", f"""WITH {SQL_SAMPLES}, {sql_percentiles("row, arm", "component = 'total_ms'")} SELECT t.row, t.component, round((t.p50 / s.p50 - 1) * 100, 6) AS change_pct
FROM lp t JOIN lp s ON s.row = t.row AND s.component = t.component AND s.arm = 'stock' WHERE t.arm = 'tuned'""")
def relative_change(spark, sf):
    p = Q.latency_percentiles(samples(spark, sf), ("row", "arm"), ("total_ms",))
    return r6(Q.relative_change(p, "tuned", "stock"), "change_pct")


@query("decision_budgets", f"""WITH {SQL_SAMPLES}, {sql_percentiles("row", "component = 'total_ms'")} SELECT CASE row WHEN 'signup' THEN 'user_pause' ELSE 'user_speech_during_agent' END AS event,
 round(p50, 6) AS budget_ms FROM lp WHERE row IN ('signup', 'purchase')""")
def decision_budgets(spark, sf):
    from colloquy.operators.calls import decision_budgets as budgets

    p = Q.latency_percentiles(samples(spark, sf), ("row", "device"), ("total_ms",))
    return r6(budgets(p, {"user_pause": "signup", "user_speech_during_agent": "purchase"}, {"device": "cuda"}), "budget_ms")


# -- lifecycle ------------------------------------------------------------------------------------

def sql_row_hash(cols) -> str:
    return "sha256(" + " || chr(31) || ".join(f"coalesce('=' || {c}::VARCHAR, '~')" for c in cols) + ")"


def sql_fp(hashes: str) -> str:
    """(n_rows, fingerprint) over a relation with a column h."""
    parts = " || '-' || ".join(f"coalesce(sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT), 0)::VARCHAR" for i in range(8))
    return f"SELECT count(*) AS n_rows, sha256(count(*)::VARCHAR || ':' || {parts}) AS fingerprint FROM {hashes}"


DOC_COLS = ("doc_id", "text", "lang", "source", "n_chars")


@query("dataset_fingerprint", f"WITH h AS (SELECT {sql_row_hash(DOC_COLS)} AS h FROM documents) {sql_fp('h')}")
def dataset_fingerprint(spark, sf):
    return C.fingerprint(D.table(spark, sf, "documents"), DOC_COLS)


def versions(spark, sf, changed=False):
    """(name, n_rows, fingerprint) of each language's part; `changed` alters one and drops another."""
    d = D.table(spark, sf, "documents")
    if changed:
        d = d.where("lang <> 'es'").withColumn("text", F.when((F.col("lang") == "de") & (F.col("doc_id") % 100 == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    h = d.select("lang", C.row_hash([F.col(c) for c in DOC_COLS]).alias("h"))
    g = h.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.sum(H.hex_int(F.col("h"), 1 + 8 * i, 8)).alias(f"s{i}") for i in range(8)])
    return g.select(F.col("lang").alias("name"), F.sha2(F.concat_ws(":", "n", F.concat_ws("-", *[F.col(f"s{i}") for i in range(8)])), 256).alias("fingerprint"))


@query("verify_manifest", """SELECT lang AS name, CASE WHEN lang = 'es' THEN 'missing' WHEN lang = 'fr' THEN 'unlisted'
 WHEN lang = 'de' AND bool_or(doc_id % 100 = 1) THEN 'changed' ELSE 'ok' END AS status FROM documents GROUP BY 1""")
def verify_manifest(spark, sf):
    return C.verify_manifest(versions(spark, sf).where("name <> 'fr'"), versions(spark, sf, changed=True))


@query("freeze_version", f"""WITH h AS (SELECT {sql_row_hash(DOC_COLS)} AS h FROM documents), f AS ({sql_fp('h')}),
h2 AS (SELECT {sql_row_hash(DOC_COLS)} AS h FROM (SELECT * REPLACE (CASE WHEN doc_id % 100 = 1 THEN text || '!' ELSE text END AS text) FROM documents)), f2 AS ({sql_fp('h2')})
SELECT 'documents.v1' AS name, n_rows, fingerprint, FALSE AS new FROM f UNION ALL SELECT 'documents.v2', n_rows, fingerprint, TRUE FROM f2""")
def freeze_version(spark, sf):
    """The first version again, which must not have changed, and a second one with edited texts."""
    d = D.table(spark, sf, "documents").select(*DOC_COLS)
    frozen = C.fingerprint(d).withColumn("name", F.lit("documents.v1"))
    edited = d.withColumn("text", F.when(F.col("doc_id") % 100 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return C.freeze_version(d, frozen, "documents.v1").unionAll(C.freeze_version(edited, frozen, "documents.v2"))


@query("restore_private", f"""SELECT 'd' || doc_id::VARCHAR AS id, lang, doc_id % 10 <> 3 AS verified FROM documents""")
def restore_private(spark, sf):
    d = D.table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "lang", "text", "doc_id")
    corpus = d.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    return C.restore_private(C.redact(d.drop("doc_id"), ["text"]), corpus, ["text"]).select("id", "lang", "verified")


@query("dataset_card", f"""WITH {SQL_EX}, e AS (SELECT split, label, stratum AS kind, NOT cue AS hard FROM exs), s AS (SELECT unnest(['train','calib','test']) AS split),
lc AS (SELECT split, string_agg(label || '=' || n::VARCHAR, ', ' ORDER BY n DESC, label) AS labels FROM (SELECT split, label, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
kc AS (SELECT split, string_agg(kind || '=' || n::VARCHAR, ', ' ORDER BY n DESC, kind) AS kinds FROM (SELECT split, kind, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1)
SELECT split, count(e.label) AS n_rows, count(*) FILTER (hard) AS hard, any_value(labels) AS labels, any_value(kinds) AS kinds FROM s LEFT JOIN e USING (split) LEFT JOIN lc USING (split) LEFT JOIN kc USING (split) GROUP BY 1""")
def dataset_card(spark, sf):
    e = examples(spark, sf).withColumn("kind", F.col("stratum")).withColumn("hard", ~F.col("cue"))
    return C.dataset_card(e)


@query("wellformed_rows", """WITH e AS (SELECT doc_id % (SELECT count(*) - 5 FROM documents) AS id, lang FROM documents)
SELECT 'label' AS rule, count(*) AS n FROM e WHERE lang NOT IN ('en','de','fr') HAVING count(*) > 0
UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT id FROM e GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0""")
def wellformed_rows(spark, sf):
    d = D.examples(spark, sf)
    n = D.table(spark, sf, "documents").agg((F.count(F.lit(1)) - 5).alias("_n"))
    from colloquy.operators.scale import attach_row

    e = attach_row(d, n).withColumn("id", F.col("doc_id") % F.col("_n")).withColumn("event", F.lit("user_pause")).withColumn(
        "source", F.lit("docs")).withColumn("user_partial", F.col("text"))
    return C.wellformed(e, ("en", "de", "fr"), ("user_pause",), ("docs",))


@query("run_reuse_check", """SELECT lang, 'n' AS field, n::VARCHAR AS "left", (n + 1)::VARCHAR AS "right" FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) WHERE lang = 'fr'""")
def run_reuse_check(spark, sf):
    a = D.table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    b = a.withColumn("n", F.when(F.col("lang") == "fr", F.col("n") + 1).otherwise(F.col("n")))
    return C.reuse_mismatches(a, b, ["lang"], ["n", "first"])


EXTRA = {"token_assignment": r'token\s*=\s*"[0-9a-f]{8,}"', "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}"}
SQL_RULES = " UNION ALL ".join(
    f"SELECT doc_id AS id, '{r}' AS rule FROM documents WHERE regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for r, p in {**K.SECRET_RULES, **EXTRA}.items())


@query("secret_scan", SQL_RULES)
def secret_scan(spark, sf):
    return C.secret_scan(D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), EXTRA)


# -- reports --------------------------------------------------------------------------------------

@query("report_pivot", f"""WITH {SQL_S}, {D.sql_scored('b', 'route10', 'sb')}, s2 AS (SELECT *, pred AS top FROM s), sb2 AS (SELECT *, pred AS top FROM sb),
t AS ({sql_table("'a' AS model", 10, 's2')} UNION ALL {sql_table("'b' AS model", 10, 'sb2')}), m AS (SELECT unnest(['a','b','c']) AS model)
SELECT model, coalesce(printf('%.3f [%.3f, %.3f]', accuracy, acc_lo, acc_hi), 'TODO') AS accuracy, coalesce(printf('%.3f', macro_f1), 'TODO') AS macro_f1, coalesce(printf('%.3f', ece), 'TODO') AS ece FROM m LEFT JOIN t USING (model)""")
def report_pivot(spark, sf):
    t = r6(M.score_table(rows(spark, sf).unionByName(rows(spark, sf, model="b")), 10), *METRIC_COLS)
    long = t.select("model", F.explode(F.array(
        F.struct(F.lit("accuracy").alias("metric"), R.cell(F.col("accuracy"), F.col("acc_lo"), F.col("acc_hi")).alias("cell")),
        F.struct(F.lit("macro_f1").alias("metric"), R.cell(F.col("macro_f1")).alias("cell")),
        F.struct(F.lit("ece").alias("metric"), R.cell(F.col("ece")).alias("cell")))).alias("c")).select("model", "c.*")
    layout = spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    return R.pivot(long, layout, ["model"], "metric", ["accuracy", "macro_f1", "ece"])


TEST = "WHERE split = 'test'"


@query("row_provenance", f"""WITH {SQL_S}, h AS (SELECT {sql_row_hash(("id", "y"))} AS h FROM s {TEST}), f AS ({sql_fp('h')})
SELECT 'a' AS model, (SELECT count(*) FROM s {TEST}) AS n, n_rows AS test_rows, fingerprint AS test_fingerprint, 'a' AS checkpoint, 'c0ffee' AS code, 1.0::DOUBLE AS temperature FROM f""")
def row_provenance(spark, sf):
    """Accuracy rows with the fingerprint of the test rows behind them; the model's name is its checkpoint."""
    test = rows(spark, sf).where("split = 'test'")
    t = M.accuracy(M.cells(test)).select("model", "n", F.col("model").alias("checkpoint"))
    return R.provenance(t, test.select("id", "y"), code="c0ffee", temperature=1.0)


def layout(spark, column: str, names) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def sql_layout(column: str, names) -> str:
    return f"(SELECT unnest({list(names)}) AS {column})"


def sql_fixed(x: str, digits: int, flag: str = "") -> str:
    return f"printf('%{flag}.{digits}f', floor({x} * {10 ** digits} + 0.5) / {10 ** digits})"


PATHS = ("view", "click", "purchase", "signup", "prompted")


@query("report_latency", f"""WITH {SQL_SAMPLES}, {sql_percentiles("row, device")}, w AS (SELECT row, any_value(device) AS device, max(p50) FILTER (component = 'total_ms') AS p50,
  max(p95) FILTER (component = 'total_ms') AS p95, max(p99) FILTER (component = 'total_ms') AS p99, max(p50) FILTER (component = 'forward_ms') AS forward,
  max(p50) FILTER (component = 'pack_ms') AS packing FROM lp GROUP BY 1)
SELECT l.row, {", ".join(f"coalesce({sql_fixed(c, 1)}, 'TODO') AS {c}" for c in ("p50", "p95", "p99", "forward", "packing"))},
 coalesce(CASE WHEN p99 <= CASE device WHEN 'cuda' THEN 50 ELSE 100 END THEN 'yes' ELSE 'no' END || ' (<= ' || CASE device WHEN 'cuda' THEN '50' WHEN 'cpu' THEN '100' END || ' ms)', 'TODO') AS budget
FROM {sql_layout('row', PATHS)} l LEFT JOIN w USING (row)""")
def report_latency(spark, sf):
    p = Q.latency_percentiles(samples(spark, sf), ("row", "device"))
    return R.latency_table(p, Q.budget_verdict(p).select("row", "budget_ms", "fits"), layout(spark, "row", PATHS))


@query("report_arms", f"""WITH {SQL_SAMPLES}, {sql_percentiles("row, arm", "component = 'total_ms'")}, {SQL_LINES},
st AS (SELECT row, arm, max(temperature_gpu) AS hottest, bool_or(hw_slowdown) AS slow FROM tel JOIN smp USING (i) WHERE phase = 'timed' GROUP BY 1, 2),
x AS (SELECT lp.*, hottest, coalesce(slow, FALSE) AS slow FROM lp LEFT JOIN st USING (row, arm))
SELECT l.row, coalesce({sql_fixed('s.p50', 1)} || ' / ' || {sql_fixed('s.p99', 1)}, 'TODO') AS stock, coalesce({sql_fixed('t.p50', 1)} || ' / ' || {sql_fixed('t.p99', 1)}, 'TODO') AS tuned,
 coalesce({sql_fixed('((t.p50 / s.p50 - 1) * 100)', 1, '+')} || '%', 'TODO') AS change, coalesce({sql_fixed('s.hottest', 0)} || ' / ' || {sql_fixed('t.hottest', 0)}, 'TODO') AS hottest,
 CASE WHEN s.row IS NULL THEN 'TODO' WHEN s.slow OR t.slow THEN 'hw_slowdown' ELSE 'no' END AS throttled
FROM {sql_layout('row', PATHS)} l LEFT JOIN (SELECT * FROM x WHERE arm = 'stock') s ON s.row = l.row LEFT JOIN (SELECT * FROM x WHERE arm = 'tuned') t ON t.row = l.row""")
def report_arms(spark, sf):
    """A call's device state is the telemetry line taken with it."""
    calls = samples(spark, sf)
    slow = F.when(F.bool_or("hw_slowdown"), F.array(F.lit("hw_slowdown"))).otherwise(F.array().cast("array<string>"))
    states = telemetry(spark, sf).where("phase = 'timed'").join(calls.select("i", "row", "arm"), "i").groupBy("row", "arm").agg(
        F.max("temperature_gpu").alias("hottest"), slow.alias("throttled"))
    p = Q.latency_percentiles(calls, ("row", "arm"), ("total_ms",)).select("row", "arm", "p50", "p99")
    return R.arms_table(p, states, layout(spark, "row", PATHS), "stock", "tuned")


DECISIONS = (("route10", 10), ("turn_complete", 2), ("barge_in", 3))
LEVELS = ("noise_000", "noise_010", "noise_020")
SQL_LEVELS = " UNION ALL ".join(
    f"SELECT decision, '{level}' AS level, accuracy, macro_f1 FROM (WITH {D.sql_scored(m, d)}, s2 AS (SELECT *, pred AS top FROM s) {sql_table(repr(d) + ' AS decision', k, 's2')})"
    for d, k in DECISIONS for m, level in zip("ab", LEVELS))


@query("report_noise", f"""WITH lv AS ({SQL_LEVELS}), cl AS (SELECT decision, level, {sql_fixed('macro_f1', 3)} || ' (' || {sql_fixed('accuracy', 3)} || ')' AS cell FROM lv)
SELECT decision, {", ".join(f"coalesce(max(cell) FILTER (level = '{level}'), 'TODO') AS {level}" for level in LEVELS)}
FROM {sql_layout('decision', [d for d, _ in DECISIONS] + ['escalate'])} LEFT JOIN cl USING (decision) GROUP BY 1""")
def report_noise(spark, sf):
    """Model a stands for clean inputs and b for noisy ones; the third level and `escalate` have no results."""
    both = reduce(DataFrame.unionByName, [rows(spark, sf, m, d) for m in "ab" for d, _ in DECISIONS])
    t = r6(M.score_table(both, 10), *METRIC_COLS)
    level = F.when(F.col("model") == "a", LEVELS[0]).otherwise(LEVELS[1])
    cells = t.select("decision", level.alias("level"), R.pair_cell(F.col("macro_f1"), F.col("accuracy")).alias("cell"))
    return R.pivot(cells, layout(spark, "decision", [d for d, _ in DECISIONS] + ["escalate"]), ["decision"], "level", LEVELS)


SHOWN = (("route10", "macro_f1"), ("route10", "accuracy"), ("route10", "ece"), ("route10", "hard_accuracy"))


@query("report_paired", f"""WITH ps AS (SELECT 'a' AS a, 'b' AS b, 'route10_' || metric AS k, {sql_fixed('difference', 3, '+')} || ' [' || {sql_fixed('lo', 3, '+')} || ', ' || {sql_fixed('hi', 3, '+')} || ']' AS cell
 FROM ({SQL['paired_bootstrap']}) JOIN ({SQL['paired_points']}) USING (metric))
SELECT l.a, l.b, {", ".join(f"coalesce(max(cell) FILTER (k = '{d}_{m}'), 'TODO') AS {d}_{m}" for d, m in SHOWN)}
FROM (SELECT 'a' AS a, unnest(['b', 'c']) AS b) l LEFT JOIN ps ON ps.a = l.a AND ps.b = l.b GROUP BY 1, 2""")
def report_paired(spark, sf):
    both = rows(spark, sf).unionByName(rows(spark, sf, model="b"))
    pairs = spark.createDataFrame([("route10", "a", "b"), ("route10", "a", "c")], "decision string, a string, b string")
    points = M.score_table(both, 10).select("model", "decision", *B.METRICS)
    d = B.paired_differences(B.replicates(both, K.BOOTSTRAP_SAMPLES, K.BOOTSTRAP_SEED, 10), points, pairs)
    return R.paired_table(r6(d, "difference", "lo", "hi"), pairs.select("a", "b"), SHOWN)


def sql_operating(m: str) -> str:
    ic = SQL_IC.replace(SQL_BARGE3, D.sql_scored(m, "barge_in"))
    yc = SQL_YC.replace(SQL_BIN2, D.sql_scored(m, "turn_complete"))
    pick = lambda c, rate: f"o AS (SELECT min(i) FILTER ({rate} <= 0.05) AS k FROM {c} WHERE split = 'calib')"
    at = lambda c, cols: f"SELECT t.theta, k IS NOT NULL AS feasible, {cols} FROM o JOIN {c} t ON t.split = 'test' AND t.i = coalesce(k, 200)"
    return f"""SELECT '{m}' AS model, x.theta AS ti, x.feasible AS fi, x.false_stop, x.missed, y.theta AS ty, y.feasible AS fy, y.premature, y.fallback * 1700 AS delay
 FROM (WITH {ic}, {pick('ic', 'false_stop')} {at('ic', 't.false_stop, t.missed')}) x, (WITH {yc}, {pick('yc', 'premature')} {at('yc', 't.premature, t.fallback')}) y"""


@query("report_operating", f"""WITH op AS ({sql_operating('a')} UNION ALL {sql_operating('b')}), m AS {sql_layout('model', 'abc')}
SELECT model, coalesce(printf('%.3f', ti) || CASE WHEN fi THEN '' ELSE ' (target unreachable)' END, 'TODO') AS theta_interrupt,
 coalesce({sql_fixed('false_stop', 3)}, 'TODO') AS false_stop, coalesce({sql_fixed('missed', 3)}, 'TODO') AS missed,
 coalesce(printf('%.3f', ty) || CASE WHEN fy THEN '' ELSE ' (target unreachable)' END, 'TODO') AS theta_yield,
 coalesce({sql_fixed('premature', 3)}, 'TODO') AS premature, coalesce({sql_fixed('delay', 0)}, 'TODO') AS added_delay_ms FROM m LEFT JOIN op USING (model)""")
def report_operating(spark, sf):
    both = lambda d: rows(spark, sf, decision=d).unionByName(rows(spark, sf, model="b", decision=d))
    by = ("split", "model")

    def at(curve, rate, limit):
        choice = G.choose_operating_point(curve.where("split = 'calib'"), rate, limit, by)
        return G.apply_operating_point(choice, curve.where("split = 'test'"), ("model",))

    i = at(G.interrupt_curve(both("barge_in"), by=by), "false_stop", K.TARGET_FALSE_STOP)
    y = at(G.yield_curve(both("turn_complete"), by=by), "premature", K.TARGET_PREMATURE)
    return R.operating_table(i, y, layout(spark, "model", "abc"))
