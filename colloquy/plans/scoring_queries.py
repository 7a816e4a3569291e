"""Scores, calibration, intervals and threshold sweeps over all predictions."""
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from colloquy import constants as K
from colloquy.functions import hashing as H, probs as P, text as T
from colloquy.operators import bootstrap as B, grids as G, lifecycle as C, scoring as O
from colloquy.operators.scale import attach_row, exact_quantiles
from colloquy.plans.registry import SQL, query
from colloquy.plans.text_queries import SQL_BRANCH, SQL_SPOKEN, spoken_types
from colloquy.sources import driver_tables as D

EDGES = O.bin_edges(K.ECE_BINS)
SQL_BIN = "(" + " + ".join(f"(conf > {e!r}::DOUBLE)::INT" for e in EDGES[1:-1]) + ")"
SQL_SQ = "list_sum(list_transform(p, lambda x, i: (x - CASE WHEN i = y + 1 THEN 1.0::DOUBLE ELSE 0.0 END) ** 2))"


def r6(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def rows(spark, sf, model="a", decision="route10", **kw):
    return O.score_rows(D.predictions(spark, sf, model, decision), **kw)


def cells(spark, sf, **kw):
    return O.cells(rows(spark, sf, **kw))


SQL_S = D.sql_scored()
GRID10 = "g AS (SELECT y, pred FROM range(10) a(y), range(10) b(pred))"


@query("confusion", f"""WITH {SQL_S}, {GRID10} SELECT 'a' AS model, 'route10' AS decision, g.y::INT AS y, g.pred::INT AS pred,
 count(s.id) AS n FROM g LEFT JOIN s ON s.y = g.y AND s.pred = g.pred GROUP BY ALL""")
def confusion(spark, sf):
    return O.confusion(cells(spark, sf))


@query("accuracy", f"WITH {SQL_S} SELECT count(*) AS n, round(avg((pred = y)::INT::DOUBLE), 6) AS accuracy FROM s")
def accuracy(spark, sf):
    return r6(O.accuracy(cells(spark, sf)), "accuracy").select("n", "accuracy")


def sql_classes(s: str = "s", k: int = 10) -> str:
    return f"""pc AS (SELECT c AS class_idx, count(*) FILTER (y = c) AS support, count(*) FILTER (y = c AND pred = c) AS tp,
  count(*) FILTER (y <> c AND pred = c) AS fp, count(*) FILTER (y = c AND pred <> c) AS fn FROM range({k}) t(c), {s} GROUP BY 1)"""


@query("per_class", f"""WITH {SQL_S}, {sql_classes()} SELECT class_idx::INT AS class_idx, support, tp, fp, fn,
 round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall,
 round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM pc""")
def per_class(spark, sf):
    return r6(O.per_class(cells(spark, sf)), "precision", "recall", "f1").drop("model", "decision")


@query("macro_f1", f"WITH {SQL_S}, {sql_classes()} SELECT round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE), 6) AS macro_f1 FROM pc")
def macro_f1(spark, sf):
    return r6(O.macro_f1(O.per_class(cells(spark, sf))), "macro_f1").select("macro_f1")


@query("brier", f"WITH {SQL_S} SELECT round(avg({SQL_SQ}), 6) AS brier FROM s")
def brier(spark, sf):
    return r6(O.brier(cells(spark, sf)), "brier").select("brier")


SQL_REL = f"""bins AS (SELECT b, ({EDGES}::DOUBLE[])[b + 1] AS lo, ({EDGES}::DOUBLE[])[b + 2] AS hi FROM range(15) t(b)),
rel AS (SELECT b AS bin, lo, hi, count(s.id) AS n, avg(conf) AS mean_conf, avg((pred = y)::INT::DOUBLE) AS acc
  FROM bins LEFT JOIN s ON conf <= hi AND CASE WHEN b = 0 THEN conf >= lo ELSE conf > lo END GROUP BY 1, 2, 3)"""


@query("reliability_bins", f"WITH {SQL_S}, {SQL_REL} SELECT bin::INT AS bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n, "
       "round(mean_conf, 6) AS mean_conf, round(acc, 6) AS acc FROM rel")
def reliability_bins(spark, sf):
    return r6(O.reliability(cells(spark, sf)), "lo", "hi", "mean_conf", "acc").drop("model", "decision")


SQL_ECE = "(SELECT sum(n * abs(acc - mean_conf)) / sum(n) FROM rel)"


@query("ece", f"WITH {SQL_S}, {SQL_REL} SELECT round({SQL_ECE}, 6) AS ece")
def ece(spark, sf):
    return r6(O.ece(O.reliability(cells(spark, sf))), "ece").select("ece")


def sql_wilson(x: str, n: str) -> tuple[str, str]:
    z2 = repr(K.Z95 * K.Z95) + "::DOUBLE"
    ph = f"({x} / {n}::DOUBLE)"
    c = f"(({ph} + {z2} / (2 * {n})) / (1 + {z2} / {n}))"
    h = f"(1.96::DOUBLE * sqrt({ph} * (1 - {ph}) / {n} + {z2} / (4.0::DOUBLE * {n} * {n})) / (1 + {z2} / {n}))"
    return f"greatest(0.0::DOUBLE, {c} - {h})", f"least(1.0::DOUBLE, {c} + {h})"


_lo, _hi = sql_wilson("x", "n")


@query("wilson_ci", f"""WITH a AS (SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_quantity > 49) AS x
 FROM lineitem GROUP BY 1, 2) SELECT *, round({_lo}, 6) AS lo, round({_hi}, 6) AS hi FROM a""")
def wilson_ci(spark, sf):
    g = D.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 49).alias("x"))
    lo, hi = O.wilson(F.col("x"), F.col("n"))
    return g.withColumn("lo", F.round(lo, 6)).withColumn("hi", F.round(hi, 6))


QS = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("mean_confidence", f"""WITH {D.sql_scored('a', 'turn_complete')} SELECT count(*) AS n, round(avg(conf), 6) AS mean_confidence,
 round(avg((pred = 1)::INT::DOUBLE), 6) AS share_true, {', '.join(f"round(quantile_cont(p[2], {q}), 6) AS q{int(q * 100)}" for q in QS)} FROM s""")
def mean_confidence(spark, sf):
    s = rows(spark, sf, decision="turn_complete").withColumn("pt", F.get("p", F.lit(1)))
    q = exact_quantiles(s, [], "pt", QS)
    a = s.agg(F.round(F.avg("conf"), 6).alias("mean_confidence"),
              F.round(F.avg((F.col("pred") == 1).cast("double")), 6).alias("share_true"))
    return attach_row(a, q).select("n", "mean_confidence", "share_true", *[
        F.round(F.get("q", F.lit(i)), 6).alias(f"q{int(p * 100)}") for i, p in enumerate(QS)])


@query("hard_subset_accuracy", f"WITH {SQL_S} SELECT count(*) FILTER (hard) AS hard_n, round(avg((pred = y)::INT::DOUBLE) FILTER (hard), 6) AS hard_accuracy FROM s")
def hard_subset_accuracy(spark, sf):
    return r6(O.score_table(rows(spark, sf), 10), "hard_accuracy").select("hard_n", "hard_accuracy")


def sql_table(label: str, k: int, s: str = "s", t: str = "") -> str:
    """SELECT of every metric over scored rows `s` (id, y, pred, p, conf, hard, top)."""
    lo, hi = sql_wilson("count(*) FILTER (pred = y)", "count(*)")
    return f"""SELECT {label}, count(*) AS n, round(avg((pred = y)::INT::DOUBLE), 6) AS accuracy,
 round({lo}, 6) AS acc_lo, round({hi}, 6) AS acc_hi,
 (SELECT round(avg(f), 6) FROM (SELECT 2 * count(*) FILTER (y = c AND pred = c) / nullif(count(*) FILTER (y = c) + count(*) FILTER (pred = c), 0)::DOUBLE AS f
   FROM range({k}) t(c), {s} GROUP BY c)) AS macro_f1,
 (SELECT round(sum(g) / max(m), 6) FROM (SELECT abs(count(*) FILTER (top = y) - sum(conf)) AS g, (SELECT count(*) FROM {s}) AS m FROM {s} GROUP BY {SQL_BIN})) AS ece,
 round(avg({SQL_SQ}), 6) AS brier, round(avg(conf), 6) AS mean_confidence, count(*) FILTER (hard) AS hard_n,
 round(avg((pred = y)::INT::DOUBLE) FILTER (hard), 6) AS hard_accuracy FROM {s}"""


METRIC_COLS = ("accuracy", "acc_lo", "acc_hi", "macro_f1", "ece", "brier", "mean_confidence",
               "hard_accuracy")


@query("score_table", f"""WITH {SQL_S}, {D.sql_scored('b', 'route10', 'sb')}, s2 AS (SELECT *, pred AS top FROM s), sb2 AS (SELECT *, pred AS top FROM sb)
{sql_table("'a' AS model", 10, 's2')} UNION ALL {sql_table("'b' AS model", 10, 'sb2')}""")
def score_table(spark, sf):
    both = rows(spark, sf).unionByName(rows(spark, sf, model="b"))
    return r6(O.score_table(both, 10), *METRIC_COLS).drop("decision")


@query("score_table_threshold", f"""WITH {D.sql_scored('a', 'turn_complete')}, s2 AS (SELECT * REPLACE ((p[2] >= 0.6::DOUBLE)::INT AS pred), pred AS top FROM s)
{sql_table("'a' AS model", 2, 's2')}""")
def score_table_threshold(spark, sf):
    s = rows(spark, sf, decision="turn_complete", theta=0.6)
    return r6(O.score_table(s, 2), *METRIC_COLS).drop("decision")


VARIANTS = (("raw", 1.0, None), ("temp", 1.8, None), ("temp_threshold", 1.8, 0.45))


@query("score_variants", " UNION ALL ".join(
    f"""(WITH {D.sql_scored('a', 'turn_complete', t=f'{t!r}::DOUBLE')}, s2 AS (SELECT * REPLACE ({
        f'(p[2] >= {th!r}::DOUBLE)::INT' if th else 'pred'} AS pred), pred AS top FROM s)
{sql_table(f"'a/{v}' AS model", 2, 's2')})""" for v, t, th in VARIANTS))
def score_variants(spark, sf):
    v = spark.createDataFrame([("turn_complete", *x) for x in VARIANTS],
                              "decision string, variant string, temperature double, theta double")
    s = O.score_variants(D.predictions(spark, sf, "a", "turn_complete"), v, 2)
    return r6(s, *METRIC_COLS).drop("decision")


# -- bootstrap ------------------------------------------------------------------------------------

REPS = K.BOOTSTRAP_SAMPLES
_M = "18446744073709551616::UHUGEINT"


def _mix(x: str, shift: int, mul: int) -> str:
    return f"((xor({x}, {x} >> {shift})::UHUGEINT * {mul}::UHUGEINT) % {_M})::UBIGINT"


def sql_replicates(decision: str = "route10", v: str = "", points: bool = False) -> str:
    """CTE {v}lrep(model, b, metric, v) over the replicates, or with `points` over all rows once; {v} starts all names."""
    cuts = " + ".join(f"(u >= {c})::INT" for c in B.poisson_cuts())
    weights = f"{v}kw AS (SELECT id, 0 AS b, 1 AS w FROM {v}s)" if points else f"""
{v}k0 AS (SELECT id, b, ((('0x' || substr(sha256('{K.BOOTSTRAP_SEED}:boot:' || id), 1, 16))::UBIGINT::UHUGEINT
  + (b + 1)::UHUGEINT * {B.GOLDEN}::UHUGEINT) % {_M})::UBIGINT AS z FROM {v}s, range({REPS}) t(b)),
{v}k1 AS (SELECT id, b, {_mix('z', 30, B.MIX1)} AS z FROM {v}k0),
{v}k2 AS (SELECT id, b, {_mix('z', 27, B.MIX2)} AS z FROM {v}k1),
{v}k3 AS (SELECT id, b, xor(z, z >> 31) >> 40 AS u FROM {v}k2),
{v}kw AS (SELECT id, b, {cuts} AS w FROM {v}k3)"""
    return f"""{D.sql_scored('a', decision, v + 's')}, {D.sql_scored('b', decision, v + 'sb')},
{v}am AS (SELECT 'a' AS model, * FROM {v}s UNION ALL SELECT 'b', * FROM {v}sb),
{weights},
{v}x AS (SELECT model, b, w, y, pred, conf, hard, {SQL_BIN} AS bin, {SQL_SQ} AS sq FROM {v}am JOIN {v}kw USING (id)),
{v}x1 AS (SELECT model, b, sum(w) AS n, sum(w * (y = pred)::INT) AS hit, sum(w * sq) AS sq,
  sum(CASE WHEN hard THEN w ELSE 0 END) AS hn, sum(CASE WHEN hard AND y = pred THEN w ELSE 0 END) AS hh FROM {v}x GROUP BY 1, 2),
{v}x2 AS (SELECT model, b, sum(g) AS gap FROM (SELECT model, b, bin, abs(sum(w * ((y = pred)::INT - conf))) AS g FROM {v}x GROUP BY 1, 2, 3) GROUP BY 1, 2),
{v}xc AS (SELECT model, b, y AS c, 2 * sum(CASE WHEN y = pred THEN w ELSE 0 END) AS tp, sum(w) AS s FROM {v}x GROUP BY 1, 2, 3
  UNION ALL SELECT model, b, pred, 0, sum(w) FROM {v}x GROUP BY 1, 2, 3),
{v}x3 AS (SELECT model, b, avg(f) AS f1 FROM (SELECT model, b, c, sum(tp) / nullif(sum(s), 0)::DOUBLE AS f FROM {v}xc GROUP BY 1, 2, 3) GROUP BY 1, 2),
{v}rep AS (SELECT model, b, hit / n::DOUBLE AS accuracy, f1 AS macro_f1, gap / n AS ece, sq / n AS brier, hh / nullif(hn, 0)::DOUBLE AS hard_accuracy
  FROM {v}x1 JOIN {v}x2 USING (model, b) JOIN {v}x3 USING (model, b)),
{v}lrep AS (UNPIVOT {v}rep ON accuracy, macro_f1, ece, brier, hard_accuracy INTO NAME metric VALUE v)"""


def replicate_rows(spark, sf):
    both = rows(spark, sf).unionByName(rows(spark, sf, model="b"))
    return B.replicates(both, REPS, K.BOOTSTRAP_SEED, 10)


@query("bootstrap_ci", f"WITH {sql_replicates()} SELECT model, metric, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM lrep GROUP BY 1, 2")
def bootstrap_ci(spark, sf):
    return r6(B.bootstrap_ci(replicate_rows(spark, sf)), "lo", "hi").drop("decision")


@query("paired_bootstrap", f"""WITH {sql_replicates()}, d AS (SELECT x.metric, x.v - y.v AS d FROM lrep x JOIN lrep y ON x.b = y.b AND x.metric = y.metric
 AND x.model = 'a' AND y.model = 'b') SELECT metric, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi,
 round(avg(CASE WHEN metric IN ('ece','brier') THEN (d >= 0)::INT ELSE (d <= 0)::INT END), 6) AS share_a_not_better FROM d GROUP BY 1""")
def paired_bootstrap(spark, sf):
    pts = O.score_table(rows(spark, sf).unionByName(rows(spark, sf, model="b")), 10)
    pairs = spark.createDataFrame([("route10", "a", "b")], "decision string, a string, b string")
    d = B.paired_differences(replicate_rows(spark, sf), pts.select("model", "decision", *B.METRICS), pairs)
    return r6(d, "lo", "hi", "share_a_not_better").select("metric", "lo", "hi", "share_a_not_better")


@query("paired_points", f"""WITH {sql_replicates(points=True)} SELECT x.metric, round(x.v, 6) AS point_a, round(y.v, 6) AS point_b, round(x.v - y.v, 6) AS difference
FROM lrep x JOIN lrep y ON x.metric = y.metric AND x.model = 'a' AND y.model = 'b'""")
def paired_points(spark, sf):
    pts = O.score_table(rows(spark, sf).unionByName(rows(spark, sf, model="b")), 10)
    pairs = spark.createDataFrame([("route10", "a", "b")], "decision string, a string, b string")
    d = B.paired_differences(replicate_rows(spark, sf), pts.select("model", "decision", *B.METRICS), pairs)
    return r6(d, "point_a", "point_b", "difference").select("metric", "point_a", "point_b", "difference")


@query("paired_guard", """SELECT vec_id AS id, CASE WHEN vec_id % 50 = 7 THEN 'missing in b' ELSE 'label differs' END AS problem
FROM embeddings WHERE vec_id % 50 IN (7, 9)""")
def paired_guard(spark, sf):
    e = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y"))
    other = e.where("id % 50 <> 7").withColumn("y", F.when(F.col("id") % 50 == 9, F.col("y") + 1
                                                           ).otherwise(F.col("y")))
    return O.paired_guard(e, other)


def sql_pair(decision: str, v: str) -> str:
    """CTE {v}pair: model a against model b."""
    return f"""{sql_replicates(decision, v)}, {sql_replicates(decision, v + 'p', points=True)},
{v}q AS (SELECT x.metric, quantile_cont(x.v - y.v, 0.025) AS lo, quantile_cont(x.v - y.v, 0.975) AS hi,
  avg(CASE WHEN x.metric IN ('ece','brier') THEN (x.v - y.v >= 0)::INT ELSE (x.v - y.v <= 0)::INT END) AS share
  FROM {v}lrep x JOIN {v}lrep y ON x.b = y.b AND x.metric = y.metric AND x.model = 'a' AND y.model = 'b' GROUP BY 1),
{v}pair AS (SELECT '{decision}' AS decision, 'a' AS a, 'b' AS b, metric, round(x.v, 6) AS point_a, round(y.v, 6) AS point_b, round(x.v - y.v, 6) AS difference,
  round(lo, 6) AS lo, round(hi, 6) AS hi, round(share, 6) AS share_a_not_better,
  (SELECT count(*) FILTER (metric <> 'hard_accuracy' OR hard) FROM {v}s) AS n
  FROM {v}q JOIN (SELECT * FROM {v}plrep WHERE model = 'a') x USING (metric) JOIN (SELECT * FROM {v}plrep WHERE model = 'b') y USING (metric))"""


@query("paired_sets", f"""WITH {sql_pair('route10', 'r')}, {sql_pair('turn_complete', 't')} SELECT * FROM rpair UNION ALL SELECT * FROM tpair""")
def paired_sets(spark, sf):
    both = reduce(DataFrame.unionByName, [rows(spark, sf, m, d) for m in "ab" for d in ("route10", "turn_complete")])
    pairs = spark.createDataFrame([("route10", "a", "b"), ("turn_complete", "a", "b")], "decision string, a string, b string")
    points = O.score_table(both, 10).select("model", "decision", *B.METRICS)
    return r6(B.paired_sets(both, pairs, points, REPS, K.BOOTSTRAP_SEED, 10), "point_a", "point_b", "difference", "lo", "hi", "share_a_not_better")


# -- calibration ----------------------------------------------------------------------------------

def sql_nll(t: str, y: str = "y") -> str:
    return (f"(list_max(logits) / {t} + ln(list_sum(list_transform(logits, lambda x: exp(x / {t} - list_max(logits) / {t}))))"
            f" - logits[{y} + 1] / {t})")


@query("nll", f"WITH {D.sql_predictions()} SELECT round(avg({sql_nll('1.3::DOUBLE')}), 6) AS nll, count(*) AS n FROM pred")
def nll(spark, sf):
    return r6(O.nll(D.predictions(spark, sf), 1.3), "nll").select("nll", "n")


def sql_fit(pred: str = "pred", v: str = "", rounds: int = 7, points: int = 33) -> str:
    """CTE {v}best(u, nll): the minimum over zooming grids of u = log(1/T), and {v}fp, the calib rows of `pred`."""
    import numpy as np

    lo, hi = float(np.log(1 / 10.0)), float(np.log(1 / 0.25))
    parts = [f"{v}fp AS (SELECT * FROM {pred} WHERE split = 'calib'), {v}sp0 AS (SELECT {lo!r}::DOUBLE AS lo, {hi!r}::DOUBLE AS hi)"]
    for r in range(rounds):
        parts.append(f"""{v}g{r} AS (SELECT i, lo, hi, lo + (hi - lo) / {points - 1} * i AS u FROM {v}sp{r}, range({points}) t(i)),
 {v}v{r} AS (SELECT i, lo, hi, u, avg({sql_nll('exp(-u)')}) AS nll FROM {v}fp, {v}g{r} GROUP BY 1, 2, 3, 4),
 {v}b{r} AS (SELECT * FROM {v}v{r} ORDER BY nll, i LIMIT 1),
 {v}sp{r + 1} AS (SELECT greatest(lo, u - (hi - lo) / {points - 1}) AS lo, least(hi, u + (hi - lo) / {points - 1}) AS hi FROM {v}b{r})""")
    parts.append(f"{v}best AS (SELECT u, nll FROM {v}b{rounds - 1})")
    return ",\n".join(parts)


def sql_fitted(v: str = "") -> str:
    """The row of a fit, rounded."""
    return f"""SELECT round(exp(-u), 4) AS temperature, round(nll, 6) AS nll_after,
 (SELECT round(avg({sql_nll('1.0::DOUBLE')}), 6) FROM {v}fp) AS nll_before, (SELECT count(*) FROM {v}fp) AS n,
 abs(u - ln(0.1::DOUBLE)) < 1e-3 OR abs(u - ln(4.0::DOUBLE)) < 1e-3 AS at_bound FROM {v}best"""


@query("fit_temperature", f"WITH {D.sql_predictions()}, {sql_fit()} {sql_fitted()}")
def fit_temperature(spark, sf):
    f = O.fit_temperature(D.predictions(spark, sf).where("split = 'calib'"))
    return f.select(F.round("temperature", 4).alias("temperature"), F.round("nll_after", 6).alias("nll_after"),
                    F.round("nll_before", 6).alias("nll_before"), "n", "at_bound")


def sql_calibrate_all() -> str:
    from colloquy.plans.quality_queries import sql_fp, sql_row_hash

    names = ("route10", "turn_complete", "barge_in")
    fits = ",\n".join(f"{D.sql_predictions('a', d, f'p{i}')}, {sql_fit(f'p{i}', f'c{i}')}, c{i}fit AS ({sql_fitted(f'c{i}')})" for i, d in enumerate(names))
    table = " UNION ALL ".join(f"SELECT 'a' AS model, '{d}' AS decision, * FROM c{i}fit" for i, d in enumerate(names))
    rows = " UNION ALL ".join(f"SELECT '{d}' AS decision, id, y FROM c{i}fp" for i, d in enumerate(names))
    return f"""WITH {fits}, fits AS ({table}), h AS (SELECT {sql_row_hash(('decision', 'id', 'y'))} AS h FROM ({rows})), fpr AS ({sql_fp('h')}),
q AS (SELECT y, {D.sql_softmax('logits', 't')} AS p FROM (SELECT *, (SELECT exp(-u) FROM c1best) AS t FROM c1fp)), {SQL_G},
tc AS (SELECT i, theta, count(*) AS n, count(*) FILTER (p[2] >= theta AND y = 1) AS tp, count(*) FILTER (p[2] >= theta AND y = 0) AS fp,
  count(*) FILTER (p[2] < theta AND y = 1) AS fn, count(*) FILTER (p[2] < theta AND y = 0) AS tn FROM gr, q GROUP BY 1, 2),
f0 AS (SELECT i, theta, n, 2 * tn / nullif(2 * tn + fn + fp, 0)::DOUBLE AS a, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS b FROM tc),
f AS (SELECT i, theta, n, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END AS score FROM f0), {SQL_PICK}
SELECT fits.*, CASE WHEN decision = 'turn_complete' THEN (SELECT theta FROM pick) END AS theta,
 CASE WHEN decision = 'turn_complete' THEN (SELECT tied FROM pick) END AS tied, (SELECT fingerprint FROM fpr) AS fingerprint FROM fits"""


def calibrate_all(spark, sf):
    """Temperature of every decision, the threshold of the binary one, and the calib fingerprint."""
    from colloquy.operators.lifecycle import fingerprint
    from colloquy.operators.scale import written

    p = D.predictions(spark, sf).unionByName(D.predictions(spark, sf, "a", "turn_complete")
                                             ).unionByName(D.predictions(spark, sf, "a", "barge_in"))
    calib = written(p.where("split = 'calib'"))
    t = written(O.fit_temperature(calib))
    s = O.score_rows(calib.join(t.select("model", "decision", "temperature"), ["model", "decision"]
                                ).where("decision = 'turn_complete'"), temperature=F.col("temperature"))
    theta = G.choose_threshold_f1(s.withColumn("p", F.get("p", F.lit(1)))).select("decision", "theta", "tied")
    found = attach_row(t.join(theta, "decision", "left"), fingerprint(calib.select("decision", "id", "y")).select("fingerprint"))
    return found.withColumns({"temperature": F.round("temperature", 4), "nll_after": F.round("nll_after", 6), "nll_before": F.round("nll_before", 6)})


@query("reliability_before_after", f"""WITH {SQL_S}, {SQL_REL}, r1 AS (SELECT 'before' AS stage, bin, n, mean_conf, acc FROM rel WHERE n > 0),
{D.sql_scored('a', 'route10', 't', '2.0::DOUBLE')}, r2 AS (SELECT b, count(t.id) AS n, avg(conf) AS c, avg((pred = y)::INT::DOUBLE) AS a FROM bins LEFT JOIN t
 ON conf <= hi AND CASE WHEN b = 0 THEN conf >= lo ELSE conf > lo END GROUP BY 1)
SELECT stage, bin::INT AS bin, n, n >= 20 AS shown, round(mean_conf, 6) AS mean_conf, round(acc, 6) AS acc FROM r1
UNION ALL SELECT 'after', b::INT, n, n >= 20, round(c, 6), round(a, 6) FROM r2 WHERE n > 0""")
def reliability_before_after(spark, sf):
    t = F.explode(F.array(F.struct(F.lit("before").alias("stage"), F.lit(1.0).alias("t")),
                          F.struct(F.lit("after").alias("stage"), F.lit(2.0).alias("t"))))
    x = D.predictions(spark, sf).select("*", t.alias("s")).withColumn("model", F.col("s.stage"))
    rel = O.reliability(O.cells(O.score_rows(x, temperature=F.col("s.t")))).where("n > 0")
    return r6(rel.select(F.col("model").alias("stage"), "bin", "n", (F.col("n") >= K.MIN_BIN_DISPLAY).alias("shown"),
                         "mean_conf", "acc"), "mean_conf", "acc")


SQL_P16 = D.sql_softmax("list_transform(logits, lambda x: round(x, 1))")


def parity_rows(spark, sf):
    p = D.predictions(spark, sf)
    low = F.transform("logits", lambda x: F.round(x, 1))
    return p.select("id", F.col("split").alias("set"), P.softmax(F.col("logits")).alias("p_ref"), P.softmax(low).alias("p_new"))


SQL_PAR = f"""{D.sql_predictions()}, q0 AS (SELECT split, {D.sql_softmax('logits')} AS a, {SQL_P16} AS b FROM pred),
q AS (SELECT split, list_position(a, list_max(a)) = list_position(b, list_max(b)) AS same,
  list_transform(a, lambda x, i: abs(x - b[i])) AS d, (a[2] >= 0.1::DOUBLE) = (b[2] >= 0.1::DOUBLE) AS ts FROM q0),
par AS (SELECT split AS "set", count(*) AS n, round(avg(same::INT::DOUBLE), 6) AS agreement, count(*) FILTER (NOT same) AS disagreements,
  round(max(list_max(d)), 6) AS max_diff, round(sum(list_sum(d)) / sum(len(d)), 6) AS mean_diff, round(avg(ts::INT::DOUBLE), 6) AS threshold_agreement
  FROM q GROUP BY 1)"""


@query("parity", f"WITH {SQL_PAR} SELECT * FROM par")
def parity(spark, sf):
    return r6(O.parity(parity_rows(spark, sf), 0.1), "agreement", "max_diff", "mean_diff", "threshold_agreement")


@query("parity_verdict", f"""WITH {SQL_PAR} SELECT min(agreement) AS worst_agreement, (SELECT "set" FROM par ORDER BY agreement, "set" LIMIT 1) AS worst_set,
 max(max_diff) AS max_diff, min(agreement) >= 0.995 AS passes FROM par""")
def parity_verdict(spark, sf):
    return O.parity_verdict(parity(spark, sf))


@query("class_prior", f"""WITH {D.sql_predictions()} SELECT c::INT AS class_idx, round(count(*) FILTER (y = c) / count(*)::DOUBLE, 6) AS share
FROM pred, range(10) t(c) WHERE split = 'train' GROUP BY 1""")
def class_prior(spark, sf):
    p = O.class_prior(D.predictions(spark, sf).where("split = 'train'"), 10)
    return p.select(F.posexplode("prior").alias("class_idx", "share")).withColumn("share", F.round("share", 6))


@query("majority_baseline", f"""WITH {D.sql_predictions()}, pr AS (SELECT y, count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM pred WHERE split = 'train' GROUP BY 1),
top AS (SELECT y FROM pr ORDER BY p DESC, y LIMIT 1)
SELECT count(*) AS n, round(avg((y = (SELECT y FROM top))::INT::DOUBLE), 6) AS accuracy, (SELECT round(max(p), 6) FROM pr) AS mean_confidence FROM pred WHERE split = 'test'""")
def majority_baseline(spark, sf):
    p = D.predictions(spark, sf)
    c = O.constant_predictor(p.where("split = 'train'"), p.where("split = 'test'"), 10)
    return r6(O.score_table(O.score_rows(c), 10), "accuracy", "mean_confidence").select("n", "accuracy", "mean_confidence")


@query("lexical_rule_model", f"""WITH a AS (SELECT event_id, user_id % 3 AS y, {D.split_sql("'u:' || user_id::VARCHAR")} AS split, {D.sql_norm(f'({SQL_SPOKEN})')} AS n FROM events),
b AS (SELECT *, {D.sql_words('n')} AS w FROM a), c AS (SELECT event_id, y, split, {SQL_BRANCH} AS branch FROM b),
m AS (SELECT branch, [round((count(*) FILTER (y = 0) + 1) / (count(*) + 3)::DOUBLE, 6), round((count(*) FILTER (y = 1) + 1) / (count(*) + 3)::DOUBLE, 6),
 round((count(*) FILTER (y = 2) + 1) / (count(*) + 3)::DOUBLE, 6)] AS probs FROM c WHERE split = 'train' GROUP BY 1)
SELECT event_id, branch, probs[1] AS p0, probs[2] AS p1, probs[3] AS p2 FROM c JOIN m USING (branch) WHERE split = 'test'""")
def lexical_rule_model(spark, sf):
    e = D.table(spark, sf, "events")
    x = e.select("event_id", (F.col("user_id") % 3).alias("y"), H.assign_split(
        F.concat(F.lit("u:"), F.col("user_id")), K.SPLIT_SEED, K.SPLIT_FRACTIONS).alias("split"),
        T.lexical_branch(T.normalize_text(spoken_types(F.col("event_type")))).alias("branch"))
    m = O.lexical_rule_model(x.where("split = 'train'"), x.where("split = 'test'"), "branch", 3)
    return m.select("event_id", "branch", *[F.round(F.get("probs", F.lit(i)), 6).alias(f"p{i}") for i in range(3)])


@query("per_stratum", f"""WITH {SQL_S}, a AS (SELECT id, split, hard, y, pred FROM s)
SELECT split, hard, GROUPING(split, hard)::INT AS level, count(*) AS n, round(avg((y = pred)::INT::DOUBLE), 6) AS accuracy FROM a GROUP BY GROUPING SETS ((), (split), (hard))""")
def per_stratum(spark, sf):
    return r6(O.per_stratum(rows(spark, sf), ["split", "hard"]), "accuracy").select("split", "hard", "level", "n", "accuracy")


SQL_CE = f"""{D.sql_predictions()}, ce AS (SELECT e::INT AS epoch, split AS task, {sql_nll('(e * 0.5::DOUBLE)')} AS ce FROM pred, range(1, 6) t(e)),
t1 AS (SELECT epoch, task, avg(ce) AS ce FROM ce GROUP BY 1, 2), t2 AS (SELECT epoch, round(avg(ce), 6) AS dev_ce FROM t1 GROUP BY 1)"""


@query("dev_ce", f"WITH {SQL_CE} SELECT epoch, dev_ce, row_number() OVER (ORDER BY dev_ce, epoch) = 1 AS best FROM t2")
def dev_ce(spark, sf):
    x = D.predictions(spark, sf).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(5))))
    ce = P.nll_row(F.col("logits"), F.col("y"), F.col("epoch") * 0.5)
    return r6(O.dev_ce(x.select("epoch", F.col("split").alias("task"), ce.alias("ce"))), "dev_ce")


@query("scoring_rules", f"""WITH {SQL_S} SELECT id, round(ln(greatest(p[y + 1], 1e-12::DOUBLE)), 6) AS log_score,
 round(p[y + 1] / sqrt(list_sum(list_transform(p, lambda x: x * x))), 6) AS spherical,
 round(list_sum(list_transform(range(1, 10), lambda i: (list_sum(p[1:i]) - CASE WHEN y < i THEN 1.0::DOUBLE ELSE 0.0 END) ** 2)), 6) AS rps FROM s""")
def scoring_rules(spark, sf):
    s = rows(spark, sf)
    return s.select("id", F.round(P.log_score(F.col("p"), F.col("y")), 6).alias("log_score"),
                    F.round(P.spherical_score(F.col("p"), F.col("y")), 6).alias("spherical"),
                    F.round(P.ranked_score(F.col("p"), F.col("y")), 6).alias("rps"))


# -- threshold sweeps -----------------------------------------------------------------------------

SQL_G = "gr AS (SELECT i, i * 5 / 1000.0::DOUBLE AS theta FROM range(201) t(i))"
SQL_BIN2 = D.sql_scored("a", "turn_complete")


def binary(spark, sf):
    return rows(spark, sf, decision="turn_complete").withColumn("p", F.get("p", F.lit(1)))


SQL_TC = f"""{SQL_BIN2}, {SQL_G}, tc AS (SELECT i::INT AS i, theta, count(*) FILTER (p[2] >= theta AND y = 1) AS tp, count(*) FILTER (p[2] >= theta AND y = 0) AS fp,
 count(*) FILTER (p[2] < theta AND y = 1) AS fn, count(*) FILTER (p[2] < theta AND y = 0) AS tn FROM gr, s GROUP BY 1, 2)"""


@query("threshold_counts", f"WITH {SQL_TC} SELECT * FROM tc")
def threshold_counts(spark, sf):
    return G.threshold_counts(binary(spark, sf)).drop("decision")


SQL_PICK = """sc AS (SELECT i, theta, n, score, max(score) OVER () AS best FROM f),
tied AS (SELECT *, count(*) OVER () AS tied, row_number() OVER (ORDER BY i) AS r FROM sc WHERE score >= best - 1e-12),
pick AS (SELECT theta, round(best, 6) AS macro_f1, n, tied FROM tied WHERE r = (tied + 1) // 2)"""


@query("choose_threshold_f1", f"""WITH {SQL_TC}, f0 AS (SELECT i, theta, tp + fp + fn + tn AS n, 2 * tn / nullif(2 * tn + fn + fp, 0)::DOUBLE AS a, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS b FROM tc),
f AS (SELECT i, theta, n, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END AS score FROM f0), {SQL_PICK} SELECT * FROM pick""")
def choose_threshold_f1(spark, sf):
    return r6(G.choose_threshold_f1(binary(spark, sf)), "macro_f1").drop("decision")


SQL_ROUTED = f"""{SQL_S}, {SQL_G}, ia AS (SELECT id, y, p[10] AS po, list_position(p[1:9], list_max(p[1:9])) - 1 AS a FROM s)"""


@query("route_with_oos", f"WITH {SQL_ROUTED} SELECT id, CASE WHEN po >= 0.2::DOUBLE THEN 9 ELSE a END AS route FROM ia")
def route_with_oos(spark, sf):
    return rows(spark, sf).select("id", G.route_with_oos(F.col("p"), 9, 0.2).alias("route"))


@query("choose_oos_threshold", f"""WITH {SQL_ROUTED}, rr AS (SELECT i, theta, y, CASE WHEN po >= theta THEN 9 ELSE a END AS r FROM ia, gr),
f1 AS (SELECT i, theta, c, 2 * count(*) FILTER (y = c AND r = c) / nullif(count(*) FILTER (y = c) + count(*) FILTER (r = c), 0)::DOUBLE AS f FROM rr, range(10) t(c) GROUP BY 1, 2, 3),
f AS (SELECT i, theta, (SELECT count(*) FROM s) AS n, avg(f) AS score FROM f1 GROUP BY 1, 2), {SQL_PICK}
SELECT *, (SELECT round(score, 6) FROM f WHERE i = 100) AS macro_f1_at_half FROM pick""")
def choose_oos_threshold(spark, sf):
    return r6(G.choose_oos_threshold(rows(spark, sf), 9, 10), "macro_f1", "macro_f1_at_half").drop("decision")


SQL_BARGE3 = D.sql_scored("a", "barge_in")
SQL_IC = f"""{SQL_BARGE3}, {SQL_G}, ic AS (SELECT split, i::INT AS i, theta, count(*) FILTER (y <> 1 AND p[2] >= theta) / nullif(count(*) FILTER (y <> 1), 0)::DOUBLE AS false_stop,
 count(*) FILTER (y = 0 AND p[2] >= theta) / nullif(count(*) FILTER (y = 0), 0)::DOUBLE AS false_stop_backchannel,
 count(*) FILTER (y = 1 AND p[2] < theta) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE AS missed FROM s, gr GROUP BY 1, 2, 3)"""


@query("interrupt_curve", f"WITH {SQL_IC} SELECT split, i, theta, round(false_stop, 6) AS false_stop, round(false_stop_backchannel, 6) AS false_stop_backchannel, round(missed, 6) AS missed FROM ic")
def interrupt_curve(spark, sf):
    c = G.interrupt_curve(rows(spark, sf, decision="barge_in"))
    return r6(c, "false_stop", "false_stop_backchannel", "missed")


SQL_YC = f"""{SQL_BIN2}, {SQL_G}, yc AS (SELECT split, i::INT AS i, theta, count(*) FILTER (y = 0 AND p[2] >= theta) / nullif(count(*) FILTER (y = 0), 0)::DOUBLE AS premature,
 count(*) FILTER (y = 1 AND p[2] < theta) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE AS fallback FROM s, gr GROUP BY 1, 2, 3)"""


@query("yield_curve", f"WITH {SQL_YC} SELECT split, i, theta, round(premature, 6) AS premature, round(fallback, 6) AS fallback, round(fallback * 1700, 4) AS added_delay_ms FROM yc")
def yield_curve(spark, sf):
    c = G.yield_curve(rows(spark, sf, decision="turn_complete"))
    return r6(c, "premature", "fallback").withColumn("added_delay_ms", F.round("added_delay_ms", 4))


@query("choose_operating_point", f"""WITH {SQL_IC}, o AS (SELECT split, min(i) FILTER (false_stop <= 0.05) AS k FROM ic GROUP BY 1)
SELECT split, i, theta, round(false_stop, 6) AS rate, k IS NOT NULL AS feasible FROM ic JOIN o USING (split) WHERE i = coalesce(k, 200)""")
def choose_operating_point(spark, sf):
    c = G.interrupt_curve(rows(spark, sf, decision="barge_in"))
    return r6(G.choose_operating_point(c, "false_stop", K.TARGET_FALSE_STOP), "rate")


@query("apply_operating_point", f"""WITH {SQL_YC}, o AS (SELECT coalesce(min(i) FILTER (premature <= 0.05), 200) AS k, count(*) FILTER (premature <= 0.05) > 0 AS feasible FROM yc WHERE split = 'calib')
SELECT t.split, t.theta, round(c.premature, 6) AS calib_rate, feasible, round(t.premature, 6) AS premature, round(t.fallback, 6) AS fallback, round(t.fallback * 1700, 4) AS added_delay_ms
FROM o JOIN yc c ON c.split = 'calib' AND c.i = k JOIN yc t ON t.split = 'test' AND t.i = k""")
def apply_operating_point(spark, sf):
    c = G.yield_curve(rows(spark, sf, decision="turn_complete"))
    choice = G.choose_operating_point(c.where("split = 'calib'"), "premature", K.TARGET_PREMATURE)
    a = G.apply_operating_point(choice, c.where("split = 'test'"))
    return r6(a, "calib_rate", "premature", "fallback").withColumn("added_delay_ms", F.round("added_delay_ms", 4))


SQL_CHOSEN = f"""{SQL_IC}, {SQL_YC.replace(SQL_BIN2, D.sql_scored('a', 'turn_complete', 'z')).replace('FROM s, gr', 'FROM z, gr').replace(SQL_G + ', ', '')}"""


@query("served_policy", f"""WITH {SQL_CHOSEN}
SELECT 'a' AS checkpoint, (SELECT coalesce(min(theta) FILTER (false_stop <= 0.05), 1.0) FROM ic WHERE split = 'calib') AS theta_interrupt,
 (SELECT coalesce(min(theta) FILTER (premature <= 0.05), 1.0) FROM yc WHERE split = 'calib') AS theta_yield,
 (SELECT theta FROM ({SQL['choose_threshold_f1']})) AS theta_escalate, (SELECT theta FROM ({SQL['choose_oos_threshold']})) AS theta_oos,
 'barge_in:false_stop' AS source_interrupt, 'turn_complete:premature' AS source_yield, 'turn_complete:macro_f1' AS source_escalate, 'route10:macro_f1' AS source_oos""")
def served_policy(spark, sf):
    """The four thresholds of model a; its name stands for the checkpoint that each result was computed with."""
    by = ("split", "model")
    i = G.choose_operating_point(G.interrupt_curve(rows(spark, sf, decision="barge_in").where("split = 'calib'"), by=by), "false_stop", K.TARGET_FALSE_STOP, by)
    y = G.choose_operating_point(G.yield_curve(rows(spark, sf, decision="turn_complete").where("split = 'calib'"), by=by), "premature", K.TARGET_PREMATURE, by)
    esc = G.choose_threshold_f1(binary(spark, sf), by=("model",))
    oos = G.choose_oos_threshold(rows(spark, sf), 9, 10, by=("model",))
    found = {"theta_interrupt": (i, "barge_in:false_stop"), "theta_yield": (y, "turn_complete:premature"),
             "theta_escalate": (esc, "turn_complete:macro_f1"), "theta_oos": (oos, "route10:macro_f1")}
    timed = lambda name, ms: F.lit(ms if name == "theta_yield" else None).cast("double")
    parts = reduce(DataFrame.unionByName, [df.select(
        F.lit(name).alias("name"), "theta", F.lit(source).alias("source"), F.col("model").alias("checkpoint"),
        timed(name, K.VAD_PAUSE_MS).alias("vad_pause_ms"), timed(name, K.MAX_WAIT_MS).alias("max_wait_ms")) for name, (df, source) in found.items()])
    get = lambda m, k: F.element_at(m, F.lit(k))
    return G.served_policy(parts).select("checkpoint", *[get("thetas", k).alias(k) for k in G.SERVED],
                                         *[get("sources", k).alias(k.replace("theta", "source")) for k in G.SERVED])


SQL_FEW = "(SELECT * FROM {} WHERE substr(id, 5)::BIGINT % 50 <> 7)"


def sql_saved(model: str, decision: str, s: str) -> str:
    """What differs between the scores of all rows and of those that were there before every 50th came."""
    few = SQL_FEW.format(s)
    conf = lambda t: f"(SELECT list(n ORDER BY y, pred) FROM (SELECT y, pred, count(*) AS n FROM {t} GROUP BY 1, 2))"
    acc = lambda t: f"(SELECT avg((y = pred)::INT::DOUBLE) FROM {t})"
    br = lambda t: f"(SELECT avg({SQL_SQ}) FROM {t})"
    ids = lambda t: f"(SELECT string_agg(id || '=' || y::VARCHAR, ',' ORDER BY id) FROM {t})"
    tests = (("accuracy", f"abs({acc(s)} - {acc(few)}) > 1e-12"), ("brier", f"abs({br(s)} - {br(few)}) > 1e-12"),
             ("confusion", f"{conf(s)} <> {conf(few)}"), ("fingerprint", f"{ids(s)} <> {ids(few)}"))
    return " UNION ALL ".join(f"SELECT '{model}' AS model, '{decision}' AS decision, '{m}' AS metric WHERE {c}" for m, c in tests)


@query("saved_guard", f"""WITH {SQL_S}, {D.sql_scored('b', 'route10', 'sb')} {sql_saved('b', 'route10', 'sb')}
UNION ALL SELECT 'a', 'barge_in', unnest(['accuracy', 'brier', 'confusion', 'fingerprint'])""")
def saved_guard(spark, sf):
    """Model a is saved as it scores, b as it scored before every 50th row came; a's barge_in has no saved result."""
    a, b, c = rows(spark, sf), rows(spark, sf, model="b"), rows(spark, sf, decision="barge_in")

    def results(parts):
        both = reduce(DataFrame.unionByName, parts)
        found = O.score_table(both, 10).select(*O.KEY, "accuracy", "brier").join(O.confusion_cells(O.cells(both)), O.KEY)
        return found.join(C.fingerprint(both, ("id", "y"), by=O.KEY).select(*O.KEY, "fingerprint"), O.KEY)

    before = b.where("cast(substring(id, 5) as bigint) % 50 <> 7")
    return O.saved_guard(results([a, b, c]), results([a, before]), ("accuracy", "brier"), exact=("confusion", "fingerprint"))


query("calibrate_all", sql_calibrate_all())(calibrate_all)  # its SQL uses the sweep's, above
