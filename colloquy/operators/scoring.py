"""Scores of model predictions. One aggregation into small cells feeds every metric.

Input predictions: (model, decision, id, logits ARRAY<DOUBLE>, y, hard [, temperature]).
"""
import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy import constants as K
from colloquy.functions import probs as P

KEY = ["model", "decision"]


def bin_edges(n_bins: int) -> list[float]:
    return [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)]


def bin_index(conf: Column, n_bins: int) -> Column:
    """0-based bin of [0, 1/n], then (lo, hi], by comparison with the literal edges."""
    return sum((F.when(conf > F.lit(e), 1).otherwise(0) for e in bin_edges(n_bins)[1:-1]),
               F.lit(0))


def score_rows(pred: DataFrame, n_bins: int = K.ECE_BINS, temperature=1.0, theta=None
               ) -> DataFrame:
    """Adds p, top, pred, conf, bin and sq to each row. `theta` thresholds the binary p_true."""
    p = P.softmax(F.col("logits"), temperature)
    s = pred.withColumn("p", p).withColumn("top", P.argmax_first(F.col("p"))).withColumn(
        "conf", F.array_max("p"))
    if theta is None:
        chosen = F.col("top")
    else:
        t = theta if isinstance(theta, Column) else F.lit(float(theta))
        chosen = F.when(t.isNull(), F.col("top")).when(
            F.size("p") != 2, F.raise_error(F.lit("a threshold needs a binary decision")
                                            ).cast("int")).otherwise(
            (F.get("p", F.lit(1)) >= t).cast("int"))
    return s.withColumn("pred", chosen).withColumn("bin", bin_index(F.col("conf"), n_bins)
                                                   ).withColumn("sq", P.brier_row(F.col("p"),
                                                                                  F.col("y")))


def cells(rows: DataFrame, by=()) -> DataFrame:
    """(keys, k, y, pred, top, bin, hard) -> n, conf_sum, sq_sum."""
    return rows.groupBy(*KEY, *by, F.size("logits").alias("k"), "y", "pred", "top", "bin", "hard"
                        ).agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("conf_sum"),
                              F.sum("sq").alias("sq_sum"))


def confusion(c: DataFrame) -> DataFrame:
    """(model, decision, y, pred, n) with zero cells."""
    have = c.groupBy(*KEY, "y", "pred").agg(F.sum("n").alias("n"))
    kinds = c.groupBy(*KEY).agg(F.max("k").alias("k"))
    last = F.col("k") - 1
    grid = kinds.withColumn("y", F.explode(F.sequence(F.lit(0), last))).withColumn(
        "pred", F.explode(F.sequence(F.lit(0), last))).drop("k")
    return grid.join(have, [*KEY, "y", "pred"], "left").na.fill(0, ["n"])


def per_class(c: DataFrame) -> DataFrame:
    """(model, decision, class_idx, support, tp, fp, fn, precision, recall, f1); NULL where
    undefined."""
    both = c.select(*KEY, "n", F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.lit(True).alias("gold"), (F.col("y") == F.col("pred")
                                                                    ).alias("hit")),
        F.struct(F.col("pred").alias("c"), F.lit(False).alias("gold"), (F.col("y") == F.col("pred")
                                                                       ).alias("hit")))).alias("e"))
    g = both.groupBy(*KEY, F.col("e.c").alias("class_idx")).agg(
        F.sum(F.when(F.col("e.gold"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("e.gold") & F.col("e.hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("e.gold"), F.col("n")).otherwise(0)).alias("predicted"))
    kinds = c.groupBy(*KEY).agg(F.max("k").alias("k")).select(*KEY, F.explode(F.sequence(
        F.lit(0), F.col("k") - 1)).alias("class_idx"))
    g = kinds.join(g, [*KEY, "class_idx"], "left").na.fill(0)
    fp, fn = F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")
    return g.select(
        *KEY, "class_idx", "support", "tp", fp.alias("fp"), fn.alias("fn"),
        F.try_divide("tp", "predicted").alias("precision"),
        F.try_divide("tp", "support").alias("recall"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + fp + fn).alias("f1"))


def macro_f1(classes: DataFrame) -> DataFrame:
    return classes.groupBy(*KEY).agg(F.avg("f1").alias("macro_f1"))


def accuracy(c: DataFrame) -> DataFrame:
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    return c.groupBy(*KEY).agg(F.sum("n").alias("n"), (F.sum(hit) / F.sum("n")).alias("accuracy"))


def reliability(c: DataFrame, n_bins: int = K.ECE_BINS) -> DataFrame:
    """(model, decision, bin, lo, hi, n, mean_conf, acc); empty bins stay, with NULLs."""
    g = c.groupBy(*KEY, "bin").agg(
        F.sum("n").alias("n"), (F.sum("conf_sum") / F.sum("n")).alias("mean_conf"),
        (F.sum(F.when(F.col("y") == F.col("top"), F.col("n")).otherwise(0)) / F.sum("n")
         ).alias("acc"))
    edges = F.array(*[F.lit(e) for e in bin_edges(n_bins)])
    grid = c.select(*KEY).distinct().withColumn("bin", F.explode(F.sequence(
        F.lit(0), F.lit(n_bins - 1))))
    return grid.join(g, [*KEY, "bin"], "left").na.fill(0, ["n"]).withColumn(
        "lo", F.get(edges, F.col("bin"))).withColumn("hi", F.get(edges, F.col("bin") + 1))


def ece(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("acc") - F.col("mean_conf")) * F.col("n")
    return bins.groupBy(*KEY).agg(F.try_divide(F.sum(gap), F.sum("n")).alias("ece"))


def brier(c: DataFrame) -> DataFrame:
    return c.groupBy(*KEY).agg((F.sum("sq_sum") / F.sum("n")).alias("brier"))


def wilson(successes: Column, n: Column, z: float = K.Z95) -> tuple[Column, Column]:
    phat = successes / n
    denom = 1 + F.lit(z * z) / n
    centre = (phat + F.lit(z * z) / (2 * n)) / denom
    half = z * F.sqrt(phat * (1 - phat) / n + F.lit(z * z) / (4 * n * n)) / denom
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def score_table(rows: DataFrame, max_k: int, n_bins: int = K.ECE_BINS, by=()) -> DataFrame:
    """Every metric, one row per (model, decision, *by), from a single pass over the rows."""
    c = cells(rows, by)
    n = F.col("n")

    def total(cond, v=n):
        return F.sum(F.when(cond, v).otherwise(0))

    hit = F.col("y") == F.col("pred")
    aggs = [F.sum(n).alias("n"), total(hit).alias("_hit"), F.sum("conf_sum").alias("_conf"),
            F.sum("sq_sum").alias("_sq"), total(F.col("hard")).alias("hard_n"),
            total(F.col("hard") & hit).alias("_hh"),
            F.array(*[total((F.col("y") == i) & hit) for i in range(max_k)]).alias("_tp"),
            F.array(*[total(F.col("y") == i) for i in range(max_k)]).alias("_sup"),
            F.array(*[total(F.col("pred") == i) for i in range(max_k)]).alias("_pre"),
            F.array(*[F.abs(total((F.col("bin") == i) & (F.col("y") == F.col("top")))
                            - F.sum(F.when(F.col("bin") == i, F.col("conf_sum")).otherwise(0.0)))
                      for i in range(n_bins)]).alias("_gap")]
    g = c.groupBy(*KEY, *by).agg(*aggs)
    f1 = F.filter(F.transform(F.arrays_zip("_tp", "_sup", "_pre"), lambda s: F.try_divide(
        2 * s["_tp"], s["_sup"] + s["_pre"])), lambda x: x.isNotNull())
    lo, hi = wilson(F.col("_hit"), F.col("n"))
    return g.select(
        *KEY, *by, "n", (F.col("_hit") / F.col("n")).alias("accuracy"), lo.alias("acc_lo"),
        hi.alias("acc_hi"),
        F.try_divide(F.aggregate(f1, F.lit(0.0), lambda a, x: a + x), F.size(f1)).alias("macro_f1"),
        (F.aggregate("_gap", F.lit(0.0), lambda a, x: a + x) / F.col("n")).alias("ece"),
        (F.col("_sq") / F.col("n")).alias("brier"),
        (F.col("_conf") / F.col("n")).alias("mean_confidence"), "hard_n",
        F.try_divide("_hh", "hard_n").alias("hard_accuracy"))


def per_stratum(rows: DataFrame, columns) -> DataFrame:
    """n and accuracy overall and per value of each column, in one pass (grouping sets)."""
    small = rows.groupBy(*KEY, *columns).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == F.col("pred")).alias("h"))
    sets = [[F.col(k) for k in KEY]] + [[F.col(k) for k in (*KEY, c)] for c in columns]
    return small.groupingSets(sets, *KEY, *columns).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"),
        (F.sum("h") / F.sum("n")).alias("accuracy"))


def class_prior(train: DataFrame, k: int) -> DataFrame:
    """(decision, prior ARRAY): class shares of the split."""
    n = F.count(F.lit(1))
    return train.groupBy("decision").agg(F.array(*[
        F.count_if(F.col("y") == i) / n for i in range(k)]).alias("prior"))


def constant_predictor(train: DataFrame, test: DataFrame, k: int, name: str = "majority"
                       ) -> DataFrame:
    """The class prior as everybody's prediction, as log-probabilities."""
    prior = class_prior(train, k)
    logits = F.transform("prior", lambda p: F.log(F.greatest(p, F.lit(1e-12))))
    return test.join(F.broadcast(prior), "decision").withColumn("logits", logits).withColumn(
        "model", F.lit(name)).drop("prior")


def lexical_rule_model(train: DataFrame, test: DataFrame, branch: str, k: int) -> DataFrame:
    """Add-one smoothed class shares per branch, looked up for each test row."""
    n = F.count(F.lit(1)) + k
    shares = train.groupBy(branch).agg(F.array(*[
        (F.count_if(F.col("y") == i) + 1) / n for i in range(k)]).alias("probs"))
    return test.join(shares, branch, "left")


def nll(pred: DataFrame, temperature=1.0) -> DataFrame:
    return pred.groupBy(*KEY).agg(F.avg(P.nll_row(F.col("logits"), F.col("y"), temperature)
                                        ).alias("nll"), F.count(F.lit(1)).alias("n"))


def _slopes(z: Column, y: Column, b: Column) -> Column:
    """NLL of softmax(b z) at y with its first and second derivative in b, from one pass over the logits."""
    top = F.array_max(z)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def add(acc, x):
        d = x - top
        e = F.exp(b * d)
        return F.struct((acc["s"] + e).alias("s"), (acc["m"] + e * d).alias("m"), (acc["q"] + e * d * d).alias("q"))

    def finish(acc):
        mean, own = acc["m"] / acc["s"], F.get(z, y) - top
        return F.struct((F.log(acc["s"]) - b * own).alias("nll"), (mean - own).alias("d1"), (acc["q"] / acc["s"] - mean * mean).alias("d2"))

    return F.aggregate(z, start, add, finish)


def fit_temperature(pred: DataFrame, bounds=K.TEMPERATURE_BOUNDS, rounds: int = 12) -> DataFrame:
    """Per (model, decision) the temperature with the least mean NLL.

    Safeguarded Newton on u = log(1/T), in which the NLL has one minimum: each round is one aggregate of NLL, slope and curvature
    for all decisions, the first two at the bounds. The slope's sign tells which side of u stays; a step that leaves what is left
    goes to its end, or to its middle if that end was tried before.
    """
    lo0, hi0 = float(np.log(1 / bounds[1])), float(np.log(1 / bounds[0]))
    rows = pred.select(*KEY, "logits", "y")
    state = pred.select(*KEY).distinct().select(*KEY, F.lit(lo0).alias("lo"), F.lit(hi0).alias("hi"), F.lit(False).alias("at_lo"), F.lit(False).alias("at_hi"),
                                                F.lit(hi0).alias("u"))
    start = min(max(0.0, lo0), hi0)
    for r in range(rounds + 1):
        held = ["lo", "hi", "at_lo", "at_hi", "u"]
        x = rows.join(state, KEY).withColumn("_s", _slopes(F.col("logits"), F.col("y"), F.exp("u")))
        x = x.groupBy(*KEY, *held).agg(F.avg("_s.nll").alias("nll_after"), F.avg("_s.d1").alias("d1"), F.avg("_s.d2").alias("d2"), F.count(F.lit(1)).alias("n"))
        if r == rounds:
            break
        beta = F.exp("u")
        slope, bend = beta * F.col("d1"), beta * beta * F.col("d2") + beta * F.col("d1")
        lower = slope > 0  # the minimum lies below u
        x = x.select(*KEY, F.when(lower, F.col("lo")).otherwise(F.col("u")).alias("lo"), F.when(lower, F.col("u")).otherwise(F.col("hi")).alias("hi"),
                     (F.col("at_lo") | ~lower).alias("at_lo"), (F.col("at_hi") | lower).alias("at_hi"),
                     F.when(bend > 0, F.col("u") - slope / bend).otherwise(F.when(lower, lo0 - 1).otherwise(hi0 + 1)).alias("u"), F.col("u").alias("old"))
        if r < 2:  # first the ends: the minimum may lie there
            end = F.when(F.col("old") < hi0, F.when(F.col("at_lo"), F.lit(start)).otherwise(F.lit(lo0))) if r else F.when(F.col("at_hi"), F.lit(lo0))
            state = x.withColumn("u", F.coalesce(end, F.lit(hi0))).drop("old")
            continue
        middle = (F.col("lo") + F.col("hi")) / 2
        still = F.abs(F.col("u") - F.col("old")) < 1e-10  # arrived: stay, whatever rounding says of the sides
        state = x.withColumn("u", F.when(still, F.col("old")).when(F.col("u") <= F.col("lo"), F.when(F.col("at_lo"), middle).otherwise(F.col("lo"))).when(
            F.col("u") >= F.col("hi"), F.when(F.col("at_hi"), middle).otherwise(F.col("hi"))).otherwise(F.col("u"))).drop("old")
    at_bound = (F.abs(F.col("u") - lo0) < 1e-3) | (F.abs(F.col("u") - hi0) < 1e-3)
    before = nll(pred).select(*KEY, F.col("nll").alias("nll_before"))
    return x.select(*KEY, F.exp(-F.col("u")).alias("temperature"), "nll_after", "n",
                    at_bound.alias("at_bound")).join(before, KEY)


def parity(rows: DataFrame, theta: float | None = None) -> DataFrame:
    """Two probability arrays p_ref and p_new on the same row: agreement and differences."""
    diff = F.transform(F.arrays_zip("p_ref", "p_new"), lambda s: F.abs(s["p_ref"] - s["p_new"]))
    r = rows.withColumn("same", P.argmax_first(F.col("p_ref")) == P.argmax_first(F.col("p_new"))
                        ).withColumn("d", diff)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.col("same").cast("double")).alias("agreement"),
            F.count_if(~F.col("same")).alias("disagreements"),
            F.max(F.array_max("d")).alias("max_diff"),
            (F.sum(F.aggregate("d", F.lit(0.0), lambda a, x: a + x)) / F.sum(F.size("d"))
             ).alias("mean_diff")]
    if theta is not None:
        same_side = (F.get("p_ref", F.lit(1)) >= theta) == (F.get("p_new", F.lit(1)) >= theta)
        aggs.append(F.avg(same_side.cast("double")).alias("threshold_agreement"))
    return r.groupBy("set").agg(*aggs)


def parity_verdict(stats: DataFrame, bar: float = K.AGREEMENT_BAR) -> DataFrame:
    return stats.agg(F.min("agreement").alias("worst_agreement"), F.min_by(
        "set", F.struct("agreement", "set")).alias("worst_set"), F.max("max_diff").alias(
        "max_diff"), (F.min("agreement") >= bar).alias("passes"))


def dev_ce(rows: DataFrame) -> DataFrame:
    """(epoch, dev_ce, best): equal mean over tasks of the mean cross-entropy; earliest on a tie."""
    per = rows.groupBy("epoch", "task").agg(F.avg("ce").alias("ce"))
    e = per.groupBy("epoch").agg(F.avg("ce").alias("dev_ce"))
    w = Window.partitionBy(F.lit(1)).orderBy("dev_ce", "epoch")
    return e.withColumn("best", F.row_number().over(w) == 1)


def score_variants(pred: DataFrame, variants: DataFrame, max_k: int) -> DataFrame:
    """One logit set scored under each (variant, temperature, theta) of its decision."""
    v = variants.withColumnRenamed("model", "_m") if "model" in variants.columns else variants
    x = pred.join(F.broadcast(v), "decision").withColumn("model", F.concat_ws("/", "model", "variant"))
    rows = score_rows(x, temperature=F.col("temperature"), theta=F.col("theta"))
    return score_table(rows, max_k)


def paired_guard(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, problem) for rows the two models were not both scored on with the same label."""
    j = a.select("id", F.col("y").alias("ya")).join(
        b.select("id", F.col("y").alias("yb")), "id", "full_outer")
    problem = (F.when(F.col("ya").isNull(), "missing in a").when(F.col("yb").isNull(),
                                                                 "missing in b")
               .when(F.col("ya") != F.col("yb"), "label differs"))
    return j.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def confusion_cells(c: DataFrame) -> DataFrame:
    """(model, decision, confusion): all cells of the confusion as one array, row by row."""
    cell = F.struct("y", "pred", "n")
    return confusion(c).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["n"]).alias("confusion"))


def saved_guard(now: DataFrame, saved: DataFrame, metrics, tolerance: float = 1e-12, exact=()) -> DataFrame:
    """(model, decision, metric) whose saved value the predictions do not reproduce.

    Metrics may differ by `tolerance`, for round-off; the columns of `exact` (a confusion, the fingerprint of the scored rows)
    must be identical. A result that only one side has fails in everything.
    """
    cols = [*metrics, *exact]
    right = saved.select(*KEY, *[F.col(m).alias("_" + m) for m in cols], F.lit(True).alias("_had"))
    j = now.withColumn("_has", F.lit(True)).join(right, KEY, "full_outer")
    known = F.coalesce(F.col("_has") & F.col("_had"), F.lit(False))
    near = {m: F.coalesce(F.abs(F.col(m) - F.col("_" + m)) <= tolerance, F.lit(False)) | (
        F.col(m).isNull() & F.col("_" + m).isNull()) for m in metrics} | {m: F.col(m).eqNullSafe(F.col("_" + m)) for m in exact}
    far = [F.when(known & near[m], F.lit(None)).otherwise(F.lit(m)) for m in cols]
    return j.select(*KEY, F.explode(F.array_compact(F.array(*far))).alias("metric"))
