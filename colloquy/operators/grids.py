"""Threshold sweeps: rows fall once into the bucket of the largest grid point <= p, then suffix sums
over the 201 buckets give every count at every threshold."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy import constants as K

LAST = K.GRID_POINTS - 1


def theta(i: Column) -> Column:
    """Grid point i: 0.000 to 1.000 in steps of 0.005, the double nearest to the decimal."""
    return (i * 5) / F.lit(1000.0)


def bucket(p: Column) -> Column:
    """Index of the largest grid point <= p. The guess is corrected against the grid's own values."""
    g = F.floor(p * 200.0).cast("int")
    g = F.least(F.greatest(g, F.lit(0)), F.lit(LAST))
    down = F.when(theta(g) > p, 1).otherwise(0)
    up = F.when((g < LAST) & (theta(g + 1) <= p), 1).otherwise(0)
    return g - down + up


def _grid(df: DataFrame, by) -> DataFrame:
    return df.select(*by).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(LAST))))


def suffix_counts(rows: DataFrame, p: Column, groups: dict[str, Column], by=("decision",)
                  ) -> DataFrame:
    """(by, i, theta, <g>_at, <g>_all): rows of each group with p >= theta, and in total."""
    by = list(by)
    b = rows.withColumn("_b", bucket(p)).groupBy(*by, "_b").agg(*[
        F.count_if(c).alias(g) for g, c in groups.items()])
    j = _grid(rows, by).join(b.withColumnRenamed("_b", "i"), [*by, "i"], "left").na.fill(
        0, list(groups))
    up = Window.partitionBy(*by).orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*by)
    return j.select(*by, "i", theta(F.col("i")).alias("theta"), *[
        F.sum(g).over(up).alias(g + "_at") for g in groups], *[
        F.sum(g).over(whole).alias(g + "_all") for g in groups])


def threshold_counts(rows: DataFrame, by=("decision",)) -> DataFrame:
    """tp/fp/fn/tn at every theta for (p, y in {0, 1}); p >= theta is positive."""
    c = suffix_counts(rows, F.col("p"), {"pos": F.col("y") == 1, "neg": F.col("y") == 0}, by)
    return c.select(*by, "i", "theta", F.col("pos_at").alias("tp"), F.col("neg_at").alias("fp"),
                    (F.col("pos_all") - F.col("pos_at")).alias("fn"),
                    (F.col("neg_all") - F.col("neg_at")).alias("tn"))


def _f1(tp, fp, fn) -> Column:
    return F.try_divide(2 * tp, 2 * tp + fp + fn)


def _mean_defined(scores) -> Column:
    kept = F.filter(F.array(*scores), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept))


def _median_of_ties(scored: DataFrame, by) -> DataFrame:
    """The lower median theta among grid points within 1e-12 of the best score."""
    by = list(by)
    top = scored.withColumn("best", F.max("score").over(Window.partitionBy(*by))).where(
        F.col("score") >= F.col("best") - 1e-12)
    w = Window.partitionBy(*by)
    r = top.withColumn("tied", F.count(F.lit(1)).over(w)).withColumn(
        "_r", F.row_number().over(w.orderBy("i")))
    return r.where(F.col("_r") == F.expr("(tied + 1) div 2")).select(
        *by, "theta", F.col("best").alias("macro_f1"), "n", "tied")


def choose_threshold_f1(rows: DataFrame, by=("decision",)) -> DataFrame:
    c = threshold_counts(rows, by)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    s = c.withColumn("score", _mean_defined([_f1(tn, fn, fp), _f1(tp, fp, fn)])).withColumn(
        "n", tp + fp + fn + tn)
    return _median_of_ties(s, by)


def route_with_oos(p: Column, oos: int, cut) -> Column:
    """The out-of-scope class when its probability reaches the cut, else the in-scope argmax."""
    from colloquy.functions.probs import argmax_excluding

    t = cut if isinstance(cut, Column) else F.lit(float(cut))
    return F.when(F.get(p, F.lit(oos)) >= t, oos).otherwise(argmax_excluding(p, oos))


def oos_scores(rows: DataFrame, oos: int, k: int, by=("decision",)) -> DataFrame:
    """(by, i, theta, n, score): macro-F1 over k classes of the routed output at every theta.

    Counts per (bucket of p_oos, y, in-scope argmax) are all the sweep needs.
    """
    from colloquy.functions.probs import argmax_excluding

    by = list(by)
    small = rows.withColumn("_b", bucket(F.get("p", F.lit(oos)))).withColumn(
        "_a", argmax_excluding(F.col("p"), oos)).groupBy(*by, "_b", "y", "_a").agg(
        F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    cols, aggs = [], []
    for c in range(k):
        same = F.col("y") == c
        aggs.append(F.sum(F.when(same, n).otherwise(0)).alias(f"y{c}"))
        if c != oos:
            aggs.append(F.sum(F.when(F.col("_a") == c, n).otherwise(0)).alias(f"a{c}"))
            aggs.append(F.sum(F.when(same & (F.col("_a") == c), n).otherwise(0)).alias(f"h{c}"))
            cols += [f"a{c}", f"h{c}"]
        cols.append(f"y{c}")
    b = small.groupBy(*by, "_b").agg(F.sum("n").alias("n"), *aggs)
    j = _grid(rows, by).join(b.withColumnRenamed("_b", "i"), [*by, "i"], "left").na.fill(
        0, ["n", *cols])
    up = Window.partitionBy(*by).orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    down = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    f = []
    for c in range(k):
        support = F.sum(f"y{c}").over(whole)
        if c == oos:
            predicted, tp = F.sum("n").over(up), F.sum(f"y{c}").over(up)
        else:   # in-scope classes are predicted for rows below the cut
            predicted = F.coalesce(F.sum(f"a{c}").over(down), F.lit(0))
            tp = F.coalesce(F.sum(f"h{c}").over(down), F.lit(0))
        f.append(F.try_divide(2 * tp, support + predicted))
    return j.select(*by, "i", theta(F.col("i")).alias("theta"), F.sum("n").over(whole).alias("n"),
                    F.array(*f).alias("_f")).withColumn("score", _mean_defined(
                        [F.get("_f", F.lit(c)) for c in range(k)])).drop("_f")


def choose_oos_threshold(rows: DataFrame, oos: int, k: int, by=("decision",)) -> DataFrame:
    s = oos_scores(rows, oos, k, by)
    at_half = s.where("i = 100").select(*by, F.col("score").alias("macro_f1_at_half"))
    return _median_of_ties(s, by).join(at_half, list(by))


def interrupt_curve(rows: DataFrame, interruption: int = 1, backchannel: int = 0, by=("split",)
                    ) -> DataFrame:
    """Per theta: false stops over non-interruptions and over backchannels, missed interruptions."""
    c = suffix_counts(rows, F.get("p", F.lit(interruption)), {
        "other": F.col("y") != interruption, "bc": F.col("y") == backchannel,
        "int": F.col("y") == interruption}, by)
    return c.select(*by, "i", "theta", F.try_divide("other_at", "other_all").alias("false_stop"),
                    F.try_divide("bc_at", "bc_all").alias("false_stop_backchannel"),
                    (1 - F.try_divide("int_at", "int_all")).alias("missed"))


def yield_curve(rows: DataFrame, vad_pause_ms: float = K.VAD_PAUSE_MS,
                max_wait_ms: float = K.MAX_WAIT_MS, by=("split",)) -> DataFrame:
    c = suffix_counts(rows, F.get("p", F.lit(1)), {"done": F.col("y") == 1,
                                                   "open": F.col("y") == 0}, by)
    fallback = 1 - F.try_divide("done_at", "done_all")
    return c.select(*by, "i", "theta", F.try_divide("open_at", "open_all").alias("premature"),
                    fallback.alias("fallback"),
                    (fallback * (max_wait_ms - vad_pause_ms)).alias("added_delay_ms"))


def choose_operating_point(curve: DataFrame, rate: str, limit: float, by=("split",)) -> DataFrame:
    """The smallest theta with rate <= limit; the last theta, marked infeasible, if there is none."""
    ok = F.col(rate) <= limit
    at = F.struct("i", "theta", F.col(rate).alias("rate"))
    g = curve.groupBy(*by).agg(
        F.min_by(at, F.when(ok, F.col("i"))).alias("first"), F.max_by(at, "i").alias("last"),
        F.coalesce(F.bool_or(ok), F.lit(False)).alias("feasible"))
    pick = F.when(F.col("feasible"), F.col("first")).otherwise(F.col("last"))
    return g.select(*by, pick["i"].alias("i"), pick["theta"].alias("theta"),
                    pick["rate"].alias("rate"), "feasible")


def apply_operating_point(calib_choice: DataFrame, test_curve: DataFrame, by=()) -> DataFrame:
    """What the theta chosen on calib does on test, per `by`."""
    return calib_choice.select(*by, "i", F.col("rate").alias("calib_rate"), "feasible").join(
        test_curve, [*by, "i"]).drop("i")


SERVED = ("theta_interrupt", "theta_yield", "theta_escalate", "theta_oos")


def served_policy(parts: DataFrame, vad_pause_ms: int = K.VAD_PAUSE_MS, max_wait_ms: int = K.MAX_WAIT_MS) -> DataFrame:
    """(checkpoint, thetas, sources): the four thresholds a deployment serves, each with the result it was read from.

    parts: (name, theta, source, checkpoint, vad_pause_ms, max_wait_ms); the timings are those a curve was drawn with, NULL for
    thresholds that have none. Fails when one of the four is absent, or they stand on different checkpoints (written with either
    slash, with or without a last one), or a curve was drawn with other timings than the policy's.
    """
    same = F.regexp_replace(F.regexp_replace("checkpoint", r"\\", "/"), "/+$", "")
    other = ~(F.coalesce("vad_pause_ms", F.lit(vad_pause_ms)) == vad_pause_ms) | ~(F.coalesce("max_wait_ms", F.lit(max_wait_ms)) == max_wait_ms)
    g = parts.withColumn("checkpoint", F.coalesce(same, F.lit(""))).agg(
        F.collect_set("checkpoint").alias("c"), F.coalesce(F.bool_or(other), F.lit(False)).alias("t"), F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("name", "theta")))).alias("thetas"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "source")))).alias("sources"))
    absent = F.array_except(F.array(*map(F.lit, SERVED)), F.map_keys("thetas"))
    fails = F.when(F.size(absent) > 0, F.concat(F.lit("no threshold named "), F.array_join(absent, ", "))).when(
        F.size("c") != 1, F.concat(F.lit("the served thresholds come from different checkpoints: "), F.array_join(F.array_sort("c"), ", "))).when(
        F.col("t"), F.lit("a curve was drawn with other timings than the policy's"))
    ok = F.when(fails.isNull(), True).otherwise(F.raise_error(fails).cast("boolean"))
    return g.where(ok).select(F.get("c", F.lit(0)).alias("checkpoint"), "thetas", "sources")
