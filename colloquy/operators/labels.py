"""Label quality: agreement, kappa, gates, disagreements and progress."""
from pyspark.sql import Column, DataFrame, functions as F

from colloquy import constants as K


def _kappa_of(cells: DataFrame, by) -> DataFrame:
    """(by, n, observed, expected) from counts per (by, a, b)."""
    by = list(by)
    ma = cells.groupBy(*by, "a").agg(F.sum("n").alias("ra")).withColumnRenamed("a", "c")
    mb = cells.groupBy(*by, "b").agg(F.sum("n").alias("rb")).withColumnRenamed("b", "c")
    both = ma.join(mb, [*by, "c"]).groupBy(*by).agg(F.sum(F.col("ra") * F.col("rb")).alias("cross"))
    tot = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(
        F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    j = tot.join(both, by, "left") if by else _attach(tot, both)
    n = F.col("n").cast("double")
    return j.withColumn("po", F.col("same") / n).withColumn(
        "pe", F.coalesce(F.col("cross"), F.lit(0)) / (n * n))


def _attach(a: DataFrame, b: DataFrame) -> DataFrame:
    from colloquy.operators.scale import attach_row

    return attach_row(a, b)


def cohen_kappa(pairs: DataFrame, by=()) -> DataFrame:
    """(by, n, kappa) of label pairs (a, b); 1 when chance agreement is 1."""
    c = pairs.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    k = _kappa_of(c, by)
    return k.select(*by, "n", F.when(F.col("pe") == 1.0, 1.0).otherwise(
        (F.col("po") - F.col("pe")) / (1.0 - F.col("pe"))).alias("kappa"))


def to_bool(label: Column) -> Column:
    """Machine answers as true/false; anything else is unsure."""
    return (F.when(label.isin("escalate", "y"), "true").when(label.isin("no", "n"), "false")
            .otherwise("unsure"))


def agreement(hand: DataFrame, machine: DataFrame) -> DataFrame:
    """One row: n on both, unsure, accuracy, kappa, precision, recall and the 2x2 counts.

    hand/machine: (id, label) with labels true/false, machine also unsure.
    """
    j = hand.select("id", F.col("label").alias("a")).join(
        machine.select("id", F.col("label").alias("b")), "id")
    c = j.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    sure = c.where(F.col("b").isin("true", "false"))

    def cell(x, y):
        return F.coalesce(F.sum(F.when((F.col("a") == x) & (F.col("b") == y), F.col("n"))), F.lit(0))

    g = c.agg(cell("true", "true").alias("tt"), cell("true", "false").alias("tf"),
              cell("false", "true").alias("ft"), cell("false", "false").alias("ff"),
              F.coalesce(F.sum(F.when(F.col("b") == "unsure", F.col("n"))), F.lit(0)).alias("unsure"))
    # chance agreement from the same four counts
    tt, tf, ft, ff = (F.col(x).cast("double") for x in ("tt", "tf", "ft", "ff"))
    n = tt + tf + ft + ff
    po = (tt + ff) / F.nullif(n, F.lit(0.0))
    pe = ((tt + tf) * (tt + ft) + (ft + ff) * (tf + ff)) / F.nullif(n * n, F.lit(0.0))
    kappa = F.when(pe == 1.0, 1.0).otherwise((po - pe) / F.nullif(1.0 - pe, F.lit(0.0)))
    return g.select(
        n.cast("bigint").alias("n"), "unsure", po.alias("accuracy"), kappa.alias("kappa"),
        (tt / F.greatest(F.lit(1.0), tt + ft)).alias("precision"),
        (tt / F.greatest(F.lit(1.0), tt + tf)).alias("recall"), "tt", "tf", "ft", "ff")


def stratum_agreement(hand: DataFrame, machine: DataFrame, strata: DataFrame) -> DataFrame:
    """(stratum, n, accuracy) on messages both labelled; stratum NULL is the total."""
    j = hand.select("id", F.col("label").alias("a")).join(machine.where(
        F.col("label").isin("true", "false")).select("id", F.col("label").alias("b")), "id").join(
        strata.select("id", "stratum"), "id", "left")
    return j.groupingSets([[], [F.col("stratum")]], "stratum").agg(
        F.grouping("stratum").cast("int").alias("level"), F.count(F.lit(1)).alias("n"),
        F.avg((F.col("a") == F.col("b")).cast("double")).alias("accuracy")).where(
        "level = 1 OR stratum IS NOT NULL")


def served_config(labels: DataFrame, fields: list[str]) -> DataFrame:
    """One row: the value of each field that all labels share, NULL where they differ."""
    return labels.agg(*[F.when(F.count_distinct(c) == 1, F.max(c)).alias(c) for c in fields])


def gate(summary: DataFrame, served: DataFrame, want: dict, min_kappa: float = K.KAPPA_BAR,
         min_precision: float = K.PRECISION_BAR) -> DataFrame:
    """(accepted, failures): why a labeller may not label yet.

    summary: one `agreement` row, or none when calib was never labelled. served: one row with the
    columns of `want` (model, prompt, ...).
    """
    j = _attach(_attach(served.sparkSession.range(1), served), summary.select(
        F.col("n").alias("_n"), "kappa", "precision"))
    same = F.lit(True)
    for k, v in want.items():
        same = same & F.col(k).eqNullSafe(F.lit(v))
    fails = F.when(F.col("_n").isNull(), F.array(F.lit("calib has not been labelled"))).when(
        ~same, F.array(F.lit("calib was labelled and judged under another configuration"))).otherwise(
        F.array_compact(F.array(
            F.when(F.col("kappa").isNull() | (F.col("kappa") < min_kappa), F.lit(
                f"kappa is below {min_kappa}")),
            F.when(F.col("precision") < min_precision, F.lit(
                f"escalate precision is below {min_precision}")))))
    return j.select((F.size(fails) == 0).alias("accepted"), F.array_join(fails, "; ").alias("failures"))


def disagreements(cands: DataFrame, hand: DataFrame, machine: DataFrame) -> DataFrame:
    """(id, stratum, hand, machine) where the labels differ; the text stays out."""
    j = cands.select("id", "stratum").join(hand.select("id", F.col("label").alias("hand")), "id").join(
        machine.where(F.col("label").isin("true", "false")).select(
            "id", F.col("label").alias("machine")), "id")
    return j.where("hand <> machine")


def label_progress(cands: DataFrame, labels: DataFrame) -> DataFrame:
    """Per split: how many candidates carry each label, and how many none (pending)."""
    j = cands.select("id", "split").join(labels.select("id", "label"), "id", "left")
    names = ("true", "false", "skip", "pending")
    state = F.coalesce("label", F.lit("pending"))
    return j.groupBy("split").agg(*[F.count_if(state == x).alias(x) for x in names])


def label_violations(labels: DataFrame) -> DataFrame:
    """(id, guidelines, label) not allowed under the guideline version."""
    ok = F.lit(False)
    for version, allowed in K.GUIDELINE_LABELS.items():
        ok = ok | ((F.col("guidelines") == version) & F.col("label").isin(*allowed))
    return labels.where(~F.coalesce(ok, F.lit(False))).select("id", "guidelines", "label")
