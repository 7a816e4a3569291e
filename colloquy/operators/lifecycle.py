"""Dataset lifecycle: fingerprints, frozen versions, manifests, cards and constraint reports."""
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from colloquy import constants as K

SPLITS = ("train", "calib", "test")


def _splits(spark) -> DataFrame:
    return spark.range(len(SPLITS)).select(F.element_at(F.array(*[F.lit(s) for s in SPLITS]), (
        F.col("id") + 1).cast("int")).alias("split"))


def label_card(examples: DataFrame, labels) -> DataFrame:
    """Rows per split and label; splits without rows stay in the card."""
    agg = examples.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.count_if(F.col("label") == x).alias(x) for x in labels])
    return agg.join(_splits(examples.sparkSession), "split", "right").na.fill(0)


def dataset_card(examples: DataFrame) -> DataFrame:
    """Per split: rows, hard rows, label counts and kind counts (largest first, then by name)."""
    base = examples.groupBy("split", "label", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("hard").alias("h"))

    def counts(col):
        g = base.groupBy("split", col).agg(F.sum("n").alias("n"))
        pair = F.struct((-F.col("n")).alias("k"), F.col(col).alias("v"))
        return g.groupBy("split").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(pair)),
            lambda s: F.concat_ws("=", s["v"], (-s["k"]).cast("string"))), ", ").alias(col + "s"))

    totals = base.groupBy("split").agg(F.sum("n").alias("n_rows"), F.sum("h").alias("hard"))
    card = _splits(examples.sparkSession).join(totals, "split", "left").na.fill(0)
    return card.join(counts("label"), "split", "left").join(counts("kind"), "split", "left")


def row_hash(cols) -> Column:
    """sha256 over the columns as text; NULL and the empty string stay distinct."""
    part = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in cols]
    return F.sha2(F.concat_ws("\u001f", *part), 256)


def fingerprint(df: DataFrame, cols=None, by=()) -> DataFrame:
    """(*by, n_rows, fingerprint): the sum of each 32-bit slice of the row hashes, so order is free."""
    names = cols or df.columns
    h = df.select(*by, row_hash([F.col(c) for c in names]).alias("h"))
    slices = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")
                    ).cast("decimal(38,0)") for i in range(8)]
    g = h.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[s.alias(f"s{i}") for i, s in enumerate(slices)])
    text = F.concat_ws("-", *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string")
                              for i in range(8)])
    return g.select(*by, "n_rows", F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), text), 256
                                     ).alias("fingerprint"))


def freeze_version(df: DataFrame, manifest: DataFrame, name: str) -> DataFrame:
    """The manifest row of `name`; fails when `name` is already frozen with other content."""
    fp = fingerprint(df).withColumn("name", F.lit(name))
    old = manifest.where(F.col("name") == name).select(
        "name", F.col("fingerprint").alias("frozen"))
    j = fp.join(old, "name", "left")
    checked = F.when(F.col("frozen").isNull() | (F.col("frozen") == F.col("fingerprint")),
                     F.col("fingerprint")).otherwise(F.raise_error(F.concat(
                         F.lit(f"{name} is frozen and never edited; write a new version. Have "),
                         "frozen", F.lit(", rebuilt "), "fingerprint")).cast("string"))
    return j.select("name", "n_rows", checked.alias("fingerprint"),
                    F.col("frozen").isNull().alias("new"))


def write_frozen(df: DataFrame, manifest: DataFrame, name: str, path: str) -> DataFrame:
    """Writes a new version once. The manifest check runs before any file is written."""
    row = freeze_version(df, manifest, name)
    if row.select("new").first()["new"]:
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return row


def verify_manifest(manifest: DataFrame, present: DataFrame, optional=()) -> DataFrame:
    """(name, status): ok, unlisted, missing, changed, or absent for optional names."""
    m = manifest.select("name", F.col("fingerprint").alias("want"))
    p = present.select("name", F.col("fingerprint").alias("got"))
    j = m.join(p, "name", "full_outer")
    may = F.col("name").isin(*optional) if optional else F.lit(False)
    status = (F.when(F.col("want").isNull(), "unlisted")
              .when(F.col("got").isNull() & may, "absent").when(F.col("got").isNull(), "missing")
              .when(F.col("want") != F.col("got"), "changed").otherwise("ok"))
    return j.select("name", status.alias("status"))


def redact(df: DataFrame, text_cols) -> DataFrame:
    """Public side of a private table: no text, but each row's hash."""
    return df.withColumn("row_hash", row_hash([F.col(c) for c in sorted(text_cols)])
                         ).drop(*text_cols)


def restore_private(public: DataFrame, corpus: DataFrame, text_cols) -> DataFrame:
    """Text joined back by id; `verified` says whether the text still has the recorded hash."""
    j = public.join(corpus.select("id", *text_cols), "id", "left")
    ok = row_hash([F.col(c) for c in sorted(text_cols)]) == F.col("row_hash")
    return j.withColumn("verified", ok)


def wellformed(examples: DataFrame, labels, events, sources) -> DataFrame:
    """(rule, n) for every broken rule: duplicate ids, unknown values, classes without rows."""
    bad = [("label", ~F.col("label").isin(*labels)), ("event", ~F.col("event").isin(*events)),
           ("split", ~F.col("split").isin(*SPLITS)), ("source", ~F.col("source").isin(*sources)),
           ("empty_text", F.trim("user_partial") == "")]
    counts = examples.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in bad])
    rows = counts.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("rule"), F.col(n).alias("n")) for n, _ in bad])).alias("r")).select("r.*")
    dup = examples.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(
        F.lit("duplicate_id").alias("rule"), F.count(F.lit(1)).alias("n"))
    seen = examples.where("split = 'train'").select("label").distinct().agg(
        F.collect_set("label").alias("s"))
    miss = seen.select(F.lit("class_without_train_rows").alias("rule"), F.size(F.array_except(
        F.array(*[F.lit(x) for x in labels]), F.col("s"))).cast("bigint").alias("n"))
    return reduce(DataFrame.unionAll, [rows, dup, miss]).where("n > 0")


def require(df: DataFrame, violations: DataFrame, what: str) -> DataFrame:
    """Strict mode: fails the job when there is any violation."""
    n = violations.select(F.count(F.lit(1))).scalar()
    ok = F.when(n == 0, True).otherwise(F.raise_error(F.lit(what)).cast("boolean"))
    return df.where(ok)


def reuse_mismatches(a: DataFrame, b: DataFrame, key, fields) -> DataFrame:
    """(key, field, left, right) where two artefacts that must agree do not (NULL-safe)."""
    right = b.select(*key, *[F.col(f).alias("_" + f) for f in fields])
    j = a.select(*key, *fields).join(right, key, "full_outer")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("left"),
                               F.col("_" + f).cast("string").alias("right")) for f in fields])
    return j.select(*key, F.explode(cells).alias("c")).select(*key, "c.*").where(
        ~F.col("left").eqNullSafe(F.col("right")))


def secret_scan(texts: DataFrame, extra_rules=None, names: str | None = None, values=()
                ) -> DataFrame:
    """(id, rule) for every matched rule. The matched value itself is never emitted."""
    rules = {**K.SECRET_RULES, **(extra_rules or {})}
    hits = [F.when(F.col("text").rlike(p), F.lit(r)) for r, p in rules.items()]
    if names:
        hits.append(F.when(F.col(names).rlike(K.SECRET_NAME), F.lit("secret_name")))
    for v in values:
        hits.append(F.when(F.contains("text", F.lit(v)), F.lit("known_value")))
    return texts.select("id", F.explode(F.array_distinct(F.array_compact(F.array(*hits)))
                                        ).alias("rule"))


def pin_violations(files: DataFrame, pins: DataFrame) -> DataFrame:
    """Sources whose sha256 is not the pinned one. `files` as read by format('binaryFile')."""
    f = files.select(F.substring_index("path", "/", -1).alias("name"),
                     F.sha2("content", 256).alias("sha256"))
    return f.join(pins, ["name", "sha256"], "left_anti")
