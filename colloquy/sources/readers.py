"""Readers and writers for the raw corpora and the row files."""
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy import constants as K, schemas as S
from colloquy.functions import text as T

SPLIT_NAMES = {"train": "train", "val": "calib", "test": "test"}


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One CSV per conversation (a glob) -> utterances with act, text and floor flags."""
    raw = spark.read.schema(S.TRANSCRIPT_CSV).option("header", True).option("escape", '"').option(
        "multiLine", True).csv(path)
    u = raw.select(F.col("conversation_no").cast("bigint").alias("conv_id"),
                   F.col("transcript_index").cast("bigint").alias("idx"), "caller", "act_tag",
                   F.coalesce("text", F.lit("")).alias("raw"))
    u = T.nfkc_stable(u.withColumn("act", T.act_class(F.col("act_tag"))).withColumn(
        "text", T.clean_transcript(F.col("raw"))).withColumn("_n", F.col("text")), "_n")
    u = u.withColumn("norm", T.normalize_text(F.col("_n"))).drop("_n")
    u = u.withColumn("minor", T.is_minor(F.col("act"), F.col("norm")))
    return u.withColumns({"ends_unit": T.ends_unit(F.col("raw")), "abandoned": T.abandoned(F.col("raw")),
                          "claims": T.claims_floor(F.col("minor"), F.col("norm"))})


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Reply-thread CSV -> (id, author, inbound, text, parent_id), texts as they are written."""
    raw = spark.read.schema(S.MESSAGE_CSV).option("header", True).option("escape", '"').option(
        "multiLine", True).csv(path)
    return raw.select(F.col("tweet_id").alias("id"), F.col("author_id").alias("author"), "inbound",
                   F.coalesce("text", F.lit("")).alias("text"),
                   F.col("in_response_to_tweet_id").cast("bigint").alias("parent_id"))


def read_intents(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON of [text, intent] pairs -> (split, n, text, intent); n is the row's position
    among in-domain pairs followed by the split's `oos_` pairs."""
    doc = spark.read.schema(S.INTENT_JSON).option("multiLine", True).json(path)
    parts = []
    for name, split in SPLIT_NAMES.items():
        oos = F.transform(F.coalesce(f"oos_{name}", F.array().cast(S.PAIRS)), lambda p: F.array(
            F.get(p, F.lit(0)), F.lit(K.OUT_OF_SCOPE)))
        pairs = F.concat(F.coalesce(name, F.array().cast(S.PAIRS)), oos)
        parts.append(doc.select(F.lit(split).alias("split"), F.posexplode(pairs).alias("n", "p")).select(
            "split", "n", F.get("p", F.lit(0)).alias("text"), F.get("p", F.lit(1)).alias("intent")))
    return T.nfkc_stable(reduce(DataFrame.unionAll, parts), "text")


def in_domain_positions(rows: DataFrame, intents) -> DataFrame:
    """Renumbers `n` over the kept intents, as row ids count only those. One split of one document
    is ordered here, so this is bounded by the source file."""
    from pyspark.sql import Window

    w = Window.partitionBy("split").orderBy("n")
    kept = rows.where(F.col("intent").isin(*intents, K.OUT_OF_SCOPE))
    return kept.withColumn("n", F.row_number().over(w) - 1)


def read_rows_jsonl(spark: SparkSession, path: str, schema=S.EXAMPLE) -> DataFrame:
    """Gzipped or plain JSON lines; blank lines do not become rows."""
    df = spark.read.schema(schema).json(path)
    return df.where(F.coalesce(*[F.col(c).cast("string") for c in df.columns if c == "id"],
                               F.lit(None)).isNotNull()) if "id" in df.columns else df


def write_rows_jsonl(df: DataFrame, path: str, parts: int | None = None) -> None:
    """Gzipped JSON lines in id order: range partitions, sorted inside, so file order is id order."""
    out = df.repartitionByRange(parts, "id") if parts else df.repartitionByRange("id")
    out.sortWithinPartitions("id").write.option("compression", "gzip").mode("errorifexists").json(path)


def write_examples(df: DataFrame, path: str) -> None:
    """The native form: Parquet by decision and split, so both prune partitions."""
    df.write.partitionBy("decision", "split").mode("errorifexists").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of raw sources, for pin checks."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SCRIPT).option("multiLine", True).json(path)


def script_segments(scripts: DataFrame) -> DataFrame:
    s = scripts.select(F.col("id").alias("call_id"), F.posexplode("timeline").alias("seg", "s"))
    return s.select("call_id", "seg", "s.who", "s.at_ms", "s.dur_ms", (
        F.col("s.at_ms") + F.col("s.dur_ms")).alias("end_ms"), "s.text")


def script_expectations(scripts: DataFrame) -> DataFrame:
    e = scripts.select(F.col("id").alias("call_id"), F.explode("expect").alias("e"))
    over = F.col("e.want").isin("stop_and_listen", "keep_talking", "ignore")
    return e.select("call_id", "e.seg", over.alias("over_agent"), "e.want", "e.route", "e.escalate",
                    "e.why")
