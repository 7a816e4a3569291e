"""Helpers shared by the corpus operators."""
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colloquy.operators.scale import shared_dir

#: A word is a maximal run of characters other than these blanks; `bytes.split()` cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
#: Python workers hold at most about this many bytes of text as words at a time, one row at least.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a frame that `saved` returned, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `limit` bytes of text; a single longer text is a piece of its own."""
    sizes = np.nan_to_num(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


class WordIds(dict):
    """64-bit ids of words: their XXH64, remembered for up to `most` words."""

    def __init__(self, most: int = 1 << 18):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit mix, so that sums and products of ids behave like fresh hashes."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from all columns of `df` and from the others."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def prefix_sums(df: DataFrame, keys: list[str], digest: str, ties: list[str], value: Column, name: str) -> DataFrame:
    """Add the sum of `value` over the rows of the same keys that come before in the order of (digest, ties).

    `digest` is a column of hex digits. Three levels (two digits, two more, the rest) keep every window
    to at most 256 sums or to the 65,536th part of a key's rows. Keys must not be null; `name` must be a new column.
    """
    c1, c2, v, s, t, o1, o2, o, i = unused(df, "c1", "c2", "v", "s", "t", "o1", "o2", "o", "i")
    d = df.withColumns({c1: F.substring(digest, 1, 2), c2: F.substring(digest, 3, 2), v: value})
    before = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*keys, c1, c2).agg(F.sum(v).alias(s))
    tops = (sums.groupBy(*keys, c1).agg(F.sum(s).alias(t))
            .select(*keys, c1, F.coalesce(F.sum(t).over(before(keys, [c1])), F.lit(0)).alias(o1)))
    mids = sums.select(*keys, c1, c2, F.coalesce(F.sum(s).over(before([*keys, c1], [c2])), F.lit(0)).alias(o2))
    offsets = mids.join(tops, [*keys, c1]).select(*keys, c1, c2, (F.col(o1) + F.col(o2)).alias(o))
    inside = F.coalesce(F.sum(v).over(before([*keys, c1, c2], [digest, *ties])), F.lit(0))
    return (d.withColumn(i, inside).join(offsets, [*keys, c1, c2])
            .select(*[F.col(f"`{c}`") for c in df.columns], (F.col(o) + F.col(i)).alias(name)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an undirected graph given as (a, b), root the smallest node of the component.

    Alternating large-star and small-star rounds; each round is written to the shared folder, and a round that
    changes nothing ends the loop. Stars are formed by a grouped minimum and an equality join, both of which
    Spark splits for a hot node. Isolated nodes do not appear.
    """
    edge = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, state = saved(edge), None
    while True:
        n, h = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if n == 0 or (n, h) == state:
            break
        state = (n, h)
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        then = saved(small)
        dropped(now)
        now = then
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
