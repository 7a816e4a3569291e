"""Draw documents whose n-grams look like a target's: importance weights over hashed n-gram buckets."""
from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.common import saved, text_slices, utf8
from colloquy.operators.scale import range_ranks

#: Words are runs of digits, letters a-z and all characters beyond ASCII; everything else separates.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def ngram_pattern(n: int) -> regex.Pattern:
    """A run of n words between boundaries; scanned with overlaps it matches once at every word that starts one."""
    return regex.compile(rb"(?<![^ ])[^ ]++" + rb" [^ ]++" * (n - 1) + rb"(?![^ ])")


def collapsed(text: bytes) -> bytes:
    """A-Z in lower case, each run of separators one space, none at the ends. Bytes beyond ASCII stay as they are."""
    return b" ".join(text.translate(_PLAIN).split())


def ngram_buckets(text: bytes, patterns: list[regex.Pattern], buckets: int) -> np.ndarray:
    """The bucket (CRC-32 modulo `buckets`) of every n-gram of a collapsed text, in the order of the patterns."""
    hashes = [np.fromiter([crc32(m[0]) for m in p.finditer(text, overlapped=True)], np.uint32) for p in patterns]
    return np.concatenate(hashes) % np.uint32(buckets)


def bucket_vectors(rows: DataFrame, lengths: range, buckets: int) -> DataFrame:
    """(doc, text) to (doc, n_words, n_features, bucket, n): the buckets of a text and how often each occurs, whole texts."""
    kind = rows.schema["doc"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [ngram_pattern(n) for n in lengths]
        for batch in batches:
            for part in text_slices(batch, "text"):
                words, total, kinds, counts, ends = [], [], [], [], [0]
                for text in utf8(part, "text"):
                    text = collapsed(text)
                    found, n = np.unique(ngram_buckets(text, patterns, buckets), return_counts=True)
                    words.append(text.count(b" ") + 1 if text else 0)
                    total.append(int(n.sum()))
                    kinds.append(found.astype(np.int32))
                    counts.append(n.astype(np.int32))
                    ends.append(ends[-1] + len(found))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x))) for x in (kinds, counts)]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(words, pa.int64()), pa.array(total, pa.int64()), *lists],
                                                 ["doc", "n_words", "n_features", "bucket", "n"])

    return rows.mapInArrow(scan, f"doc {kind}, n_words long, n_features long, bucket array<int>, n array<int>")


def bucket_counts(vectors: DataFrame) -> DataFrame:
    """(bucket, n) over all vectors."""
    pairs = vectors.select(F.explode(F.arrays_zip("bucket", "n")).alias("p"))
    return pairs.groupBy("p.bucket").agg(F.sum(F.col("p.n").cast("long")).alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """A bucket's gain, floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))). Two counters a bucket come to the driver, never more."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, frame in ((s, source), (t, target)):
        for r in frame.collect():
            counts[r["bucket"]] = r["n"]
    whole_s, whole_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000.0 * math.log((b + 1.0) * whole_s / ((a + 1.0) * whole_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weighed(vectors: DataFrame, gain: np.ndarray) -> DataFrame:
    """The vectors' rows with `weight`, the sum of the gains of all their features, instead of the vectors."""
    kind = vectors.schema["doc"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = batch.column("bucket"), batch.column("n")
            per = gain[found.flatten().to_numpy()] * n.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())]).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(per)])
            weight = sums[ends[1:]] - sums[ends[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n_words"), batch.column("n_features"), pa.array(weight, pa.int64())],
                                             ["doc", "n_words", "n_features", "weight"])

    return vectors.mapInArrow(weigh, f"doc {kind}, n_words long, n_features long, weight long")


def gumbel(doc: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)) for the uniform u that the seed and the id give."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, doc: str, text: str, target: DataFrame, target_text: str, lengths: range = range(1, 2), buckets: int = 10000,
             least: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """(doc, n_words, n_features, weight, score, rank): a draw without replacement by importance weight.

    Texts are scanned once; their bucket vectors are written to the shared folder. A document's score is its weight plus
    Gumbel noise from its id; of the N documents with `least` words or more, the floor(percent N / 100) with the highest
    scores have a rank, the others null. Scores are ranked over ranges that Spark samples, so no task holds them all.
    Null or empty texts have no features and weight 0. A null id draws as an empty one and ranks before
    others of its score. Repeated rows each count, and rank next to each other. An empty target weighs by the source alone;
    an empty table gives an empty result. Other columns of `docs` are not read.
    """
    vectors = saved(bucket_vectors(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), lengths, buckets))
    wanted = bucket_vectors(target.select(F.lit(0).alias("doc"), F.col(target_text).alias("text")), lengths, buckets)
    rows = weighed(vectors, gains(bucket_counts(vectors), bucket_counts(wanted), buckets))
    scored = rows.withColumn("score", F.col("weight") + gumbel(F.col("doc"), seed)).withColumn("few", F.col("n_words") < least)
    draws = vectors.where(F.col("n_words") >= least).count() * percent // 100
    ranked = range_ranks(scored, [], ["few", F.desc("score"), "doc", "weight", "n_features"], "rank")
    drawn = F.when(~F.col("few") & (F.col("rank") <= draws), F.col("rank").cast("long"))
    return ranked.select(F.col("doc").alias(doc), "n_words", "n_features", "weight", "score", drawn.alias("rank"))
