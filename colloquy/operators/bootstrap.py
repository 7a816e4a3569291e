"""Poisson bootstrap. A row's weight in replicate b depends on its id only, so any two models
scored on the same ids are resampled together, and only per-task partial sums are shuffled."""
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from colloquy import constants as K
from colloquy.functions import hashing as H
from colloquy.operators.scoring import KEY

_MASK = (1 << 64) - 1
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def poisson_cuts() -> list[int]:
    """24-bit cut points of the Poisson(1) distribution."""
    cdf, term, out = 0.0, math.exp(-1.0), []
    for k in range(11):
        cdf += term
        out.append(int(cdf * (1 << 24)))
        term /= k + 1
    return [c for c in out if c < (1 << 24)]


_CUTS = np.array(poisson_cuts(), dtype=np.uint64)


def poisson_weights(keys: np.ndarray, first: int, count: int) -> np.ndarray:
    """(len(keys), count) weights of replicates first..first+count-1 by a 64-bit mix of key and b."""
    b = np.arange(first + 1, first + count + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        z = keys[:, None] + b[None, :] * np.uint64(GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
        z ^= z >> np.uint64(31)
    return np.searchsorted(_CUTS, z >> np.uint64(40), side="right").astype(np.float64)


def names(max_k: int, n_bins: int) -> list[str]:
    return (["n", "hit", "sq", "hard", "hard_hit"] + [f"tp{i}" for i in range(max_k)]
            + [f"sup{i}" for i in range(max_k)] + [f"pre{i}" for i in range(max_k)]
            + [f"gap{i}" for i in range(n_bins)])


def _design(g: pd.DataFrame, max_k: int, n_bins: int) -> np.ndarray:
    n, at = len(g), np.arange(len(g))
    y, pred, bins = (g[c].to_numpy(np.int64) for c in ("y", "pred", "bin"))
    hit, hard = (y == pred).astype(float), g["hard"].to_numpy(float)
    x = np.zeros((n, 5 + 3 * max_k + n_bins))
    x[:, 0], x[:, 1], x[:, 2] = 1.0, hit, g["sq"].to_numpy(float)
    x[:, 3], x[:, 4] = hard, hard * hit
    x[at, 5 + y] = hit
    x[at, 5 + max_k + y] = 1.0
    x[at, 5 + 2 * max_k + pred] = 1.0
    x[at, 5 + 3 * max_k + bins] = (y == g["top"].to_numpy(np.int64)) - g["conf"].to_numpy(float)
    return x


#: Replicates of one packed accumulator, and how many tasks' accumulators meet in the first merge.
PACK, MERGE_FAN = 500, 32
_PACKED = "model string, decision string, block int, part int, sums binary"


def _accumulate(samples: int, max_k: int, n_bins: int):
    width = len(names(max_k, n_bins))

    def run(batches):
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, g in pdf.groupby(KEY, sort=False):
                x = _design(g, max_k, n_bins)
                ids = g["key"].to_numpy(np.int64).view(np.uint64)
                total = acc.setdefault(key, np.zeros((samples, width)))
                for b in range(0, samples, PACK):
                    m = min(PACK, samples - b)
                    total[b:b + m] += poisson_weights(ids, b, m).T @ x
        for (model, decision), total in acc.items():
            yield pd.DataFrame({"model": model, "decision": decision, "block": range(0, samples, PACK), "part": TaskContext.get().partitionId() // MERGE_FAN,
                                "sums": [total[b:b + PACK].tobytes() for b in range(0, samples, PACK)]})

    return run


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(pdf["sums"].iloc[0]).copy()
    for more in pdf["sums"].iloc[1:]:
        total += np.frombuffer(more)
    return pdf.head(1).assign(sums=[total.tobytes()])


def replicates(rows: DataFrame, samples: int, seed: int, max_k: int, n_bins: int = K.ECE_BINS) -> DataFrame:
    """(model, decision, b, metrics...) for every replicate. `rows` come from score_rows.

    A task sends its sums as one packed row for every PACK replicates, whatever its rows; these are added up in a tree, so no
    merge takes more than MERGE_FAN tasks' accumulators, or one of each MERGE_FAN tasks. The hard rows are summed in the same
    pass: their weights are those of a bootstrap over them alone.
    """
    cols = names(max_k, n_bins)
    h = H.keyed(seed, "boot", F.col("id"))
    slim = rows.select(*KEY, F.conv(F.substring(h, 1, 16), 16, -10).cast("bigint").alias("key"),
                       "y", "pred", "top", "bin", "conf", "sq", "hard")
    packed = slim.mapInPandas(_accumulate(samples, max_k, n_bins), _PACKED)
    packed = packed.groupBy(*KEY, "block", "part").applyInPandas(_merged, _PACKED)

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(_merged(pdf)["sums"].iloc[0]).reshape(-1, len(cols))
        out = pd.DataFrame(total, columns=cols)
        out.insert(0, "b", np.arange(len(total), dtype=np.int32) + int(pdf["block"].iloc[0]))
        out.insert(0, "decision", pdf["decision"].iloc[0])
        out.insert(0, "model", pdf["model"].iloc[0])
        return out

    g = packed.groupBy(*KEY, "block").applyInPandas(last, "model string, decision string, b int, " + ", ".join(f"{c} double" for c in cols))
    f1 = F.filter(F.array(*[F.try_divide(2 * F.col(f"tp{i}"), F.col(f"sup{i}") + F.col(f"pre{i}"))
                            for i in range(max_k)]), lambda v: v.isNotNull())
    gap = reduce(lambda a, c: a + c, [F.abs(F.col(f"gap{i}")) for i in range(n_bins)])
    return g.select(
        *KEY, "b", F.try_divide("hit", "n").alias("accuracy"),
        F.try_divide(F.aggregate(f1, F.lit(0.0), lambda a, v: a + v), F.size(f1)).alias("macro_f1"),
        F.try_divide(gap, F.col("n")).alias("ece"), F.try_divide("sq", "n").alias("brier"),
        F.try_divide("hard_hit", "hard").alias("hard_accuracy"))


METRICS = ("accuracy", "macro_f1", "ece", "brier", "hard_accuracy")
LOWER_IS_BETTER = ("ece", "brier")


def _long(df: DataFrame, keys) -> DataFrame:
    return df.unpivot([*keys, "b"], list(METRICS), "metric", "value")


def bootstrap_ci(reps: DataFrame) -> DataFrame:
    """(model, decision, metric, lo, hi): 95 % percentile intervals over the replicates."""
    return _long(reps, KEY).groupBy(*KEY, "metric").agg(
        F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(
        *KEY, "metric", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))


def paired_differences(reps: DataFrame, points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair (a, b) and metric: both points, a - b, its interval, share where a is not better.

    `reps` and `points` are long or wide over METRICS; `pairs` has (decision, a, b).
    """
    r = _long(reps, KEY)
    x = r.join(pairs.withColumnRenamed("b", "other"), (r.model == F.col("a")) & (
        r.decision == pairs.decision)).select(r.decision, "a", "other", r.b, "metric",
                                              F.col("value").alias("va"))
    y = r.select("decision", F.col("model").alias("other"), "b", "metric",
                 F.col("value").alias("vb"))
    d = x.join(y, ["decision", "other", "b", "metric"]).withColumn("d", F.col("va") - F.col("vb"))
    worse = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("d") >= 0).otherwise(
        F.col("d") <= 0)
    g = d.groupBy("decision", "a", "other", "metric").agg(
        F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"),
        F.avg(worse.cast("double")).alias("share_a_not_better"))
    p = points.unpivot(KEY, list(METRICS), "metric", "point")
    pa = p.select("decision", F.col("model").alias("a"), "metric", F.col("point").alias("point_a"))
    pb = p.select("decision", F.col("model").alias("other"), "metric",
                  F.col("point").alias("point_b"))
    return g.join(pa, ["decision", "a", "metric"]).join(pb, ["decision", "other", "metric"]).select(
        "decision", "a", F.col("other").alias("b"), "metric", "point_a", "point_b",
        (F.col("point_a") - F.col("point_b")).alias("difference"),
        F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"), "share_a_not_better")


def paired_sets(rows: DataFrame, pairs: DataFrame, points: DataFrame, samples: int, seed: int, max_k: int) -> DataFrame:
    """Every pair (decision, a, b) of a set compared on the same resampled rows, and on the hard rows alone.

    Adds to `paired_differences` the number of rows that each metric is about. Both models of a pair must be scored on the same
    ids and labels; a pair that is not fails the job.
    """
    have = rows.join(pairs.select("decision", F.explode(F.array("a", "b")).alias("model")).distinct(), KEY, "left_semi")
    sums = have.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.count_if("hard").alias("n_hard"), F.sum(F.xxhash64("id", "y").cast("decimal(20,0)")).alias("same"))
    x = sums.select("decision", F.col("model").alias("a"), "n", "n_hard", F.col("same").alias("_a"))
    y = sums.select("decision", F.col("model").alias("b"), F.col("same").alias("_b"), F.col("n").alias("_n"))
    sizes = pairs.join(x, ["decision", "a"]).join(y, ["decision", "b"])
    fits = F.when((F.col("_a") == F.col("_b")) & (F.col("n") == F.col("_n")), True).otherwise(F.raise_error(F.concat_ws(
        " ", "decision", F.lit("is not scored on the same rows by"), "a", F.lit("and"), "b")).cast("boolean"))
    sizes = sizes.where(fits).select("decision", "a", "b", "n", "n_hard")
    d = paired_differences(replicates(have, samples, seed, max_k), points, pairs)
    n = F.when(F.col("metric") == "hard_accuracy", F.col("n_hard")).otherwise(F.col("n"))
    return d.join(sizes, ["decision", "a", "b"]).withColumn("n", n).drop("n_hard")
