"""Exact k best by inner product, pruned by bounds from means and deviations of vector segments."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Candidates of a block, and queries of a block.
BLOCK = 4096
QUERIES = 1024
#: Segments of a vector at each resolution, coarse to fine.
LEVELS = (2, 8)


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row and segment: sqrt(length) x mean, then the deviation's norm; the dot of two such rows bounds the inner product.

    Within a segment <a, b> = n mean(a) mean(b) + <a - mean, b - mean> <= n mean(a) mean(b) + |a - mean| |b - mean|.
    The same two numbers bound squared distances from below: |a|^2 + |b|^2 - 2 x this.
    """
    parts = np.array_split(np.arange(x.shape[1]), min(segments, max(1, x.shape[1])))
    mean = np.stack([x[:, p].mean(axis=1) * np.sqrt(len(p)) for p in parts], axis=1)
    left = np.stack([x[:, p].std(axis=1) * np.sqrt(len(p)) for p in parts], axis=1)
    return np.concatenate([mean, left], axis=1)


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """(query_id, vec_id, score) of each query's k best rows of one block, its own id left out; ties to smaller ids.

    The block is worked in chunks. A chunk's row is dropped as soon as its bound at some resolution is below the
    k-th score that the query already has; the others get the exact integer inner product.
    """
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    # int64 holds every sum if the largest product times the dimension does; float64 bounds get a margin for rounding
    wide = float(np.abs(queries).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) >= 2.0 ** 62
    q, c = (queries.astype(object), x.astype(object)) if wide else (queries, x)
    qf, xf = queries.astype(np.float64), x.astype(np.float64)
    stats = [(segment_statistics(qf, s), segment_statistics(xf, s)) for s in LEVELS]
    small = np.finfo(np.float64).eps * 64 * np.abs(qf).sum(axis=1) * np.abs(xf).max(initial=0) + 1e-6
    found_s = [np.empty(0, dtype=object if wide else np.int64) for _ in range(len(q))]
    found_i = [np.empty(0, np.int64) for _ in range(len(q))]
    kth = np.full(len(q), -np.inf)
    for at in range(0, len(ids), 512):
        rows = slice(at, at + 512)
        alive = np.ones((len(q), len(ids[rows])), bool)
        for a, b in stats:
            if np.isfinite(kth).any():
                alive &= a @ b[rows].T + small[:, None] >= kth[:, None]
        alive &= query_ids[:, None] != ids[rows][None, :]
        for i in np.flatnonzero(alive.any(axis=1)):
            keep = np.flatnonzero(alive[i])
            scores = c[rows][keep] @ q[i]
            s = np.concatenate([found_s[i], scores])
            v = np.concatenate([found_i[i], ids[rows][keep]])
            top = np.lexsort((v, -s))[:k] if not wide else np.array(sorted(range(len(s)), key=lambda n: (-s[n], v[n]))[:k])
            found_s[i], found_i[i] = s[top], v[top]
            if len(top) == k:
                kth[i] = float(s[top[-1]])
    clip = lambda s: int(min(max(int(s), -2 ** 63), 2 ** 63 - 1))
    return [(int(query_ids[i]), int(v), clip(s)) for i in range(len(q)) for s, v in zip(found_s[i], found_i[i])]


def exact_top_k(vectors: DataFrame, vec_id: str, vector: str, *, every: int, k: int, scale: int = 256) -> DataFrame:
    """Each query's k best other rows: query_id, rank (from 1), vec_id, score.

    Components become floor(scale x component) in double. Queries are the rows whose id `every` divides; candidates are all rows
    with another id. Score: integer inner product, ties to the smaller id. Rows with a null id, and vectors that are
    null, empty or hold null or non-finite components, take no part; components beyond 2^52 are cut to it. Vectors of different
    length never meet. Equal rows count once; rows that only share an id are candidates each. Scores beyond a long are cut
    to its range. Blocks of queries meet blocks of candidates by a
    replicated equality key: the work is the query set against all rows, and a task holds one block of each.
    """
    x = F.transform(F.col(vector), lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale).cast("double"), F.lit(2.0 ** 52)), F.lit(-2.0 ** 52)).cast("long"))
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    rows = (vectors.where(F.col(vec_id).isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)))
            .select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).distinct()
            .withColumn("dim", F.size("x")))
    total = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    groups, sets = max(1, -(-total[0] // BLOCK)), max(1, -(-total[1] // QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "x"), F.lit(n)).cast("int")
    queries = rows.where(F.col("vec_id") % every == 0).withColumns({"qset": deal(sets), "is_query": F.lit(True)})
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    candidates = rows.withColumns({"block": deal(groups), "is_query": F.lit(False)})
    candidates = candidates.withColumn("qset", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    both = queries.unionByName(candidates)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf.is_query], pdf[~pdf.is_query]
        out = []
        if len(q) and len(c):
            out = best_of_block(np.stack(q.x), q.vec_id.to_numpy(), np.stack(c.x), c.vec_id.to_numpy(), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    local = both.groupBy("dim", "qset", "block").applyInPandas(work, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (local.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
