"""Splits, de-duplication and seeded draws. Every draw orders by a keyed hash of the row id."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy import constants as K
from colloquy.functions import hashing as H, text as T
from colloquy.operators import scale as S
from colloquy.operators.lifecycle import SPLITS, require


def split_leaks(df: DataFrame, group: str = "group", split: str = "split") -> DataFrame:
    """(group, problem) for groups in several splits or in an unknown one."""
    pairs = df.groupBy(group, split).agg(F.count(F.lit(1)).alias("n"))
    g = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("splits"), F.bool_or(
        ~F.col(split).isin(*SPLITS)).alias("unknown"))
    return g.select(group, F.when(F.col("unknown"), "unknown_split").when(
        F.col("splits") > 1, "several_splits").alias("problem")).where("problem IS NOT NULL")


def _text_key(text: Column) -> Column:
    return F.sha2(T.normalize_any(text), 256)


def _ids_with_text_in(rows: DataFrame, others: DataFrame, text: str) -> DataFrame:
    """Ids of `rows` whose normalised text occurs among `others`. Each text is normalised once."""
    keys = S.written(rows.select("id", _text_key(F.col(text)).alias("_k")))
    seen = S.written(others.select(_text_key(F.col(text)).alias("_k")).distinct()).withColumn(
        "_seen", F.lit(True))
    return S.hot_safe_lookup(keys, seen, "_k", "inner").select("id")


def dedupe_against_train(df: DataFrame, text: str = "text") -> DataFrame:
    """Drops calib/test rows whose normalised text also occurs in train. `id` must be unique."""
    repeats = _ids_with_text_in(df.where("split <> 'train'"), df.where("split = 'train'"), text)
    return df.join(repeats, "id", "left_anti")


def dedupe_report(df: DataFrame, text: str = "text") -> DataFrame:
    """(split, n_rows, dropped) from one count per normalised text."""
    g = df.groupBy(_text_key(F.col(text)).alias("k")).agg(*[
        F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    rows = g.select(F.explode(F.array(*[F.struct(
        F.lit(s).alias("split"), F.col(s).alias("n"), (F.lit(s != "train") & (F.col("train") > 0)
                                                       ).alias("d")) for s in SPLITS])).alias("r"))
    return rows.groupBy("r.split").agg(
        F.sum(F.when(~F.col("r.d"), F.col("r.n")).otherwise(0)).alias("n_rows"),
        F.sum(F.when(F.col("r.d"), F.col("r.n")).otherwise(0)).alias("dropped"))


def one_per_group(df: DataFrame, group: str, seed, purpose: str) -> DataFrame:
    """One uniformly drawn member per group, by one aggregation without a sort."""
    h = H.keyed(seed, purpose, F.col("id"))
    return df.groupBy(F.col(group).alias("_g")).agg(F.min_by(F.struct(*df.columns), h).alias("r")
                                                    ).select("r.*")


def seeded_sample(df: DataFrame, n: int, seed, purpose: str) -> DataFrame:
    d = df.withColumn("_h", H.keyed(seed, purpose, F.col("id")))
    return S.smallest_by_hash(d, [], "_h", "id", n).drop("_h")


def train_pool(cands: DataFrame, held_out: DataFrame, n: int, seed) -> DataFrame:
    """n train candidates, one per group, none repeating a held-out text."""
    kept = _not_held_out(cands, held_out)
    return seeded_sample(one_per_group(kept, "group", seed, "pool-thread"), n, seed, "pool-draw")


def _not_held_out(cands: DataFrame, held_out: DataFrame) -> DataFrame:
    train = cands.where("split = 'train'")
    return train.join(_ids_with_text_in(train, held_out, "text"), "id", "left_anti")


def train_pool_report(cands: DataFrame, held_out: DataFrame, n: int) -> DataFrame:
    train = cands.where("split = 'train'")
    kept = _not_held_out(cands, held_out)
    a = train.agg(F.count(F.lit(1)).alias("train_candidates"))
    b = kept.groupBy("group").agg(F.count(F.lit(1)).alias("c")).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("kept"), F.count(F.lit(1)).alias("train_threads"))
    return S.attach_row(a, b).select(
        "train_candidates", (F.col("train_candidates") - F.col("kept")).alias("dropped"),
        "train_threads", F.least(F.lit(n), F.col("train_threads")).alias("chosen"))


def equal_strata_sample(df: DataFrame, strata, n: int, seed, purpose: str) -> DataFrame:
    """n/k rows from each of the k strata with a shuffled display order; short strata fail."""
    if n % len(strata):
        raise ValueError(f"n must be a multiple of {len(strata)}")
    per = n // len(strata)
    d = df.where(F.col("stratum").isin(*strata)).withColumn(
        "_h", H.keyed(seed, purpose, F.col("id")))
    picked = S.smallest_by_hash(d, ["stratum"], "_h", "id", per)
    sizes = d.groupBy("stratum").agg(F.count(F.lit(1)).alias("c"))
    short = sizes.where(F.col("c") >= per).agg(F.count(F.lit(1)).alias("full")).where(
        F.col("full") < len(strata))
    picked = require(picked, short, f"a stratum has fewer than {per} rows")
    shown = picked.withColumn("_h", H.keyed(seed, purpose, "order", F.col("id")))
    return S.hash_ranks(shown, [], "_h", "id", "display").drop("_h")


def largest_remainder(sizes: DataFrame, by: str = "split", name: str = "stratum") -> DataFrame:
    """Integer quotas in proportion to `size` that sum to `n` per `by`; ties go by name."""
    w = Window.partitionBy(by)
    s = sizes.withColumn("_t", F.sum("size").over(w))
    s = s.withColumn("_q", F.floor(F.col("n") * F.col("size") / F.col("_t")).cast("bigint"))
    s = s.withColumn("_q", F.expr("(n * size) div _t")).withColumn(
        "_m", (F.col("n") * F.col("size")) % F.col("_t"))
    left = F.col("n") - F.sum("_q").over(w)
    r = F.row_number().over(w.orderBy(F.desc("_m"), name))
    return s.withColumn("quota", F.col("_q") + F.when(r <= left, 1).otherwise(0)).drop(
        "_t", "_q", "_m")


def proportional_sample(df: DataFrame, sizes: dict, seed) -> DataFrame:
    """Per split, a proportional draw over strata; one shuffled display order over all splits.

    Reads ids, splits and strata only, never a label's value.
    """
    n = None
    for s, k in sizes.items():
        n = F.when(F.col("split") == s, k) if n is None else n.when(F.col("split") == s, k)
    pop = df.where(F.col("split").isin(*sizes)).groupBy("split", "stratum").agg(
        F.count(F.lit(1)).alias("size")).withColumn("n", n.cast("bigint"))
    quotas = largest_remainder(pop).select("split", "stratum", "quota")
    d = df.withColumn("_h", H.keyed(seed, "relabel", F.col("split"), F.col("stratum"), F.col("id")))
    picked = S.smallest_by_hash(d, ["split", "stratum"], "_h", "id", F.col("quota"), quotas)
    shown = picked.withColumn("_h", H.keyed(seed, "relabel", "order", F.col("id")))
    return S.hash_ranks(shown, [], "_h", "id", "display").drop("_h")


def guarded_train_sample(pool: DataFrame, eval_groups: DataFrame, n: int, seed) -> DataFrame:
    """A train draw that fails when a pool row is not train or shares a group with an eval set."""
    stray = pool.where("split <> 'train'").select("id")
    shared = pool.join(eval_groups.select("group").distinct(), "group", "left_semi").select("id")
    safe = require(pool, stray, "pool rows outside train")
    safe = require(safe, shared, "pool groups are also in an eval set")
    return seeded_sample(safe, n, seed, "train-hand")


def carve_dev(df: DataFrame, fraction: float, seed, task: str, group: str = "group") -> DataFrame:
    """Marks whole groups as dev: round(fraction * groups) of them, at least one.

    Only the hash of the last chosen group travels back to the rows, so no join by group.
    """
    if not 0 < fraction < 1:
        raise ValueError(f"{task}: fraction must be in (0, 1), got {fraction}")
    groups = df.select(F.col(group).alias("id")).distinct().withColumn(
        "_h", H.keyed(seed, "dev", task, F.col("id")))
    size = groups.agg(F.count(F.lit(1)).alias("n_groups")).withColumn("k", F.greatest(
        F.lit(1), F.bround(F.col("n_groups") * F.lit(float(fraction))).cast("bigint")))
    picked = S.smallest_by_hash(groups, [], "_h", "id", F.col("k"), size)
    cut = picked.agg(F.max("_h").alias("_cut"))
    many = size.where("n_groups < 2")
    d = require(S.attach_row(df, cut), many, f"{task}: needs at least two groups")
    return d.withColumn("dev", H.keyed(seed, "dev", task, F.col(group)) <= F.col("_cut")
                        ).drop("_cut")


def epoch_mixture(items: DataFrame, quotas: DataFrame, seed, epoch: int, keys=("task",)
                  ) -> DataFrame:
    """Each task's quota: the pool repeated whole as often as it fits, topped up with a draw."""
    keys = list(keys)
    sizes = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    plan = sizes.join(quotas, keys).withColumn("_whole", F.expr("quota div _size")).withColumn(
        "_rest", F.col("quota") % F.col("_size")).select(*keys, "_whole", "_rest")
    whole = items.join(plan, keys).where("_whole > 0").select(
        *items.columns, F.explode(F.expr("sequence(1L, _whole)")).alias("copy"))
    d = items.withColumn("_h", H.keyed(seed, "mix", epoch, F.col("id")))
    rest = S.smallest_by_hash(d, keys, "_h", "id", F.col("_rest"), plan).drop("_h")
    return whole.unionByName(rest.withColumn("copy", F.lit(0).cast("bigint")))


def mixture_report(items: DataFrame, quotas: DataFrame) -> DataFrame:
    s = items.groupBy("task").agg(F.count(F.lit(1)).alias("pool")).join(quotas, "task")
    return s.select("task", F.col("quota").alias("n_rows"),
                    (F.col("quota") / F.col("pool")).alias("repeats"))


def class_quotas(items: DataFrame, quotas: DataFrame) -> DataFrame:
    """Each task's quota split evenly over its classes; the extra rows go to the lowest classes."""
    c = items.select("task", "label").distinct()
    w = Window.partitionBy("task")
    c = c.withColumn("_k", F.count(F.lit(1)).over(w)).withColumn(
        "_i", F.row_number().over(w.orderBy("label")) - 1).join(quotas, "task")
    return c.select("task", "label", (F.expr("quota div _k") + F.when(
        F.col("_i") < F.col("quota") % F.col("_k"), 1).otherwise(0)).alias("quota"))


def class_balanced_mixture(items, quotas, seed, epoch) -> DataFrame:
    return epoch_mixture(items, class_quotas(items, quotas), seed, epoch, ("task", "label"))


def even_subsample(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at evenly spaced ranks of `order` (rounded half to even); all rows when n >= size."""
    ranked = S.attach_row(S.range_ranks(df, [], [order], "_rank"),
                          df.agg(F.count(F.lit(1)).alias("_size")))
    size = df.agg(F.count(F.lit(1)).alias("_size"))
    steps = S.attach_row(df.sparkSession.range(n).withColumnRenamed("id", "_i"), size)
    step = (F.col("_size") - 1).cast("double") / F.lit(float(max(n - 1, 1)))
    wanted = steps.select((F.bround(F.col("_i") * step) + 1).cast("bigint").alias("_rank")
                          ).distinct()
    few = ranked.where(F.col("_size") > n).join(wanted, "_rank", "left_semi")
    return few.unionByName(ranked.where(F.col("_size") <= n)).drop("_rank", "_size")


def stride_subsample(df: DataFrame, order: str, per: int, keys=("decision",)) -> DataFrame:
    """Per key, every step-th row in `order` (step = size div per, at least 1), the first `per`."""
    keys = list(keys)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    r = S.range_ranks(df, keys, [order], "_rank").join(size, keys)
    step = F.greatest(F.lit(1), F.expr(f"_size div {per}"))
    at = F.col("_rank") - 1
    return r.where((at % step == 0) & (at / step < per)).drop("_rank", "_size")


def cap_rows(df: DataFrame, cap: int, seed, keys=("task",)) -> DataFrame:
    d = df.withColumn("_h", H.keyed(seed, "cap", F.col("id")))
    return S.smallest_by_hash(d, list(keys), "_h", "id", cap).drop("_h")


def resume_todo(cands: DataFrame, labels: DataFrame, model: str, prompt: str) -> DataFrame:
    done = labels.where((F.col("model") == model) & (F.col("prompt") == prompt)).select("id")
    return cands.join(done, "id", "left_anti")


def latest_label(labels: DataFrame, at: str = "at") -> DataFrame:
    """The last record per id: the greatest `at`, then the greatest `seq` if there is one (the
    record's place in its log), then the greatest other fields, so input order never decides.
    Aggregates before the shuffle, so repeated ids stay cheap."""
    first = [c for c in (at, "seq") if c in labels.columns]
    order = first + [c for c in labels.columns if c not in first]
    return labels.groupBy(F.col("id").alias("_id")).agg(F.max(F.struct(*order)).alias("r")).select(
        *[F.col(f"r.{c}").alias(c) for c in labels.columns])


def labelled_rows(cands: DataFrame, labels: DataFrame, split: str, guidelines: str) -> DataFrame:
    """True/false labelled candidates of one split; a label of another guideline version fails."""
    j = cands.where(F.col("split") == split).join(
        latest_label(labels).select("id", F.col("label"), "guidelines", "labeller"), "id"
        ).where("label <> 'skip'")
    same = F.when(F.col("guidelines") == guidelines, True).otherwise(F.raise_error(F.concat(
        F.col("id"), F.lit(" was labelled under guidelines "), "guidelines")).cast("boolean"))
    return j.where(same).withColumn("kind", F.col("stratum")).withColumn("hard", ~F.col("cue"))


def machine_rows(cands: DataFrame, labels: DataFrame, source: str) -> DataFrame:
    """Train rows from machine labels; anything that is not a yes/no answer drops out."""
    to_bool = F.when(F.col("answer").isin("escalate", "y"), "true").when(
        F.col("answer").isin("no", "n"), "false")
    j = cands.join(latest_label(labels).select(
        "id", F.col("label").alias("answer"), F.col("model").alias("labeller"), "prompt"), "id")
    return j.withColumn("label", to_bool).where("label IS NOT NULL").drop("answer").withColumn(
        "source", F.lit(source)).withColumn("kind", F.col("stratum")).withColumn(
        "hard", ~F.col("cue"))


def min_label_gate(rows: DataFrame, at_least: int) -> DataFrame:
    few = rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < at_least)
    return require(rows, few, f"fewer than {at_least} labelled rows")


def request_key(*cols: Column) -> Column:
    """sha256 of the request's canonical JSON (fields sorted by name by the caller)."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def cached_answers(requests: DataFrame, cache: DataFrame, labels) -> DataFrame:
    """Each request with its cached answer as probabilities; no answer means uniform and invalid."""
    from colloquy.functions.probs import stated_probs

    j = requests.join(cache.select("key", "response"), "key", "left")
    p, ok = stated_probs(F.coalesce("response", F.lit("{}")), labels)
    return j.withColumn("probs", p).withColumn("valid", ok).drop("response")
