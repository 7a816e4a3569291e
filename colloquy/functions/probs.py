"""Array expressions over logits and probabilities."""
from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lit(x):
    return x if isinstance(x, Column) else F.lit(float(x))


def softmax(logits: Column, temperature=1.0) -> Column:
    t = _lit(temperature)

    def shares(e):
        return let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x),
                   lambda total: F.transform(e, lambda x: x / total))

    def exps(z):
        return let(F.array_max(z), lambda m: F.transform(z, lambda x: F.exp(x - m)))

    return let(let(F.transform(logits, lambda x: x / t), exps), shares)


def argmax_first(p: Column) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def argmax_excluding(p: Column, skip: int) -> Column:
    masked = F.transform(p, lambda x, i: F.when(i != skip, x))
    return (F.array_position(masked, F.array_max(masked)) - 1).cast("int")


def brier_row(p: Column, y: Column) -> Column:
    sq = F.transform(p, lambda x, i: F.pow(x - F.when(i == y, 1.0).otherwise(0.0), 2.0))
    return F.aggregate(sq, F.lit(0.0), lambda a, x: a + x)


def is_distribution(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.forall(p, lambda x: x >= -1e-9) & (F.abs(total - 1.0) <= 1e-3)


def nll_row(logits: Column, y: Column, temperature) -> Column:
    t = _lit(temperature)
    m = F.array_max(logits) / t
    s = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x / t - m))
    return m + F.log(s) - F.get(logits, y) / t


def stated_probs(answer_json: Column, labels) -> tuple[Column, Column]:
    """(probabilities over labels, usable). Negative, missing and non-numeric values count 0."""
    raw = F.from_json(answer_json, "map<string,string>")
    mass = F.array(*[
        F.greatest(F.lit(0.0), F.coalesce(
            F.when(F.element_at(raw, F.lit(x)).rlike(r"^-?[0-9]"),
                   F.element_at(raw, F.lit(x)).try_cast("double")), F.lit(0.0)))
        for x in labels])
    total = F.aggregate(mass, F.lit(0.0), lambda a, x: a + x)
    ok = total > 0
    uniform = F.array(*[F.lit(1.0 / len(labels))] * len(labels))
    scaled = F.transform(mass, lambda x: x / F.when(ok, total).otherwise(1.0))
    return F.when(ok, scaled).otherwise(uniform), ok


def smoothed_target(y: Column, k: int, s: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                       lambda i: F.lit(s / k) + F.when(i == y, 1.0 - s).otherwise(0.0))


def log_score(p: Column, y: Column) -> Column:
    return F.log(F.greatest(F.get(p, y), F.lit(1e-12)))


def spherical_score(p: Column, y: Column) -> Column:
    norm = F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x))
    return F.get(p, y) / norm


def ranked_score(p: Column, y: Column) -> Column:
    """Sum over the first k-1 classes of the squared gap between cumulative forecast and outcome."""
    seed = F.struct(F.lit(0.0).alias("cum"), F.lit(0).alias("i"), F.lit(0.0).alias("s"))

    def step(a, x):
        cum = a["cum"] + x
        gap = cum - F.when(y <= a["i"], 1.0).otherwise(0.0)
        last = a["i"] >= F.size(p) - 1
        return F.struct(cum.alias("cum"), (a["i"] + 1).alias("i"),
                        (a["s"] + F.when(last, 0.0).otherwise(gap * gap)).alias("s"))

    return F.aggregate(p, seed, step)["s"]
