"""Report tables: long metrics to fixed layouts, with TODO for cells that do not exist."""
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.operators.lifecycle import fingerprint
from colloquy.operators.scale import attach_row

TODO = "TODO"


def cell(value: Column, lo: Column | None = None, hi: Column | None = None, digits: int = 3) -> Column:
    """`0.813` or `0.813 [0.807, 0.820]`; n/a when the metric is undefined."""
    f = f"%.{digits}f"
    text = F.format_string(f, value)
    if lo is not None:
        text = F.when(lo.isNotNull(), F.concat(text, F.lit(" ["), F.format_string(f, lo), F.lit(
            ", "), F.format_string(f, hi), F.lit("]"))).otherwise(text)
    return F.when(value.isNull(), "n/a").otherwise(text)


def pivot(cells: DataFrame, layout: DataFrame, rows, column: str, columns, value: str = "cell"
          ) -> DataFrame:
    """One row per layout row, one column per entry of `columns`; missing cells read TODO."""
    p = cells.groupBy(*rows).pivot(column, list(columns)).agg(F.first(value))
    return layout.join(p, list(rows), "left").na.fill(TODO, list(columns))


def fixed(value: Column, digits: int = 3) -> Column:
    """The value rounded half up in binary arithmetic, so that it prints alike in every engine."""
    return F.floor(value * 10 ** digits + 0.5) / 10 ** digits


def signed_cell(value: Column, lo: Column, hi: Column, digits: int = 3) -> Column:
    """A difference with its interval, `+0.012 [-0.004, +0.028]`; n/a when it is undefined."""
    f = f"%+.{digits}f"
    x, a, b = (F.format_string(f, fixed(c, digits)) for c in (value, lo, hi))
    return F.when(value.isNull(), "n/a").otherwise(F.concat(x, F.lit(" ["), a, F.lit(", "), b, F.lit("]")))


def pair_cell(value: Column, other: Column, digits: int = 3) -> Column:
    """Two figures of one thing, `0.813 (0.790)`; n/a for one that is undefined."""
    f = f"%.{digits}f"
    x, y = (F.when(c.isNull(), "n/a").otherwise(F.format_string(f, fixed(c, digits))) for c in (value, other))
    return F.when(value.isNull(), "n/a").otherwise(F.concat(x, F.lit(" ("), y, F.lit(")")))


def _filled(found: DataFrame, layout: DataFrame, rows, columns) -> DataFrame:
    return layout.join(found, list(rows), "left").select(*layout.columns, *columns).na.fill(TODO, list(columns))


def latency_table(percentiles: DataFrame, verdicts: DataFrame, layout: DataFrame) -> DataFrame:
    """Layout rows with p50, p95 and p99 of the whole call, the forward and packing shares of p50, and whether the budget is met.

    percentiles: (row, component, p50, p95, p99); verdicts: (row, budget_ms, fits). A row that was not measured reads TODO.
    """
    at = lambda part, c: F.max(F.when(F.col("component") == part, F.col(c)))
    one = lambda c: F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string("%.1f", fixed(F.col(c), 1)))
    g = percentiles.groupBy("row").agg(at("total_ms", "p50").alias("p50"), at("total_ms", "p95").alias("p95"), at("total_ms", "p99").alias("p99"),
                                       at("forward_ms", "p50").alias("forward"), at("pack_ms", "p50").alias("packing"))
    fits = F.concat(F.when(F.col("fits"), "yes").otherwise("no"), F.lit(" (<= "), F.format_string("%.0f", "budget_ms"), F.lit(" ms)"))
    cells = ("p50", "p95", "p99", "forward", "packing")
    j = g.join(verdicts, "row").select("row", *[one(c).alias(c) for c in cells], fits.alias("budget"))
    return _filled(j, layout, ["row"], [*cells, "budget"])


def arms_table(percentiles: DataFrame, states: DataFrame, layout: DataFrame, base: str, other: str) -> DataFrame:
    """Two arms of each layout row side by side: p50 / p99, the change of p50 in percent, hottest device, and what throttled it.

    percentiles: (row, arm, p50, p99) of the whole call; states: (row, arm, hottest, throttled array). Both arms or TODO.
    """
    x = percentiles.join(states, ["row", "arm"], "left").groupBy("row").pivot("arm", [base, other]).agg(
        F.first("p50").alias("p50"), F.first("p99").alias("p99"), F.first("hottest").alias("hottest"), F.first("throttled").alias("throttled"))
    c = lambda arm, k: F.col(f"`{arm}_{k}`")
    x = x.where(c(base, "p50").isNotNull() & c(other, "p50").isNotNull())
    two = lambda arm: F.format_string("%.1f / %.1f", fixed(c(arm, "p50"), 1), fixed(c(arm, "p99"), 1))
    why = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(c(a, "throttled"), F.array().cast("array<string>")) for a in (base, other)])))
    j = x.select("row", two(base).alias(base), two(other).alias(other),
                 F.format_string("%+.1f%%", fixed((c(other, "p50") / c(base, "p50") - 1) * 100, 1)).alias("change"),
                 F.format_string("%.0f / %.0f", fixed(c(base, "hottest"), 0), fixed(c(other, "hottest"), 0)).alias("hottest"),
                 F.when(F.size(why) == 0, "no").otherwise(F.array_join(why, ", ")).alias("throttled"))
    return _filled(j, layout, ["row"], [base, other, "change", "hottest", "throttled"])


def paired_table(differences: DataFrame, layout: DataFrame, columns) -> DataFrame:
    """A row per layout pair (a, b); a column `decision.metric` for each of `columns`, the difference with its interval.

    differences: (decision, a, b, metric, difference, lo, hi). A pair that was not compared reads TODO, an undefined metric n/a.
    """
    d = differences.select("a", "b", F.concat_ws(".", "decision", "metric").alias("_at"),
                           signed_cell(F.col("difference"), F.col("lo"), F.col("hi")).alias("cell"))
    names = [f"{decision}.{metric}" for decision, metric in columns]
    p = d.groupBy("a", "b").pivot("_at", names).agg(F.first("cell"))
    q = p.select("a", "b", *[F.col(f"`{n}`").alias(n.replace(".", "_")) for n in names])
    return _filled(q, layout, ["a", "b"], [n.replace(".", "_") for n in names])


def operating_table(interrupt: DataFrame, yields: DataFrame, layout: DataFrame) -> DataFrame:
    """Per model the chosen thresholds and what they do on test; a threshold that misses its target on calib says so.

    interrupt: (model, theta, feasible, false_stop, missed); yields: (model, theta, feasible, premature, added_delay_ms).
    """
    theta = F.concat(F.format_string("%.3f", "theta"), F.when(F.col("feasible"), "").otherwise(" (target unreachable)"))
    three = lambda c: F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string("%.3f", fixed(F.col(c)))).alias(c)
    i = interrupt.select("model", theta.alias("theta_interrupt"), three("false_stop"), three("missed"))
    delay = F.when(F.col("added_delay_ms").isNull(), "n/a").otherwise(F.format_string("%.0f", fixed(F.col("added_delay_ms"), 0)))
    y = yields.select("model", theta.alias("theta_yield"), three("premature"), delay.alias("added_delay_ms"))
    return _filled(i.join(y, "model", "full_outer"), layout, ["model"], [*i.columns[1:], *y.columns[1:]])


def provenance(df: DataFrame, test: DataFrame | None = None, **facts) -> DataFrame:
    """Result rows with the facts they stand on: the scored rows' own count and fingerprint, and any constants (code, checkpoint, ...).

    With `test`, the rows that were scored (all columns count), each result carries `test_rows` and `test_fingerprint` of them.
    """
    if test is not None:
        df = attach_row(df, fingerprint(test).select(F.col("n_rows").alias("test_rows"), F.col("fingerprint").alias("test_fingerprint")))
    return df.withColumns({k: F.lit(v) for k, v in facts.items()}) if facts else df
