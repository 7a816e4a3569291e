"""Spend of model calls: bounds, summaries, admission, projections."""
from pyspark.sql import Column, DataFrame, functions as F

from colloquy import constants as K
from colloquy.operators.scale import attach_row, chunk_scan


def costed(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds bound_usd, spent_usd and cost_source. A model without a price fails.

    prices: (model, in_per_m, out_per_m), one row per model.
    """
    j = calls.join(prices, "model", "left")
    price = F.when(F.col("in_per_m").isNotNull(), F.col("in_per_m")).otherwise(F.raise_error(
        F.concat(F.lit("no price ceiling for "), F.col("model"))).cast("double"))
    bound = (F.col("prompt_tokens") * price + F.col("completion_tokens") * F.col("out_per_m")) / 1e6
    return j.withColumn("bound_usd", bound).withColumn(
        "spent_usd", F.coalesce("cost_usd", "bound_usd")).withColumn(
        "cost_source", F.when(F.col("cost_usd").isNotNull(), "reported").otherwise("upper_bound")
    ).drop("in_per_m", "out_per_m")


def spend_summary(costs: DataFrame) -> DataFrame:
    return costs.groupBy("purpose", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("spent_usd").alias("cost_usd"),
        F.count_if(F.col("cost_source") == "upper_bound").alias("bound_calls"))


def calls_by_provider(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.coalesce("provider", F.lit("?")).alias("provider")).agg(
        F.count(F.lit(1)).alias("calls"))


def budget_admission(requests: DataFrame, spent: DataFrame, order: str, width: int,
                     cap_usd: float = K.SPEND_CAP_USD, margin: float = K.SPEND_MARGIN) -> DataFrame:
    """Adds running_usd and admitted: spent + running worst case stays within cap x margin.

    requests: unique integer `order`, worst_usd. The first refusal ends the run, and worst cases
    are not negative, so the admitted rows are a prefix.
    """
    r = chunk_scan(requests, [], order, width, cumsum={"running_usd": F.col("worst_usd")}, levels=2)
    r = attach_row(r, spent.agg(F.coalesce(F.sum("spent_usd"), F.lit(0.0)).alias("_spent")))
    return r.withColumn("admitted", F.col("_spent") + F.col("running_usd") <= cap_usd * margin
                        ).drop("_spent")


def prompt_token_estimate(contents: Column) -> Column:
    """About three characters a token plus a fixed overhead per message and per request."""
    return F.aggregate(contents, F.lit(16), lambda a, c: a + F.floor(F.length(c) / 3).cast("int") + 8)


def project_spend(pilot: DataFrame, plan: DataFrame) -> DataFrame:
    """(part, cost_per_call, calls, projected_usd) plus a total row. plan: (part, calls)."""
    p = pilot.groupBy("part").agg(F.avg("spent_usd").alias("cost_per_call")).join(plan, "part")
    p = p.withColumn("projected_usd", F.col("cost_per_call") * F.col("calls"))
    total = p.agg(F.lit("total").alias("part"), F.lit(None).cast("double").alias("cost_per_call"),
                  F.sum("calls").alias("calls"), F.sum("projected_usd").alias("projected_usd"))
    return p.select("part", "cost_per_call", "calls", "projected_usd").unionByName(total)


def invalid_answers(answers: DataFrame, by: str = "decision") -> DataFrame:
    return answers.groupBy(by).agg(F.count_if(~F.col("valid")).alias("invalid"), F.avg(
        (~F.col("valid")).cast("double")).alias("share"))
