"""Run metadata: cost and time per model, usage per episode, batch tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaforge.functions.texts import cost_usd


def with_cost(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Runs with total_tokens and estimated_cost_usd from ``prices`` (model, price_in, price_out per million tokens)."""
    out = runs.join(prices, "model", "left").withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    return out.withColumn("estimated_cost_usd", cost_usd(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("price_in"), F.col("price_out"))).drop("price_in", "price_out")


def summarise(runs: DataFrame) -> DataFrame:
    """Means and totals per model, three decimals (half to even). Runs without elapsed_seconds do not count."""
    r = lambda c: F.bround(c, 3)
    return runs.where("elapsed_seconds is not null").groupBy("model").agg(
        F.count("*").alias("episodes"), r(F.avg("elapsed_seconds")).alias("seconds_per_episode"), r(F.avg("n_llm_calls")).alias("llm_calls_per_episode"), r(F.avg("total_tokens")).alias("tokens_per_episode"),
        r(F.avg("estimated_cost_usd")).alias("cost_per_episode_usd"), r(F.sum("elapsed_seconds") / 3600).alias("total_hours"), r(F.sum("estimated_cost_usd")).alias("total_cost_usd"),
    )


def usage(calls: DataFrame) -> DataFrame:
    """Tokens and calls per episode."""
    return calls.groupBy("episode_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count("*").alias("n_llm_calls"))


def tally(runs: DataFrame) -> DataFrame:
    """Episodes by status: failed where an error is recorded."""
    return runs.groupBy(F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status")).agg(F.count("*").alias("n"))
