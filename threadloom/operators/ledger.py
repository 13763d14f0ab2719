"""Costs and times of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CALLS = "phase string, stage string, model string, prompt_tokens long, completion_tokens long, seconds double, error string"
PRICES = "model string, prompt_price double, completion_price double"


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls (stage, model, prompt_tokens, completion_tokens, seconds) with their cost; an unknown model is free. Prices are per 1,000 tokens."""
    rows = calls.join(prices, "model", "left")
    cost = (F.col("prompt_tokens") * F.coalesce("prompt_price", F.lit(0.0)) + F.col("completion_tokens") * F.coalesce("completion_price", F.lit(0.0))) / 1000
    return rows.withColumn("cost", cost).drop("prompt_price", "completion_price")


def by_stage(calls: DataFrame) -> DataFrame:
    """Tokens, calls, time and cost of each stage, with its share of the time."""
    rows = calls.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds"), F.sum("cost").alias("cost"))
    total = rows.agg(F.sum("seconds").alias("all_seconds"))
    share = F.when(F.col("all_seconds") > 0, 100 * F.col("seconds") / F.col("all_seconds")).otherwise(0.0)
    return rows.crossJoin(F.broadcast(total)).withColumn("percent", share).drop("all_seconds")  # one row


def split_halves(tokens):
    """Tokens of a joint extraction dealt to entities and relations."""
    half = F.floor(tokens / 2).cast("long")
    return half, tokens - half


def within_budget(calls: DataFrame, budget: float) -> DataFrame:
    """Stages in order with their running cost, and whether it is still within the budget."""
    run = F.sum("cost").over(Window.orderBy("stage"))  # a row for each stage
    return calls.groupBy("stage").agg(F.sum("cost").alias("cost")).withColumn("cost_so_far", run).withColumn("within", F.col("cost_so_far") <= budget)


def remaining_tokens(prompt_tokens, window):
    """How many tokens a model's window leaves for its reply."""
    return F.greatest(window - prompt_tokens, F.lit(0))


def rollups(calls: DataFrame) -> DataFrame:
    """Calls with their cost (phase, stage, ...) summed by stage, by phase and over all (null where summed over), with the share of all seconds."""
    sums = [F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("seconds").alias("seconds"), F.sum("cost").alias("cost"), F.count("error").alias("errors"), F.grouping_id().alias("level")]
    rows = calls.groupingSets([[F.col("phase"), F.col("stage")], [F.col("phase")], []], F.col("phase"), F.col("stage")).agg(*sums).where("calls > 0")
    whole = F.max(F.when(F.col("level") == 3, F.col("seconds"))).over(Window.partitionBy())  # a row for each stage
    return rows.withColumn("percent", F.when(whole > 0, 100 * F.col("seconds") / whole).otherwise(0.0)).drop("level")


def overview(calls: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: seconds, tokens and cost of building and of querying beside the measures (total_questions, ...), and what they come to for each question."""
    of = lambda c, phase: F.coalesce(F.sum(F.when(F.col("phase") == phase, F.col(c))), F.lit(0.0))
    total = calls.agg(of("seconds", "build").alias("build_seconds"), of("seconds", "query").alias("query_seconds"), of("cost", "build").alias("build_cost"), of("cost", "query").alias("query_cost"), F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0)).alias("tokens"))
    n = F.greatest("total_questions", F.lit(1))
    rows = total.crossJoin(F.broadcast(metrics)).withColumn("seconds", F.col("build_seconds") + F.col("query_seconds"))  # one row each
    rows = rows.withColumn("questions_per_minute", F.col("total_questions") / F.greatest(F.col("seconds") / 60, F.lit(0.001)))
    return rows.withColumn("seconds_per_question", F.col("query_seconds") / n).withColumn("cost_per_question", F.col("query_cost") / n)


def advice(overview: DataFrame, most_cost: float = 0.1, most_seconds: float = 10.0, least_accuracy: float = 0.8) -> DataFrame:
    """(about, of, impact, found): what in an overview is over its threshold; no row where nothing is."""
    rule = lambda about, of, impact, found, bad: F.when(bad, F.struct(F.lit(about).alias("about"), F.lit(of).alias("of"), F.lit(impact).alias("impact"), F.col(found).cast("double").alias("found")))
    rules = [
        rule("cost", "building: a smaller model may do for extraction", "high", "build_cost", F.col("build_cost") > most_cost),
        rule("time", "querying: fewer candidates or a faster model", "medium", "seconds_per_question", F.col("seconds_per_question") > most_seconds),
        rule("accuracy", "retrieval: more candidates, other thresholds or prompts", "high", "accuracy", F.col("accuracy") < least_accuracy),
    ]
    return overview.select(F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("a")).select("a.*")


def report(stages: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: totals of all stages beside the measures."""
    totals = stages.agg(F.sum("calls").alias("calls"), F.sum("seconds").alias("seconds"), F.sum("cost").alias("cost"))
    rows = totals.crossJoin(F.broadcast(metrics))  # one row each
    return rows.withColumn("questions_per_minute", F.when(F.col("seconds") > 0, 60 * F.col("total_questions") / F.col("seconds")))
