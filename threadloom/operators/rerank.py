"""Rerankers over a question's pool of triples; they start again from the raw similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import temporal
from threadloom.operators.retrieve import top


def weights(summary_weight: float, with_summaries: bool, extra: float = 0.0) -> tuple[float, float]:
    """(similarity, session) weights; without summaries all weight is on similarity. Where these and `extra` weights are more than 1.5 in all, they are scaled down to it."""
    scale = _scale(extra)
    return ((1 - summary_weight) * scale, summary_weight * scale) if with_summaries else (scale, 0.0)


def _scale(extra: float) -> float:
    return min(1.0, 1.5 / (1 + extra))


def _scored(pool: DataFrame, sessions: DataFrame | None) -> DataFrame:
    if sessions is None:
        return pool.withColumn("session_score", F.lit(0.0))
    return pool.join(sessions, ["question_id", "session_id"], "left").withColumn("session_score", F.coalesce("session_score", F.lit(0.0)))


def simple(pool: DataFrame, sessions: DataFrame | None, summary_weight: float = 0.3, k: int = 8, factors: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of similarity, session score and further columns of pool with weights of 0 or more (factors); ties keep the pool's order. A null counts as 0."""
    factors = factors or {}
    if min(factors.values(), default=0) < 0:
        raise ValueError(f"weights of factors are 0 or more: {factors}")
    extra = sum(factors.values())
    a, b = weights(summary_weight, sessions is not None, extra)
    score = a * F.coalesce("similarity", F.lit(0.0)) + b * F.col("session_score")
    for name, weight in factors.items():
        score = score + weight * _scale(extra) * F.coalesce(F.col(name), F.lit(0.0))
    rows = _scored(pool, sessions).withColumn("final_score", F.round(score, 6))
    return top(rows, [F.desc("final_score"), F.col("pool_rank")], k, rank="final_rank")


def temporal_rerank(pool: DataFrame, sessions: DataFrame | None, summary_weight: float = 0.3, power: float = 0.5, k: int = 8) -> DataFrame:
    """The weighted sum times exp(-(gap / median gap)^power) between question and triple; a session score of 0 counts as 0.01.

    pool has question_time and timestamp as well. A missing time is a gap of 0, and counts in the median.
    """
    a, b = weights(summary_weight, sessions is not None)
    rows = _scored(pool, sessions).withColumn("gap", temporal.day_gap(temporal.question_day(F.col("question_time")), F.col("timestamp")))
    rows = rows.withColumn("median_gap", F.median("gap").over(Window.partitionBy("question_id")))
    lifted = F.when(F.col("session_score") == 0, 0.01).otherwise(F.col("session_score"))
    score = (b * lifted + a * F.coalesce("similarity", F.lit(0.0))) * temporal.decay(F.col("gap"), F.col("median_gap"), power)
    rows = rows.withColumn("final_score", F.round(score, 6))
    return top(rows, [F.desc("final_score"), F.col("pool_rank")], k, rank="final_rank")
