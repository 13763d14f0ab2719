"""Measures over results: answers, verdicts and sessions found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text


def judged(results: DataFrame) -> DataFrame:
    """Whether each row (answer, output) is answered, and correct; without an expected answer it is neither right nor scored."""
    scored = (F.coalesce("answer", F.lit("")) != "") & (F.coalesce("output", F.lit("")) != "")
    return results.withColumn("answered", F.coalesce("output", F.lit("")) != "").withColumn("correct", F.when(scored, text.answer_match(F.col("answer"), F.col("output"))).otherwise(False))


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Accuracy and answer rate, over all questions, or for each value of `by`."""
    aggs = [F.count("*").alias("total_questions"), F.count_if("answered").alias("answered_questions"), F.count_if("correct").alias("correct_answers")]
    out = rows.groupBy(*by).agg(*aggs)
    n = F.greatest("total_questions", F.lit(1))
    return out.withColumn("accuracy", F.round(F.col("correct_answers") / n, 6)).withColumn("answer_rate", F.round(F.col("answered_questions") / n, 6))


def judge_prompt(question_type: Column, question: Column, answer: Column, output: Column) -> Column:
    """What a judging model is asked; its verdict is whether its reply has a yes."""
    rule = (
        F.when(question_type == "temporal-reasoning", "Days, weeks or months may be off by one.")
        .when(question_type == "knowledge-update", "Older information beside the updated answer is fine.")
        .when(question_type == "single-session-preference", "The reply must recall and use the preference; it need not cover all of it.")
        .otherwise("The reply must contain the correct answer or be equivalent to it.")
    )
    return F.concat(rule, F.lit("\nQuestion: "), question, F.lit("\nCorrect answer: "), answer, F.lit("\nReply: "), output, F.lit("\nIs the reply correct? Answer yes or no."))


def verdict(reply: Column) -> Column:
    return F.contains(F.lower(reply), F.lit("yes"))


def session_recall(origin: Column, found: Column) -> Column:
    """The share of origin sessions that were found, repeats counted; 0 where either is empty."""
    hits = F.size(F.filter(origin, lambda x: F.array_contains(found, x)))
    return F.when((F.size(origin) > 0) & (F.size(found) > 0), hits / F.greatest(F.size(origin), F.lit(1))).otherwise(0.0)


def session_recall_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, recall): `session_recall` of all rows (key, origin, found) of a key, one session each, counted by session before a key's rows meet."""
    each = rows.select(key, F.explode(F.array(F.struct(F.col("origin").alias("session"), F.lit(1).alias("n"), F.lit(0).alias("hit")), F.struct(F.col("found").alias("session"), F.lit(0).alias("n"), F.lit(1).alias("hit")))).alias("x"))
    counted = each.groupBy(key, "x.session").agg(F.sum("x.n").alias("n"), F.max("x.hit").alias("hit"))
    known = F.when(F.col("session").isNotNull(), F.col("n")).otherwise(0)
    return counted.groupBy(key).agg(F.coalesce(F.try_divide(F.sum(known * F.col("hit")), F.sum(known)), F.lit(0.0)).alias("recall"))


def running_accuracy(rows: DataFrame, order) -> DataFrame:
    """Correct answers and accuracy so far, in order of question_id within `order`'s window."""
    right, seen = F.sum(F.col("correct").cast("int")).over(order), F.count("*").over(order)
    return rows.withColumn("right_so_far", right).withColumn("accuracy_so_far", F.round(right / seen, 6))
