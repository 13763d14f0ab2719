"""What a run leaves behind: calls, errors and reports; and how models are called."""

import asyncio
import time

import pytest
from pyspark.sql import functions as F

from threadloom.operators import extract, ledger
from threadloom.plans.config import Config
from threadloom.plans.memory import Memory

SESSION = "doc_id long, session_id string, session_time string, context string"
REPLY = '("entity"|Ann|person|x)##("relationship"||S|Ann|Paris|visits|7)##END'


class Slow:
    """Notes how many calls are under way; fails on `bad`, hangs on `hang`, and fails twice on `shy`."""

    def __init__(self):
        self.now, self.most, self.seen = 0, 0, {}

    async def agenerate(self, prompt):
        self.now += 1
        self.most = max(self.most, self.now)
        self.seen[prompt] = self.seen.get(prompt, 0) + 1
        try:
            await asyncio.sleep(30 if prompt == "hang" else 0.01)
            if prompt == "bad" or prompt == "shy" and self.seen[prompt] < 3:
                raise ValueError("no")
            return f"{prompt}|{self.most}|{self.seen[prompt]}"
        finally:
            self.now -= 1


def test_calls_are_capped_retried_and_timed_out(spark):
    rows = spark.createDataFrame([(f"p{k}",) for k in range(60)] + [("bad",), ("hang",), ("shy",)], "prompt string").coalesce(1)
    began = time.monotonic()
    got = {r["prompt"]: r for r in extract.generate(rows, "prompt", Slow, calls=extract.Calls(5, 1.0, 2, 0.01), told="call").collect()}
    assert time.monotonic() - began < 25
    good = [r["reply"].split("|") for p, r in got.items() if p not in ("bad", "hang")]
    assert max(int(x[1]) for x in good) == 5 and len(good) == 61
    assert got["shy"]["reply"].endswith("|3") and got["shy"]["call_error"] is None and got["shy"]["call_seconds"] > 0
    assert (got["bad"]["reply"], got["bad"]["call_error"]) == ("", "ValueError: no")
    assert got["hang"]["call_error"].startswith("TimeoutError")


def test_a_failing_batch_is_told_row_by_row(spark):
    class Picky:
        def generate(self, prompts):
            if "x" in prompts:
                raise KeyError("x")
            return [p + "!" for p in prompts]

    rows = spark.createDataFrame([("a",), ("x",), ("b",)], "prompt string").coalesce(1)
    assert [(r["reply"], r["call_error"]) for r in extract.generate(rows, "prompt", Picky, told="call").collect()] == [("a!", None), ("", "KeyError: 'x'"), ("b!", None)]
    assert extract.generate(rows.limit(0), "prompt", Picky).count() == 0


def test_a_run_leaves_its_calls_and_errors(spark, tmp_path):
    class Builder:
        def generate(self, prompts):
            return [REPLY] * len(prompts)

    class Asker:
        def generate(self, prompts):
            if any("Question: Why" in p and p.startswith("Facts") for p in prompts):
                raise RuntimeError("down")
            return ["abcdefgh"] * len(prompts)

    m = Memory(spark, str(tmp_path / "m"), Config(model="m1", query_model="m2"), generator=Builder, query_generator=Asker)
    assert m.calls().count() == 0
    m.build(spark.createDataFrame([(0, "S0", "", '"user": "Ann"'), (1, "S1", "", '"user": "Ann"')], SESSION))
    asked = spark.createDataFrame([(1, "Why?", "", "x", ["S0"]), (2, "Who?", "", "abc", ["S0"])], "question_id long, question string, question_time string, answer string, origin array<string>")
    out = {r["question_id"]: r for r in m.query(asked).collect()}
    assert out[1]["error"] == "RuntimeError: down" and out[1]["output"] == "No answer could be generated."
    assert out[2]["error"] is None and out[2]["output"] == "abcdefgh"
    found = {(r["phase"], r["stage"], r["model"]): r for r in m.calls().groupBy("phase", "stage", "model").agg(F.count("*").alias("n"), F.sum("completion_tokens").alias("c"), F.count("error").alias("e"), F.min("seconds").alias("s"), F.min("prompt_tokens").alias("p")).collect()}
    assert {k: (r["n"], r["c"], r["e"]) for k, r in found.items()} == {("build", "extraction", "m1"): (2, 2 * (len(REPLY) // 4), 0), ("build", "summaries", "m1"): (2, 2 * (len(REPLY) // 4), 0), ("query", "query_entities", "m2"): (2, 4, 0), ("query", "answer", "m2"): (2, 2, 1)}
    assert all(r["s"] >= 0 and r["p"] > 0 for r in found.values())
    prices = spark.createDataFrame([("m1", 100.0, 100.0)], ledger.PRICES)
    rolled, overview, advice = m.report(prices, m.query(asked))
    assert {(r["phase"], r["stage"]): r["calls"] for r in rolled.collect()}[None, None] == 12  # four of the build, four of each time asked
    row = overview.first()
    assert row["total_questions"] == 2 and row["build_cost"] > 0.1 and row["query_cost"] == 0 and row["questions_per_minute"] > 0
    assert {r["about"] for r in advice.collect()} == {"cost", "accuracy"}


def test_no_calls_no_report(spark):
    empty = spark.createDataFrame([], ledger.CALLS).withColumn("cost", F.lit(0.0))
    metrics = spark.createDataFrame([(0, 1.0)], "total_questions long, accuracy double")
    assert ledger.rollups(empty).count() == 0
    assert ledger.overview(empty, metrics).first()["questions_per_minute"] == 0 and ledger.advice(ledger.overview(empty, metrics)).count() == 0
    with pytest.raises(ValueError):
        Config.parse(modle="x")
