"""Documents as units: their order, their layouts, their origins, and what a failing model leaves alone."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import chunking, retrieve
from threadloom.plans.config import Config
from threadloom.plans.memory import Memory
from threadloom.sources import corpus

SESSION = "doc_id long, session_id string, session_time string, context string"


class Says:
    """Relations as the dialogue tells them: `A does B`."""

    def generate(self, prompts):
        out = []
        for p in prompts:
            told = p.rpartition("Dialogue:\n")[2]
            lines = [line.partition(": ")[2].split() for line in told.splitlines()]
            out.append("##".join(f'("relationship"||S|{w[0]}|{w[2]}|{w[1]}|5)' for w in lines if len(w) == 3) or "END")
        return out


def test_named_speakers_are_ingested(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    m.build(spark.createDataFrame([(0, "D1", "", '"Caroline": "hi there""Melanie": "hello you""Caroline" : "bye"'), (1, "D2", "", '"user" : "hi""assistant": "yo"')], SESSION))
    assert [(r["chunk_id"], r["doc_id"], r["text"]) for r in m.store.read()["chunks"].orderBy("chunk_id").collect()] == [(0, 0, "Caroline: hi there\nMelanie: hello you"), (1, 0, "Caroline: bye"), (2, 1, "User: hi\nAssistant: yo")]
    with pytest.raises(ValueError):
        chunking.dialogue_chunks(spark.createDataFrame([], SESSION), "other")


def test_rows_of_one_session_stay_apart(spark):
    said = lambda k: f'"user": "q {k}""assistant": "a {k}"'
    rows = spark.createDataFrame([(0, "S1", "2023/01/01", said("one")), (1, "S1", "2023/01/02", said("two")), (2, "S1", "2023/01/02", said("two"))], SESSION)
    got = [r["text"] for r in chunking.with_chunk_ids(chunking.dialogue_chunks(rows)).orderBy("chunk_id").collect()]
    assert got == ["User: q one\nAssistant: a one", "User: q two\nAssistant: a two", "User: q two\nAssistant: a two"]


def test_the_last_document_decides_a_relation(spark, tmp_path):
    rows = [(0, "D2", "", '"user": "Ann visits Paris"'), (1, "D10", "", '"user": "Ann left Paris"')]
    m = Memory(spark, str(tmp_path / "m"), generator=Says)
    m.build(spark.createDataFrame(rows, SESSION).repartition(2))
    tables = m.store.read()
    assert [r["session_id"] for r in tables["chunks"].orderBy("chunk_id").collect()] == ["D2", "D10"]
    assert [r["relation"] for r in tables["edges"].collect()] == ["left"]


def test_documents_without_an_id_are_numbered(spark):
    rows = spark.createDataFrame([(f"D{k}", "", f'"user": "{k}"') for k in range(30)], "session_id string, session_time string, context string").coalesce(3)
    got = corpus.with_doc_id(rows).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["session_id"]) for r in got] == [(k, f"D{k}") for k in range(30)]


def test_windows_of_title_and_content(spark, tmp_path):
    rows = spark.createDataFrame([(0, "D1", "", "ctx", "A title", "the content here"), (1, "D2", "", "only context", None, None)], SESSION + ", title string, content string")
    m = Memory(spark, str(tmp_path / "m"), Config(chunk_mode="tokens", window_tokens=4, window_overlap=1))
    got = [(r["doc_id"], r["title"], r["chunk_idx"], r["text"]) for r in m.chunks(rows).orderBy("chunk_id").collect()]
    assert got == [(0, "A title", 0, "A title the content"), (0, "A title", 3, "content here"), (1, "", 0, "only context")]


def test_summaries_follow_the_documents(spark, tmp_path):
    class Told:
        def generate(self, prompts):
            return [p.rpartition("Context: ")[2] for p in prompts]

    rows = spark.createDataFrame([(1, "S", "", "second"), (0, "S", "", "first")], SESSION).repartition(1)
    (got,) = Memory(spark, str(tmp_path / "m"), generator=Told).summaries(rows).collect()
    assert got["context"]["summary_1"] == "first\n\nsecond"


def test_a_failed_merge_keeps_the_old_summary(spark, tmp_path):
    class Good:
        def generate(self, prompts):
            return [json.dumps({"keys": "k", "context": {"theme_1": "t", "summary_1": "s"}})] * len(prompts)

    class Failing:
        def generate(self, prompts):
            raise RuntimeError

    one = spark.createDataFrame([(0, "S", "", '"user": "x"')], SESSION)
    Memory(spark, str(tmp_path / "m"), generator=Good).build(one)
    m = Memory(spark, str(tmp_path / "m"), generator=Failing)
    m.add(one.union(spark.createDataFrame([(1, "T", "", '"user": "y"')], SESSION)))
    got = {r["session_id"]: (r["keys"], r["summary_status"]) for r in m.store.read()["summaries"].collect()}
    assert got["S"] == ("k", "ok") and got["T"][1] == "failed"


def test_origins_of_all_forms(spark, tmp_path):
    lines = [{"question": "a", "origin": ["D1", "D2"]}, {"question": "b", "origin": "D3"}, {"question": "c", "origin": "D4, D5;D6"}, {"question": "d", "origin": []}, {"question": "e"}, {"question": "f", "origin": [" D7 ", None, ""]}]
    (tmp_path / "q.json").write_text("\n".join(map(json.dumps, lines)))
    got = {r["question"]: r["origin"] for r in corpus.read_questions(spark, str(tmp_path / "q.json")).collect()}
    assert got == {"a": ["D1", "D2"], "b": ["D3"], "c": ["D4", "D5", "D6"], "d": [], "e": [], "f": ["D7"]}
    m = Memory(spark, str(tmp_path / "m"))
    results = corpus.read_questions(spark, str(tmp_path / "q.json")).where("question = 'a'").withColumns({"answer": F.lit("x"), "output": F.lit("x"), "top_session_ids": F.array(F.lit("D2"))})
    assert m.evaluate(results).first()["session_recall"] == 0.5


def test_top_is_limited_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("question_id"), F.col("id").alias("score"))
    plan = retrieve.top(rows, [F.desc("score")], 2)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["question_id"], r["score"], r["rank"]) for r in plan.collect()) == [(0, 96, 1), (0, 99, 0), (1, 94, 1), (1, 97, 0), (2, 95, 1), (2, 98, 0)]


def test_flagship_plan_is_cut(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["retrieve_pipeline"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert plan.partition("Physical Plan")[2].count("FileScan") < 20
