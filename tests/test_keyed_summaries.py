"""Summaries as keyed state: a batch touches its own sessions, a restart goes on, a failing model changes nothing."""

import json

import pytest

from threadloom.operators import extract
from threadloom.sources.snapshots import Snapshots
from threadloom.streaming import summaries
from threadloom.streaming.summaries import joined, parsed, session_summaries, shown, summarise_into, use_rocksdb

PART = "doc_id long, session_id string, session_time string, context string"


class Telling:
    """Replies with what it was asked: a merge or a new summary, and the parts; fails where told to."""

    def generate(self, prompts):
        (p,) = prompts
        if "FAIL" in p.rpartition("Context: ")[2]:
            raise RuntimeError
        kind = "merged" if p.startswith("Bring") else "new"
        known = p.partition("summary so far: ")[2] or p.partition("Summary so far: ")[2].partition("\nSession ID")[0]
        return [json.dumps({"keys": kind, "context": {"theme_1": known, "summary_1": p.rpartition("Context: ")[2]}})]


def put(path, name, *rows):
    (path / name).write_text("\n".join(json.dumps(dict(zip(("doc_id", "session_id", "session_time", "context"), r))) for r in rows))


@pytest.fixture
def stream(spark, tmp_path):
    use_rocksdb(spark)
    source = tmp_path / "in"
    source.mkdir()

    def run(out):
        rows = spark.readStream.schema(PART).option("maxFilesPerTrigger", 1).json(str(source))
        got = []

        def keep(batch, batch_id):
            got.extend((batch_id, r.asDict()) for r in batch.collect())

        changed = session_summaries(rows, Telling)
        changed.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / out)).trigger(availableNow=True).start().awaitTermination()
        return [(b, r["session_id"], r["keys"], r["context"].get("summary_1"), r["summary_status"], r["parts"]) for b, r in got]

    yield source, run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_batches_touch_their_own_sessions_and_restart(stream):
    source, run = stream
    put(source, "a.json", (1, "A", "2023/01/01", "second"), (0, "A", "", "first"), (2, "B", None, "b"), (3, None, "", "no session"))
    assert sorted(run("ck")) == [(0, "A", "new", "first\n\nsecond", "ok", 2), (0, "B", "new", "b", "ok", 1)]
    put(source, "b.json", (4, "A", "", "third"))
    assert run("ck") == [(1, "A", "merged", "third", "ok", 3)]  # a new query on the same checkpoint
    put(source, "c.json", (5, "B", "", "FAIL"), (6, "C", "", "FAIL"))
    assert sorted(run("ck")) == [(2, "B", "new", "b", "failed", 2), (2, "C", "session, conversation", "", "failed", 1)]
    put(source, "d.json", (7, "C", "", "c"), (8, "B", "", "more"))
    assert sorted(run("ck")) == [(3, "B", "merged", "more", "ok", 3), (3, "C", "new", "c", "ok", 1)]


def test_changes_are_appended_to_a_memory(spark, stream, tmp_path):
    source, _ = stream
    store = Snapshots(spark, str(tmp_path / "m"), buckets=2)
    put(source, "a.json", (0, "A", "2023/01/01", "a"), (1, "B", "", "b"))

    def go():
        rows = spark.readStream.schema(PART).option("maxFilesPerTrigger", 1).json(str(source))
        summarise_into(store, session_summaries(rows, Telling), str(tmp_path / "ck"), extract.HashEmbedder).awaitTermination()

    go()
    put(source, "b.json", (2, "A", "", "again"))
    go()
    got = {r["session_id"]: (r["keys"], r["embedding"] is not None) for r in store.read()["summaries"].collect()}
    assert got == {"A": ("merged", True), "B": ("new", True)} and store.versions() == [0, 1]
    assert store.read(0)["summaries"].where("keys = 'merged'").isEmpty()


def test_texts_equal_the_columns(spark):
    from pyspark.sql import functions as F

    from threadloom.operators import chunking, context

    told = {"theme_10": "ten", "theme_2": "two", "summary_2": "s", "other": "x"}
    row = spark.createDataFrame([("S", None, "k", told)], "session_id string, session_time string, keys string, context map<string,string>")
    assert row.select(context.summary_line(*map(F.col, row.columns))).first()[0] == shown("S", None, "k", told)
    parts = ["a b", "b", "c", "a b\n\nc", ""]
    frame = spark.createDataFrame([("S", "", k, p) for k, p in enumerate(parts)], "session_id string, session_time string, ordinal int, context string")
    assert chunking.concat_sessions(frame).first()["context"] == joined(parts)
    replies = ['{"keys": "k", "context": {"theme_1": "t"}}', 'so: ```json\n{"keys": "k", "context": {"theme_1": "t"}}\n```', "plain " * 60, "", '{"context": 3}', '[1]', 'x {"session_time": "2024", "context": {}} y']
    frame = spark.createDataFrame([(str(k), "2023/01/02 10:00", r) for k, r in enumerate(replies)], "session_id string, session_time string, reply string")
    for r in extract.parse_summaries(frame).collect():
        time, keys, said, status = parsed(replies[int(r["session_id"])], "2023/01/02 10:00")
        assert (r["keys"], r["context"], r["summary_status"]) == (keys, said, status)
    assert summaries.UPDATE.count(",") == 6
