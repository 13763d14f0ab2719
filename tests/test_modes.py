"""What `mode` asks for, chunks made elsewhere, counts of an addition, the command line, and the first relations of names."""

import json

import pytest

from tests.test_memory import People, edges, memory, sessions
from threadloom import __main__ as command
from threadloom.operators import context, graph, retrieve
from threadloom.plans.memory import Memory


def test_modes(spark, tmp_path):
    path, first, second = tmp_path / "m", sessions(spark, ("S0", "Ann in Paris")), sessions(spark, ("S1", "Cid in Paris"))
    with pytest.raises(FileNotFoundError):
        memory(spark, path, mode="load").insert()
    for mode in ("add", "other"):
        with pytest.raises(ValueError):
            memory(spark, path, mode=mode).insert()
    assert memory(spark, path, mode="add").insert(first) == 0  # nothing is stored: a build
    assert memory(spark, path, mode="add").insert(second) == 1
    m = memory(spark, path)
    assert m.insert() == 1 and edges(m) == {("Ann", "visits", "Paris"), ("Cid", "hates", "Paris")}
    assert m.added() == {"nodes": {"added": 1, "merged": 1}, "edges": {"added": 1, "merged": 0}} and m.added(0) == {}
    assert memory(spark, path, mode="force").insert(second) == 2 and edges(m) == {("Cid", "hates", "Paris")}


def test_chunks_made_elsewhere(spark, tmp_path):
    m = memory(spark, tmp_path / "m")
    m.build(sessions(spark, ("S0", "Ann in Paris")))
    given = spark.createDataFrame([(7, 1, "S1", "2023/01/03", "Cid in Paris", "x"), (7, 0, "S1", "2023/01/03", "Ann in Paris", "x"), (8, 0, "S2", None, None, "x")], "doc_id long, chunk_idx int, session_id string, session_time string, text string, ordinal string")
    assert m.add_chunks(given) == 1
    stored = m.store.read()
    assert [(r["chunk_id"], r["session_id"], r["text"]) for r in stored["chunks"].orderBy("chunk_id").collect()][1:] == [(1, "S1", "Ann in Paris"), (2, "S1", "Cid in Paris")]
    assert edges(m) == {("Ann", "visits", "Paris"), ("Cid", "hates", "Paris")}
    assert m.added()["edges"] == {"added": 1, "merged": 1}
    assert [r["session_id"] for r in stored["summaries"].collect()] == ["S0"]
    assert m.add_chunks(given.limit(0)) == 2 and m.added() == {k: {"added": 0, "merged": 0} for k in ("nodes", "edges")}
    assert m.add(sessions(spark, ("S9", "Ann"))) == 3 and {r[0] for r in m.store.read()["chunks"].select("chunk_id").collect()} == {0, 1, 2, 3}


def test_counts_outlive_a_compaction(spark, tmp_path):
    m = memory(spark, tmp_path / "m", compact_after=1)
    m.build(sessions(spark, ("S0", "Ann in Paris")))
    assert m.add(sessions(spark, ("S1", "Cid in Paris"))) == 2 and m.added()["nodes"] == {"added": 1, "merged": 1}


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    said = [{"session_id": f"S{k}", "session_time": "2023/01/02", "context": f'"user": "{name} in Paris""assistant": "I see"'} for k, name in enumerate(("Ann", "Cid"))]
    (tmp_path / "in" / "Corpus.json").write_text(json.dumps(said))
    asked = {"question": "Where did Ann go?", "answer": "Paris", "question_type": "x", "question_time": "2023/01/05", "origin": "S0", "label": ""}
    (tmp_path / "in" / "Question.json").write_text(json.dumps(asked) + "\n")
    (tmp_path / "s.yaml").write_text("mode: force\ntop_chunks: 1\n")
    given = ["--data", str(tmp_path / "in"), "--store", str(tmp_path / "m"), "--model", f"{People.__module__}:People"]
    assert command.run(spark, [*given, "--settings", str(tmp_path / "s.yaml"), "--out", str(tmp_path / "out")]) == 0
    assert spark.read.json(str(tmp_path / "out" / "results")).first()["output"] == "Paris"
    assert spark.read.json(str(tmp_path / "out" / "metrics")).first()["correct_answers"] == 1
    assert command.run(spark, [*given, "--mode", "add"]) == 1
    assert command.run(spark, given) == 1  # as it is stored
    assert len(edges(Memory(spark, str(tmp_path / "m")))) == 2


EDGES = "ordinal long, src string, tgt string, relation string, chunk_id long"


def test_relations_of_names_come_in_order_and_once(spark):
    e = spark.createDataFrame([(5, "a", "b", "r", 1), (3, "b", "a", "s", 2), (4, "a", "a", "t", None), (1, "c", "d", "u", 4), (2, "d", "b", "v", 2)], EDGES)
    names = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 1, "b"), (2, 0, "c"), (2, 1, None), (3, 0, "none")], "question_id int, query_ord int, name string")
    got = [(r["question_id"], r["relation"], r["rank"]) for r in retrieve.relations_of(names, e, 4).orderBy("question_id", "rank").collect()]
    assert got == [(1, "s", 0), (1, "t", 1), (1, "r", 2), (1, "v", 3), (2, "u", 0)]
    assert retrieve.relations_of(names.limit(0), e).isEmpty() and retrieve.relations_of(names, e.limit(0)).isEmpty()
    assert sorted(r[0] for r in context.chunk_ids_of(e).collect()) == [1, 2, 4]
    counts = graph.upsert_counts(e.where("ordinal < 3"), e, ["src", "tgt"]).first()
    assert (counts["added"], counts["merged"]) == (3, 2)
    assert tuple(graph.upsert_counts(e, e.limit(0), ["src", "tgt"]).first()) == (0, 0)


def test_triples_of_a_figure(spark):
    rows = spark.createDataFrame([(1, k, 1.0 - k / 10) for k in range(12)] + [(2, 0, 0.5)], "question_id int, final_rank int, final_score double")
    got = {(r["question_id"], r["final_rank"]): (r["bucket"], r["in_table"]) for r in retrieve.visual_triples(rows).collect()}
    assert len(got) == 11 and got[1, 0] == ("high", True) and got[1, 9] == ("low", False) and got[1, 4] == ("medium", True) and got[2, 0] == ("high", True)
