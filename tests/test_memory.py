"""The memory plan, its snapshots and streams, and the operators that they use."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions import temporal
from threadloom.operators import context, dedup, evaluate, extract, ledger, retrieve
from threadloom.plans.config import Config
from threadloom.plans.memory import Memory
from threadloom.sources import corpus
from threadloom.streaming.ingest import ingest, session_stream

SUMMARY = {"session_id": "", "session_time": "", "keys": "ann, paris", "context": {"theme_1": "Travel", "summary_1": "Ann went to Paris."}}


class People:
    """Entities and relations of the names in a dialogue, a summary of each session, the names in a question."""

    def generate(self, prompts):
        out = []
        for p in prompts:
            names = [n for n in ("Ann", "Cid", "Paris") if n in p]
            if p.startswith("List the entities and relations"):
                entities = [f'("entity"|{n}|{"location" if n == "Paris" else "person"}|about {n})' for n in names]
                relations = ['("relationship"||S|Ann|Paris|visits|7)'] * ("Ann" in names) + ['("relationship"||S|Cid|Paris|hates|3)'] * ("Cid" in names)
                out.append("##".join([*entities, *relations, "END"]))
            elif p.startswith("List the entities that"):
                out.append("##".join([f'("entity"|{n}|person)' for n in names]))
            elif p.startswith("Summarise"):
                out.append(json.dumps(SUMMARY))
            elif p.startswith("Bring"):
                out.append(json.dumps(SUMMARY | {"keys": "ann, paris, more"}))
            elif "Answer yes or no" in p:
                out.append("Yes." if "Correct answer: Paris" in p else "no")
            else:
                out.append("Paris" if "Summaries:" in p and "Ann went to Paris" in p else "")
        return out


def sessions(spark, *rows):
    return spark.createDataFrame([(s, "2023/01/02", f'"user": "{said}""assistant": "I see"') for s, said in rows], "session_id string, session_time string, context string")


def memory(spark, path, **given):
    return Memory(spark, str(path), Config(**given), generator=People)


def edges(m):
    return {(r["src"], r["relation"], r["tgt"]) for r in m.store.read()["edges"].collect()}


def test_a_reply_with_several_entities(spark, tmp_path):
    m = memory(spark, tmp_path / "m")
    m.build(sessions(spark, ("S0", "Ann and Cid talk of Paris")))
    assert edges(m) == {("Ann", "visits", "Paris"), ("Cid", "hates", "Paris")}
    nodes = {r["name"]: (r["entity_type"], r["extracted"], r["description"], r["embedding"] is not None) for r in m.store.read()["nodes"].collect()}
    assert nodes == {"Ann": ("person", True, "about Ann", True), "Cid": ("person", True, "about Cid", True), "Paris": ("location", True, "about Paris", True)}
    assert m.store.read()["edges"].where("embedding is null").isEmpty()
    (s,) = m.store.read()["summaries"].collect()
    assert (s["session_id"], s["keys"], s["summary_status"], s["embedding"] is not None) == ("S0", "ann, paris", "ok", True)


def test_streams_into_a_memory_that_has_versions(spark, tmp_path):
    m = memory(spark, tmp_path / "m")
    assert m.build(sessions(spark, ("S0", "Ann in Paris"))) == 0
    assert m.add(sessions(spark, ("S1", "Cid in Paris")), "s", 0) == 1
    assert m.add(sessions(spark, ("S1", "Cid in Paris")), "s", 0) == 1  # the batch again
    assert m.add(sessions(spark, ("S2", "Ann"))) == 2
    assert m.add(sessions(spark, ("S4", "Cid")), "s", 1) == 3
    assert {r[0] for r in m.store.read()["chunks"].select("session_id").collect()} == {"S0", "S1", "S2", "S4"}
    assert m.add(sessions(spark, ("S5", "Ann")), "other", 0) == 4
    assert m.store.batches(4) == {"s": 1, "other": 0}
    assert m.build(sessions(spark, ("S9", "Ann in Paris"))) == 5 and m.store.versions() == [5]


def test_a_stream_after_a_build(spark, tmp_path):
    source = tmp_path / "in"
    sessions(spark, ("S1", "Cid in Paris"), ("S2", "Ann")).repartition(2).write.json(str(source))
    m = memory(spark, tmp_path / "m")
    m.build(sessions(spark, ("S0", "Ann in Paris")))
    ingest(m, session_stream(spark, str(source)), str(tmp_path / "ck")).awaitTermination()
    assert m.store.read()["chunks"].select("session_id").distinct().count() == 3
    assert edges(m) == {("Ann", "visits", "Paris"), ("Cid", "hates", "Paris")}


def test_summaries_are_brought_up_to_date(spark, tmp_path):
    m = memory(spark, tmp_path / "m")
    m.build(sessions(spark, ("S0", "Ann in Paris"), ("S1", "Cid")))
    m.add(sessions(spark, ("S0", "Ann again"), ("S2", "Ann")))
    assert {r["session_id"]: r["keys"] for r in m.store.read()["summaries"].collect()} == {"S0": "ann, paris, more", "S1": "ann, paris", "S2": "ann, paris"}


def test_questions_use_entities_and_summaries(spark, tmp_path):
    m = memory(spark, tmp_path / "m")
    m.build(sessions(spark, ("S0", "Ann in Paris")))
    asked = spark.createDataFrame([(1, "Where did Ann go?", "Paris", "2023/01/05", ["S0"], "x"), (2, "who?", "none", "", ["S9"], "x")], "question_id long, question string, answer string, question_time string, origin array<string>, question_type string")
    named = {r["question_id"]: (r["query_name"], r["query_type"]) for r in m.asked(asked).collect()}
    assert named == {1: ("Ann", "person"), 2: ("who?", "unknown")}
    out = {r["question_id"]: r for r in m.query(asked).collect()}
    assert out[1]["output"] == "Paris" and out[1]["top_session_ids"] == ["S0"]
    assert {r["question_type"]: r["correct_answers"] for r in m.judge(m.query(asked)).collect()} == {"x": 1}
    position = memory(spark, tmp_path / "m", summary_scores="position", temporal=False).query(asked).collect()
    assert len(position) == 2


def test_a_graph_without_vectors_is_searched_by_name(spark, tmp_path):
    class Broken:
        def embed(self, texts):
            raise RuntimeError

    m = Memory(spark, str(tmp_path / "m"), generator=People, embedder=Broken)
    m.build(sessions(spark, ("S0", "Ann in Paris")))
    asked = spark.createDataFrame([(1, "Where did Ann go?", "")], "question_id long, question string, question_time string")
    assert m.query(asked).first()["top_session_ids"] == ["S0"]


def test_embedder_failures_stay_with_their_texts(spark):
    class Picky:
        def embed(self, texts):
            if "bad" in texts:
                raise ValueError
            return [[1.0] for _ in texts]

    rows = spark.createDataFrame([("bad",), ("good",)], "t string").coalesce(1)
    assert {r["t"]: r["embedding"] for r in extract.embed(rows, "t", Picky).collect()} == {"bad": None, "good": [1.0]}


def test_token_mode_and_missing_store(spark, tmp_path):
    m = memory(spark, tmp_path / "m", chunk_mode="tokens", window_tokens=4, window_overlap=1)
    rows = spark.createDataFrame([("S0", "t", "a b c d e f"), ("S1", "t", None)], "session_id string, session_time string, context string")
    assert [(r["chunk_id"], r["session_id"], r["chunk_idx"], r["text"]) for r in m.chunks(rows).orderBy("chunk_id").collect()] == [(0, "S0", 0, "a b c d"), (1, "S0", 3, "d e f")]
    with pytest.raises(FileNotFoundError):
        m.query(spark.createDataFrame([(1, "q", "")], "question_id long, question string, question_time string"))


def test_files_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"session_id": "A0"}\n')
    (tmp_path / "b.json").write_text("".join(f'{{"session_id": "B{k}"}}\n' for k in range(50)))
    (tmp_path / "c.json").write_text('{"session_id": "C0"}\n{"session_id": "C1"}\n')
    got = {r["doc_id"]: r["session_id"] for r in corpus.read_sessions(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(["A0", *(f"B{k}" for k in range(50)), "C0", "C1"]))
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "q.json").write_text('\n [{"question": "x", "origin": "S1; S2"}, {"question": "y"}]')
    assert [(r["question_id"], r["question"], r["origin"]) for r in corpus.read_questions(spark, str(tmp_path / "q")).orderBy("question_id").collect()] == [(0, "x", ["S1", "S2"]), (1, "y", [])]


def test_month_names_in_any_case(spark):
    for given, want in (("8 may, 2023", "2023/05/08"), ("1:56 pm on 8 Jan, 2023", "2023/01/08"), ("3 SEPT 2022", "2022/09/03"), ("3 Foo 2022", "2022/00/03")):
        assert spark.range(1).select(temporal.named_date(F.lit(given))).first()[0] == want


def test_long_strengths_and_small_prefixes(spark):
    rows = spark.createDataFrame([('("relationship"|t|S|a|b|r|12345678901)',)], "reply string")
    assert extract.parse_relations(rows).first()["strength"] == 2**31 - 1
    names = [" ".join(f"w{k}" for k in range(100)), " ".join(f"w{k}" for k in range(45, 145))]  # 55 of 145 shared
    both = [" ".join(f"w{k}" for k in range(100)), " ".join([*(f"w{k}" for k in range(55)), *(f"v{k}" for k in range(0))])]  # 55 of 100
    for texts, linked in ((names, False), (both, True)):
        mentions = spark.createDataFrame([(i, n, "p") for i, n in enumerate(texts)], "ordinal long, entity string, type string")
        assert (dedup.entity_leaders(mentions, 0.55).select("leader").distinct().count() == 1) is linked


def test_untyped_leaders(spark):
    mentions = spark.createDataFrame([(0, "a b", "p"), (1, "b a", "q")], "ordinal long, entity string, type string")
    assert [dedup.entity_leaders(mentions, 0.85, typed).select("leader").distinct().count() for typed in (True, False)] == [2, 1]


def test_long_chains_of_names_settle(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    assert {r["id"]: r["leader"] for r in dedup.leaders(links).collect()} == {i: i - i % 2 for i in range(13)}


def test_stubs_of_chunks_without_text(spark):
    e = spark.createDataFrame([(i, "a", f"r{i}", "b", 7) for i in range(14)] + [(20, "x", "y", "z", 8)], "ordinal long, src string, relation string, tgt string, chunk_id long")
    chosen = spark.createDataFrame([(1, 7, None, 0), (1, 8, "own", 1), (1, 9, None, 2)], "question_id int, chunk_id long, text string, chunk_rank int")
    got = {r["chunk_id"]: r["text"] for r in context.with_stubs(chosen, e).collect()}
    assert got == {7: "; ".join(f"a r{i} b" for i in range(10)), 8: "own", 9: None}


def test_nodes_by_name_and_triples_of_sessions(spark):
    nodes = spark.createDataFrame([(2, "Ann", "person"), (1, "Bob", None), (3, "ann", "cat")], "ordinal long, name string, entity_type string")
    names = spark.createDataFrame([(1, 0, "ANN"), (1, 1, "bob"), (2, 0, "x")], "question_id int, query_ord int, query_name string")
    assert [r["name"] for r in retrieve.nodes_named(names, nodes, 2).orderBy("rank").collect()] == ["Ann", "ann"]
    e = spark.createDataFrame([(1, "a", "S1", [1.0, 0.0]), (2, "b", "S1", [0.0, 1.0]), (3, "c", "S2", [1.0, 0.0]), (4, "d", "S1", None)], "ordinal long, src string, session_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "question_id int, query_vec array<double>")
    got = retrieve.session_triples_top(q, e, spark.createDataFrame([(1, "S1")], "question_id int, session_id string"), 2).orderBy("rank").collect()
    assert [(r["src"], r["similarity"]) for r in got] == [("a", 1.0), ("b", 0.0)]


def test_converters(spark, tmp_path):
    groups = spark.createDataFrame([(1, {"session_1": "one", "session_2": "two", "session_4": "four", "session_1_date_time": "1:00 pm on 8 May, 2023"})], "id int, conversation map<string,string>")
    assert [(r["number"], r["body"]) for r in corpus.numbered_sessions(groups, "conversation", ["id"]).orderBy("number").collect()] == [(1, "one"), (2, "two")]
    rows = spark.createDataFrame([("multi-session", None), ("other", "x"), ("temporal-reasoning", "")], "question_type string, answer string")
    routed = corpus.routed(rows).withColumn("answer", corpus.filled_answer(F.col("answer")))
    assert {(r["folder"], r["answer"]) for r in routed.collect()} == {("ms", corpus.NO_ANSWER), ("tr", corpus.NO_ANSWER)}
    corpus.write_lines(routed, str(tmp_path / "out"), ["folder"])
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    turns = spark.range(1).select(F.array(F.struct(F.lit("Ann").alias("s"), F.lit("hi").alias("t"), F.lit("a cat").alias("c"))).alias("x"))
    assert turns.select(corpus.flatten_turns(F.col("x"), "s", "t", "c")).first()[0] == '"Ann": "hi (attached is a cat)"'


def test_ledgers_and_verdicts(spark):
    calls = spark.createDataFrame([("a", 1, 2.0, 3.0), ("b", 1, 1.0, 3.0)], "stage string, calls int, cost double, seconds double")
    assert [r["within"] for r in ledger.within_budget(calls, 2.5).orderBy("stage").collect()] == [True, False]
    half, rest = spark.range(1).select(*ledger.split_halves(F.lit(7))).first()
    assert (half, rest) == (3, 4)
    assert spark.range(1).select(ledger.remaining_tokens(F.lit(10), F.lit(4))).first()[0] == 0
    metrics = spark.createDataFrame([(12,)], "total_questions int")
    assert ledger.report(calls, metrics).first()["questions_per_minute"] == 120
    assert spark.range(1).select(evaluate.verdict(F.lit("Yes, it is"))).first()[0]
