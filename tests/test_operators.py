"""Operators on small literal tables: the cases that the provided tables lack."""

import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.functions import temporal, text, vector
from threadloom.operators import chunking, context, dedup, evaluate, extract, graph, rerank, retrieve
from threadloom.plans.config import Config
from threadloom.plans.memory import Memory
from threadloom.sources import corpus
from threadloom.streaming.ingest import ingest, session_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def turns_of(context, roles_only):
    """Turns of a flattened dialogue by scanning it."""
    marks = list(re.finditer(r'"(user|assistant)"\s*:\s*"' if roles_only else r'"([^"]+)"\s*:\s*"', context or ""))
    out = []
    for i, (here, after) in enumerate(zip(marks, [*marks[1:], None])):
        body = context[here.end() : after.start() if after else None]
        stop = body.rfind('"') if after else body.find('"')
        said = re.sub(r"\s+", " ", (body if stop < 0 else body[:stop]).strip().strip('"')).strip()
        if said:
            out.append((i, here[1], said))
    return out


def test_turns_end_at_the_last_quote_but_the_final_one_at_its_first(spark):
    r = random.Random(3)
    bits = ['"user": "', '"assistant":"', '"Ann": "', '"', ' ', '\n', 'a', 'b b', ' ', '\x1f', ': ', '""', "é", "\\"]
    said = ['"user": "say "hi" please""assistant": "ok "done" now"', None, "", "plain", '"Ann": "a  b""Bob":"c"', '"user": """assistant": "x"']
    said += ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(300)]
    rows = spark.createDataFrame([(str(i), "t", c) for i, c in enumerate(said)], "session_id string, session_time string, context string")
    for roles_only in (True, False):
        got = {}
        for x in chunking.parse_turns(rows, roles_only).orderBy("turn_idx").collect():
            got.setdefault(int(x["session_id"]), []).append((x["turn_idx"], x["speaker"], x["content"]))
        assert [got.get(i, []) for i in range(len(said))] == [turns_of(c, roles_only) for c in said]
    assert turns_of(said[0], True) == [(0, "user", 'say "hi" please'), (1, "assistant", "ok")]


def test_pairs_with_lone_assistants(spark):
    rows = [("S", "t", i, r, str(i)) for i, r in enumerate(["assistant", "user", "assistant", "assistant", "user", "user", "assistant"])]
    turns = spark.createDataFrame(rows, "session_id string, session_time string, turn_idx int, speaker string, content string")
    got = chunking.pair_turns(turns).orderBy("chunk_idx").collect()
    assert [r["n_turns"] for r in got] == [1, 2, 1, 1, 2]
    assert got[1]["text"] == "User: 1\nAssistant: 2"
    assert [r["n_turns"] for r in chunking.fixed_pairs(turns).orderBy("chunk_idx").collect()] == [2, 2, 2, 1]


def test_windows_keep_the_tail(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, "a b"), (3, " "), (4, None)], "doc_id long, text string")
    got = [tuple(r)[:4] for r in chunking.token_windows(docs, 4, 1).orderBy("doc_id", "start_idx").collect()]
    assert got == [(1, 0, 4, 4), (1, 3, 7, 4), (1, 6, 10, 4), (1, 9, 10, 1), (2, 0, 2, 2)]


def test_dates(spark):
    assert one(spark, temporal.day_gap(F.lit("2023/5/1"), F.lit("2023/05/03"))) == 2
    assert one(spark, temporal.day_gap(F.lit("2023/00/08"), F.lit("2023/05/03"))) == 0
    assert one(spark, temporal.named_date(F.lit("8 May, 2023"))) == "2023/05/08"
    assert one(spark, temporal.named_date(F.lit("8 Foo, 2023"))) == "2023/00/08"
    assert one(spark, temporal.edge_time(F.lit(""), F.lit(None).cast("string"), F.array(F.lit(""), F.lit("2023-02-01 10:00")))) == "2023/02/01"


def test_answers(spark):
    for expected, output, right in [("3", "There are 3 cats", True), ("3", "there are 13.5", True), ("3.5 km", "about 3.6", False), ("Café noir", "un café, noir!", True), ("blue red", "red and blue", True), ("one two three four", "four three two one", False)]:
        assert one(spark, text.answer_match(F.lit(expected), F.lit(output))) is right, expected
    assert one(spark, evaluate.session_recall(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit("a")))) == pytest.approx(2 / 3)
    assert one(spark, text.origin_list(F.lit("a; b,c"))) == ["a", "b", "c"]
    assert one(spark, text.evidence_sessions(F.array(F.lit("D10:3"), F.lit("D1:2"), F.lit("D10:9")))) == ["D10", "D1"]


def test_zero_vectors(spark):
    assert one(spark, vector.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 0


def test_parsers(spark):
    reply = '("entity"|"Ann (x)"|person|a friend)##("entity"|y)##("relationship"|2023/01/01|S1|a|b|likes|9)##("relationship"|t|S|a|b|r| 9x)##("relationship"|a|b|c|d|e)##END##'
    rows = spark.createDataFrame([(1, reply), (2, ""), (3, None)], "id int, reply string")
    assert [tuple(r) for r in extract.parse_entities(rows).collect()] == [(1, "Ann (x)", "person", "a friend")]
    assert [(r["strength"], r["weight"]) for r in extract.parse_relations(rows).collect()] == [(9, 0.9), (1, 0.1)]


def test_summaries(spark):
    good = '{"session_id": "S1", "session_time": "", "keys": "a, b", "context": {"theme_2": "two", "summary_2": "y", "theme_10": "ten", "summary_10": "z"}}'
    rows = spark.createDataFrame([("S1", "2023/01/01 10:00", good), ("S2", "2023/01/02", f"```json\n{good}\n```"), ("S3", "2023/01/03T1", "not json")], "session_id string, session_time string, reply string")
    got = {r["keys"]: r for r in extract.parse_summaries(rows).withColumn("shown", context.summary_text(F.col("context"))).orderBy("session_time").collect()}
    assert got["a, b"]["shown"] == "two: y\nten: z"
    assert got["session, conversation"]["shown"] == "Conversation: not json" and got["session, conversation"]["session_time"] == "2023/01/03"


def greedy(names, threshold):
    """Leader clustering by scanning."""
    out, led = [], []
    for i, (name, kind) in enumerate(names):
        t = set(name.lower().split())
        found = next((j for j, n, k, u in led if k == kind.lower() and (n == name.lower() or (t and u and len(t & u) / len(t | u) >= threshold))), None)
        if found is None:
            led.append((i, name.lower(), kind.lower(), t))
        out.append(i if found is None else found)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_entity_leaders_equal_a_scan(spark, seed):
    r = random.Random(seed)
    base = [[r.choice("abcdefghij") + str(r.randint(0, 3)) for _ in range(r.randint(0, 12))] for _ in range(12)]
    names = []
    for _ in range(150):
        words = list(r.choice(base))
        if words and r.random() < 0.6:
            words[r.randrange(len(words))] = r.choice("xyz")
        names.append((" ".join(words).title() if r.random() < 0.3 else " ".join(words), r.choice(["p", "P", "q"])))
    rows = spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(names)], "ordinal long, entity string, type string")
    for threshold in (0.85, 0.5):
        got = {x["ordinal"]: x["leader"] for x in dedup.entity_leaders(rows, threshold).collect()}
        assert [got[i] for i in range(len(names))] == greedy(names, threshold)


def test_edges_and_nodes(spark):
    kind = "ordinal long, src string, tgt string, relation string, create_time string, session_id string, chunk_id long, strength int"
    rows = spark.createDataFrame([(1, "a", "b", "likes", "t1", "S1", 0, 3), (2, "A", "b", "likes", "t2", "S2", 1, 5), (3, "a", "b", "knows", "t3", "S3", 2, 1), (4, "c", "c", "self", "t4", "S4", 3, 1), (5, "", "b", "x", "t", "S", 4, 1)], kind)
    deduped = dedup.deduplicate_relations(rows)
    first = deduped.where("ordinal = 1").first()
    assert (first["src"], first["create_time"], first["session_id"], first["strength"], first["chunk_ids"]) == ("a", "t1", "S2", 5, [0, 1])
    edges = graph.edges_of(deduped)
    assert {(r["src"], r["tgt"]): r["relation"] for r in edges.collect()} == {("a", "b"): "knows", ("c", "c"): "self"}
    entities = spark.createDataFrame([(7, "a", "person", 0), (8, "lonely", "person", 0)], "ordinal long, entity string, type string, chunk_id long")
    assert {r["name"]: r["extracted"] for r in graph.nodes_of(entities, edges).collect()} == {"a": True, "b": False, "c": False}


def test_rerank_with_missing_times(spark):
    pool = spark.createDataFrame([(1, "S1", 0, 0.5, "2024/01/01", "2024/01/11"), (1, "S2", 1, 0.5, "", "2024/01/11"), (1, "S1", 2, 0.5, "2024/01/10", "2024/01/11")], "question_id int, session_id string, pool_rank int, similarity double, timestamp string, question_time string")
    scores = spark.createDataFrame([(1, "S1", 0.4)], "question_id int, session_id string, session_score double")
    got = [r["pool_rank"] for r in rerank.temporal_rerank(pool, scores).orderBy("final_rank").collect()]
    assert got == [1, 2, 0]
    assert [r["pool_rank"] for r in rerank.simple(pool, None).orderBy("final_rank").collect()] == [0, 1, 2]


def test_chunks_in_first_named_order(spark):
    triples = spark.createDataFrame([(1, 0, [5, 0], 0), (1, 1, None, 9), (1, 2, [5], 7)], "question_id int, final_rank int, chunk_ids array<long>, chunk_id long")
    chunks = spark.createDataFrame([(0, "zero"), (5, "five"), (7, "seven")], "chunk_id long, text string")
    got = [(r["chunk_id"], r["text"]) for r in context.chunks_of(triples, chunks, 4).orderBy("chunk_rank").collect()]
    assert got == [(5, "five"), (0, "zero"), (9, None), (7, "seven")]


def test_top_entities_break_ties_by_ordinal(spark):
    nodes = spark.createDataFrame([(2, "b", "unknown", [1.0, 0.0]), (1, "a", "unknown", [1.0, 0.0]), (3, "z", "x", [-1.0, 0.0])], "ordinal long, name string, entity_type string, embedding array<float>")
    asked = spark.createDataFrame([(1, 0, "unknown", [1.0, 0.0])], "question_id int, query_ord int, query_type string, query_vec array<double>")
    got = [(r["name"], r["score"]) for r in retrieve.top_entities(retrieve.entity_scores(asked, nodes), 3).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("b", 1.0), ("z", 0.0)]


def test_sessions_are_read_in_order(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"session_id": "A", "session_time": "2023/01/01", "context": "x"}\n')
    assert [(r["session_id"], r["doc_id"], r["content"]) for r in corpus.read_sessions(spark, str(tmp_path / "c.json")).collect()] == [("A", 0, "x")]
    (tmp_path / "d.json").write_text('[{"session_id": "A"}, {"session_id": "B"}]')
    assert [(r["session_id"], r["doc_id"]) for r in corpus.read_sessions(spark, str(tmp_path / "d.json"), json_array=True).orderBy("doc_id").collect()] == [("A", 0), ("B", 1)]


def test_settings(tmp_path):
    assert Config.parse(top_chunks=5).to_dict()["top_chunks"] == 5
    with pytest.raises(ValueError):
        Config.parse(no_such=1)


class Scripted:
    """Says that everyone named in a dialogue knows Bob."""

    def generate(self, prompts):
        out = []
        for p in prompts:
            names = [w for w in ("Ann", "Cid") if w in p]
            out.append("##".join([f'("entity"|{n}|person|x)##("relationship"||S|{n}|Bob|knows|3)' for n in names] + ["END"]))
        return out


def sessions(spark, names):
    rows = [(f"S{i}", f"2023/01/0{i + 1}", f'"user": "I am {n}""assistant": "hello {n}"') for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "session_id string, session_time string, context string")


def test_build_add_query_evaluate(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "m"), generator=Scripted)
    memory.build(sessions(spark, ["Ann"]))
    memory.add(sessions(spark, ["Ann", "Cid"]))
    tables = memory.store.read()
    assert {(r["src"], r["tgt"]) for r in tables["edges"].collect()} == {("Ann", "Bob"), ("Cid", "Bob")}
    assert tables["chunks"].select("chunk_id").distinct().count() == 3
    asked = spark.createDataFrame([(1, "Who is Ann?", "Bob", "2023/01/05", ["S0"])], "question_id long, question string, answer string, question_time string, origin array<string>")
    results = memory.query(asked)
    assert results.first()["output"] and "S0" in results.first()["top_session_ids"]
    assert memory.evaluate(results).first()["session_recall"] == 1.0


def test_a_stream_of_sessions_equals_adding_them(spark, tmp_path):
    source = tmp_path / "in"
    sessions(spark, ["Ann", "Cid"]).repartition(2).write.json(str(source))
    streamed, added = Memory(spark, str(tmp_path / "s"), generator=Scripted), Memory(spark, str(tmp_path / "a"), generator=Scripted)
    ingest(streamed, session_stream(spark, str(source)), str(tmp_path / "ck")).awaitTermination()
    added.add(sessions(spark, ["Ann", "Cid"]))
    pairs = [{(r["src"], r["tgt"], r["relation"], r["strength"]) for r in m.store.read()["edges"].collect()} for m in (streamed, added)]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 2
