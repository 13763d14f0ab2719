"""Names of one template, containment without comparing every pair, sessions told twice, factors of a ranking."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import chunking, dedup, rerank, retrieve


def scan(sets, threshold):
    """Greedy clustering by brute force; sets alone are left out."""
    leaders, led, linked = [], {}, set()
    for i, (kind, tokens) in sorted(sets.items()):
        alike = [j for j in sets if j != i and sets[j][0] == kind and len(tokens & sets[j][1]) / len(tokens | sets[j][1]) >= threshold]
        linked |= {i} if alike else set()
        led[i] = next((j for j in leaders if j in alike), i)
        if led[i] == i:
            leaders.append(i)
    return {i: led[i] for i in linked}


@pytest.mark.parametrize(("seed", "hot"), [(1, 3), (2, 3), (3, 8), (4, 1000)])
def test_leaders_of_templates_equal_a_scan(spark, seed, hot):
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(12)]
    sets = {}
    for i in range(120):
        tokens = set(base) - set(rng.sample(base, rng.choice([0, 0, 1, 1, 2]))) if i % 3 else {f"v{rng.randrange(9)}" for _ in range(7)}
        sets[i * 5 % 601] = (rng.choice("ab"), tokens | ({f"own{i}"} if rng.random() < 0.4 else set()))
    frame = spark.createDataFrame([(k, i, sorted(t)) for i, (k, t) in sets.items()], "kind string, id long, tokens array<string>")
    got = {r["id"]: r["leader"] for r in dedup.set_leaders(frame, 0.85, hot).collect()}
    want = scan(sets, 0.85)
    assert {i: x for i, x in got.items() if x != i} == {i: x for i, x in want.items() if x != i}
    assert all(want.get(i, i) == x for i, x in got.items())


def test_a_template_makes_no_pairs_of_its_names(spark, monkeypatch):
    """4,000 names that differ in a word of forty: 7,998,000 pairs reach the threshold, few are listed."""
    seen, real = [], dedup._similar
    monkeypatch.setattr(dedup, "_similar", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    rows = spark.range(4000).select("id", F.lit("t").alias("kind"), F.concat(F.array(*[F.lit(f"w{k}") for k in range(40)]), F.array(F.concat(F.lit("own"), "id"))).alias("tokens"))
    got = dedup.set_leaders(rows, 0.85)
    assert got.groupBy("leader").count().collect() == [(0, 4000 - (0 if got.where("id = 0").count() else 1))]
    assert sum(x.count() for x in seen) < 20_000


def test_provenance_stays_in_rows(spark):
    rows = spark.createDataFrame([(0, "Ann", "p", 1, "S1", "d1"), (1, "ann", "P", 1, "S1", "d1"), (2, "Ann", "p", 2, "S1", None), (3, "Bob", "p", None, None, None)], "ordinal long, entity string, type string, chunk_id long, session_id string, session_time string")
    got = dedup.entity_provenance(rows).select("ordinal", "chunk_id", "session_id", "session_time", "entity", "mentions", "latest").collect()
    assert {tuple(r) for r in got} == {(0, 1, "S1", "d1", "Ann", 2, 1), (0, 2, "S1", None, "Ann", 1, 2), (3, None, None, None, "Bob", 1, 3)}


NAMES = ["", "a", "ab", "abc", "xabcx", "ABC", "é", "日本", "日本語の本", "the cat", "cat", "a cat sat", "at", " ", None, "x" * 50, "ab"]


@pytest.mark.parametrize("k", [1, 5, 100])
def test_fallback_equals_every_pair(spark, k):
    nodes = [(i * 7 % 17, n, None) for i, n in enumerate(NAMES)]
    asked = [(q, o, NAMES[(q * 3 + o * 5) % len(NAMES)]) for q in range(len(NAMES)) for o in range(3)]
    want = set()
    for q in range(len(NAMES)):
        met = {}
        for _, o, name in (x for x in asked if x[0] == q and x[2] is not None):
            for ordinal, n, _ in nodes:
                if n is not None and (name.lower() in n.lower() or n.lower() in name.lower()):
                    met[n] = min(met.get(n, (9, 9, 99)), (o, int(name.lower() != n.lower()), ordinal))
        want |= {(q, n, r) for r, (_, n) in enumerate(sorted((at, n) for n, at in met.items())[:k])}
    got = retrieve.name_fallback(spark.createDataFrame(asked, "question_id long, query_ord int, query_name string"), spark.createDataFrame(nodes, "ordinal long, name string, entity_type string"), k)
    assert {(r["question_id"], r["name"], r["rank"]) for r in got.collect()} == want
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_no_names(spark):
    none = spark.createDataFrame([], "question_id long, query_ord int, query_name string")
    nodes = spark.createDataFrame([], "ordinal long, name string, entity_type string")
    one = spark.createDataFrame([(1, 0, "a")], none.schema)
    assert retrieve.name_fallback(none, nodes).count() == 0 and retrieve.name_fallback(one, nodes).count() == 0


def test_sessions_with_nulls_and_repeats(spark):
    parts = spark.createDataFrame([("A", "d", 0, None), ("A", "d", 1, "x y"), ("A", "d", 2, "y"), ("A", "d", 3, "z"), ("A", "d", 4, "x y"), ("B", "e", 0, None)], "session_id string, session_time string, ordinal long, context string")
    assert {r["session_id"]: r["context"] for r in chunking.concat_sessions(parts).collect()} == {"A": "x y\n\nz", "B": None}
    assert {r["session_id"]: r["context"] for r in chunking.concat_sessions(parts, False).collect()} == {"A": "x y\n\ny\n\nz\n\nx y", "B": None}


def test_factors_are_scaled_and_nulls_count_as_nothing(spark):
    pool = spark.createDataFrame([(1, "S", 0, 0.5, 1.0), (1, "S", 1, 0.5, None), (1, "S", 2, None, None)], "question_id long, session_id string, pool_rank int, similarity double, seen double")
    got = [(r["pool_rank"], r["final_score"]) for r in rerank.simple(pool, None, factors={"seen": 2.0}).orderBy("final_rank").collect()]
    assert got == [(0, 1.25), (1, 0.25), (2, 0.0)]
    assert rerank.weights(0.3, True) == (0.7, 0.3) and rerank.weights(0.3, False, 0.5) == (1.0, 0.0) and rerank.weights(0.5, True, 2.0) == (0.25, 0.25)
    with pytest.raises(ValueError):
        rerank.simple(pool, None, factors={"seen": -1.0})
