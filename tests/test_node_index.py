"""The index of nodes gives what scoring every pair gives, and reads fewer pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import node_index, retrieve
from threadloom.plans.memory import Memory

NODE = "ordinal long, name string, entity_type string, embedding array<double>"
ASKED = "question_id long, query_ord int, query_type string, query_vec array<double>"


def clustered(rng, n, dims, groups):
    centres = rng.normal(size=(groups, dims))
    return centres[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, dims))


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng, 3000, 16, 30)
    x[:40] = x[0]  # equal vectors: ties go by ordinal
    x[50] = 0
    rows = [(k, f"n{k}", [None, "person", "place"][k % 3], v.tolist()) for k, v in enumerate(x)] + [(9000, "none", "person", None)]
    asked = [(q, o, ["unknown", "person", None][(q + o) % 3], (x[7 * q + o] + 0.01).tolist()) for q in range(20) for o in range(1 + q % 2)]
    return spark.createDataFrame(rows, NODE).repartition(3), spark.createDataFrame([*asked, (77, 0, "person", [0.0] * 16), (78, 0, "x", None)], ASKED)


@pytest.mark.parametrize("per_part", [50_000, 40])
def test_equals_all_pairs(spark, frames, tmp_path, per_part):
    nodes, asked = frames
    index = node_index.NodeIndex(spark, f"file://{tmp_path}/index")
    assert not index.exists()
    index.build(nodes, cells=60, per_part=per_part)
    known = asked.where("query_vec is not null").withColumn("query_type", F.coalesce("query_type", F.lit("unknown")))
    want = sorted((r["question_id"], r["rank"], r["ordinal"], round(r["score"], 6)) for r in retrieve.top_entities(retrieve.entity_scores(known, nodes), 8).collect())
    got = sorted((r["question_id"], r["rank"], r["ordinal"], round(r["score"], 6)) for r in index.search(asked, 8).collect())
    assert got == want and index.exists()
    assert sum(c["n"] for c in index.cells()) == 3000  # every vector is indexed
    assert 0 < index.pairs_read < index.pairs_all


def test_far_fewer_pairs_where_types_do_not_decide(spark, frames, tmp_path):
    nodes, asked = frames
    index = node_index.NodeIndex(spark, f"file://{tmp_path}/index").build(nodes, cells=60)
    index.search(asked.where("question_id < 20"), 4, type_weight=0.0)
    assert index.pairs_read < 0.3 * index.pairs_all


def test_few_nodes_and_none(spark, tmp_path):
    few = spark.createDataFrame([(1, "a", None, [1.0, 0.0]), (2, "b", "t", [0.0, 1.0])], NODE)
    asked = spark.createDataFrame([(1, 0, "t", [0.0, 2.0])], ASKED)
    assert [(r["ordinal"], r["score"]) for r in node_index.scratch_index(spark, few).search(asked).orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]
    assert node_index.scratch_index(spark, few.limit(0)).search(asked).count() == 0


def test_a_memory_is_searched_by_its_index(spark, tmp_path):
    class Says:
        def generate(self, prompts):
            return ['("entity"|Ann|person|x)##("entity"|Paris|place|y)##("relationship"||S|Ann|Paris|visits|7)##END' if p.startswith("List") else "" for p in prompts]

    m = Memory(spark, str(tmp_path / "m"), generator=Says)
    m.build(spark.createDataFrame([(0, "S0", "", '"user": "Ann visits Paris"')], "doc_id long, session_id string, session_time string, context string"))
    asked = spark.createDataFrame([(1, "Where is Ann?", "")], "question_id long, question string, question_time string")
    plain = [tuple(r) for r in m.query(asked).collect()]
    m.build_index()
    assert m._index().exists() and [tuple(r) for r in m.query(asked).collect()] == plain
