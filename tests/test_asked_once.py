"""Names that a question asks for many times."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import retrieve


def most_rows(frame):
    """The most rows that a join of the frame's final plan puts out; the frame is collected."""
    rows = {tuple(r) for r in frame.collect()}
    plan, most, todo = frame._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows, most


@pytest.mark.parametrize("times", [1, 400])
def test_repeated_names_meet_a_node_once(spark, times):
    nodes = spark.createDataFrame([(i, f"Ring {i % 5}", f"t{i % 4}") for i in range(20)], "ordinal long, name string, entity_type string")
    asked = spark.range(5 * times).select((F.col("id") % 2).alias("question_id"), F.col("id").alias("query_ord"), F.concat(F.lit("RING "), F.col("id") % 5).alias("query_name"))
    rows, most = most_rows(retrieve.nodes_named(asked, nodes, 3))
    assert most <= 2 * 20 and len(rows) == 6
    first = {q: min((o, i, f"Ring {i % 5}", f"t{i % 4}") for o in range(5 * times) if o % 2 == q for i in range(20) if i % 5 == o % 5) for q in (0, 1)}
    assert {(q, n, t) for q, n, t, r in rows if r == 0} == {(q, x[2], x[3]) for q, x in first.items()}
    rows, most = most_rows(retrieve.name_fallback(asked, nodes, 3))
    assert most <= 100 and {(q, n) for q, n, r in rows if r == 0} == {(0, "Ring 0"), (1, "Ring 1")}
    edges = nodes.select("ordinal", F.col("name").alias("src"), F.col("entity_type").alias("relation"), F.lit("x").alias("tgt"))
    rows, most = most_rows(retrieve.relations_of(asked.select("question_id", "query_ord", F.initcap("query_name").alias("name")), edges, 3).select("question_id", "src", "rank"))
    assert most <= 2 * 20 and {(q, s) for q, s, r in rows if r == 0} == {(0, "Ring 0"), (1, "Ring 1")}


def test_a_null_place_comes_first(spark):
    nodes = spark.createDataFrame([(0, "a", "t"), (1, "b", "t")], "ordinal long, name string, entity_type string")
    asked = spark.createDataFrame([(1, 0, "a"), (1, None, "b"), (1, 5, "b")], "question_id long, query_ord long, query_name string")
    assert [r["name"] for r in retrieve.nodes_named(asked, nodes).orderBy("rank").collect()] == ["b", "a"]
    assert [r["name"] for r in retrieve.name_fallback(asked, nodes).orderBy("rank").collect()] == ["b", "a"]
