"""The knowledge graph as node and edge tables: at most one edge for each (source, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges_of(relations: DataFrame) -> DataFrame:
    """The last relation of each (source, target) by ordinal; rows without an end or a name are left out."""
    whole = relations.where("coalesce(src, '') != '' and coalesce(tgt, '') != '' and coalesce(relation, '') != ''")
    time = F.coalesce(F.nullif("create_time", F.lit("")), "session_time") if "session_time" in relations.columns else F.col("create_time")
    last = F.max_by(F.struct("relation", "session_id", time.alias("session_time"), "chunk_id"), "ordinal").alias("e")
    return whole.groupBy("src", "tgt").agg(F.min("ordinal").alias("ordinal"), last).select("ordinal", "src", "tgt", "e.*")


def nodes_of(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with an edge: the last entity of each name, and ends that were never extracted."""
    about = F.col("description") if "description" in entities.columns else F.lit(None).cast("string")
    named = entities.withColumn("about", about).groupBy(F.col("entity").alias("name")).agg(F.min("ordinal").alias("ordinal"), F.max_by(F.struct("type", "chunk_id", "about"), "ordinal").alias("e"))
    ends = edges.select(F.col("src").alias("name"), "ordinal").union(edges.select("tgt", "ordinal")).groupBy("name").agg(F.min("ordinal").alias("edge_ordinal"))
    rows = ends.join(named, "name", "left")
    return rows.select(F.coalesce("ordinal", "edge_ordinal").alias("ordinal"), "name", F.col("e.type").alias("entity_type"), F.col("e.chunk_id").alias("chunk_id"), F.col("ordinal").isNotNull().alias("extracted"), *([F.col("e.about").alias("description")] if "description" in entities.columns else []))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, value, n): numbers of nodes and edges, nodes by type and edges by relation."""
    total = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit("").alias("value"), "n")
    types = nodes.groupBy(F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("unknown")).alias("value")).count().select(F.lit("node_type").alias("kind"), "value", F.col("count").alias("n"))
    names = edges.groupBy(F.coalesce(F.nullif("relation", F.lit("")), F.lit("unknown")).alias("value")).count().select(F.lit("edge_type").alias("kind"), "value", F.col("count").alias("n"))
    return total(nodes, "nodes").union(total(edges, "edges")).union(types).union(names)


def _given(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old nodes with their gaps filled from new ones; chunk_id takes the new value. Both with description, or neither."""
    told = [c for c in ("description",) if c in old.columns and c in new.columns]
    n = new.select("name", *[F.col(c).alias(f"n_{c}") for c in ("ordinal", "entity_type", "chunk_id", "extracted", *told)])
    rows = old.join(n, "name", "full_outer")
    return rows.select(
        F.coalesce("ordinal", "n_ordinal").alias("ordinal"), "name", F.coalesce(_given("entity_type"), "n_entity_type").alias("entity_type"),
        F.coalesce("n_chunk_id", "chunk_id").alias("chunk_id"), (F.coalesce("extracted", F.lit(False)) | F.coalesce("n_extracted", F.lit(False))).alias("extracted"),
        *[F.coalesce(_given(c), f"n_{c}").alias(c) for c in told],
    )


def _united(*columns: str) -> Column:
    parts = [F.coalesce(F.col(c), F.array()) for c in columns]
    return F.array_sort(F.filter(F.array_union(*parts), lambda x: x.isNotNull()))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old relation's name stays; ids and times are united, the greatest strength and the latest ids are kept.

    Both frames: ordinal, src, tgt, relation, session_id, session_time, chunk_id, strength, chunk_ids, session_ids, session_times.
    """
    columns = ["ordinal", "relation", "session_id", "session_time", "chunk_id", "strength", "chunk_ids", "session_ids", "session_times"]
    n = new.select("src", "tgt", *[F.col(c).alias(f"n_{c}") for c in columns])
    rows = old.join(n, ["src", "tgt"], "full_outer")
    strength = F.greatest("strength", "n_strength")
    return rows.select(
        F.coalesce("ordinal", "n_ordinal").alias("ordinal"), "src", "tgt", F.coalesce(_given("relation"), "n_relation").alias("relation"),
        F.coalesce("n_session_id", "session_id").alias("session_id"), F.coalesce(_given("n_session_time"), "session_time").alias("session_time"), F.coalesce("n_chunk_id", "chunk_id").alias("chunk_id"),
        strength.alias("strength"), (strength / 10.0).alias("weight"), *[_united(c, f"n_{c}").alias(c) for c in ("chunk_ids", "session_ids", "session_times")],
    )


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows of `new` (one for each key) are added, and how many are merged into a row of `old` with the same keys."""
    had = F.col("had").isNotNull()
    rows = new.select(*keys).join(old.select(*keys, F.lit(True).alias("had")), keys, "left")
    return rows.agg(F.count_if(~had).alias("added"), F.count_if(had).alias("merged"))


def node_types(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Each name with the type of the first entity of that name, else `unknown`."""
    first = entities.groupBy(F.col("entity").alias("name")).agg(F.min_by("type", "ordinal").alias("t"))
    return names.join(first, "name", "left").withColumn("entity_type", F.coalesce("t", F.lit("unknown"))).drop("t")
