"""Retrieval for batches of questions: entities, triples, sessions. Every frame is keyed by question_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text, vector


def top(rows: DataFrame, by: list, k: int, keys: tuple = ("question_id",), rank: str = "rank") -> DataFrame:
    """The first k rows of each question in the given order, ranked from 0."""
    order = Window.partitionBy(*keys).orderBy(*by)
    # the bare number is compared, so that Spark limits the rows before they are shuffled
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k).withColumn(rank, F.col(rank) - 1)


def entity_scores(questions: DataFrame, nodes: DataFrame, type_weight: float = 0.3) -> DataFrame:
    """Score of each node for each question: the best over its query vectors of 0.7 cosine + 0.3 type match, 0 at least.

    questions: question_id, query_ord, query_type, query_vec (a row for each query string); nodes:
    ordinal, name, entity_type, embedding. The question side is a stated query set against all nodes.
    """
    n = nodes.where("embedding is not null").withColumn("node_norm", vector.norm(F.col("embedding")))
    q = questions.withColumn("query_norm", vector.norm(F.col("query_vec")))
    q = q.groupBy("question_id").agg(F.collect_list(F.struct("query_ord", "query_type", "query_vec", "query_norm")).alias("queries"))
    pairs = n.crossJoin(q)

    def score(one: Column) -> Column:
        similar = vector.dot(F.col("embedding"), one["query_vec"]) / (F.col("node_norm") * one["query_norm"])
        return (1 - type_weight) * similar + F.when(one["query_type"] == F.coalesce("entity_type", F.lit("unknown")), type_weight).otherwise(0.0)

    best = F.array_max(F.transform("queries", score))
    return pairs.select("question_id", "ordinal", "name", "entity_type", F.round(F.greatest(best, F.lit(0.0)), 6).alias("score"))


def top_entities(scores: DataFrame, k: int = 8) -> DataFrame:
    return top(scores, [F.desc("score"), F.col("ordinal")], k)


def incident_triples(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end among a question's entities, with the bonus 1 / (rank + 1) of the better end.

    entities: question_id, name, rank. An end that isn't among them counts as one rank after the last.
    """
    entities = entities.withColumn("n_entities", F.count("*").over(Window.partitionBy("question_id")))
    by_src = entities.select("question_id", "n_entities", F.col("name").alias("src"), F.col("rank").alias("src_rank"))
    by_tgt = entities.select("question_id", "n_entities", F.col("name").alias("tgt"), F.col("rank").alias("tgt_rank"))
    one, two = edges.join(by_src, "src"), edges.join(by_tgt, "tgt")
    union = one.withColumn("tgt_rank", F.lit(None).cast("int")).unionByName(two.withColumn("src_rank", F.lit(None).cast("int")))
    rows = union.groupBy("question_id", "src", "tgt").agg(F.max("src_rank").alias("src_rank"), F.max("tgt_rank").alias("tgt_rank"), F.max("n_entities").alias("n_entities"), *[F.first(c).alias(c) for c in edges.columns if c not in ("src", "tgt")])
    rank = F.least(F.coalesce("src_rank", "n_entities"), F.coalesce("tgt_rank", "n_entities"))
    rows = rows.withColumn("entity_bonus", 1 / (rank + 1.0))
    return rows.withColumn("triple_text", F.concat_ws(" ", "src", "relation", "tgt")).drop("n_entities")


def triple_pool(triples: DataFrame, k: int = 8) -> DataFrame:
    """The pool of candidates by similarity + 0.2 bonus: twice k, 20 at least. A missing similarity counts as 0."""
    scored = triples.withColumn("pool_score", F.round(F.coalesce("similarity", F.lit(0.0)) + 0.2 * F.col("entity_bonus"), 6))
    return top(scored, [F.desc("pool_score"), F.col("ordinal")], max(2 * k, 20), rank="pool_rank")


def summary_scores(pairs: DataFrame, best: int = 3) -> DataFrame:
    """Session scores: the mean of the best similarities of key and query entity (question_id, session_id, similarity)."""
    order = Window.partitionBy("question_id", "session_id").orderBy(F.desc("similarity"))
    kept = pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= best)
    return kept.groupBy("question_id", "session_id").agg(F.round(F.avg("similarity"), 6).alias("session_score"))


def positional_scores(summaries: DataFrame) -> DataFrame:
    """Scores by position alone: 0.9 times 0.9 to the number of summaries before."""
    return summaries.withColumn("session_score", F.round(0.9 * F.pow(F.lit(0.9), F.col("place")), 6))


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short, long) of distinct texts (text) where the first lies within the second; empty texts are left out.

    A text is looked up by that of its runs of three letters (itself, if it has fewer) that the fewest longer texts have, so that only texts that have this run are compared.
    """
    runs = lambda t: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.array(*[F.substring(t, i, F.lit(w)) for w in (1, 2, 3)]))))
    t = F.col("text")
    within = long.where("text != ''").select(F.col("text").alias("long"), F.explode(runs(t)).alias("run"))
    count = within.groupBy("run").agg(F.count("*").alias("n"))
    own = short.where("text != ''").select(F.col("text").alias("short"), F.explode(F.filter(runs(t), lambda x: F.length(x) == F.least(F.lit(3), F.length(t)))).alias("run"))
    rarest = own.join(count, "run").groupBy("short").agg(F.min(F.struct("n", "run")).alias("r")).select("short", F.col("r.run").alias("run"))
    return within.join(rarest, "run").where(F.contains("long", "short")).select("short", "long")


def _asked_once(queries: DataFrame, *keys: str) -> DataFrame:
    """Each question's names once, with the first place where it asks for them (a null place comes before all): rows that repeat a name must not meet its nodes again and again."""
    first = F.when(F.count("query_ord") == F.count("*"), F.min("query_ord"))
    return queries.groupBy("question_id", *keys).agg(first.alias("query_ord"))


def name_fallback(queries: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """Without vectors: nodes of the same name, then those that contain or are contained, in order of discovery; case doesn't count.

    queries: question_id, query_ord, query_name. A null name finds nothing; an empty one lies within every name, and an empty node's within every query.
    """
    asked = _asked_once(queries.select("question_id", "query_ord", F.lower("query_name").alias("q")).where("q is not null"), "q")
    known = nodes.where("name is not null").groupBy("name").agg(F.min("ordinal").alias("ordinal")).withColumn("n", F.lower("name"))
    given, stored = asked.select(F.col("q").alias("text")).distinct(), known.select(F.col("n").alias("text")).distinct()
    first = known.orderBy(F.col("n") != "", "ordinal", "name").limit(k)
    pairs = contained(given, stored).select(F.col("short").alias("q"), F.col("long").alias("n")).union(contained(stored, given).select(F.col("long"), F.col("short")))
    pairs = pairs.union(first.select(F.lit(""), "n")).union(given.select("text", F.lit(""))).distinct()
    found = asked.join(pairs, "q").join(known, "n").withColumn("phase", F.when(F.col("q") == F.col("n"), 0).otherwise(1))
    met = found.groupBy("question_id", "name").agg(F.min(F.struct("query_ord", "phase", "ordinal")).alias("at"))
    return top(met, [F.col("at"), F.col("name")], k).select("question_id", "name", "rank")


def session_triples(edges: DataFrame, sessions: DataFrame) -> DataFrame:
    """Edges of a list of sessions."""
    return edges.join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def incident_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Incoming, then outgoing edges of the named nodes, each (source, target, relation) once."""
    into = edges.join(nodes.select(F.col("name").alias("tgt")), "tgt", "left_semi").withColumn("phase", F.lit(0))
    out = edges.join(nodes.select(F.col("name").alias("src")), "src", "left_semi").withColumn("phase", F.lit(1))
    rows = into.unionByName(out)
    return rows.groupBy("src", "tgt", "relation").agg(F.min("phase").alias("phase"), F.min("chunk_id").alias("chunk_id"))


def relations_of(names: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The first k edges of each question's names (question_id, query_ord, name), each (source, target, relation) once: name by name, incoming before outgoing, in order of their ordinals.

    A null name, and one without edges, has none.
    """
    names = _asked_once(names, "name")
    into, out = (edges.join(names.select("question_id", "query_ord", F.col("name").alias(end)), end).withColumn("phase", F.lit(phase)) for phase, end in enumerate(("tgt", "src")))
    kept = [c for c in edges.columns if c not in ("src", "tgt", "relation")]
    first = F.min_by(F.struct(*kept), F.struct("query_ord", "phase", "ordinal")).alias("e")
    rows = into.unionByName(out).groupBy("question_id", "src", "tgt", "relation").agg(F.min(F.struct("query_ord", "phase", "ordinal")).alias("at"), first)
    return top(rows, [F.col("at"), F.col("src"), F.col("tgt"), F.col("relation")], k).select("question_id", "src", "tgt", "relation", "e.*", "rank")


def visual_triples(triples: DataFrame, n: int = 10, in_table: int = 5, score: str = "final_score", rank: str = "final_rank") -> DataFrame:
    """The first n triples of each question, as a figure shows them: cut in three by score among themselves, the first few marked for its table."""
    shown = triples.where(F.col(rank) < n)
    return visual_buckets(shown, score).withColumn("in_table", F.col(rank) < in_table)


def visual_buckets(triples: DataFrame, score: str = "score") -> DataFrame:
    """Triples with their score scaled to 0..1 within the question and cut in three."""
    own = Window.partitionBy("question_id")
    low, high = F.min(score).over(own), F.max(score).over(own)
    scaled = F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0)
    return triples.withColumn("bucket", F.when(scaled >= 2 / 3, "high").when(scaled >= 1 / 3, "medium").otherwise("low"))


def key_entity_similarity(summaries: DataFrame, queries: DataFrame) -> DataFrame:
    """Similarities of each summary key with each query entity, by name (question_id, session_id, similarity)."""
    keys = summaries.select("session_id", F.explode(text.key_list(F.col("keys"))).alias("key"))
    pairs = keys.crossJoin(queries.select("question_id", "query_name"))
    return pairs.select("question_id", "session_id", text.name_similarity(F.col("key"), F.col("query_name")).alias("similarity"))


def text_similarity(a_vec: Column, b_vec: Column, a: Column, b: Column) -> Column:
    """Cosine of two texts' vectors; where one is missing, the similarity of the names."""
    return F.when(a_vec.isNotNull() & b_vec.isNotNull(), vector.cosine(a_vec, b_vec)).otherwise(text.name_similarity(a, b))


def relevant_summaries(queries: DataFrame, summaries: DataFrame, k: int = 3) -> DataFrame:
    """The k summaries of each question with the greatest cosine to any of its query vectors, 0 at least (question_id, session_id, score, rank).

    queries: question_id, query_ord, query_type, query_vec; summaries: session_id, embedding.
    """
    items = summaries.select(F.xxhash64("session_id").alias("ordinal"), F.col("session_id").alias("name"), F.lit("").alias("entity_type"), "embedding")
    scores = entity_scores(queries.withColumn("query_type", F.lit("unknown")), items, type_weight=0.0)
    return top(scores, [F.desc("score"), F.col("name")], k).select("question_id", F.col("name").alias("session_id"), "score", "rank")


def mean_scores(pairs: DataFrame) -> DataFrame:
    """Session scores: the mean of all similarities of key and query entity (question_id, session_id, similarity); 0 without any."""
    return pairs.groupBy("question_id", "session_id").agg(F.round(F.coalesce(F.avg("similarity"), F.lit(0.0)), 6).alias("session_score"))


def nodes_named(names: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """The first k nodes of each question's names (question_id, query_ord, query_name), case aside, in the order of the names."""
    asked = _asked_once(names.select("question_id", "query_ord", F.lower("query_name").alias("key")), "key")
    found = nodes.withColumn("key", F.lower("name")).join(asked, "key").drop("key")
    first = found.groupBy("question_id", "name", "entity_type").agg(F.min(F.struct("query_ord", "ordinal")).alias("at"))
    return top(first, [F.col("at"), F.col("name")], k).drop("at")


def session_triples_top(queries: DataFrame, edges: DataFrame, sessions: DataFrame, k: int = 8) -> DataFrame:
    """The k edges of each question's sessions (question_id, session_id) with the greatest cosine to its vector (question_id, query_vec)."""
    rows = edges.join(sessions.select("question_id", "session_id").distinct(), "session_id").join(queries.select("question_id", "query_vec"), "question_id")
    rows = rows.withColumn("similarity", F.round(F.coalesce(vector.cosine(F.col("embedding"), F.col("query_vec")), F.lit(0.0)), 6))
    return top(rows, [F.desc("similarity"), F.col("ordinal")], k).drop("embedding", "query_vec")
