"""What a question's prompt is made of: chunks, utterances, triples, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators.retrieve import top


def chunks_of(triples: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """The first k chunks of each question's triples, in the order in which they are first named.

    triples: question_id, final_rank, chunk_ids, chunk_id. A chunk that isn't stored has null text.
    """
    named = F.array_union(F.coalesce("chunk_ids", F.array().cast("array<long>")), F.array("chunk_id"))
    rows = triples.select("question_id", "final_rank", F.posexplode(named).alias("pos", "chunk_id")).where("chunk_id is not null")
    first = rows.groupBy("question_id", "chunk_id").agg(F.min(F.struct("final_rank", "pos")).alias("at"))
    return top(first.join(chunks.select("chunk_id", "text"), "chunk_id", "left"), [F.col("at"), F.col("chunk_id")], k, rank="chunk_rank").drop("at")


def chunk_ids_of(relations: DataFrame) -> DataFrame:
    """The distinct chunks that relations come from, those of none left out."""
    return relations.select("chunk_id").where("chunk_id is not null").distinct()


def stub_text(edges: DataFrame, most: int = 10) -> DataFrame:
    """For chunks without a stored text: up to `most` of their relations."""
    first = top(edges, [F.col("ordinal"), F.col("src"), F.col("tgt")], most, ("chunk_id",))
    rows = first.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "src", "relation", "tgt").alias("line")))).alias("r"))
    return rows.select("chunk_id", F.array_join("r.line", "; ").alias("stub"))


def with_stubs(chosen: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """Chosen chunks; those without a stored text get what the graph says of them."""
    bare = chosen.where("text is null").select("chunk_id").distinct()
    stubs = stub_text(edges.join(bare, "chunk_id", "left_semi"), most)
    return chosen.join(stubs, "chunk_id", "left").withColumn("text", F.coalesce("text", "stub")).drop("stub")


def user_utterances(chunk: Column) -> Column:
    """What the user says in a chunk; else its first two longer sentences; else a preview."""
    lines = F.filter(F.split(chunk, "\n"), lambda x: F.trim(x).startswith("User:"))
    said = F.array_join(F.transform(lines, lambda x: F.trim(F.substring(F.trim(x), 6, 1 << 30))), " ")
    sentences = F.filter(F.transform(F.split(chunk, "[.!?]+"), lambda x: F.trim(x)), lambda x: (F.length(x) > 10) & ~F.lower(x).startswith("assistant"))
    return F.when(F.size(lines) > 0, said).when(F.size(sentences) > 0, F.array_join(F.slice(sentences, 1, 2), ". ")).otherwise(text.preview(chunk, 200))


def triple_line(src: Column, relation: Column, tgt: Column) -> Column:
    return F.concat(F.lit("("), src, F.lit(", "), relation, F.lit(", "), tgt, F.lit(")"))


def _themes(context: Column) -> Column:
    """Numbers of the themes, in order."""
    keys = F.filter(F.map_keys(context), lambda k: k.rlike(r"^theme_\d+$"))
    return F.array_sort(F.transform(keys, lambda k: F.substring(k, 7, 9).cast("int")))


def summary_text(context: Column) -> Column:
    """Themes and their summaries, in the order of their numbers."""
    one = lambda i: F.concat(F.coalesce(F.try_element_at(context, F.concat(F.lit("theme_"), i.cast("string"))), F.lit("")), F.lit(": "), F.coalesce(F.try_element_at(context, F.concat(F.lit("summary_"), i.cast("string"))), F.lit("")))
    return F.array_join(F.transform(_themes(context), one), "\n")


def summary_line(session_id: Column, session_time: Column, keys: Column, context: Column) -> Column:
    """A whole summary in one text: session, time, keys, themes."""
    return F.concat(F.lit("Session "), session_id, F.lit(" ("), F.coalesce(session_time, F.lit("unknown")), F.lit(") Keys: "), F.coalesce(keys, F.lit("")), F.lit(" "), summary_text(context))


def prompts(questions: DataFrame, triples: DataFrame, chunks: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """The prompt of each question: its triples, then its numbered chunks, its summaries (question_id, rank, line) if any, then the question."""
    t = triples.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("final_rank", triple_line(F.col("src"), F.col("relation"), F.col("tgt")).alias("line")))).alias("t"))
    numbered = F.concat(F.lit("["), (F.col("chunk_rank") + 1).cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    c = chunks.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("chunk_rank", numbered.alias("line")))).alias("c"))
    rows = questions.join(t, "question_id", "left").join(c, "question_id", "left")
    facts, passages = F.coalesce(F.array_join("t.line", "; "), F.lit("")), F.coalesce(F.array_join("c.line", "\n"), F.lit(""))
    parts = [F.lit("Facts: "), facts, F.lit("\nPassages:\n"), passages]
    if summaries is not None:
        s = summaries.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("s"))
        rows = rows.join(s, "question_id", "left")
        parts += [F.when(F.col("s").isNotNull(), F.concat(F.lit("\nSummaries:\n"), F.array_join("s.line", "\n"))).otherwise("")]
    return rows.select("question_id", F.concat(*parts, F.lit("\nQuestion: "), "question").alias("prompt"))
