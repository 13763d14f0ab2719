"""Chunks of dialogues and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text
from threadloom.plans.lineage import cut
from threadloom.sources.corpus import dense_id

_SPACE = r"[\s\x1C-\x1F]"
# (?U): white space of all scripts
_PREFIX = {True: rf'(?U)"(user|assistant)"{_SPACE}*:{_SPACE}*"', False: rf'(?U)"([^"]+)"{_SPACE}*:{_SPACE}*"'}
_DOCUMENT = ("doc_id", "session_id", "session_time")


def _units(rows: DataFrame) -> list[str]:
    """What tells documents apart."""
    return [c for c in _DOCUMENT if c in rows.columns]


def parse_turns(sessions: DataFrame, roles_only: bool = True) -> DataFrame:
    """A row for each turn of each document's flattened context (doc_id, session_id, session_time, context); turns without text are left out, but counted in turn_idx.

    A document is a row of its own, also where several are of one session; without doc_id, the rows of a session are one. A turn's content ends at the last quote before the next turn's name, the final turn's at its first quote.
    White space in it becomes single blanks. roles_only: turns of "user" and "assistant" alone. A null context has no turns.
    """
    context, name = F.coalesce("context", F.lit("")), _PREFIX[roles_only]
    bodies = F.split(context, name, -1)
    said = F.arrays_zip(F.regexp_extract_all(context, F.lit(name), F.lit(1)).alias("speaker"), F.slice(bodies, 2, F.size(bodies)).alias("body"))
    rows = sessions.select(*_units(sessions), F.size(bodies).alias("n"), F.posexplode(said).alias("turn_idx", "turn"))
    body = F.col("turn.body")
    body = F.when(F.col("turn_idx") == F.col("n") - 2, F.substring_index(body, '"', 1)).otherwise(F.regexp_replace(body, r'"[^"]*\z', ""))
    body = F.regexp_replace(F.regexp_replace(body, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", ""), r'\A"+|"+\z', "")
    content = F.trim(F.regexp_replace(body, rf"(?U){_SPACE}+", " "))
    return rows.select(*_units(rows), "turn_idx", F.col("turn.speaker").alias("speaker"), content.alias("content")).where("content != ''")


def _assembled(numbered: DataFrame, line) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("turn_idx", line.alias("line"))))
    grouped = numbered.groupBy(*_units(numbered), "chunk_idx").agg(lines.alias("lines"))
    return grouped.select(*_units(grouped), F.col("chunk_idx").cast("int").alias("chunk_idx"), F.size("lines").alias("n_turns"), F.array_join("lines.line", "\n").alias("text"))


def pair_turns(turns: DataFrame) -> DataFrame:
    """A user turn with the assistant turn of its document right after it; an assistant turn without one stands alone."""
    order = Window.partitionBy(_units(turns)[0]).orderBy("turn_idx")
    joined = (F.col("speaker") == "assistant") & (F.coalesce(F.lag("speaker").over(order), F.lit("")) == "user")
    begins = turns.withColumn("begins", F.when(joined, 0).otherwise(1))
    numbered = begins.withColumn("chunk_idx", F.sum("begins").over(order) - 1)
    return _assembled(numbered, F.concat(F.initcap("speaker"), F.lit(": "), F.col("content")))


def fixed_pairs(turns: DataFrame) -> DataFrame:
    """Groups of two turns of a document, whoever speaks."""
    place = F.row_number().over(Window.partitionBy(_units(turns)[0]).orderBy("turn_idx")) - 1
    return _assembled(turns.withColumn("chunk_idx", F.floor(place / 2)), F.concat("speaker", F.lit(": "), "content"))


LAYOUTS = ("auto", "roles", "speakers")


def dialogue_chunks(sessions: DataFrame, layout: str = "auto") -> DataFrame:
    """Chunks of two turns of dialogues (doc_id, session_id, session_time, context).

    layout: `roles` pairs a user's turn with the assistant's after it, `speakers` takes turns of any names two by two, and
    `auto` goes by roles in documents that have turns of user or assistant, and by speakers in others.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout: {layout}")
    has_roles = F.coalesce("context", F.lit("")).rlike(_PREFIX[True])
    roles = sessions.where(has_roles) if layout == "auto" else sessions
    named = sessions.where(~has_roles) if layout == "auto" else sessions
    parts = {"roles": lambda: pair_turns(parse_turns(roles)), "speakers": lambda: fixed_pairs(parse_turns(named, roles_only=False))}
    return parts["roles"]().unionByName(parts["speakers"]()) if layout == "auto" else parts[layout]()


def document_text(docs: DataFrame) -> DataFrame:
    """Documents with their text for windows: title and content, parted by a blank line; without content, the context."""
    has = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    body, title = F.coalesce(has("content"), has("context"), F.lit("")), F.coalesce(has("title"), F.lit(""))
    return docs.withColumn("title", title).withColumn("text", F.when(title != "", F.concat(title, F.lit("\n\n"), body)).otherwise(body))


def with_chunk_ids(chunks: DataFrame, first: int = 0) -> DataFrame:
    """Dense chunk ids in the order of documents and their chunks, counted by range partitions."""
    placed = cut(chunks.repartitionByRange("doc_id", "chunk_idx").sortWithinPartitions("doc_id", "chunk_idx"))
    return dense_id(placed, "chunk_id").withColumn("chunk_id", F.col("chunk_id") + first)


def token_windows(docs: DataFrame, size: int = 1200, overlap: int = 100, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Windows of `size` words, each beginning `size - overlap` after the last; the tail is kept. keep: columns of docs beside."""
    rows = docs.withColumn("words", text.tokens(F.col("text"))).where(F.size("words") > 0)
    rows = rows.withColumn("start_idx", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(size - overlap))))
    window = F.slice("words", F.col("start_idx") + 1, F.lit(size))
    rows = rows.select(*keep, "start_idx", window.alias("window"))
    return rows.select(*keep, "start_idx", (F.col("start_idx") + F.size("window")).alias("end_idx"), F.size("window").alias("token_count"), F.array_join("window", " ").alias("text"))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Counts over chunks (session_id, n_turns, text), and how many are without text."""
    words = F.size(text.tokens(F.col("text")))
    return chunks.agg(
        F.count("*").alias("total_chunks"), F.sum(words).alias("total_tokens"), F.countDistinct("session_id").alias("sessions"),
        F.count_if(F.col("n_turns") >= 2).alias("paired"), F.count_if(F.col("n_turns") < 2).alias("alone"), F.count_if(F.trim("text") == "").alias("invalid"),
    )


def concat_sessions(parts: DataFrame, skip_contained: bool = True) -> DataFrame:
    """Contexts of each session joined by a blank line in order of `ordinal`; one already contained is skipped, and so is a null. A session of nulls has a null context."""
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("context").isNotNull(), F.struct("ordinal", "context")))), lambda x: x["context"])
    # a part told before is contained, so that only different ones need be looked for
    rows = parts.groupBy("session_id").agg(F.min_by("session_time", "ordinal").alias("session_time"), (F.array_distinct(ordered) if skip_contained else ordered).alias("parts"))
    add = lambda acc, x: F.when(F.contains(acc, x), acc).otherwise(F.concat(acc, F.lit("\n\n"), x))
    joined = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(1))), F.get("parts", 0), add) if skip_contained else F.when(F.size("parts") > 0, F.array_join("parts", "\n\n"))
    return rows.select("session_id", "session_time", joined.alias("context"))
