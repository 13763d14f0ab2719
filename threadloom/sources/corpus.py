"""Reading dialogue corpora and question sets, and turning two public layouts into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import temporal, text
from threadloom.plans.lineage import cut

SESSION = "session_id string, session_time string, context string, title string, content string"
QUESTION = "question string, answer string, question_type string, question_time string, origin string, label string"
#: fixed value: what stands for the answer of a question without one, and so decides whether it scores
NO_ANSWER = "Context insufficient to answer"
#: question types and the folders their results go to
FOLDERS = {"single-session-user": "ssu", "single-session-assistant": "ssa", "single-session-preference": "ssp", "multi-session": "ms", "knowledge-update": "ku", "temporal-reasoning": "tr"}


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether the first written letter of the files is that of a JSON array."""
    first = spark.read.text(path).where("trim(value) != ''").first()
    return first is not None and first["value"].lstrip("\ufeff \t").startswith("[")


def read_json(spark: SparkSession, path: str, schema: str, json_array: bool | None, name: str) -> DataFrame:
    """Rows of JSON files, numbered from 0 by file name, then by their place in the file."""
    return numbered(spark.read.schema(schema).json(path, multiLine=is_array(spark, path) if json_array is None else json_array), name)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows just read from files with their number from 0, by file name, then by place."""
    rows = rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_block", F.col("_metadata.file_block_start")).withColumn("_at", F.monotonically_increasing_id())
    # a split is read by one task from its first row to its last
    splits = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each split
    splits = splits.select("_file", "_block", "_first", ahead.alias("_ahead"))
    return rows.join(splits, ["_file", "_block"]).withColumn(name, F.col("_at") - F.col("_first") + F.col("_ahead")).drop("_file", "_block", "_at", "_first", "_ahead")


def read_sessions(spark: SparkSession, path: str, json_array: bool | None = None) -> DataFrame:
    """Sessions of a JSON array or of one JSON object a line, told by their first letter; doc_id counts from 0 in file order.

    The schema is declared, so times stay strings; a missing content is the context.
    """
    return read_json(spark, path, SESSION, json_array, "doc_id").withColumn("content", F.coalesce("content", "context"))


def read_questions(spark: SparkSession, path: str, json_array: bool | None = None) -> DataFrame:
    return read_json(spark, path, QUESTION, json_array, "question_id").withColumn("origin", text.origin_list(F.col("origin")))


def dense_id(rows: DataFrame, name: str) -> DataFrame:
    """Numbers rows from 0 in their order of reading: by the counts of the partitions before, then by place.

    Only one count for each partition goes through a single task.
    """
    marked = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright(F.col("_at"), 33))
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    numbered = marked.join(F.broadcast(ahead), "_part")
    return numbered.withColumn(name, F.col("_at") - F.shiftleft(F.col("_part"), 33) + F.col("_ahead")).drop("_at", "_part", "_ahead")


def with_doc_id(sessions: DataFrame) -> DataFrame:
    """Sessions with their doc_id; where they have none, numbered from 0 in their order of reading."""
    return sessions if "doc_id" in sessions.columns else dense_id(cut(sessions), "doc_id")


def flatten_turns(turns: Column, role: str, body: str, caption: str | None = None) -> Column:
    """`"role": "text"` of all turns in order, one after the other."""

    def one(t: Column) -> Column:
        said = t[body] if caption is None else F.concat(t[body], F.when(F.coalesce(t[caption], F.lit("")) != "", F.concat(F.lit(" (attached is "), t[caption], F.lit(")"))).otherwise(""))
        return F.concat(F.lit('"'), t[role], F.lit('": "'), said, F.lit('"'))

    return F.array_join(F.transform(turns, one), "")


def zip_sessions(items: DataFrame, ids: str, dates: str, sessions: str, keep: list[str]) -> DataFrame:
    """A row for each session of an item's parallel arrays, as far as the shortest goes."""
    n = F.least(F.size(ids), F.size(dates), F.size(sessions))
    zipped = F.arrays_zip(*[F.slice(F.col(c), 1, n).alias(c) for c in (ids, dates, sessions)])
    rows = items.select(*keep, F.posexplode(zipped).alias("place", "s"))
    return rows.select(*keep, "place", F.col(f"s.{ids}").alias("session_id"), F.coalesce(temporal.date_prefix(F.col(f"s.{dates}")), F.lit("")).alias("session_time"), F.col(f"s.{sessions}").alias("turns"))


def numbered_sessions(groups: DataFrame, conversation: str, keep: list[str]) -> DataFrame:
    """Sessions session_1, session_2, ... of a map from names to JSON texts, up to the first that is missing."""
    rows = groups.select(*keep, F.explode(conversation).alias("name", "body")).where(F.col("name").rlike(r"^session_\d+$"))
    rows = rows.withColumn("number", F.regexp_extract("name", r"(\d+)", 1).cast("int"))
    place = F.row_number().over(Window.partitionBy(*keep).orderBy("number"))
    return rows.withColumn("place", place).where("place = number").drop("place")


def filled_answer(answer: Column) -> Column:
    given = answer.cast("string")
    return F.when(given.isNull() | (given == ""), NO_ANSWER).otherwise(given)


def routed(rows: DataFrame) -> DataFrame:
    """Rows of known question types with the folder that each type goes to."""
    known = F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair])
    return rows.withColumn("folder", F.element_at(known, F.col("question_type"))).where("folder is not null")


def write_lines(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON object a line; `by`: a folder for each value."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)
