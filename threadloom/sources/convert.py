"""From two public dialogue layouts to sessions and questions, item by item.

Items are read as VARIANT values, since one layout has open keys: session_1, session_2, ... and their
dates beside them. `groups` have a conversation of such keys and a list of questions about it; `haystacks`
have one question and three parallel lists of ids, dates and sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import temporal, text
from threadloom.sources import corpus

_MESSAGES = "array<struct<speaker:string,text:string,blip_caption:string>>"
_TURNS = "array<struct<role:string,content:string>>"
_EMPTY = ("0", "0.0", "false", "[]", "{}", "null")


def read_items(spark: SparkSession, path: str, json_array: bool | None = None, first: int = 0) -> DataFrame:
    """(item, v): the items of JSON arrays, or of one JSON object a line, numbered from `first` by file and place.

    An array is one value of Spark, so that a file of one is read by one task; a corpus of any size should have an item a line.
    """
    whole = corpus.is_array(spark, path) if json_array is None else json_array
    rows = spark.read.option("singleVariantColumn", "v").json(path, multiLine=whole)
    rows = corpus.numbered(rows, "file")
    if not whole:
        return rows.select((F.col("file") + first).alias("item"), "v")
    rows = rows.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("file", "pos", F.col("value").alias("v"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    sizes = rows.groupBy("file").agg(F.count("*").alias("n")).select("file", ahead.alias("ahead"))
    return rows.join(sizes, "file").select((F.col("ahead") + F.col("pos") + first).alias("item"), "v")


def _exploded(items: DataFrame, path: str, *keep: str) -> DataFrame:
    """Entries (pos, key, value) of the array or object at a path; none where there is none."""
    spark = items.sparkSession
    rows = items.select("item", *keep, F.try_variant_get("v", path, "variant").alias("inner"))
    return rows.lateralJoin(spark.tvf.variant_explode(F.col("inner").outer())).drop("inner")


def group_sessions(items: DataFrame) -> DataFrame:
    """(item, number, session_id, session_time, context) of groups: sessions 1, 2, ... up to the first that is missing, with the dates that have their number.

    session_id is D and the number; a date that can't be read stays as it is, a missing one is ''. A session that isn't a list of messages has no turns.
    """
    entries = _exploded(items, "$.conversation").withColumn("number", F.regexp_extract("key", r"^session_(\d{1,9})(_date_time)?$", 1)).where("number != ''")
    entries = entries.withColumn("number", F.col("number").cast("int")).withColumn("dated", F.col("key").endswith("_date_time"))
    told = entries.where(~F.col("dated") & (F.col("key") == F.concat(F.lit("session_"), "number"))).select("item", "number", F.try_variant_get("value", "$", _MESSAGES).alias("turns"))
    dates = entries.where("dated").groupBy("item", "number").agg(F.max(F.try_variant_get("value", "$", "string")).alias("date"))
    place = F.row_number().over(Window.partitionBy("item").orderBy("number"))
    told = told.withColumn("place", place).where("place = number").join(dates, ["item", "number"], "left")
    turns = F.transform(F.coalesce("turns", F.array()), lambda t: F.struct(F.coalesce(t["speaker"], F.lit("")).alias("speaker"), F.coalesce(t["text"], F.lit("")).alias("text"), t["blip_caption"].alias("blip_caption")))
    context = corpus.flatten_turns(turns, "speaker", "text", "blip_caption")
    return told.select("item", F.col("number").cast("long").alias("number"), F.concat(F.lit("D"), "number").alias("session_id"), F.coalesce(temporal.named_date(F.col("date")), F.lit("")).alias("session_time"), context.alias("context"))


def _plain(v: str, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _answer(v: str) -> Column:
    """An answer as text; one that is missing or empty in the sense of its JSON type is told as such."""
    given, kind = _plain(v, "$.answer"), F.schema_of_variant(F.try_variant_get(v, "$.answer", "variant"))
    given = F.when(kind == "BOOLEAN", F.initcap(given)).otherwise(given)
    return corpus.filled_answer(F.when((kind == "STRING") | ~F.lower(given).isin(*_EMPTY), given))


def group_questions(items: DataFrame, two_letters: bool = False) -> DataFrame:
    """(item, number, question, answer, question_type, origin, label) of groups; number counts an item's questions from 0. origin: the sessions of the evidence marks."""
    rows = _exploded(items, "$.qa").where("value is not null")
    marks = F.coalesce(F.try_variant_get("value", "$.evidence", "array<string>"), F.array().cast("array<string>"))
    answer = _answer("value")
    return rows.select(
        "item", F.col("pos").cast("long").alias("number"), F.coalesce(_plain("value", "$.question"), F.lit("")).alias("question"), answer.alias("answer"),
        F.coalesce(_plain("value", "$.category"), F.lit("")).alias("question_type"), text.evidence_sessions(marks, two_letters).alias("origin"), answer.alias("label"),
    )


def haystack_sessions(items: DataFrame) -> DataFrame:
    """(item, number, session_id, session_time, context) of haystacks, as far as the shortest of the three lists goes; number counts from 0, and a date that doesn't begin with one is ''."""
    lists = items.select("item", *[F.coalesce(F.try_variant_get("v", f"$.haystack_{c}", kind), F.array().cast(kind)).alias(c) for c, kind in (("session_ids", "array<string>"), ("dates", "array<string>"), ("sessions", "array<variant>"))])
    rows = corpus.zip_sessions(lists, "session_ids", "dates", "sessions", ["item"])
    turns = F.coalesce(F.try_variant_get("turns", "$", _TURNS), F.array().cast(_TURNS))
    turns = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["content"], F.lit("")).alias("content")))
    return rows.select("item", F.col("place").cast("long").alias("number"), "session_id", "session_time", corpus.flatten_turns(turns, "role", "content").alias("context"))


def haystack_questions(items: DataFrame) -> DataFrame:
    """(item, number, question, answer, question_type, question_time, origin, label): the one question of each haystack; origin: its answer's sessions."""
    field = lambda c: F.coalesce(_plain("v", f"$.{c}"), F.lit(""))
    ids = F.try_variant_get("v", "$.answer_session_ids", "array<string>")
    origin = F.coalesce(ids, text.origin_list(_plain("v", "$.answer_session_ids")))
    return items.select("item", F.lit(0).cast("long").alias("number"), field("question").alias("question"), field("answer").alias("answer"), field("question_type").alias("question_type"), field("question_date").alias("question_time"), origin.alias("origin"), field("answer").alias("label"))


LAYOUTS = {"groups": (group_sessions, group_questions), "haystacks": (haystack_sessions, haystack_questions)}


def next_item(spark: SparkSession, to: str) -> int:
    """The number after the greatest item that a folder of conversions holds; 0 if there is none."""
    names = []
    for kind in ("sessions", "questions"):
        base = spark._jvm.org.apache.hadoop.fs.Path(f"{to.rstrip('/')}/{kind}")
        fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
        names += [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
    return max((int(n[5:]) + 1 for n in names if n.startswith("item=") and n[5:].isdigit()), default=0)


def convert(spark: SparkSession, path: str, to: str, layout: str, json_array: bool | None = None, route: bool = False) -> None:
    """Converts raw files to a folder: sessions/item=N and questions/item=N with JSON lines, in order within an item.

    Items are added after those that the folder has. route: only questions of known types (and their sessions) are written, with the folder of their type as a column.
    An item is written by one task, in the order of its numbers; the raw files are read once for sessions and once for questions.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout: {layout}")
    items = read_items(spark, path, json_array, next_item(spark, to))
    sessions, questions = (f(items) for f in LAYOUTS[layout])
    if route:
        questions = corpus.routed(questions)
        sessions = sessions.join(questions.select("item", "folder").distinct(), "item")
    for rows, name in ((sessions, "sessions"), (questions, "questions")):
        rows.repartition("item").sortWithinPartitions("item", "number").write.mode("append").partitionBy("item").json(f"{to}/{name}")
