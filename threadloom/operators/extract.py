"""Model-backed extraction: pluggable backends, and parsing of the replies in plain column expressions."""

from __future__ import annotations

import asyncio
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text


class TextGenerator(Protocol):
    """A language model; made once in each worker."""

    def generate(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class EchoGenerator:
    """An offline stand-in: the first 50 letters of the prompt."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [f"Offline reply to: {p[:50]}..." for p in prompts]


class HashEmbedder:
    """An offline stand-in: signed hashes of words, summed and scaled to unit length."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.dimensions] += 1.0 if h >> 31 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out


@dataclass(frozen=True)
class Calls:
    """How a task calls a model that answers one prompt at a time (``async def agenerate(prompt)``): at most `concurrency` calls are under way at once.

    A call over `timeout` seconds fails. A failing call is made again up to `retries` times, after `backoff` seconds and then twice as long each time.
    Over a whole cluster as many calls can be under way as tasks run, times `concurrency`.
    """

    concurrency: int = 16
    timeout: float | None = None
    retries: int = 0
    backoff: float = 0.5


def _one_by_one(model, prompts: list[str], calls: Calls) -> list[tuple[str, float, str | None]]:
    async def ask(prompt: str, gate: asyncio.Semaphore) -> tuple[str, float, str | None]:
        async with gate:
            began, error = time.monotonic(), None
            for k in range(calls.retries + 1):
                if k:
                    await asyncio.sleep(calls.backoff * 2 ** (k - 1))
                try:
                    return await asyncio.wait_for(model.agenerate(prompt), calls.timeout) or "", time.monotonic() - began, None
                except Exception as e:  # a row that fails must not end the job
                    error = f"{type(e).__name__}: {e}"
            return "", time.monotonic() - began, error

    async def all_of() -> list:
        gate = asyncio.Semaphore(calls.concurrency)
        return await asyncio.gather(*(ask(p, gate) for p in prompts))

    return asyncio.run(all_of())


def _in_batches(model, prompts: list[str]) -> list[tuple[str, float, str | None]]:
    """A batch in one call; if it fails, row by row."""
    began = time.monotonic()
    try:
        said = model.generate(prompts)
        return [(x or "", (time.monotonic() - began) / len(prompts), None) for x in said]
    except Exception:
        out = []
        for p in prompts:
            began = time.monotonic()
            try:
                out.append((model.generate([p])[0] or "", time.monotonic() - began, None))
            except Exception as e:  # a row that fails must not end the job
                out.append(("", time.monotonic() - began, f"{type(e).__name__}: {e}"))
        return out


def generate(rows: DataFrame, prompt: str, make, out: str = "reply", calls: Calls | None = None, told: str | None = None) -> DataFrame:
    """Adds a model's reply to each row's prompt. A failing batch is asked again row by row; a failing row gets ''.

    make: a function without arguments that gives a TextGenerator, or a model with `agenerate` (see `Calls`), called once in a task.
    told: with it, the columns {told}_seconds and {told}_error say how long each reply took, and why it failed (null if it didn't).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            prompts = batch[prompt].tolist()
            found = _one_by_one(model, prompts, calls or Calls()) if hasattr(model, "agenerate") else _in_batches(model, prompts) if prompts else []
            said, seconds, errors = ([x[k] for x in found] for k in range(3))
            yield batch.assign(**{out: said} | ({f"{told}_seconds": seconds, f"{told}_error": errors} if told else {}))

    wide = rows.withColumn(out, F.lit(""))
    wide = wide.withColumns({f"{told}_seconds": F.lit(0.0), f"{told}_error": F.lit(None).cast("string")}) if told else wide
    return rows.mapInPandas(run, wide.schema)


def embed(rows: DataFrame, column: str, make, out: str = "embedding") -> DataFrame:
    """Adds vectors of the distinct texts, each embedded once. A failing batch is tried again text by text; a failing text gets null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            try:
                found = model.embed(batch[column].tolist())
            except Exception:
                found = []
                for t in batch[column]:
                    try:
                        found += model.embed([t])
                    except Exception:  # a text that fails must not end the job
                        found.append(None)
            yield batch.assign(**{out: found})

    distinct = rows.select(column).distinct()
    vectors = distinct.mapInPandas(run, distinct.withColumn(out, F.lit(None).cast("array<double>")).schema)
    return rows.join(vectors, column, "left")


def records(reply: Column) -> Column:
    """The records of a reply, without blanks and the end mark."""
    return F.filter(F.transform(F.split(reply, "##"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^[*#]*END[*#]*$"))


def _parts(record: Column) -> Column:
    bare = F.regexp_replace(record, r"^[()]+|[()]+$", "")
    return F.transform(F.split(bare, r"\|"), lambda x: F.trim(F.regexp_replace(F.trim(x), r'^"+|"+$', "")))


def _records(replies: DataFrame, reply: str, kind: str, fields: int, place: str | None) -> DataFrame:
    """Records of a kind with their parts `p`, and the column `place`: where in its reply each stands."""
    rows = replies.select("*", F.posexplode(records(F.col(reply))).alias(place or "record_place", "record")).withColumn("p", _parts(F.col("record")))
    return rows.where((F.col("p")[0] == kind) & (F.size("p") >= fields))


def _kept(replies: DataFrame, reply: str, place: str | None) -> list[str]:
    return [*(c for c in replies.columns if c != reply), *([place] if place else [])]


def parse_entities(replies: DataFrame, reply: str = "reply", place: str | None = None) -> DataFrame:
    """A row for each entity record of three fields or more: entity, type, description (its fourth field or '')."""
    rows = _records(replies, reply, "entity", 3, place)
    return rows.select(*_kept(replies, reply, place), F.col("p")[1].alias("entity"), F.col("p")[2].alias("type"), F.coalesce(F.try_element_at("p", F.lit(4)), F.lit("")).alias("description"))


def parse_query_entities(replies: DataFrame, reply: str = "reply", place: str = "query_ord") -> DataFrame:
    """What a question names: records of an entity and its type, both given, with their places (query_name, query_type)."""
    rows = _records(replies, reply, "entity", 3, place)
    rows = rows.select(*_kept(replies, reply, place), F.col("p")[1].alias("query_name"), F.col("p")[2].alias("query_type"))
    return rows.where("query_name != '' and query_type != ''")


def parse_relations(replies: DataFrame, reply: str = "reply", place: str | None = None) -> DataFrame:
    """A row for each relation record of seven fields or more; a strength that isn't all digits is 1, with weight 0.1; the greatest is that of an int."""
    rows = _records(replies, reply, "relationship", 7, place)
    strength = F.when(F.col("p")[6].rlike("^[0-9]+$"), F.coalesce(F.expr("try_cast(p[6] as int)"), F.lit(2**31 - 1))).otherwise(1)
    named = [F.col("p")[k].alias(c) for k, c in ((1, "create_time"), (2, "session_id"), (3, "src"), (4, "tgt"), (5, "relation"))]
    return rows.select(*_kept(replies, reply, place), *named, strength.alias("strength"), (strength / 10.0).alias("weight"))


_SUMMARY = "session_id string, session_time string, keys string, context map<string,string>"


def parse_summaries(replies: DataFrame) -> DataFrame:
    """Summaries from replies (session_id, session_time, reply): JSON, fenced JSON, or a row made from the reply itself."""
    plain = F.when(F.trim("reply").startswith("{"), F.from_json("reply", _SUMMARY))
    found = replies.withColumn("s", F.coalesce(plain, F.from_json(text.json_in(F.col("reply")), _SUMMARY)))
    good = F.col("s.context").isNotNull()
    day = F.split(F.col("session_time"), "[ T]")[0]
    spare = F.create_map(F.lit("theme_1"), F.lit("Conversation"), F.lit("summary_1"), text.preview(F.col("reply"), 200))
    return found.select(
        F.coalesce(F.nullif("s.session_id", F.lit("")), "session_id").alias("session_id"), F.coalesce(F.nullif("s.session_time", F.lit("")), day).alias("session_time"),
        F.when(good, F.coalesce("s.keys", F.lit(""))).otherwise("session, conversation").alias("keys"), F.when(good, F.col("s.context")).otherwise(spare).alias("context"),
        F.when(F.coalesce("reply", F.lit("")) == "", "failed").otherwise("ok").alias("summary_status"),
    )
