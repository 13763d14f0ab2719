"""Session summaries as keyed state: a stream's state store holds the summary of each session.

Each micro-batch asks the model about the sessions that it has parts of, and about no others: a session
without state is summarised, one with state is brought up to date. The state lies in RocksDB beside the
stream's checkpoint, so that a restarted stream goes on from it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadloom.plans.memory import MERGE, SUMMARISE

SUMMARY = "session_time string, keys string, context map<string,string>, parts long"
UPDATE = "session_id string, session_time string, keys string, context map<string,string>, summary_status string, parts long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(contexts: list[str]) -> str:
    """Parts of a session by blank lines; one that is contained in what stands already is skipped."""
    out: str | None = None
    for c in contexts:
        out = c if out is None else out if c in out else f"{out}\n\n{c}"
    return out or ""


def shown(session_id: str, time: str | None, keys: str | None, context: dict) -> str:
    """A summary in one text, as models are told it."""
    numbers = sorted(int(k[6:]) for k in context if re.fullmatch(r"theme_\d+", k))
    told = "\n".join(f"{context.get(f'theme_{n}') or ''}: {context.get(f'summary_{n}') or ''}" for n in numbers)
    return f"Session {session_id} ({'unknown' if time is None else time}) Keys: {keys or ''} {told}"


def parsed(reply: str, time: str | None) -> tuple[str | None, str, dict[str, str], str]:
    """(session_time, keys, context, status) of a reply: its JSON, plain or fenced, or a row made from the reply itself."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", reply, re.DOTALL) or re.search(r"(\{.*\})", reply, re.DOTALL)
    for text in (reply, fenced and fenced[1]):
        try:
            found = json.loads(text or "")
        except ValueError:
            continue
        if isinstance(found, dict) and isinstance(found.get("context"), dict):
            context = {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in found["context"].items()}
            return found.get("session_time") or time, str(found.get("keys") or ""), context, "ok"
    day = None if time is None else re.split("[ T]", time)[0]
    return day, "session, conversation", {"theme_1": "Conversation", "summary_1": reply if len(reply) <= 200 else f"{reply[:200]}..."}, "ok" if reply else "failed"


class Summaries(StatefulProcessor):
    """make: a function without arguments that gives a TextGenerator, called once in a task."""

    def __init__(self, make):
        self.make = make

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = self.make()
        self.state = handle.getValueState("summary", SUMMARY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows)).sort_values("doc_id", kind="stable", na_position="last")  # one session's parts in one batch
        times = [t for t in parts["session_time"] if t]
        time, told = (times or [None])[0], joined([c or "" for c in parts["context"]])
        old = self.state.get() if self.state.exists() else None
        about = f"Session ID: {key[0]}\nSession Time: {'unknown' if time is None else time}\nContext: {told}"
        prompt = SUMMARISE + about if old is None else f"{MERGE}{shown(key[0], old[0], old[1], dict(old[2] or {}))}\n{about}"
        try:
            reply = self.model.generate([prompt])[0] or ""
        except Exception:  # a session that fails must not end the stream
            reply = ""
        day, keys, context, status = parsed(reply, time)
        n = len(parts) + (old[3] if old is not None else 0)
        if old is not None and status == "failed":  # what is known stays
            day, keys, context = old[0], old[1], dict(old[2] or {})
        if old is not None or status == "ok":
            self.state.update((day, keys, context, n))
        yield pd.DataFrame({"session_id": [key[0]], "session_time": [day], "keys": [keys], "context": [context], "summary_status": [status], "parts": [n]})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of any shape needs this store; it spills to disk, so that memory doesn't bound the number of sessions."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def session_summaries(sessions: DataFrame, generator) -> DataFrame:
    """A stream of changed summaries from a stream of sessions' parts (doc_id, session_id, session_time, context).

    A row for each session of each micro-batch: session_id, session_time, keys, context, summary_status, parts (told so far).
    Parts of a batch are told in the order of doc_id. A model that fails changes no summary that is there: the row says
    `failed`; a session without one stays without, and is summarised by its next part. Rows without a session_id are left out.
    Set the state store with `use_rocksdb` before the stream starts.
    """
    rows = sessions.where("session_id is not null").select("doc_id", "session_id", "session_time", "context")
    return rows.groupBy("session_id").transformWithStateInPandas(Summaries(generator), UPDATE, "Update", "None")


def summarise_into(store, changed: DataFrame, checkpoint: str, embedder=None, name: str = "summaries"):
    """Starts a query that appends changed summaries to the newest snapshot of a store; only their buckets' rows are written.

    A batch that runs again is skipped if the snapshot has it.
    """
    from threadloom.operators import context, extract

    def merge(batch: DataFrame, batch_id: int) -> None:
        from pyspark.sql import functions as F

        newest = max(store.versions(), default=None)
        manifest = store.manifest(newest)
        if batch_id <= manifest["batches"].get(name, -1):
            return
        rows = batch.where("summary_status = 'ok'").drop("parts").withColumn("shown", context.summary_line(F.col("session_id"), F.col("session_time"), F.col("keys"), F.col("context")))
        rows = rows.withColumn("embedding", F.lit(None).cast("array<double>")) if embedder is None else extract.embed(rows, "shown", embedder)
        store.append({"summaries": rows.drop("shown")}, 0 if newest is None else newest + 1, newest, manifest["batches"] | {name: batch_id}, manifest["next_chunk"])

    return changed.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
