"""Sessions as a stream: each micro-batch becomes the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.plans.memory import Memory
from threadloom.sources.corpus import SESSION


def session_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(SESSION).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(memory: Memory, sessions: DataFrame, checkpoint: str, name: str = "sessions"):
    """Starts a query that merges each batch into the memory. A batch that runs again is skipped if the newest snapshot has it.

    name: tells streams into the same memory apart; a new checkpoint needs a new name, as its batches count from 0.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        memory.add(batch, stream=name, batch=batch_id)

    return sessions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
