"""What the vector operators share: reading list columns, and dealing big cells out in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTOR = "vec_id long, dim int, vector binary"


def rows_of(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each list as float64; None where it is null, empty, or holds a null or a non-finite number."""
    flat, offsets = column.values, np.asarray(column.offsets)
    valid = np.asarray(column.is_valid())
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    for i in range(len(column)):
        own = values[offsets[i] : offsets[i + 1]]
        yield own if valid[i] and len(own) and np.isfinite(own).all() else None


def stack(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def blocks(items: DataFrame, asks: DataFrame, keys: list[str], item: str, ask: str, per_items: int, per_asks: int) -> DataFrame:
    """Rows of both frames, dealt so that each item of a cell meets each ask of the cell in one block.

    Both frames have the key columns and further columns of their own; a cell's items are cut into
    parts of about per_items and its asks into parts of about per_asks by hash of their id columns
    (item, ask), and rows of one side go to every part of the other. Adds item_part, ask_part, is_ask.
    """
    sizes = items.groupBy(*keys).agg(F.ceil(F.count("*") / per_items).cast("int").alias("item_parts"))
    asked = asks.groupBy(*keys).agg(F.ceil(F.count("*") / per_asks).cast("int").alias("ask_parts"))
    parts = sizes.join(asked, keys)
    own = items.join(parts, keys).withColumn("item_part", F.pmod(F.xxhash64(item), "item_parts").cast("int"))
    own = own.withColumn("ask_part", F.explode(F.expr("sequence(0, ask_parts - 1)"))).withColumn("is_ask", F.lit(False))
    met = asks.join(parts, keys).withColumn("ask_part", F.pmod(F.xxhash64(ask), "ask_parts").cast("int"))
    met = met.withColumn("item_part", F.explode(F.expr("sequence(0, item_parts - 1)"))).withColumn("is_ask", F.lit(True))
    return own.drop("item_parts", "ask_parts").unionByName(met.drop("item_parts", "ask_parts"), allowMissingColumns=True)
