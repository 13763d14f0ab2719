"""Token files: concatenated ids with Elias-Fano coded document boundaries.

A file is a Parquet table with a row for each block of about a million ids. A row holds the ids as
little-endian integers of 2 or 4 bytes, the doc_ids, and where each document starts as an Elias-Fano
sequence: of each offset the low bits packed, the high bits as a unary bit vector, and the position
of every 64th set bit, so that select finds any offset from a few bytes: about 2 + log2(ids per
document) bits a document instead of a table of 64-bit offsets. Blocks are in ascending order of doc_id.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm import pretokens
from threadloom.llm import textkernel as tk
from threadloom.llm.workdir import columns_or_null, small_batches

_EVERY = 64
END_ID = 0


class EliasFano:
    """A rising sequence of whole numbers, with select."""

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.count, self.low_bits = count, low_bits
        self.low, self.high, self.samples = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        at = (values >> bits) + np.arange(n)
        unary = np.zeros((int(at[-1]) + 1) if n else 0, np.uint8)
        unary[at] = 1
        low = (values[:, None] >> np.arange(bits)) & 1
        return cls(n, bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes(), at[::_EVERY].astype("<u4").tobytes())

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.int64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits))

    def select(self, first: int, last: int | None = None) -> np.ndarray:
        """The values first..last-1 (one, if last isn't given), read from the nearest sample on."""
        last = first + 1 if last is None else last
        if last <= first:
            return np.zeros(0, np.int64)
        near = first // _EVERY
        a = int(self.samples[near])
        beyond = -(-last // _EVERY)
        b = int(self.samples[beyond]) if beyond < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[a // 8 : -(-b // 8) + 1], bitorder="little")[a % 8 :]) + a
        skip = first - near * _EVERY
        at = ones[skip : skip + last - first]
        return (at - np.arange(first, last) << self.low_bits) | self._lows(first, last)


_BLOCK = "part int, base long, n_docs int, n_ids long, width int, doc_ids binary, low_bits int, low binary, high binary, samples binary, ids binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("base", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary()), ("ids", pa.binary())])
_encoders: dict = {}


def _encoder(path: str, end: int):
    """Ids of UTF-8 rows by the tokenizers library; each different piece is encoded once a worker."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        special = [str(t).encode() for t in (x.content for x in library.get_added_tokens_decoder().values())]
        tokenize = library.model.tokenize
        pieces = pretokens.PieceCache(lambda words: [[t.id for t in tokenize(w)] for w in words], pretokens.byte_letters())
        _encoders[path] = library, special, pieces
    library, special, pieces = _encoders[path]

    def encode(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, rows = pretokens.cut(raw, offsets, spaces_join=True)
        ids, lengths = pieces.ids(raw, starts, ends)
        ids, bounds = ids.astype(np.uint32), np.concatenate([[0], np.cumsum(lengths)])[rows]
        data = raw.tobytes()
        if any(s in data for s in special):  # a special token cuts a text before pieces are made
            texts = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            whole = [library.encode(t.decode(), add_special_tokens=False).ids if any(s in t for s in special) else None for t in texts]
            chunks = [ids[bounds[i] : bounds[i + 1]] if x is None else np.array(x, np.uint32) for i, x in enumerate(whole)]
            ids, bounds = np.concatenate(chunks), np.concatenate([[0], np.cumsum([len(c) for c in chunks])])
        return np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))

    return encode


def _write(path: str, end: int, per_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, part = _encoder(path, end), 0, TaskContext.get().partitionId()
        for batch in batches:
            raw, offsets = tk.text_bytes(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for first, last in tk.slices(offsets, 4 << 20):
                ids, bounds = encode(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                for a, b in tk.slices(bounds, per_block):
                    own = ids[bounds[a] : bounds[b]]
                    width = 2 if int(own.max()) < 1 << 16 else 4
                    ef = EliasFano.of(bounds[a : b + 1] - bounds[a])
                    docs = names[first + a : first + b]
                    null = np.packbits([x is None for x in docs])
                    yield pa.RecordBatch.from_pydict(dict(zip(_SCHEMA.names, ([x] for x in (
                        part, base, b - a, len(own), width, np.array([x or 0 for x in docs], "<i8").tobytes() + null.tobytes(),
                        ef.low_bits, ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes(), own.astype(f"<u{width}").tobytes(),
                    )))), schema=_SCHEMA)
                    base += len(own)

    return run


def write_token_files(docs: DataFrame, to: str, tokenizer: str, end: int = END_ID, per_block: int = 1_000_000) -> None:
    """Writes the ids of all texts of docs (doc_id, text) to the folder `to`, in ascending doc_id order.

    A null or empty text is the end id alone. Null doc_ids come first; rows that repeat a doc_id stand
    next to each other, in the order of their texts' hashes. Further columns are left behind. No rows
    give a folder without blocks. tokenizer: path of a tokenizers file; special tokens aren't added.
    """
    small_batches(docs.sparkSession)
    docs = columns_or_null(docs, doc_id="long", text="string")
    ranged = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranged.mapInArrow(_write(tokenizer, end, per_block), _BLOCK).write.option("compression", "zstd").parquet(to)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n_docs"]
            ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
            bounds = EliasFano(n + 1, row["low_bits"], row["low"], row["high"], row["samples"]).select(0, n + 1)
            data = memoryview(ids).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            null = np.unpackbits(np.frombuffer(row["doc_ids"][8 * n :], np.uint8))[:n].astype(bool)
            docs = pa.array(np.frombuffer(row["doc_ids"][: 8 * n], "<i8"), mask=null)
            yield pa.RecordBatch.from_arrays([docs, pa.array(bounds[:-1] + row["base"] + row["ahead"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of token files, each with the number of ids in all parts before its own (ahead)."""
    blocks = spark.read.schema(_BLOCK).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each writing task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return blocks.join(F.broadcast(parts), "part")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from its block."""
    return token_blocks(spark, path).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
