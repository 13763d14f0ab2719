"""Packing of token pieces into sequences: exact complements first, then best fit.

Only lengths matter for packing, so the plan is made from how many pieces there are of each length: a
table of as many rows as a sequence has tokens, whatever the corpus. The gap that a piece leaves, from
the longest on, is looked up by address among single lengths, then sums of two, then sums of three; as
many equal combinations as the counts allow are taken at once, so that each step uses up some length
(but for a piece or two), and the plan has a few thousand rows at most. What finds no exact complement
goes, longest first, where it leaves the smallest gap. Pieces then find their places by their numbers
among the pieces of their length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm import textkernel as tk
from threadloom.llm.token_files import END_ID, _encoder
from threadloom.llm.workdir import Scratch, columns_or_null, small_batches


class Sums:
    """Lengths at hand, and which of one, two or three of them add up to a sum. Counts only fall, so that a sum once found out of reach stays so."""

    def __init__(self, counts: np.ndarray):
        self.have = counts.astype(np.int64)
        self.larger = np.zeros(len(counts), np.int64)  # of the pair last found for each sum: 0 none yet, -1 never again

    def _pair(self, total: int) -> int:
        x = int(self.larger[total])
        if x > 0 and self.have[x] > 0 and self.have[total - x] > (x == total - x):
            return x
        if x >= 0:
            xs = np.arange(total - 1, (total - 1) // 2, -1)
            good = (self.have[xs] > 0) & (self.have[total - xs] > (xs == total - xs))
            self.larger[total] = xs[good.argmax()] if good.any() else -1
        return int(self.larger[total])

    def _fits(self, parts: list[int]) -> bool:
        return all(self.have[x] >= n for x, n in Counter(parts).items())

    def complement(self, lead: int, gap: int, parts: int) -> list[int] | None:
        """So many lengths (one to three) beside `lead` that fill the gap, the largest possible first; none of them is over lead."""
        if parts == 1:
            return [gap] if gap <= lead and self._fits([lead, gap]) else None
        xs = np.arange(min(lead, gap - 1), max((gap - 1) // parts, 0), -1)
        xs = xs[self.have[xs] > 0]
        if parts == 2:
            x = self._pair(gap) if gap > 1 else -1
            for x in [x] * (0 < x <= lead) + xs[self.have[gap - xs] > 0].tolist() * (x > 0):
                if self._fits([lead, x, gap - x]):
                    return [x, gap - x]
            return None
        for x in xs[xs < gap - 1].tolist():
            y = self._pair(gap - x)
            if y > 0 and self._fits([lead, x, y, gap - x - y]):
                return [x, y, gap - x - y]
        return None

    def take(self, parts: list[int]) -> tuple[int, list[tuple[int, int]]]:
        """As many of the combination as there are: (copies, (length, times) of each length)."""
        times = list(Counter(parts).items())
        copies = min(int(self.have[x]) // n for x, n in times)
        for x, n in times:
            self.have[x] -= copies * n
        return copies, times


Kind = tuple[int, list[tuple[int, int]]]


def plan(counts: np.ndarray, size: int) -> list[Kind]:
    """(copies, lengths with their times in one sequence) of all kinds of sequences. counts: pieces of each length from 0 to size.

    Exact combinations can use up small pieces that best fit would have needed, so plans that stop at sums of fewer
    lengths are made as well, and the one with the fewest sequences counts.
    """
    return min((_plan(counts, size, parts) for parts in (3, 2, 1, 0)), key=lambda kinds: sum(copies for copies, _ in kinds))


def _plan(counts: np.ndarray, size: int, most: int) -> list[Kind]:
    """Exact combinations of a piece with one others, then two, then three, as far as `most`; best fit for what is left."""
    sums, out = Sums(counts), []
    if sums.have[size]:
        out.append(sums.take([size]))
    for parts in range(1, most + 1):
        for lead in range(size - 1, 0, -1):
            while sums.have[lead] > 0 and (rest := sums.complement(lead, size - lead, parts)):
                out.append(sums.take([lead, *rest]))
    open_: dict[int, list] = {}  # kinds of sequences by the gap they still have

    def close(copies: int, items: list, gap: int) -> None:
        if copies and gap:
            open_.setdefault(gap, []).append((copies, items))
        elif copies:
            out.append((copies, items))

    for length in range(size, 0, -1):
        left = int(sums.have[length])
        while left:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                copies, items, gap = left, [], size
            else:
                copies, items = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
            each = gap // length
            full = min(copies, left // each)
            close(full, [*items, (length, each)], gap - each * length)
            left -= full * each
            rest = copies - full
            if rest and 0 < left < each:
                close(1, [*items, (length, left)], gap - left * length)
                rest, left = rest - 1, 0
            if items:
                close(rest, items, gap)
    return out + [kind for kinds in open_.values() for kind in kinds]


def slots(kinds: list[Kind]) -> np.ndarray:
    """Rows (length, first number, times, first sequence, offset) in order of length and number: where the pieces of each length go."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for copies, items in kinds:
        offset = 0
        for length, times in items:
            rows.append((length, used[length], times, sequence, offset))
            used[length] += copies * times
            offset += length * times
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


_PIECE = "doc_id long, piece int, start long, length long, ids binary, part int, nth long"


def _cut(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = _encoder(path, end), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            raw, offsets = tk.text_bytes(batch.column("text"))
            for first, last in tk.slices(offsets, 4 << 20):
                ids, bounds = encode(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                n = np.diff(bounds)
                pieces = -(-n // size)
                of = np.repeat(np.arange(len(n)), pieces)
                number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = n - (pieces - 1) * size  # the first piece may be shorter, all others are full
                start = np.where(number > 0, head[of] + (number - 1) * size, 0)
                length = np.where(number > 0, size, head[of])
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                within = np.arange(len(order)) - np.searchsorted(ranked, ranked)
                nth = np.empty(len(order), np.int64)
                nth[order] = seen[ranked] + within
                seen += np.bincount(length, minlength=size + 1)
                edges = np.append(bounds[of] + start, bounds[-1]).astype("<i4") * 4
                data = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                docs = batch.column("doc_id").slice(first, last - first).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([docs, pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), data, pa.array(np.full(len(of), part, np.int32)), pa.array(nth)], ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    return run


def cut_pieces(spark: SparkSession, docs: DataFrame, tokenizer: str, size: int = 2048, end: int = END_ID) -> DataFrame:
    """A written table of the pieces of all texts of docs (doc_id, text): doc_id, piece, start, length, ids (little-endian, 4 bytes each), part, nth.

    A document is its ids, without special tokens added, and the end id; only one longer than `size` is cut. A null or empty
    text is the end id alone. Rows that repeat or have no doc_id are documents of their own; further columns are left behind.
    part and nth number the pieces of a length: nth within the task that wrote them. tokenizer: path of a tokenizers file.
    """
    if size < 1:
        raise ValueError("a sequence holds at least one token")
    small_batches(spark)
    docs = columns_or_null(docs, doc_id="long", text="string")
    return Scratch(spark, "pieces").table(docs.mapInArrow(_cut(tokenizer, size, end), _PIECE))


def _placed(table: np.ndarray, top: int):
    """Adds sequence_id and offset to pieces with their numbers; a piece's row of the plan is the last that begins at or before it."""
    keys = table[:, 0] * top + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            row = table[np.searchsorted(keys, length * top + number, "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            at = number - row[:, 1]
            kept = [c for c in batch.schema.names if c not in ("number", "part", "nth")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(row[:, 3] + at // row[:, 2]), pa.array(row[:, 4] + at % row[:, 2] * length)], [*kept, "sequence_id", "offset"])

    return run


def place(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Pieces (part, nth, length and any other columns) with sequence_id and offset in place of part and nth.

    What reaches the driver is one count for each length, and the plan made from it; tasks' counts are joined, not sent.
    """
    sizes = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # as many rows as a sequence has tokens, at most
        counts[r["length"]] = r["n"]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    ahead = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    numbered = pieces.join(ahead, ["part", "length"]).withColumn("number", F.col("nth") + F.col("ahead")).drop("ahead")
    kept = [f for f in numbered.schema if f.name not in ("number", "part", "nth")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return numbered.mapInArrow(_placed(slots(plan(counts, size)), int(counts.max()) + 1), schema)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences (sequence_id, length, ids) of placed pieces that have their ids."""
    rows = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))  # a sequence's pieces
    return rows.select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
