"""Periodic runs of words: linear-time runs from Lyndon arrays over an ordered alphabet.

A run is a stretch of words that repeats itself with a period of at most a quarter of its length. Words
become ranks by sorting. Every run has, in the order of the alphabet or in its reverse, a root that is
the longest Lyndon word at its start; so both Lyndon arrays are made, from left to right with the chain
of previous smaller suffixes on a stack. A common extension is never compared twice: the comparisons
made at the mirror place in the match that reaches farthest are taken over, and along the chain a known
extension decides the next one. No suffix structures and no hashes take part.

Whole batches are first cut, in array operations, at words that no run can hold: within a stretch of L
words a run has a period of L / 4 at most, so a word whose nearest equals in the stretch are farther
away ends it. Only what is left, which is little but for real repetition, is walked word by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import textkernel as tk
from threadloom.llm.workdir import columns_or_null, small_batches

LEAST_LENGTH, LEAST_PERIODS = 6, 4


def word_ranks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A rank for each word, by sorting eight bytes at a time: words have equal ranks only if they are equal."""
    left, at = ends - starts, starts.copy()
    rank = np.zeros(len(starts), np.int64)
    rows, eights = np.arange(len(starts)), np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    for _ in range(8):
        if not len(rows):
            break
        part = np.ascontiguousarray(eights[at[rows]])
        part[np.arange(8) >= left[rows, None]] = 0
        # how many bytes are left tells "a" from "a\0", and whether a word goes on
        key = np.unique(part.view("<u8").ravel(), return_inverse=True)[1] * 10 + np.minimum(left[rows], 9)
        key += rank[rows] * (int(key.max()) + 1)
        rank[rows] = np.unique(key, return_inverse=True)[1] + int(rank.max()) + 1
        rows = rows[left[rows] > 8]
        left[rows] -= 8
        at[rows] += 8
    if len(rows):  # very long words
        data = raw.tobytes()
        key = [(int(rank[r]), data[at[r] : at[r] + left[r]]) for r in rows.tolist()]
        top, last, order = int(rank.max()), None, sorted(range(len(key)), key=key.__getitem__)
        for k in order:
            top, last = top + (key[k] != last), key[k]
            rank[rows[k]] = top
    return np.unique(rank, return_inverse=True)[1]


def stretches(words: np.ndarray, docs: np.ndarray, rounds: int = 30) -> list[tuple[int, int]]:
    """(first, last) of the stretches that may hold runs; the rest of the words are in none. Cutting ends after `rounds`, for texts where it gets on slowly.

    words: ranks of all documents' words, one document after the other; docs: the document of each.
    """
    n = len(words)
    at = np.arange(n)  # places of the words that are left
    piece = docs.astype(np.int64)
    for k in range(rounds + 1):
        if not len(at):
            break
        new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)])
        piece = np.cumsum(new) - 1
        size = np.bincount(piece)
        key = piece * (int(words.max()) + 1) + words[at]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        gap = np.where(same, np.diff(at[order]), n + 1)
        near = np.full(len(at), n + 1)
        near[order[1:]] = gap
        near[order[:-1]] = np.minimum(near[order[:-1]], gap)
        keep = (LEAST_PERIODS * near <= size[piece]) & (size[piece] >= LEAST_LENGTH)
        if keep.all() or k == rounds:
            first = np.flatnonzero(new)
            return list(zip(at[first].tolist(), (at[np.append(first[1:], len(at)) - 1] + 1).tolist()))
        at, piece = at[keep], piece[keep]
    return []


def lyndon(text: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next smaller suffix (the end of its longest Lyndon word; the text's end if none), and how far the two suffixes agree."""
    n = len(text)
    after, agree = [n] * n, [0] * n  # of place and next smaller suffix
    before, back = [-1] * n, [0] * n  # previous smaller suffix, and how far the two agree
    first = [0] * n  # how far the suffixes of i - 1 and i agree
    mirror = reach = 0  # text[i:reach] equals text[i - mirror : reach - mirror]
    left = 0  # from which place on that holds
    for i in range(1, n):
        k = i - 1
        x = 0
        if mirror and i < reach and k >= left:
            x = first[i - mirror]
            if x >= reach - i:
                x = reach - i
                known = False
            else:
                known = True
        else:
            known = False
        if not known:
            e = i + x
            a = k + x
            while e < n and text[a] == text[e]:
                e += 1
                a += 1
            x = e - i
            if e > reach:
                reach, mirror, left = e, 1, k + 1
        first[i] = x
        while True:
            # suffixes k < i agree in x places; the end of the text is smaller than all words
            if i + x < n and text[k + x] < text[i + x]:
                before[i], back[i] = k, x
                break
            after[k], agree[k] = i, x
            y, down = back[k], before[k]
            if down < 0:
                break
            if y < x:  # the one below differs from k where i doesn't
                before[i], back[i] = down, y
                break
            if y == x:
                known = False
                if mirror and i < reach and down >= left:
                    m, d = i - mirror, down - mirror
                    z = agree[d] if after[d] == m else back[m] if before[m] == d else -1
                    if z >= x:
                        if i + z < reach:
                            x, known = z, True
                        else:
                            x = max(x, reach - i)
                if not known:
                    e = i + x
                    a = down + x
                    while e < n and text[a] == text[e]:
                        e += 1
                        a += 1
                    x = e - i
                    if e > reach:
                        reach, mirror, left = e, i - down, i
            k = down
    return after, agree


def runs_of(text: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of ranks, by start, then period."""
    n, found = len(text), set()
    if n < LEAST_LENGTH:
        return []
    top = max(text)
    for ordered in (text, [top - t for t in text]):
        after, agree = lyndon(ordered)
        for i in range(n):
            j = after[i]
            p = j - i
            # a run's first root begins in its first period, so that three of four periods follow it
            if j >= n or agree[i] < (LEAST_PERIODS - 2) * p:
                continue
            if i >= p and after[i - p] == i and agree[i - p] >= p:
                continue  # not the run's first root
            s = i
            while s > 0 and text[s - 1] == text[s - 1 + p]:
                s -= 1
            length = j + agree[i] - s
            if length >= max(LEAST_LENGTH, LEAST_PERIODS * p):
                found.add((s, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _periodic(n: np.ndarray, ids: list) -> tuple[np.ndarray, np.ndarray]:
    """For each document from which word on it repeats itself, and with which period: every tenth, by its id."""
    h = np.array([0 if x is None else zlib.crc32(str(x).encode()) for x in ids], np.int64)
    on = (h % 10 == 0) & (n > 0) & np.array([x is not None for x in ids], bool)
    g = h // 10
    a = np.where(on, g % np.maximum(n, 1), n)
    return a, np.where(on, 1 + (n - a) // (3 + g % 8), 1)


SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _detect(perturb: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tk.text_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for a, b in tk.slices(offsets, 2 << 20):
                yield _batch(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ids[a:b], perturb)

    return run


def _batch(raw: np.ndarray, offsets: np.ndarray, ids: list, perturb: bool) -> pa.RecordBatch:
    starts, ends, rows = tk.word_spans(raw, offsets)
    n = np.diff(rows)
    docs = np.repeat(np.arange(len(n)), n)
    own = np.arange(len(starts)) - rows[:-1][docs]  # the number of each word in its document
    if perturb:
        a, p = _periodic(n, ids)
        source = np.where(own >= a[docs], a[docs] + (own - a[docs]) % p[docs], own) + rows[:-1][docs]
        starts, ends = starts[source], ends[source]
    words = word_ranks(raw, starts, ends)
    found: list[list[dict]] = [[] for _ in ids]
    dropped = np.zeros(len(words) + 1, np.int64)
    for first, last in stretches(words, docs):
        doc = int(docs[first])
        base = first - int(rows[doc])
        for s, length, q in runs_of(words[first:last].tolist()):
            found[doc].append({"start": base + s, "length": length, "period": q})
            dropped[first + s + q] += 1
            dropped[first + s + length] -= 1
    for runs in found:
        runs.sort(key=lambda r: (r["start"], r["period"]))
    keep = np.cumsum(dropped[:-1]) == 0
    lengths = (ends - starts)[keep] + 1
    text = tk.gather(np.append(raw, np.uint8(0x20)), starts[keep], lengths)
    closes = np.cumsum(lengths)
    if len(text):
        text = text.copy()
        text[closes - 1] = 0x20
    bounds = np.concatenate([[0], closes])[np.concatenate([[0], np.cumsum(np.bincount(docs[keep], minlength=len(n)))]).astype(np.int64)]
    data = text.tobytes()
    kept = [data[x : max(x, y - 1)].decode() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, _RUNS), pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])


def periodic_runs(spark: SparkSession, docs: DataFrame, perturb: bool = False) -> DataFrame:
    """The runs of each whole text of docs (doc_id, text), and the text without what they repeat: (doc_id, runs, collapsed).

    Words are what stands between white space (space, 0x09 to 0x0D). A run is a stretch of words with smallest period q,
    6 words long and 4 periods at least, that can't be made longer on either side. A word after the first period of a run
    that holds it is dropped; the others are joined by single blanks. Runs come by start, then period.

    A null or empty text has no runs and an empty text; rows that repeat a doc_id, or have none, stand for themselves;
    further columns are left behind, whatever their names. A text is held by one task, whatever its length.
    perturb: as a test of the detector, every tenth document (crc32 of its doc_id) first repeats its own words from some word on.
    """
    small_batches(spark)
    return columns_or_null(docs, doc_id="long", text="string").mapInArrow(_detect(perturb), SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """Of each row of `periodic_runs`: how many runs, the longest one (then the earliest, then that of the smallest period), and digests of runs and text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

