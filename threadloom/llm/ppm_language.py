"""Languages of texts by prediction by partial matching over bytes.

Each language has a context tree of bytes, three deep, with frozen counts. A byte costs -log2 of its
share under the longest context that has been seen, and every context in which it hasn't been seen
adds the cost of its escape (method C: with n visits and d different followers, an escape has
d / (n + d)). A text's language is the one whose tree gives it the shortest exact code length. Since
counts are frozen, all costs are known before any text is read. A table holds them: a row for each context
of three bytes that some language has seen, else for each of two, else of one, and in it a cost for
each byte. Bytes that no learnt text has share one symbol, and cost what tells them from each other as well.

The best of the learnt languages may still be a wrong one. A text is in none of them if its bits per byte
are far over those of nearly all labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm import textkernel as tk
from threadloom.llm.workdir import columns_or_null, small_batches

UNKNOWN = "und"
_DEPTH = 3
_START = 8  # bytes added to a text's length in its bits per byte, since the first bytes of a text cost more
_STEPS = 64  # of a bit per byte, in the counts that bounds are read from


@dataclass
class LanguageModel:
    symbols: np.ndarray  # of each byte; 0 stands for what precedes a text, size - 1 for all bytes never seen
    size: int
    languages: list[str]
    grams: list[np.ndarray]  # of each language: codes of four symbols
    counts: list[np.ndarray]


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, _ = tk.text_bytes(batch.column("text"))
        n = np.bincount(tk.LOWER[raw], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(n)], ["byte", "n"])


def _codes(raw: np.ndarray, offsets: np.ndarray, symbols: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the three symbols before every byte, and its own symbol; each row begins after three symbols 0."""
    n = len(offsets) - 1
    at = np.arange(len(raw)) + _DEPTH * np.repeat(np.arange(1, n + 1), np.diff(offsets))
    padded = np.zeros(len(raw) + _DEPTH * n, np.int32)
    padded[at] = symbols[tk.LOWER[raw]]
    before = np.zeros_like(padded)
    for k in range(1, _DEPTH + 1):
        before[k:] += padded[:-k] * size ** (k - 1)
    return before[at], padded[at]


def _grams(symbols: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                raw, offsets = tk.text_bytes(batch.column("text").filter(pa.array(langs == lang)))
                before, own = _codes(raw, offsets, symbols, size)
                code, n = np.unique(before.astype(np.int64) * size + own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], ["lang", "code", "n"])

    return run


def train(spark: SparkSession, labelled: DataFrame, per_language: int = 1000) -> LanguageModel:
    """Counts contexts in at most `per_language` texts of each language (doc_id, text, lang), chosen by hash of doc_id and text.

    Rows with a null text or language teach nothing; rows that are alike in all three teach once. Rows without a doc_id, or with one that
    others have too, count like any other.
    """
    small_batches(spark)
    labelled = columns_or_null(labelled, doc_id="long", text="string", lang="string").where("text is not null and lang is not null")
    labelled = labelled.withColumn("key", F.xxhash64("doc_id", "text"))
    place = F.shiftrightunsigned("key", 1)
    # about twice as many as asked for, so that a task ranks few rows of a common language; a share for
    # each language is broadcast (the model holds far more for each), so that rows are thinned out before the shuffle
    share = labelled.groupBy("lang").agg((F.lit(2.0 * per_language) / F.approx_count_distinct("key")).alias("share"))
    some = labelled.select("key", "lang").join(F.broadcast(share), "lang").where(place < F.col("share") * F.lit(float(1 << 63)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "key"))
    chosen = some.select("lang", "key").distinct().withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "key")
    sample = labelled.join(F.broadcast(chosen), ["lang", "key"], "left_semi").groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", "text")  # at most per_language keys a language
    seen = sample.mapInArrow(_bytes, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), "byte").collect()
    size = len(seen) + 2
    symbols = np.full(256, size - 1, np.int32)
    for k, r in enumerate(seen):
        symbols[r["byte"]] = k + 1
    rows = sample.mapInArrow(_grams(symbols, size), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    of = [rows[rows["lang"] == x].sort_values("code") for x in languages]
    return LanguageModel(symbols, size, languages, [x["code"].to_numpy() for x in of], [x["n"].to_numpy() for x in of])


@dataclass
class Costs:
    """rows: the row of each code of three symbols; tables: of each language, the bits of each (row, symbol); aside: those that tell bytes of one symbol apart."""

    rows: np.ndarray
    tables: list[np.ndarray]
    aside: np.ndarray


def costs(model: LanguageModel) -> Costs:
    """Bits of every byte after every context, escapes included."""
    size = model.size
    three = np.unique(np.concatenate([np.unique(g // size) for g in model.grams])) if model.grams else np.zeros(0, np.int64)
    two = np.unique(three % size**2)
    rows = np.arange(size**2, dtype=np.int32) % size + len(three) + len(two)
    rows[two] = len(three) + np.arange(len(two))
    rows = np.tile(rows, size)
    rows[three] = np.arange(len(three))
    tables = []
    for grams, counts in zip(model.grams, model.counts):
        before, own = np.divmod(grams, size)
        spread = lambda at, n: np.bincount(at * size + own, counts, n * size).reshape(n, size)  # noqa: E731, B023
        none = _longer(spread(np.zeros_like(own), 1), np.full((1, size), np.log2(size)))
        one = _longer(spread(before % size, size), np.tile(none, (size, 1)))
        pair = _longer(spread(np.searchsorted(two, before % size**2), len(two)), one[two % size])
        full = _longer(spread(np.searchsorted(three, before), len(three)), pair[np.searchsorted(two, three % size**2)])
        tables.append(np.concatenate([full, pair, one]).astype(np.float32).ravel())
    unseen = model.symbols == size - 1
    return Costs(rows, tables, np.where(unseen, np.log2(max(unseen.sum(), 1)), 0.0).astype(np.float32))


def _longer(count: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Bits of each symbol after each context with these counts, given those after the next shorter contexts."""
    n, d = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, shorter, np.where(count > 0, np.log2((n + d) / count), np.log2((n + d) / d) + shorter))


def _tellable(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes that are no digit and have none in their context: numbers and keys are in no language."""
    digit = (raw >= 48) & (raw <= 57)
    near, place = digit.copy(), np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, _DEPTH + 1):
        near[k:] |= digit[:-k] & (place[k:] >= k)
    return ~near


def _judged(model: LanguageModel, known: Costs, batch: pa.RecordBatch, rates: bool = False) -> Iterator[pa.RecordBatch]:
    """rates: with the bits per byte of the best language, digits and what follows them aside."""
    names, tables = np.array([*model.languages, UNKNOWN], object), known.tables
    column = batch.column("text")
    raw, offsets = tk.text_bytes(column)
    for first, last in tk.slices(offsets, 1 << 20):
        part, own = raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        n = last - first
        letters = np.add.reduceat(np.append(~tk.WHITE[part] & ((part | 32) >= 97) & ((part | 32) <= 122), False), np.minimum(own[:-1], len(part))) * (np.diff(own) > 0)
        for i in np.flatnonzero((letters == 0) & (np.diff(own) > 0)).tolist():
            letters[i] = any(map(str.isalpha, column[first + i].as_py()))
        if not tables:
            best, score, rate = np.zeros(n, int), np.zeros(n), np.zeros(n)
        else:
            before, symbol = _codes(part, own, model.symbols, model.size)
            code = known.rows[before] * model.size + symbol
            bits, rate = np.zeros((len(tables), n)), np.zeros((len(tables), n))
            some = np.diff(own) > 0
            if some.any():
                told, aside = _tellable(part, own) if rates else None, known.aside[tk.LOWER[part]]
                for k, table in enumerate(tables):
                    each = table[code] + aside
                    bits[k, some] = np.add.reduceat(each, own[:-1][some], dtype=np.float64)
                    if rates:
                        rate[k, some] = np.add.reduceat(each * told, own[:-1][some], dtype=np.float64)
                        rate[k, some] /= np.add.reduceat(told, own[:-1][some], dtype=np.int64) + _START
            best = bits.argmin(0)
            gap = (bits - bits.min(0)) * np.minimum(1, 64 / np.maximum(np.diff(own), 1))
            score = 1 / np.exp2(-gap).sum(0)
            rate = rate[best, np.arange(n)]
        best = np.where(letters > 0, best, len(model.languages))
        score = np.where(letters > 0, score, 0.0)
        found = {"doc_id": batch.column("doc_id").slice(first, n), "lang_pred": pa.array(names[best].tolist(), pa.string()), "score": pa.array(score)}
        yield pa.RecordBatch.from_pydict(found | ({"rate": pa.array(rate)} if rates else {}))


def predict(spark: SparkSession, docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs (doc_id, text).

    lang_pred is a learnt language, or `und` with score 0 where a text is null, empty or has no letter,
    or where nothing was learnt. score: the best language's share of 2^-bits over all languages, with
    the bits of a text of over 64 bytes scaled to 64. Of languages with the same code length the first in
    alphabetical order is taken. Texts of any length are read whole; rows that repeat, or have no doc_id, are predicted
    each; further columns, whatever their names, are left behind.
    """
    given = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = costs(given.value)  # of one task, so that an idle worker holds none
        for batch in batches:
            yield from _judged(given.value, known, batch)

    small_batches(spark)
    return columns_or_null(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double")


def bounds(spark: SparkSession, labelled: DataFrame, model: LanguageModel, share: float = 0.999, times: float = 1.75) -> dict[str, float]:
    """Of each language: `times` the bits per byte that `share` of all labelled texts (doc_id, text, lang) predicted to be in it keep to."""
    given = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = costs(given.value)  # of one task, so that an idle worker holds none
        for batch in batches:
            for part in _judged(given.value, known, batch, rates=True):
                step = pa.array(np.ceil(np.asarray(part.column("rate")) * _STEPS).astype(np.int64))
                n = pa.table({"lang": part.column("lang_pred"), "step": step}).group_by(["lang", "step"]).aggregate([([], "count_all")])
                yield from n.select(["lang", "step", "count_all"]).rename_columns(["lang", "step", "n"]).combine_chunks().to_batches()

    small_batches(spark)
    texts = columns_or_null(labelled, doc_id="long", text="string", lang="string").where("text is not null and lang is not null").select("doc_id", "text")
    rows = texts.mapInArrow(run, "lang string, step long, n long").groupBy("lang", "step").agg(F.sum("n").alias("n")).orderBy("lang", "step").collect()
    out = {}
    for lang in model.languages:
        own = [r for r in rows if r["lang"] == lang]
        if own:
            upto = np.cumsum([r["n"] for r in own])
            out[lang] = times * own[int(np.searchsorted(upto, share * upto[-1]))]["step"] / _STEPS
    return out


def keep_known(spark: SparkSession, docs: DataFrame, model: LanguageModel, most: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a predicted language and at most the bits per byte of `most` (see `bounds`) in it."""
    given = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = costs(given.value)  # of one task, so that an idle worker holds none
        for batch in batches:
            only = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], ["doc_id", "text"])
            found = [x for part in _judged(given.value, known, only, rates=most is not None) for x in zip(part.column("lang_pred").to_pylist(), part.column("rate").to_pylist() if most is not None else [0] * len(part))]
            yield batch.filter(pa.array([x != UNKNOWN and (most is None or rate <= most.get(x, max(most.values(), default=0.0))) for x, rate in found], pa.bool_()))

    small_batches(spark)
    return docs.mapInArrow(run, docs.schema)
