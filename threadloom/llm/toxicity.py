"""Toxic documents and their offending sentences, by multiple-instance learning.

A document is a bag of sentences. With p = sigmoid(b + sum of the weights of a sentence's features) and
p0 = sigmoid(b), what a sentence without any feature has, a sentence is toxic with probability
q = (p - p0) / (1 - p0); a document is toxic unless none of its sentences is, nor the leak, which any
document has once (noisy-or). Weights are 0 or more, so q is too, and sentences without features add
nothing however many they are. Weights, b and leak are fitted by this rule to document labels alone, on a
bounded sample, and texts are scored by it (one without a sentence: 0); q then tells where the toxicity is.
Features are words and their first 4, 5 and 6 bytes, so that inflected or derived forms count too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import textkernel as tk
from threadloom.llm.workdir import Scratch, columns_or_null, small_batches

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = _NOT_LETTER[128:] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
_PREFIXES = (4, 5, 6)
_SLICE = 1 << 20  # bytes of text in work at a time


def _features(raw: np.ndarray, offsets: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Features and their sentences: hashes (or places in `known`), sentence numbers, and for each
    sentence its row and its first and last byte. A sentence without a word isn't one."""
    raw = tk.LOWER[raw]
    starts, ends, rows = tk.word_spans(raw, offsets, _NOT_LETTER)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    mark = np.searchsorted(np.flatnonzero(_STOP[raw]), starts) + row
    new = np.concatenate([[True], mark[1:] != mark[:-1]]) if len(mark) else np.zeros(0, bool)
    sentence = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(starts)) - 1 if len(heads) else heads
    found, of = [], []
    for k in (None, *_PREFIXES):
        some = slice(None) if k is None else np.flatnonzero(ends - starts >= k)
        h = tk.span_hashes(raw, starts[some], ends[some] if k is None else starts[some] + k)
        if k is not None:
            h = tk.mix(h + np.uint64(k))
        if known is None:
            found.append(h)
            of.append(sentence[some])
        elif len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = np.flatnonzero(known[at] == h)
            found.append(at[hit])
            of.append(sentence[some][hit])
    empty = np.zeros(0, np.int64)
    return np.concatenate(found) if found else empty, np.concatenate(of) if of else empty, row[heads], starts[heads], ends[tails]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents have each feature."""
    for batch in batches:
        raw, offsets = tk.text_bytes(batch.column("text"))
        toxic = np.asarray(batch.column("toxic")).astype(np.int64)
        for first, last in tk.slices(offsets, _SLICE):
            f, s, row, _, _ = _features(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], None)
            unique, at = np.unique(f, return_inverse=True)
            n = last - first
            pair = np.unique(at * n + row[s])
            feature, doc = np.divmod(pair, n)
            bad = np.bincount(feature, weights=toxic[first:last][doc], minlength=len(unique)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(bad), pa.array(np.bincount(feature, minlength=len(unique)) - bad)], ["feature", "bad", "good"])


def _bags(known):
    """For each document that has a sentence its label, and the features of its sentences that have some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(known.value, np.uint64)
        for batch in batches:
            raw, offsets = tk.text_bytes(batch.column("text"))
            for first, last in tk.slices(offsets, _SLICE):
                f, s, row, _, _ = _features(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], own)
                pair = np.unique(s * max(len(own), 1) + f)
                s, f = np.divmod(pair, max(len(own), 1))
                cuts = np.searchsorted(row[s], np.arange(last - first + 1))
                told = np.flatnonzero(np.bincount(row, minlength=last - first))
                blobs = [(s[cuts[k] : cuts[k + 1]].astype("<i4").tobytes(), f[cuts[k] : cuts[k + 1]].astype("<u2").tobytes()) for k in told.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(first, last - first).take(pa.array(told)), pa.array([x for x, _ in blobs], pa.binary()), pa.array([y for _, y in blobs], pa.binary())], ["toxic", "places", "features"])

    return run


@dataclass
class ToxicityModel:
    known: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float
    leak: float = 0.0  # -log of the probability that a document without toxic sentences is clean


@dataclass
class _Part:
    """Some documents as flat arrays: each pair of a sentence and a feature, the document of each sentence that has a feature."""

    toxic: np.ndarray
    owner: np.ndarray  # of each sentence: its document
    sentence: np.ndarray  # of each pair
    feature: np.ndarray


def _part(bags: list) -> _Part:
    places, features = (np.frombuffer(b"".join(bytes(r[c]) for r in bags), kind) for c, kind in (("places", "<i4"), ("features", "<u2")))
    doc = np.repeat(np.arange(len(bags), dtype=np.int32), [len(r["places"]) // 4 for r in bags])
    new = np.ones(len(doc), bool)  # pairs come by document and sentence
    new[1:] = (doc[1:] != doc[:-1]) | (places[1:] != places[:-1])
    return _Part(np.array([r["toxic"] for r in bags], np.int8), doc[new], np.cumsum(new, dtype=np.int32) - 1, features)


def _evidence(z: np.ndarray, b: float) -> np.ndarray:
    """-log(1 - q) of sentences from their log-odds."""
    return np.logaddexp(0, z) - np.logaddexp(0, b)


def _gradient(part: _Part, x: np.ndarray, share: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """Of the noisy-or likelihood in x, the weights, b and log(leak): with S = leak - sum of log(1 - q) over sentences, P(toxic) = 1 - exp(-S). share: what a clean and a toxic document count."""
    n, w, b, leak = len(part.toxic), x[:-2], x[-2], np.exp(x[-1])
    z = b + np.bincount(part.sentence, weights=w[part.feature], minlength=len(part.owner))
    s = np.clip(leak + np.bincount(part.owner, weights=_evidence(z, b), minlength=n), 1e-9, 500)
    up = np.where(part.toxic > 0, -share[1] / np.expm1(s), share[0])
    p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
    dz = up[part.owner] * p
    return np.concatenate([np.bincount(part.feature, weights=dz[part.sentence], minlength=len(w)), [(up[part.owner] * (p - p0)).sum(), up.sum() * leak]])


def _fit(bags: list, size: int, steps: int, rate: float, decay: float, per_part: int = 500, share: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, float, float]:
    """Adam over all documents at each step, weights held at 0 or more; `per_part` documents at a time, so that little is held beside the pairs."""
    n, parts = len(bags), []
    while bags:
        parts.append(_part(bags[-per_part:]))
        del bags[-per_part:]
    x = np.concatenate([np.zeros(size), [-4.0, -5.0]])
    m, v = np.zeros(size + 2), np.zeros(size + 2)
    for step in range(1, steps + 1):
        grad = sum(_gradient(part, x, share) for part in parts) / n
        grad[:-2] += decay * x[:-2]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        x[:-2] = np.maximum(x[:-2], 0)
    return x[:-2], float(x[-2]), float(np.exp(x[-1]))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame | None = None, most: int = 24_000, most_features: int = 4096, steps: int = 400) -> ToxicityModel:
    """Fits to docs (doc_id long, text) with labels (doc_id long, toxic 0/1); at most `most` labels, a third of them toxic, by hash of doc_id.

    Rows with a null label or text, or without a letter, teach nothing; a doc_id labelled both ways counts as toxic. Without a
    toxic or without a clean row the model gives every text a score near 0. Without labels, docs has toxic.
    Sampled rows of a class count for all of its labels, so that scores mean the same at every size.
    """
    small_batches(spark)
    labels = docs if labels is None else labels
    docs = columns_or_null(docs, doc_id="long", text="string").where("doc_id is not null and text is not null")
    labels = columns_or_null(labels, doc_id="long", toxic="int").where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    scratch = Scratch(spark, "toxicity")
    labels = scratch.table(labels.join(docs.select("doc_id"), "doc_id", "left_semi"))
    total = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    bounds = {1: most // 3, 0: most - most // 3}
    some = [labels.where(F.col("toxic") == k).orderBy(*first).limit(n) for k, n in bounds.items()]
    chosen = some[0].union(some[1])
    # at most `most` labels are broadcast, so no text is shuffled; the texts found are read twice
    sample = scratch.table(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"))
    counts = sample.groupBy("toxic").count().collect()
    bad, good = (sum(r["count"] for r in counts if r["toxic"] == k) for k in (1, 0))
    if not bad or not good:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -20.0)
    stands_for = [total[k] / min(total[k], bounds[k]) for k in (0, 1)]
    mean = (good * stands_for[0] + bad * stands_for[1]) / (good + bad)
    share = (stands_for[0] / mean, stands_for[1] / mean)
    seen = sample.mapInArrow(_document_counts, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) - F.log(F.lit((bad + 1) / (good + 1)))
    z = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = seen.where("bad >= 3").withColumn("z", z).where("z > 2").orderBy(F.desc("z"), "feature").limit(most_features).select("feature").collect()
    known = np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64))
    given = spark.sparkContext.broadcast(known.tobytes())
    bags = sample.mapInArrow(_bags(given), "toxic int, places binary, features binary").collect()
    weights, bias, leak = _fit(bags, len(known), steps, 0.1, 2e-4, share=share) if len(known) else (np.zeros(0), -8.0, 0.0)
    return ToxicityModel(known, weights, bias, leak)


def _scores(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ToxicityModel = model.value
        for batch in batches:
            raw, offsets = tk.text_bytes(batch.column("text"))
            for first, last in tk.slices(offsets, _SLICE):
                part, n = raw[offsets[first] : offsets[last]], last - first
                f, s, row, starts, ends = _features(part, offsets[first : last + 1] - offsets[first], own.known)
                s, f = np.divmod(np.unique(s * max(len(own.known), 1) + f), max(len(own.known), 1))
                z = own.bias + np.bincount(s, weights=own.weights[f], minlength=len(row))
                evidence = _evidence(z, own.bias)
                found = np.flatnonzero(evidence > np.log(2))
                base = offsets[first:last] - offsets[first]
                spans: list[list] = [[] for _ in range(n)]
                for k in found.tolist():
                    r = row[k]
                    spans[r].append({"start": int(starts[k] - base[r]), "end": int(ends[k] - base[r]), "score": float(-np.expm1(-evidence[k]))})
                told = np.bincount(row, minlength=n) > 0
                score = np.where(told, -np.expm1(-own.leak - np.bincount(row, weights=evidence, minlength=n)), 0.0)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                ids = [batch.column(c).slice(first, n) for c in batch.schema.names if c != "text"]
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, kind)], [*names, "score", "predicted", "sentences"])

    return run


def score(spark: SparkSession, docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """Adds score, predicted and sentences to the rows of docs (doc_id long, text string, nothing else).

    A row for each row. Null and empty texts, and texts without letters, have no sentences and a score
    of 0. sentences: those that are toxic with a probability over 1/2, as byte ranges of the UTF-8 text.
    Texts of any length are read whole; sentences without known features add nothing to the score.
    """
    small_batches(spark)
    given = spark.sparkContext.broadcast(model)
    docs = columns_or_null(docs, doc_id="long", text="string")
    return docs.mapInArrow(_scores(given, threshold), "doc_id long, score double, predicted int, sentences array<struct<start:int,end:int,score:double>>")


def keep_clean(spark: SparkSession, docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose text isn't predicted toxic."""
    small_batches(spark)
    given = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            only = pa.RecordBatch.from_arrays([batch.column("text")], ["text"])
            clean = [p for part in _scores(given, threshold)(iter([only])) for p in part.column("predicted").to_pylist()]
            yield batch.filter(pa.array([p == 0 for p in clean], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
