"""Near-duplicate vectors through an inverted multi-index.

Unit vectors are cut in halves, and each half has a codebook of its own; the pairs of codewords make a
grid of cells, and every vector lies in the cell of its nearest codewords. A vector looks for links in
the cells nearest to it, in the order of the summed squared distances of its halves to the codewords
(multi-sequence order), as far as a margin over its nearest cell. The margin is set on a sample so that
a vector at the threshold from another is reached with the target probability. Candidates are verified
by their cosine in double precision. Equal vectors are one class, met once and counted with weight.

Blocks give counts and a spanning forest of the links found, never the list of pairs, so that a large
group of near copies costs no more output than rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import vectors
from threadloom.llm.components import components
from threadloom.llm.workdir import Scratch, columns_or_null


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors; those that link with nothing have a null vector."""
    for batch in batches:
        dims, blobs = [], []
        for v in vectors.rows_of(batch.column("embedding")):
            norm = 0.0
            if v is not None:
                top = np.abs(v).max()
                v = v / top if top > 0 else v
                norm = np.sqrt(v @ v)
            dims.append(len(v) if norm > 0 else 0)
            blobs.append((v / norm).tobytes() if norm > 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], ["vec_id", "dim", "vector"])


@dataclass
class Codebooks:
    halves: tuple[np.ndarray, np.ndarray]
    margin: float

    def gaps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each half, by how much each codeword's squared distance exceeds the nearest one's."""
        cut, out = self.halves[0].shape[1], []
        for part, book in ((x[:, :cut], self.halves[0]), (x[:, cut:], self.halves[1])):
            far = (book * book).sum(1)[None, :] - 2 * part @ book.T
            out.append(far - far.min(1, keepdims=True))
        return out[0], out[1]

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.gaps(x)
        return a.argmin(1) * len(self.halves[1]) + b.argmin(1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that each row visits, each row's in multi-sequence order."""
        a, b = self.gaps(x)
        row, i = np.nonzero(a <= self.margin)
        near = b[row] + a[row, i][:, None]
        at, j = np.nonzero(near <= self.margin)
        row, cell, far = row[at], i[at] * len(self.halves[1]) + j, near[at, j]
        order = np.lexsort((far, row))
        return row[order], cell[order]

    def reaches(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Whether x[i] visits cell[i]."""
        a, b = self.gaps(x)
        i, j = np.divmod(cell, len(self.halves[1]))
        r = np.arange(len(x))
        return a[r, i] + b[r, j] <= self.margin


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    book = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = ((book * book).sum(1)[None, :] - 2 * x @ book.T).argmin(1)
        count = np.bincount(own, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, own, x)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


def fit(sample: np.ndarray, codewords: int, cosine: float, recall: float, seed: int = 7) -> Codebooks:
    """Codebooks of both halves, and the margin at which a vector `cosine` away is reached with probability `recall`."""
    rng = np.random.default_rng(seed)
    cut = sample.shape[1] // 2
    books = Codebooks((_codebook(sample[:, :cut], codewords, rng), _codebook(sample[:, cut:], codewords, rng)), np.inf)
    x = sample[rng.choice(len(sample), min(len(sample), 4000), replace=False)]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.maximum(np.sqrt((noise * noise).sum(1, keepdims=True)), 1e-12)
    a, b = books.gaps(x)
    i, j = np.divmod(books.home(cosine * x + np.sqrt(1 - cosine * cosine) * noise), len(books.halves[1]))
    r = np.arange(len(x))
    books.margin = float(np.quantile(a[r, i] + b[r, j], recall, method="higher"))
    return books


def _visited(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, cell = books.value.visits(vectors.stack(batch.column("vector").to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row)) for c in ("rep", "weight", "vector")] + [pa.array(cell.astype(np.int64))], ["rep", "weight", "vector", "cell"])

    return run


def _homes(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = books.value.home(vectors.stack(batch.column("vector").to_pylist()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "weight", "vector")), pa.array(cell.astype(np.int64))], ["rep", "weight", "vector", "cell"])

    return run


def _verified(books, cosine: float):
    def run(table: pa.Table) -> pa.Table:
        asks = np.asarray(table.column("is_ask"))
        rep, weight, blobs = table.column("rep").to_numpy(), table.column("weight").to_numpy(), table.column("vector").to_pylist()
        i, j = np.flatnonzero(asks), np.flatnonzero(~asks)
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        if not len(i) or not len(j):
            return empty
        q, x = vectors.stack([blobs[k] for k in i]), vectors.stack([blobs[k] for k in j])
        hit = q @ x.T >= cosine
        hit &= rep[i][:, None] != rep[j][None, :]
        a, b = np.nonzero(hit)
        if not len(a):
            return empty
        # the pair is met again in the asker's cell if the other one visits it; else both count it here
        back = np.zeros(len(a), bool)
        home = books.value.home(q)
        for lo in range(0, len(a), 65536):
            back[lo : lo + 65536] = books.value.reaches(x[b[lo : lo + 65536]], home[a[lo : lo + 65536]])
        ids = np.concatenate([rep[i][a], rep[j][b[~back]]])
        node, at = np.unique(ids, return_inverse=True)
        links = np.bincount(at, weights=np.concatenate([weight[j][b], weight[i][a[~back]]])).astype(np.int64)
        label_q, label_x = rep[i].copy(), rep[j].copy()
        while True:  # the smallest id that links lead to within the block
            before = label_q.sum(), label_x.sum()
            np.minimum.at(label_q, a, label_x[b])
            np.minimum.at(label_x, b, label_q[a])
            if before == (label_q.sum(), label_x.sum()):
                break
        tree = np.unique(np.concatenate([np.stack([rep[i][np.unique(a)], label_q[np.unique(a)]], 1), np.stack([rep[j][np.unique(b)], label_x[np.unique(b)]], 1)]), axis=0)
        ends = pa.array(np.concatenate([links, tree[:, 1]]))
        counted = pa.array(np.arange(len(ends)) < len(node))
        none = pa.nulls(len(ends), pa.int64())
        return pa.table({"a": np.concatenate([node, tree[:, 0]]), "b": pc.if_else(counted, none, ends), "links": pc.if_else(counted, ends, none)})

    return run


def near_duplicates(spark: SparkSession, table: DataFrame, cosine: float = 0.95, recall: float = 0.995, most_sample: int = 20_000, per_cell: int = 50) -> DataFrame:
    """Direct links and components of vectors with a cosine of `cosine` or more.

    table: vec_id, embedding. Returns vec_id, n_links (other rows linked directly), component_id (the
    smallest vec_id reachable by links, its own included), kept (vec_id = component_id), a row for each
    row. Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing
    (their own vec_id is their component), nor do vectors of different lengths. A row with a null vec_id
    takes part in nothing: 0 links, a null component, not kept. Rows that repeat a vec_id count as rows. Further columns are left
    behind. Every link that is returned holds; a link is found with a probability of at least about `recall`.
    Codebooks are fitted on at most `most_sample` vectors, by hash of vec_id, with about `per_cell` vectors to a cell.
    """
    scratch = Scratch(spark, "multi_index")
    rows = columns_or_null(table, vec_id="long", embedding="array<double>").mapInArrow(_units, vectors.VECTOR)
    rows = scratch.table(rows.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.sha2("vector", 256))))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    classes = scratch.table(classes)
    trees = counts = None
    for dim, n in [(r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()]:
        own = classes.where(F.col("dim") == dim)
        sample = own.orderBy(F.xxhash64("rep")).limit(most_sample).select("vector").collect()
        codewords = max(1, min(1024, int(np.sqrt(n / per_cell))))
        books = spark.sparkContext.broadcast(fit(vectors.stack([bytes(r[0]) for r in sample]), codewords, cosine, recall))
        kind = "rep long, weight long, vector binary, cell long"
        items, asks = (own.select("rep", "weight", "vector").mapInArrow(f(books), kind) for f in (_homes, _visited))
        dealt = vectors.blocks(items, asks, ["cell"], "rep", "rep", 2048, 4096)
        met = scratch.table(dealt.groupBy("cell", "item_part", "ask_part").applyInArrow(_verified(books, cosine), "a long, b long, links long"))
        count = met.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
        tree = met.where("b is not null").select("a", "b")
        counts, trees = (count, tree) if counts is None else (counts.union(count), trees.union(tree))
    if counts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    named = components(scratch, trees).withColumnRenamed("id", "rep")
    known = classes.select("key", "rep", "weight").join(counts.withColumnRenamed("a", "rep"), "rep", "left").join(named, "rep", "left")
    known = known.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.join(known, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
