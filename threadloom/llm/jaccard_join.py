"""Exact Jaccard join of documents on word shingles, in the metric space of Jaccard distance.

Nearly all documents lie at or near distance 1 from any pivot sampled from the whole corpus, so windows around the cells of such
pivots would copy every document to every cell. The space is therefore first cut by what near documents have in common: a linked pair shares at least one of
the rarest 20 % of either set's shingles, so the documents of each such shingle are a region, and a
document stands in every region in whose reach it is. Then, with r = 1 - similarity:

1. The least document of each region is its first pivot; regions with the same pivot are one from here on.
   All exact distances to it are computed, and documents within r of it are linked. A region
   whose documents lie in one component is closed.
2. In an open region of more than a few documents, pivots of several components are chosen and all distances
   to them computed. Each document goes to the Voronoi cell of its nearest pivot p, and, by the triangle
   inequality, a copy of it to each cell q with d(x, q) <= d(x, p) + 2 r: whatever it links with
   in that cell can't be farther. Cells in one component are closed, the others are regions of the next turn.
3. A small region is joined whole in its group. So is, in blocks that meet two by two, one that its
   pivots don't tell apart (say, pages of one template, all equally far from each other): if the pivots
   themselves would each be copied to several cells, nothing is copied.

All groups give only a forest of links between components not yet joined; texts with the same set are
one class. Pairs of a group are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import textkernel as tk
from threadloom.llm.components import components
from threadloom.llm.workdir import Scratch, buckets_for, columns_or_null, small_batches

#: A shingle is common from this share of all documents on; so at most 256 times the mean set size are.
COMMON_SHARE = 256
COMMON_LEAST = 2000
#: A region of so many documents, and so many shared shingles in all, at most is joined whole, in one group.
WHOLE, WHOLE_HASHES = 128, 2_000_000
_LOW = 6  # bytes of a shingle hash that are sent beside its bucket


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges of a batch: first, last, the shingle hashes of their sets, the sets' offsets and digests."""
    raw, offsets = tk.text_bytes(batch.column("text"))
    for first, last in tk.slices(offsets, 6 << 20):  # mostly a whole batch
        h, rows = tk.shingles(*tk.words(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]), size)
        sums = np.concatenate([[0], np.cumsum(h, dtype=np.uint64)]).astype(np.uint64)
        yield first, last, h, rows, (sums[rows[1:]] - sums[rows[:-1]]).view(np.int64)


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "mark", "n", "key", "common"]
        for batch in batches:
            given = [batch.column(c) for c in ("doc_id", "mark")]
            for first, last, h, rows, keys in _sets(batch, size):
                yield pa.RecordBatch.from_arrays([*(x.slice(first, last - first) for x in given), pa.array(np.diff(rows)), pa.array(keys), pa.array(np.zeros(len(keys), bool))], names)
                one = np.unique(keys, return_index=True)[1]
                h, c = np.unique(tk.gather(h, rows[one], np.diff(rows)[one]), return_counts=True)
                h, c = h[c >= 4], c[c >= 4]
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(h), pa.int64())] * 2, pa.array(c), pa.array(h.view(np.int64)), pa.array(np.ones(len(h), bool))], names)

    return run


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _scatter(size: int, buckets: int, common):
    """Sets of a batch cut by hash range: for each bucket the documents' keys and sizes, how many hashes each has there, and these."""
    names = ["bucket", "keys", "sizes", "counts", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(common.value, np.uint64)
        for batch in batches:
            for _, _, h, starts, keys in _sets(batch, size):
                n = np.diff(starts)
                one = np.unique(keys, return_index=True)[1]
                one = one[n[one] > 0]
                if not len(one):
                    continue
                h, doc = tk.gather(h, starts[one], n[one]), np.repeat(np.arange(len(one)), n[one])
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hot = known[at] == h if len(known) else np.zeros(len(h), bool)
                b = np.where(hot, buckets, _bucket(h, buckets))
                order = np.argsort(b, kind="stable")
                h, doc, b = h[order], doc[order], b[order]
                # only buckets that have something: the number of all grows with the corpus
                begins = np.flatnonzero(np.diff(b, prepend=-1)).tolist()
                rows = []
                for k, lo, hi in zip(b[begins].tolist(), begins, [*begins[1:], len(b)]):
                    which, count = np.unique(doc[lo:hi], return_counts=True)
                    of = one[which]
                    if k < buckets:
                        rows.append((k, keys[of].tobytes(), tk.squeeze(n[of]), tk.squeeze(count), tk.pack(h[lo:hi], _LOW)))
                    else:  # the common ones need no counting: a row for each document, hashes as they are
                        ends = np.cumsum(count)
                        rows += [(-1, keys[o : o + 1].tobytes(), tk.squeeze(n[o : o + 1]), b"", h[lo + e - c : lo + e].tobytes()) for o, c, e in zip(of, count, ends)]
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows))), schema=pa.schema([("bucket", pa.int64()), *((x, pa.binary()) for x in names[1:])]))

    return run


_KEPT = pa.schema([("gather", pa.int64()), *((c, pa.binary()) for c in ("keys", "sizes", "counts", "hashes", "df"))])
KEPT = "gather long, keys binary, sizes binary, counts binary, hashes binary, df binary"


def _shared(gathers: int):
    """Of one bucket: for each set, the hashes that another set has too, and in how many sets they are; by hash of the sets' keys."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64)
        sizes, counts = (np.concatenate([tk.unsqueeze(x) for x in table.column(c).to_pylist()]) for c in ("sizes", "counts"))
        h = tk.unpack(b"".join(table.column("hashes").to_pylist()), _LOW)
        one = np.sort(np.unique(keys, return_index=True)[1])  # the same set from several batches counts once
        if len(one) < len(keys):
            mine = np.zeros(len(keys), bool)
            mine[one] = True
            h, keys, sizes, counts = h[np.repeat(mine, counts)], keys[one], sizes[one], counts[one]
        _, place, run_ = np.unique(h, return_inverse=True, return_counts=True)
        df = run_[place]
        del place, run_
        keep = df > 1
        per = np.bincount(np.repeat(np.arange(len(keys), dtype=np.int32), counts)[keep], minlength=len(keys))
        h, df = h[keep] | (np.uint64(bucket & 0xFFFF) << np.uint64(48)), np.minimum(df[keep], 0xFFFFFFFE)
        to = _bucket(tk.mix(keys.view(np.uint64)), gathers)
        each = np.repeat(to, per)
        order, of = np.argsort(each, kind="stable"), np.argsort(to, kind="stable")
        of = of[per[of] > 0]
        cuts, ends = np.searchsorted(to[of], np.arange(gathers + 1)), np.searchsorted(each[order], np.arange(gathers + 1))
        rows = []
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            docs, part = of[cuts[k] : cuts[k + 1]], order[ends[k] : ends[k + 1]]
            rows.append((k, keys[docs].tobytes(), tk.squeeze(sizes[docs]), tk.squeeze(per[docs]), h[part].tobytes(), tk.squeeze(df[part])))
        return pa.Table.from_pydict(dict(zip(_KEPT.names, zip(*rows))) if rows else {c: [] for c in _KEPT.names}, schema=_KEPT)

    return run


def _common_rows(gathers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, hashes = (batch.column(c).to_pylist() for c in ("keys", "sizes", "hashes"))
            to = _bucket(tk.mix(np.frombuffer(b"".join(keys), np.uint64)), gathers)
            counts = [len(x) // 8 for x in hashes]
            rows = {"gather": to, "keys": keys, "sizes": sizes, "counts": [tk.squeeze(np.array([n])) for n in counts], "hashes": hashes, "df": [tk.squeeze(np.full(n, 0xFFFFFFFF)) for n in counts]}
            yield pa.RecordBatch.from_pydict(rows, schema=_KEPT)

    return run


_SET = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("rare", pa.list_(pa.int64()))])


def _sets_of(percent: int):
    """Sets that can link at all, put together again: their shared hashes, sorted, and those of their rarest part."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64)
        sizes, counts, df = (np.concatenate([tk.unsqueeze(x) for x in table.column(c).to_pylist()]) for c in ("sizes", "counts", "df"))
        h = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
        unique, first, at = np.unique(keys, return_index=True, return_inverse=True)
        of = np.repeat(at, counts)
        order = np.lexsort((h, df, of))
        ends = np.cumsum(np.bincount(of, minlength=len(unique)))
        out = []
        for i, (n, a, b) in enumerate(zip(sizes[first].tolist(), [0, *ends[:-1].tolist()], ends.tolist())):
            if (b - a) * 100 >= n * percent:
                own = h[order[a:b]]
                reach = n - -(-percent * n // 100) + 1 - (n - len(own))
                out.append((int(unique[i]), n, np.sort(own).tobytes(), own[: max(reach, 0)].view(np.int64).tolist()))
        return pa.Table.from_pydict(dict(zip(_SET.names, zip(*out))) if out else {c: [] for c in _SET.names}, schema=_SET)

    return run


def _linked(percent: int):
    """Of pairs with both sets: those within the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.array([len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist())], np.int64)
            close = both * (100 + percent) >= percent * (np.asarray(batch.column("na")) + np.asarray(batch.column("nb")))
            yield batch.select(["a", "b"]).filter(pa.array(close))

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many hashes each set of a shares with each set of b; sets are sorted and distinct."""
    out = np.zeros((len(a), len(b)), np.float32)
    ha, hb = (np.concatenate(x) for x in (a, b))
    known = np.intersect1d(np.unique(ha), np.unique(hb), assume_unique=True)
    if not len(known):
        return out
    sides = []
    for sets, h in ((a, ha), (b, hb)):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = np.flatnonzero(known[at] == h)
        order = hit[np.argsort(at[hit], kind="stable")]
        sides.append((np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order], at[order]))
    for low in range(0, len(known), width):
        parts = []
        for sets, (row, at) in zip((a, b), sides):
            first, last = np.searchsorted(at, [low, low + width])
            part = np.zeros((len(sets), min(width, len(known) - low)), np.float32)
            part[row[first:last], at[first:last] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T  # counts below 2^24 are exact
    return out


class _Forest:
    """Which labels have been joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _close(both: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return both.astype(np.int64) * (100 + percent) >= percent * (na[:, None] + nb[None, :])


#: A link has only `base` and `other`: labels to be joined. Else a place: a row of a region in a cell.
_PLACED = pa.schema([(c, pa.int64()) for c in ("region", "m", "weight", "cell", "id", "w", "base", "label", "other")] + [("own", pa.bool_())])
PLACED = "region long, m long, weight long, cell long, id long, w long, base long, label long, other long, own boolean"


def _cells(percent: int, most_copies: float = 2.0):
    """Groups of a region's members, each with all of its pivots: links to pivots, and the cells of each member.

    If the pivots themselves would be in over `most_copies` cells besides their own on average, cells don't
    tell the region apart, and all its members stay in one: the region's own. All groups of a region
    see the same pivots, and so decide alike.
    """
    twice = 2 * (1 - percent / 100) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tk.runs(batches, "region", "part"):
            ids, base, label, n, w = (table.column(c).to_numpy() for c in ("id", "base", "label", "n", "w"))
            is_pivot = np.asarray(table.column("is_pivot"))
            hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
            rows: list[tuple] = []
            for first, last in tk.groups_of(table, "region", "part"):
                at = np.arange(first, last)
                p, x = at[is_pivot[at]], at[~is_pivot[at]]
                region, m, weight = (table.column(c)[first].as_py() for c in ("region", "m", "weight"))
                forest = _Forest()
                if len(p):
                    far = overlaps([hashes[i] for i in p], [hashes[i] for i in p])
                    for i, j in zip(*np.nonzero(_close(far, n[p], n[p], percent))):
                        forest.join(int(label[p[i]]), int(label[p[j]]))
                    far = 1 - far / (n[p][:, None] + n[p][None, :] - far)
                    np.fill_diagonal(far, 2)
                    mixed = len(p) < 2 or (far <= far.min(1, keepdims=True) + twice).sum() > (1 + most_copies) * len(p)
                if len(p) and len(x):
                    far = overlaps([hashes[i] for i in x], [hashes[i] for i in p])
                    close = _close(far, n[x], n[p], percent)
                    far = 1 - far / (n[x][:, None] + n[p][None, :] - far)
                for i, k in enumerate(x.tolist()):
                    here, own = forest.root(int(label[k])), (region, m, weight)
                    if not len(p):
                        rows.append((*own, region, int(ids[k]), int(w[k]), int(base[k]), here, None, True))
                        continue
                    near = int(far[i].argmin())
                    told = set()
                    for j in np.flatnonzero(close[i]).tolist():
                        there = forest.root(int(label[p[j]]))
                        if there not in told and base[k] != base[p[j]]:
                            rows.append((*[None] * 6, int(base[k]), None, int(base[p[j]]), False))
                        told.add(there)
                        here = min(here, there)
                    cells = [near] if mixed else np.flatnonzero(far[i] <= far[i, near] + twice).tolist()
                    rows += [(*own, region if mixed else int(ids[p[j]]), int(ids[k]), int(w[k]), int(base[k]), here, None, j == near) for j in cells]
                if table.column("part")[first].as_py() == 0:  # what joins pivots, once for a region
                    far = overlaps([hashes[i] for i in p], [hashes[i] for i in p]) if len(p) else np.zeros((0, 0))
                    rows += [(*[None] * 6, int(base[p[i]]), None, int(base[p[j]]), False) for i, j in zip(*np.nonzero(_close(far, n[p], n[p], percent))) if base[p[i]] < base[p[j]]]
            yield pa.RecordBatch.from_pydict(dict(zip(_PLACED.names, zip(*rows))) if rows else {c: [] for c in _PLACED.names}, schema=_PLACED)

    return run


def _whole(percent: int):
    """Groups joined whole: a forest of the links between different labels. side: 0 meets 1, and 2 meets 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tk.runs(batches, "region", "i", "j"):
            base, label, n, side = (table.column(c).to_numpy() for c in ("base", "label", "n", "side"))
            hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
            out = []
            for first, last in tk.groups_of(table, "region", "i", "j"):
                at = np.arange(first, last)
                left, right = at[side[at] != 1], at[side[at] != 0]
                if not len(left) or not len(right):
                    continue
                close = _close(overlaps([hashes[k] for k in left], [hashes[k] for k in right]), n[left], n[right], percent)
                close &= label[left][:, None] != label[right][None, :]
                forest = _Forest()
                for i, j in zip(*np.nonzero(close)):
                    if forest.join(int(label[left[i]]), int(label[right[j]])):
                        out.append((int(base[left[i]]), int(base[right[j]])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["base", "other"])

    return run


def jaccard_components(spark: SparkSession, docs: DataFrame, percent: int = 80, size: int = 5, per_bucket: int = 3_000_000) -> DataFrame:
    """Components of the documents whose shingle sets have a Jaccard similarity of percent/100 or more.

    Returns (doc_id long, n_shingles long, component_id long), a row for each row of docs. Words are
    what lies between ASCII white space, with A-Z lowered; null and empty texts, and texts without
    words, have no shingles and link with nothing; a text of fewer than `size` words is one shingle.
    component_id is the smallest doc_id reachable by links, the row's own included. A row with a
    null doc_id takes part in nothing and has a null component; rows that repeat a doc_id are rows of
    their own, linked as their texts are. Texts of any length count whole. Further columns of docs,
    whatever their names, are left behind. Sets are held as 64-bit hashes, of which 48 bits and the bucket are compared.
    """
    return classified(spark, docs, percent, size, per_bucket).select("doc_id", "n_shingles", "component_id")


def classified(spark: SparkSession, docs: DataFrame, percent: int = 80, size: int = 5, per_bucket: int = 3_000_000) -> DataFrame:
    """As jaccard_components, with what tells rows apart that share a doc_id: `mark`, the xxhash64 of the text, and `component`, a number of the component alone."""
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    docs = columns_or_null(docs, doc_id="long", text="string")
    read = scratch.table(docs.withColumn("mark", F.xxhash64("text")).mapInArrow(_features(size), "doc_id long, mark long, n long, key long, common boolean"))
    rows = read.where("not common").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.when(F.expr("n > 0 and doc_id is not null"), F.col("key")).alias("key"))
    totals = rows.agg(F.count("*"), F.sum("n_shingles")).first()
    common = read.where("common").groupBy("key").agg(F.sum("n").alias("df")).where(F.col("df") >= max(COMMON_LEAST, totals[0] // COMMON_SHARE)).select("key").collect()
    common = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in common], np.int64).view(np.uint64)).tobytes())
    classes = scratch.table(rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("id")))
    buckets = buckets_for(totals[1] or 0, per_bucket)

    sent = docs.where("doc_id is not null").mapInArrow(_scatter(size, buckets, common), "bucket long, keys binary, sizes binary, counts binary, hashes binary")
    counted = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(_shared(buckets), KEPT)
    if common.value != b"":
        counted = counted.union(sent.where("bucket < 0").dropDuplicates(["keys"]).mapInArrow(_common_rows(buckets), KEPT))
    sets = scratch.table(counted.groupBy("gather").applyInArrow(_sets_of(percent), "id long, n long, hashes binary, rare array<long>"))
    members = sets.select(F.explode("rare").alias("region"), "id", (F.length("hashes") / 8).cast("long").alias("w"))
    named = components_of(scratch, members, sets.select("id", "n", "hashes"), percent)
    named = scratch.table(classes.join(named.withColumnRenamed("id", "key"), "key").select("key", "component", "id"))
    least = scratch.table(named.groupBy("component").agg(F.min("id").alias("component_id")))
    named = named.join(least, "component").select("key", "component", "component_id")
    classes = classes.join(named, "key", "left").select("key", F.coalesce("component", "key").alias("component"), F.coalesce("component_id", "id").alias("component_id"))
    classes = scratch.table(classes)
    alone = rows.where("key is null").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    out = ["doc_id", "n_shingles", "mark", "component", "component_id"]
    return rows.join(classes, "key").select(*out).union(alone.select(*out))


def one_of_each(spark: SparkSession, docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """One row of docs, with all its columns, of each component: that of the least doc_id, and of its texts that of the least hash.

    Rows without words, and rows without a doc_id, all stay. Of rows with the same doc_id and text one stays.
    """
    found = classified(spark, docs, percent, size).where("n_shingles > 0 and doc_id is not null")
    texts = found.groupBy("component", "doc_id", "mark").agg(F.count("*").alias("rows"))
    chosen = texts.groupBy("component").agg(F.min(F.struct("doc_id", "mark", "rows")).alias("r")).select("r.*")
    chosen = Scratch(spark, "one_of_each").table(chosen)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    worded = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = own.where(worded).join(chosen, ["doc_id", "mark"]).select("row", "doc_id", "mark", "rows")
    repeated = kept.where("rows > 1").dropDuplicates(["doc_id", "mark"])
    rest = own.where(~worded).select("row")
    return kept.where("rows = 1").select("row").union(repeated.select("row")).union(rest).select("row.*")


def components_of(scratch: Scratch, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the sets that link, from regions (region, id) that hold every linked pair together at least once.

    sets: id, n, hashes (of the shingles that other sets have too).
    """
    # first turn: one pivot for each region
    first = scratch.table(members.groupBy("region").agg(F.min("id").alias("pivot"), F.count("*").alias("m")).where("m > 1"))
    members = scratch.table(members.join(first, "region").where("id != pivot").select(F.col("pivot").alias("region"), "id", "w").distinct())
    left, right = (sets.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("hashes").alias(f"h{s}")) for s in "ab")
    pairs = members.select(F.col("id").alias("a"), F.col("region").alias("b"))
    links = scratch.table(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ha", "hb").mapInArrow(_linked(percent), "a long, b long"))
    labels = scratch.table(components(scratch, links).select("id", F.col("component").alias("label")))

    # all pairs with the pivot are known; what is left of a region is open if it lies in several components
    rest = scratch.table(members.join(labels, "id", "left").select("region", "id", "w", F.coalesce("label", "id").alias("label")))
    open_ = scratch.table(_open(rest, ["region"]))
    active = rest.join(open_, "region").select("region", "m", "weight", "id", "w", F.col("label").alias("base"), "label")
    is_small = (F.col("m") <= WHOLE) & (F.col("weight") <= WHOLE_HASHES)
    small, mixed, links = [active.where(is_small)], [], []
    large, turn = scratch.table(active.where(~is_small)), 1
    while not large.isEmpty():
        placed = scratch.table(_divided(large, sets, percent, turn))
        links.append(placed.where("cell is null").select("base", "other"))
        placed = placed.where("cell is not null")
        cells = _open(placed, ["region", "cell"], F.first("m").alias("of")).withColumnsRenamed({"m": "size", "weight": "size_w"})
        # a cell that holds nearly all of its region isn't cut again
        cells = scratch.table(cells.withColumn("lone", F.col("size") > 0.75 * F.col("of")))
        found = placed.join(cells, ["region", "cell"])
        mixed.append(found.where("lone").select(F.xxhash64("region", "cell", F.lit(turn)).alias("region"), F.col("size").alias("m"), F.col("size_w").alias("weight"), "id", "base", "label"))
        active = found.where("not lone").select(F.xxhash64("region", "cell", F.lit(turn)).alias("region"), F.col("size").alias("m"), F.col("size_w").alias("weight"), "id", "w", "base", "label")
        small.append(active.where(is_small))
        large, turn = scratch.table(active.where(~is_small)), turn + 1

    links.append(_joined(scratch, small, mixed, sets, percent))
    more = links[0]
    for x in links[1:]:
        more = more.union(x)
    merged = components(scratch, more.select(F.col("base").alias("a"), F.col("other").alias("b")))
    merged = scratch.table(merged.select(F.col("id").alias("label"), "component"))
    # a set that the first turn didn't link may be linked by a later one: its label is its own id
    alone = merged.join(labels, merged["label"] == labels["id"], "left_anti").select(F.col("label").alias("id"), "component")
    return labels.join(merged, "label", "left").select("id", F.coalesce("component", "label").alias("component")).union(alone)


def _open(members: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Regions whose members have several labels, with how many members and shared shingles they have."""
    each = [F.count("*").alias("m"), F.sum("w").alias("weight"), F.min("label").alias("low"), F.max("label").alias("high")]
    return members.groupBy(*keys).agg(*each, *more).where("m > 1 and low != high").drop("low", "high")


def _parts(rows: Column, hashes: Column, most: Column | int) -> Column:
    """Into how many parts rows go, so that each has about `most` and not too many hashes."""
    return F.greatest(F.ceil(rows / most), F.ceil(hashes / WHOLE_HASHES), F.lit(1)).cast("int")


def _divided(large: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """Members of large regions in the cells of about sqrt(m) pivots, each the least of a component chosen by hash; in groups of about WHOLE."""
    scratch = Scratch(large.sparkSession, "jaccard_pivots")
    heads = scratch.table(large.groupBy("region", "label").agg(F.min("id").alias("id"), F.first("m").alias("m")))
    n_labels = scratch.table(heads.groupBy("region").agg(F.count("*").alias("n_labels")))
    share = F.least(F.greatest(F.sqrt("m"), F.lit(8.0)), F.lit(64.0)) / F.col("n_labels")
    draw = F.shiftrightunsigned(F.xxhash64("id", "region", F.lit(turn)), 1)
    pivots = heads.join(n_labels, "region").where(draw < share * F.lit(float(1 << 63))).select("region", "id", F.lit(True).alias("chosen"))
    rows = large.join(pivots, ["region", "id"], "left").join(sets, "id")
    parts = _parts(F.col("m"), F.col("weight"), WHOLE)
    own = F.array(F.struct(F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(False).alias("is_pivot")))
    everywhere = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(k.alias("part"), F.lit(True).alias("is_pivot")))
    dealt = rows.withColumn("to", F.explode(F.when(F.col("chosen"), F.concat(own, everywhere)).otherwise(own)))
    dealt = dealt.select("region", "to.part", "to.is_pivot", "m", "weight", "id", "w", "base", "label", "n", "hashes")
    tasks = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "region", "part").sortWithinPartitions("region", "part").mapInArrow(_cells(percent), PLACED)


def _joined(scratch: Scratch, small: list[DataFrame], mixed: list[DataFrame], sets: DataFrame, percent: int) -> DataFrame:
    """Links of small regions, and of regions that pivots don't tell apart.

    These are dealt out in blocks of about m^0.7 that meet two by two. Documents of the region's most
    frequent label needn't meet each other: their blocks meet only those of the others.
    """
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].union(union(frames[1:]))
    group = F.lit(0)
    rows = union(small).select("region", group.alias("i"), group.alias("j"), F.lit(2).alias("side"), "id", "base", "label")
    if mixed:
        left = scratch.table(union(mixed))
        count = left.groupBy("region", "label").agg(F.count("*").alias("c"))
        main = scratch.table(count.groupBy("region").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("c")))
        left = left.join(main, "region")
        block, mean = F.ceil(F.pow("m", F.lit(0.7))), F.col("weight") / F.col("m")
        mains, rests = (_parts(c, c * mean, block) for c in (F.col("c"), F.col("m") - F.col("c")))
        own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        to = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
        one, many = own(mains), own(rests)
        of_main = F.transform(F.sequence(F.lit(0), rests - 1), lambda k: to(-1 - one, k, F.lit(0)))
        with_main = F.transform(F.sequence(F.lit(0), mains - 1), lambda k: to(-1 - k, many, F.lit(1)))
        with_rest = F.transform(F.sequence(F.lit(0), rests - 1), lambda k: to(F.least(many, k), F.greatest(many, k), F.when(k == many, 2).when(many < k, 0).otherwise(1)))
        dealt = left.withColumn("to", F.explode(F.when(F.col("label") == F.col("main"), of_main).otherwise(F.concat(with_main, with_rest))))
        rows = rows.union(dealt.select("region", "to.i", "to.j", "to.side", "id", "base", "label"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.join(sets, "id").select("region", "i", "j", "side", "base", "label", "n", "hashes")
    return scratch.table(rows.repartition(tasks, "region", "i", "j").sortWithinPartitions("region", "i", "j").mapInArrow(_whole(percent), "base long, other long"))
