"""Collocations: phrases of two to four words, counted by position bitmaps.

The corpus lies in shards of about 8 MB of text in one language. In a shard every word has a bitmap of
its positions; positions of different pieces are never next to each other. A bitmap is kept compressed:
(block, mask of 16 positions) where the mask isn't empty, and the entries of all bitmaps of a shard lie
side by side, by block. Shifting a phrase's bitmap by one place and taking the AND with that of a
further item gives the longer phrase's, whose popcount is its count in the shard. Counts are summed over
shards.

A shard can't know by itself what is frequent, so the corpus is passed twice. First words, then pairs of
frequent words are summed; in the second pass each shard extends frequent pairs to three and at once to
four words, depth first, and only along pairs that are frequent in the whole corpus. Words, then pairs,
get numbers, so that every key is two numbers of 32 bits and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm import textkernel as tk
from threadloom.llm.workdir import Scratch, buckets_for, columns_or_null, small_batches

BITS = 16
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[0x0A, 0x0B, 0x0C, 0x0D, *b".,;:!?"]] = True
_BETWEEN = _ENDS_PIECE.copy()
_BETWEEN[[0x20, 0x09]] = True
UNKNOWN_LANG = "und"

_SHARD = "shard long, lang string, words array<string>, counts array<long>, places binary"


def _shards(most: int):
    """Shards of the texts of a task, each of one language and about `most` bytes; at most four times that much is held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, sizes = TaskContext.get().partitionId() << 32, {}, {}
        for batch in batches:
            for lang, texts in _by_lang(batch):
                held.setdefault(lang, []).append(texts)
                sizes[lang] = sizes.get(lang, 0) + texts.nbytes
            while sizes and (max(sizes.values()) >= most or sum(sizes.values()) >= 4 * most):
                lang = max(sizes, key=sizes.get)
                del sizes[lang]
                for out in _encode(lang, held.pop(lang), most, number):
                    number += 1
                    yield out
        for lang, texts in held.items():
            for out in _encode(lang, texts, most, number):
                number += 1
                yield out

    return run


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    coded = batch.column("lang").dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    texts = batch.column("text").take(pa.array(order))
    bounds = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    for lang, a, b in zip(coded.dictionary.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        yield lang, texts.slice(a, b - a)


def _encode(lang: str, texts: list[pa.Array], most: int, number: int) -> Iterator[pa.RecordBatch]:
    """Shards (one, unless texts are very long) as their different words, how often each stands, and the word at each place."""
    all_raw, all_offsets = tk.text_bytes(pa.chunked_array(texts))
    for first, last in tk.slices(all_offsets, 2 * most):
        raw, offsets = tk.LOWER[all_raw[all_offsets[first] : all_offsets[last]]], all_offsets[first : last + 1] - all_offsets[first]
        starts, ends, of_row = tk.word_spans(raw, offsets, _BETWEEN)
        if not len(starts):
            continue
        # a word begins a piece if it is its row's first, or a mark stands before it
        marks = np.concatenate([[0], np.cumsum(_ENDS_PIECE[raw], dtype=np.int32)])
        begins = np.concatenate([[True], marks[starts[1:]] > marks[starts[:-1]]])
        begins[of_row[:-1][np.diff(of_row) > 0]] = True
        letters = raw[~_BETWEEN[raw]]
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)]).astype("<i8").tobytes()), pa.py_buffer(letters.tobytes()))
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        # the word of each place counted from 1; 0 lies between pieces
        places = np.zeros(len(codes) + int(begins.sum()), np.int64)
        places[np.arange(len(codes)) + np.cumsum(begins)] = codes + 1
        counts, one = np.bincount(codes), lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        row = [pa.array([number]), pa.array([lang]), one(coded.dictionary.cast(pa.string())), one(pa.array(counts)), pa.array([tk.squeeze(places)], pa.binary())]
        yield pa.RecordBatch.from_arrays(row, ["shard", "lang", "words", "counts", "places"])
        number += 1


class Bitmaps:
    """Compressed position bitmaps of many items: entries (block, item, mask) by block, the mask never 0."""

    def __init__(self, block: np.ndarray, item: np.ndarray, mask: np.ndarray):
        self.block, self.item, self.mask = block, item, mask

    @classmethod
    def of(cls, items: np.ndarray) -> Bitmaps:
        """From the item at each position, below 0 where there is none."""
        at = np.flatnonzero(items >= 0)
        item, block = items[at], at // BITS
        order = np.argsort(block * (int(item.max(initial=0)) + 1) + item)
        block, item, bit = block[order], item[order], np.left_shift(1, at % BITS)[order].astype(np.uint32)
        if not len(at):
            return cls(block, item, bit)
        new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (item[1:] != item[:-1])]))
        return cls(block[new], item[new], np.bitwise_or.reduceat(bit, new))

    def shifted(self) -> Bitmaps:
        """Every position one further; what leaves a block enters the next."""
        mask = self.mask << np.uint32(1)
        over = np.flatnonzero(mask >> np.uint32(BITS))
        stay = mask & np.uint32((1 << BITS) - 1)
        block, item, mask = np.concatenate([self.block, self.block[over] + 1]), np.concatenate([self.item, self.item[over]]), np.concatenate([stay, np.ones(len(over), np.uint32)])
        order = np.argsort(block, kind="stable")
        order = order[mask[order] > 0]
        return Bitmaps(block[order], item[order], mask[order])


def extended(phrases: Bitmaps, items: Bitmaps, step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, phrase, item, mask) of all non-empty ANDs of shifted phrases with items: where each phrase is followed by each item."""
    moved = phrases.shifted()
    first, last = np.searchsorted(items.block, moved.block), np.searchsorted(items.block, moved.block, "right")
    pairs = last - first
    ends = np.cumsum(pairs)
    out = []
    begin = 0
    while begin < len(pairs):  # so many ANDs at a time
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + step, "right")))
        n = pairs[begin:end]
        a = np.repeat(np.arange(begin, end), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[begin:end], n)
        both = moved.mask[a] & items.mask[b]
        hit = np.flatnonzero(both)
        out.append((moved.block[a[hit]], moved.item[a[hit]], items.item[b[hit]], both[hit]))
        begin = end
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint32)
    return tuple(np.concatenate(x) for x in zip(*out))


def popcounts(keys: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the number of positions of each."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(np.bitwise_count(mask[order]).astype(np.int64), new) if len(new) else new


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + (pa.Codec("zstd").compress(data, asbytes=True) if data else b"")


def _unzip(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.Codec("zstd").decompress(blob[8:], decompressed_size=n, asbytes=True) if n else b""


def _rising(a: np.ndarray) -> bytes:
    """A rising list of whole numbers, by its steps."""
    return tk.squeeze(np.diff(a, prepend=0), 8)


def _risen(blob: bytes) -> np.ndarray:
    return np.cumsum(tk.unsqueeze(blob, 8))


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets that have items, each with its items' places."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return ((int(bucket[x[0]]), x) for x in np.split(order, cuts) if len(x))


# What shards count is packed by the bucket that its hash falls into, summed bucket by bucket, and what is frequent goes back to
# the shards that have it, with its number. A number is a place in a bucket times the number of buckets, plus the bucket.
_LOCAL = "bucket int, shard long, lang string, refs binary, items binary, n binary"
_FOUND = "shard long, lang string, refs binary, numbers binary, items binary, n binary"
_FOUND_ARROW = pa.schema([("shard", pa.int64()), ("lang", pa.string()), *((c, pa.binary()) for c in ("refs", "numbers", "items", "n"))])


def _local_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words, n = batch.column("words")[row].values, batch.column("counts")[row].values.to_numpy()
                raw, offsets = tk.text_bytes(words)
                hashes = tk.span_hashes(raw, offsets[:-1], offsets[1:])
                for bucket, own in _dealt((hashes % np.uint64(buckets)).astype(np.int64)):
                    blob = _zip("\n".join(words.take(pa.array(own)).to_pylist()).encode())  # a line end is in no word
                    yield _row(bucket, batch.column("shard")[row], batch.column("lang")[row], _rising(own), blob, tk.squeeze(n[own]))

    return run


def _row(bucket: int, shard, lang, refs, items: bytes, n: bytes) -> pa.RecordBatch:
    plain = [x.as_py() if isinstance(x, pa.Scalar) else x for x in (shard, lang)]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([plain[0]], pa.int64()), pa.array([plain[1]], pa.string()), *(pa.array([x], pa.binary()) for x in (refs, items, n))], ["bucket", "shard", "lang", "refs", "items", "n"])


def _sum_words(least: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        bucket, out, used = table.column("bucket")[0].as_py(), [], 0
        langs = np.asarray(table.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            rows = table.take(pa.array(np.flatnonzero(langs == lang))).to_pylist()
            lists = [_unzip(r["items"]).split(b"\n") for r in rows]
            coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
            codes, words = coded.indices.to_numpy(), coded.dictionary
            # sums in doubles are exact below 2^53
            f = np.bincount(codes, np.concatenate([tk.unsqueeze(r["n"]) for r in rows])).astype(np.int64)
            good = f >= least
            number = (used + np.cumsum(good) - 1) * buckets + bucket
            used += int(good.sum())
            begin = 0
            for r, x in zip(rows, lists):
                own = codes[begin : begin + len(x)]
                begin += len(x)
                keep = good[own]
                out.append({"shard": r["shard"], "lang": lang, "refs": _rising(_risen(r["refs"])[keep]), "numbers": tk.squeeze(number[own[keep]], 8)})
            out.append({"lang": lang, "numbers": tk.squeeze(number[good], 8), "items": _zip(b"\n".join(words.filter(pa.array(good)).to_pylist())), "n": tk.squeeze(f[good], 8)})
        return pa.Table.from_pylist(out, _FOUND_ARROW)

    return run


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            numbers = tk.unsqueeze(r["numbers"], 8)
            if len(numbers):
                words = _unzip(r["items"]).decode().split("\n")
                yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(words)), pa.array(words), pa.array(tk.unsqueeze(r["n"], 8)), pa.array(numbers)], ["lang", "word", "f", "number"])


def _packed_keys(keys: np.ndarray, n: np.ndarray, buckets: int, shard, lang: str) -> Iterator[pa.RecordBatch]:
    for bucket, own in _dealt((tk.mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)):
        yield _row(bucket, shard, lang, None, _rising(keys[own]), tk.squeeze(n[own]))


def _sums(rows: list[dict], least: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each row's keys, and the frequent keys of all with their counts."""
    lists = [_risen(r["items"]) for r in rows]
    keys, n = np.concatenate(lists), np.concatenate([tk.unsqueeze(r["n"]) for r in rows])
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    f = np.add.reduceat(n[order], new)
    return lists, keys[new][f >= least], f[f >= least]


def _sum_pairs(least: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        lists, frequent, f = _sums(rows, least)
        numbers = np.arange(len(frequent)) * buckets + rows[0]["bucket"]
        for r, keys in zip(rows, lists):
            at = np.minimum(np.searchsorted(frequent, keys), max(len(frequent) - 1, 0))
            hit = frequent[at] == keys if len(frequent) else np.zeros(len(keys), bool)
            if hit.any():
                out.append({"shard": r["shard"], "refs": _rising(keys[hit]), "numbers": tk.squeeze(numbers[at[hit]], 8)})
        out.append({"refs": _rising(frequent), "numbers": tk.squeeze(numbers, 8), "n": tk.squeeze(f, 8)})
        return pa.Table.from_pylist(out, _FOUND_ARROW)

    return run


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(_risen(r["refs"])), pa.array(tk.unsqueeze(r["n"], 8)), pa.array(tk.unsqueeze(r["numbers"], 8))], ["key", "f", "pair"])


def _sum_longer(least: int):
    def run(table: pa.Table) -> pa.Table:
        out, rows = [], table.to_pylist()
        for length in ("3", "4"):
            if own := [r for r in rows if r["lang"] == length]:
                _, keys, f = _sums(own, least)
                out.append(pa.table({"length": pa.array(np.full(len(keys), int(length), np.int32)), "key": keys, "f": f}))
        return pa.concat_tables(out)

    return run


def _back(found: DataFrame, name: str) -> DataFrame:
    """What goes back to each shard: a row with a part from each bucket."""
    return found.where("shard is not null").groupBy("shard").agg(F.collect_list(F.struct("refs", "numbers")).alias(name))


def _joined(parts: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + [_risen(p["refs"]) for p in parts or []]), np.concatenate(none + [tk.unsqueeze(p["numbers"], 8) for p in parts or []])


def _items(row: dict) -> np.ndarray:
    """The number of the frequent word at each place of a shard, else -1."""
    known, numbers = _joined(row["known"])
    own = np.full(int(max(known, default=-1)) + 2, -1, np.int64)
    own[known + 1] = numbers
    at = tk.unsqueeze(row["places"])
    return np.where(at < len(own), own[np.minimum(at, len(own) - 1)], -1)


def _pairs(buckets: int):
    """Pairs of frequent words of each shard, with their counts in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                words = Bitmaps.of(_items(row))
                _, one, two, mask = extended(words, words)
                yield from _packed_keys(*popcounts(one << 32 | two, mask), buckets, row["shard"], None)

    return run


def _longer(buckets: int):
    """Phrases of three and four words of each shard, along frequent pairs, with their counts in it; their length stands as lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                keys, numbers = _joined(row["pairs"])
                order = np.argsort(keys)
                keys, numbers = keys[order], numbers[order]
                words = Bitmaps.of(_items(row))
                block, one, two, mask = extended(words, words)
                at = np.minimum(np.searchsorted(keys, one << 32 | two), max(len(keys) - 1, 0))
                good = keys[at] == (one << 32 | two) if len(keys) else np.zeros(len(one), bool)
                two = Bitmaps(block[good], numbers[at[good]], mask[good])  # marks where the second word stands
                block, begin, end, mask = extended(two, two)
                yield from _packed_keys(*popcounts(begin << 32 | end, mask), buckets, None, "3")
                # four words are a pair, and the next pair but one: on from the bitmaps of three
                three, item = np.unique(begin << 32 | end, return_inverse=True)
                _, item, end, mask = extended(Bitmaps(block, item, mask), two)
                begin = three.view(np.uint64)[item] >> np.uint64(32)
                yield from _packed_keys(*popcounts(begin.astype(np.int64) << 32 | end, mask), buckets, None, "4")

    return run


class Phrases:
    """Frequent phrases of one to four words of each language, from texts (text, lang)."""

    def __init__(self, spark: SparkSession, docs: DataFrame, least: int = 30, shard_bytes: int = 8 << 20, per_bucket: int = 3_000_000):
        small_batches(spark)
        scratch = Scratch(spark, "phrases")
        docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
        shards = scratch.table(docs.mapInArrow(_shards(shard_bytes), _SHARD))
        sizes = shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.size("counts").alias("local"))
        self.totals = scratch.table(sizes.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("local").alias("local")))
        whole, local = (x or 0 for x in self.totals.agg(F.sum("n"), F.sum("local")).first())
        buckets = buckets_for(local, per_bucket // 3)
        words = shards.select("shard", "lang", "words", "counts").mapInArrow(_local_words(buckets), _LOCAL)
        words = scratch.table(words.groupBy("bucket").applyInArrow(_sum_words(least, buckets), _FOUND))
        coded = scratch.table(shards.select("shard", "places").join(_back(words, "known"), "shard"))
        scratch.drop(shards)
        buckets = buckets_for(whole, per_bucket)
        pairs = scratch.table(coded.mapInArrow(_pairs(buckets), _LOCAL).groupBy("bucket").applyInArrow(_sum_pairs(least, buckets), _FOUND))
        longer = coded.join(_back(pairs, "pairs"), "shard").mapInArrow(_longer(buckets), _LOCAL)
        longer = scratch.table(longer.groupBy("bucket").applyInArrow(_sum_longer(least), "length int, key long, f long"))
        words_found, pairs_found = words, pairs
        words = words.where("shard is null").select("lang", "numbers", "items", "n").mapInArrow(_word_rows, "lang string, word string, f long, number long")
        pairs = pairs.where("shard is null").select("refs", "numbers", "n").mapInArrow(_pair_rows, "key long, f long, pair long")
        #: (lang, words, f, phrase) of all frequent phrases
        self.frequent = scratch.table(self._named(words, pairs, longer).withColumn("phrase", F.array_join("words", " ")))
        scratch.drop(coded, words_found, pairs_found, longer)

    @staticmethod
    def _named(words: DataFrame, pairs: DataFrame, longer: DataFrame) -> DataFrame:
        """Phrases by their words, from keys of two numbers."""
        first, second = F.shiftrightunsigned("key", 32), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
        a = words.select("lang", F.col("word").alias("a"), F.col("number").alias("first"))
        b = words.select(F.col("word").alias("b"), F.col("number").alias("second"))
        two = pairs.select("pair", "f", first.alias("first"), second.alias("second")).join(a, "first").join(b, "second").select("pair", "lang", "f", F.array("a", "b").alias("words"))
        begin, end = two.select("lang", F.col("words").alias("x"), F.col("pair").alias("first")), two.select(F.col("words").alias("y"), F.col("pair").alias("second"))
        more = longer.select("length", "f", first.alias("first"), second.alias("second")).join(begin, "first").join(end, "second")
        # three words are two pairs that share their middle word, four are two pairs side by side
        whole = F.when(F.col("length") == 3, F.concat("x", F.slice("y", 2, 1))).otherwise(F.concat("x", "y"))
        return words.select("lang", F.array("word").alias("words"), "f").union(two.select("lang", "words", "f")).union(more.select("lang", whole, "f"))

    def scored(self) -> DataFrame:
        """Candidates (lang, phrase, a, l, r, score) with their lowest-scoring cut, but for those that a longer one mostly stands for."""
        counts, candidates = self.frequent.select("lang", "phrase", "f"), self.frequent.where(F.size("words") > 1)
        cut = lambda k: F.struct(k.alias("k"), F.array_join(F.slice("words", 1, k), " ").alias("left"), F.array_join(F.slice("words", k + 1, F.size("words") - k), " ").alias("right"))
        cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut)).alias("c")).select("lang", "phrase", "a", "c.*")
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        best = cuts.withColumn("score", _score()).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("m"))
        return best.join(self._covered(candidates), ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "m.l", "m.r", "m.score")

    @staticmethod
    def _covered(candidates: DataFrame) -> DataFrame:
        """Phrases that lie within a longer candidate of at least 0.8 times their count."""
        inside = F.expr("filter(flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), s -> array_join(slice(words, s, n), ' ')))), x -> x is not null)")
        longer = candidates.where(F.size("words") > 2).select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
        own = candidates.select("lang", "phrase", "f")
        big = lambda c: F.col(c).cast("decimal(20,0)")
        return own.join(longer, ["lang", "phrase"]).where(100 * big("longest") >= 80 * big("f")).select("lang", "phrase")


def _score() -> Column:
    """floor(2,000,000 a / (l + r)) in whole numbers that may pass 64 bits."""
    return F.expr("cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")


def collocations(spark: SparkSession, docs: DataFrame, least: int = 30, most: int = 2000, shard_bytes: int = 8 << 20) -> DataFrame:
    """The best `most` phrases of each language of docs (text, lang): lang, rank from 1, phrase, a, l, r, n, score.

    Texts are cut at `. , ; : ! ?` and 0x0A to 0x0D into pieces, these at spaces and tabs into words, A-Z folded. A candidate has
    2 to 4 words and stands in pieces `least` times or more (a, overlaps included). Of its cuts in two parts (l and r times) the
    one with the lowest score floor(2,000,000 a / (l + r)) counts, ties to the shorter first part. Dropped is what lies within a longer candidate
    with 100 f >= 80 a. n: words of the language. Order: score, a, phrase (in bytes).

    A null text is empty, a null lang is `und`; repeated rows count again; doc_id isn't looked at; further columns are left behind. A
    text is held by one task; a very long one makes a shard of its own.
    """
    found = Phrases(spark, columns_or_null(docs, text="string", lang="string"), least, shard_bytes)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.scored().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(found.totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
