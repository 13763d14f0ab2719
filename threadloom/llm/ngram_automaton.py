"""Log10 probabilities of texts under a weighted backoff automaton of trigrams.

States are histories seen in training: the last two words if they have been seen together, else the last
word, else none (the root). With c the counts and b2, b3 the smoothing of orders 2 and 3:

- the root gives every word w (c(w) + a) / (N + a (V + 1)),
- the arc of a state h with w has the weight (c(h w) + b P(w | shorter h)) / (c(h) + b),
- where a state has no arc with w, its failure arc leads to the shorter state with the weight b / (c(h) + b).

So the weights of a state's words sum to 1. A text is traversed once, left to right: each step has a state,
takes failure arcs as long as no arc carries the word, adds the logarithms of what it took, and moves on to
the longest state that ends in the word. Before a text's first word stands END, and END closes it.

The automaton of a corpus is as large as the corpus, so no task and no driver ever holds it. Texts are kept as
blocks of word numbers. Each block asks for the counts of its own n-grams, by hash range; ranges are
summed over all blocks; and each block gets back the counts of the part of the automaton that its texts
can walk. An n-gram is one entry of a block however often it occurs, so none fills a range. N-grams
are told apart by 48 bits of their hashes beside the range. Triples are asked for when words and pairs
have been told and the files of that shuffle are gone, so that the disk holds about half of what is asked at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import textkernel as tk
from threadloom.llm.workdir import Scratch, buckets_for, columns_or_null, shuffles_freed, small_batches

END = np.uint64(0x656E64206F662074)  # stands for the end of a text, and before its first word
_LOW = np.uint64((1 << 48) - 1)
_SEGMENT = 512  # texts are traversed side by side; longer ones in segments, whose first state the words before give

_BLOCK = "block long, doc_ids binary, held binary, lengths binary, tokens binary, vocabulary binary, train long, grams long"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("doc_ids", "held", "lengths", "tokens", "vocabulary")), ("train", pa.int64()), ("grams", pa.int64())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers of a block's own sorted vocabulary of word hashes, each text closed by END."""
    block = TaskContext.get().partitionId() << 32
    for batch in _gathered(batches):
        raw, offsets = tk.text_bytes(batch.column("text"))
        ids, held = np.array(batch.column("doc_id").to_pylist(), object), np.asarray(batch.column("held").to_numpy(), bool)
        for first, last in tk.slices(offsets, 8 << 20):
            h, rows = tk.words(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            h = np.insert(h, rows[1:], END)
            vocabulary, tokens = np.unique(h, return_inverse=True)
            lengths, own = np.diff(rows) + 1, held[first:last]
            named = np.array([x if x is not None else 0 for x in ids[first:last]], np.int64)
            null = np.array([x is None for x in ids[first:last]], np.uint8)
            yield pa.RecordBatch.from_pydict({
                "block": [block], "doc_ids": [named.tobytes() + null.tobytes()], "held": [own.tobytes()], "lengths": [tk.squeeze(lengths)], "tokens": [tk.squeeze(tokens)],
                "vocabulary": [vocabulary.tobytes()], "train": [int(lengths[~own].sum())], "grams": [len(tokens)],
            }, schema=_BLOCK_SCHEMA)
            block += 1


def _gathered(batches: Iterator[pa.RecordBatch], most: int = 6 << 20) -> Iterator[pa.Table]:
    """Batches joined up to about `most` bytes: larger blocks repeat fewer n-grams."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


WORDS, PAIRS, TRIPLES = range(3)
ROUNDS = (WORDS, PAIRS), (TRIPLES,)  # what is asked for together


def _follow(histories: np.ndarray, words: np.ndarray) -> np.ndarray:
    return tk.mix(histories * np.uint64(0x9E3779B97F4A7C15) + words)


class Block:
    """A block's texts, and those of its distinct words, pairs and triples that are asked for, each with its place in the order in which they are sent.

    Words are dealt to the first word_buckets ranges, pairs to the next `buckets`, triples to as many after these.
    """

    def __init__(self, row: dict, word_buckets: int, buckets: int, kinds: tuple[int, ...] = (WORDS, PAIRS, TRIPLES)):
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.tokens, self.lengths = tk.unsqueeze(row["tokens"]), tk.unsqueeze(row["lengths"])
        self.train = np.repeat(~np.frombuffer(row["held"], bool), self.lengths)
        size, self.starts = len(self.vocabulary), np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = self.end = int(np.searchsorted(self.vocabulary, END))
        self.pairs, pair = np.unique(before * size + self.tokens, return_inverse=True)
        h, w = np.divmod(self.pairs, size)
        two = _follow(self.vocabulary[h], self.vocabulary[w])
        hashes, bucket, own = [], [], []

        def deal(of: np.ndarray, first: int, many: int, in_training: np.ndarray) -> None:
            hashes.append(of)
            bucket.append(first + ((of >> np.uint64(40)) * np.uint64(many) >> np.uint64(24)).astype(np.int64))
            own.append(np.bincount(in_training, minlength=len(of)))

        if WORDS in kinds:
            deal(tk.mix(self.vocabulary), 0, word_buckets, self.tokens[self.train])
        if PAIRS in kinds:
            deal(two, word_buckets, buckets, pair[self.train])
        if TRIPLES in kinds:
            later = np.ones(len(self.tokens), bool)
            later[self.starts] = False
            later = np.flatnonzero(later)
            self.triples, triple = np.unique(pair[later - 1] * size + self.tokens[later], return_inverse=True)  # (pair, word)
            p, x = np.divmod(self.triples, size)
            deal(_follow(two[p] ^ np.uint64(0x5851F42D4C957F2D), self.vocabulary[x]), word_buckets + buckets, buckets, triple[self.train[later]])
        self.hashes, self.own, bucket = np.concatenate(hashes), np.concatenate(own), np.concatenate(bucket)
        # one sort of one key; n-grams that tie are told the same sums, in whichever order they stand
        small = word_buckets + 2 * buckets <= 1 << 16
        self.order = np.argsort(bucket.astype(np.uint64) << np.uint64(48) | self.hashes & _LOW) if small else np.lexsort((self.hashes & _LOW, bucket))
        self.bucket = bucket[self.order]

    def sent(self, word_buckets: int, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
        low, count = (self.hashes & _LOW)[self.order], self.own[self.order]
        cuts = np.searchsorted(self.bucket, np.arange(word_buckets + 2 * buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[k], cuts[k + 1])
            yield k, tk.squeeze(np.diff(low[part], prepend=np.uint64(0)), 6), tk.squeeze(count[part])


_ASKED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])


def _ask(word_buckets: int, buckets: int, kinds: tuple[int, ...]):
    """A block's n-grams of these kinds and their counts in its training texts, by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                rows = [(k, row["block"], g, c) for k, g, c in Block(row, word_buckets, buckets, kinds).sent(word_buckets, buckets)]
                if rows:  # a block of texts without words has no triples
                    yield pa.RecordBatch.from_pydict(dict(zip(_ASKED.names, zip(*rows))), schema=_ASKED)

    return run


_TOLD = "block long, bucket long, counts binary, seen long"


def _tell(table: pa.Table) -> pa.Table:
    """Sums of one hash range over all blocks, sent back to each block in its own order; and how many n-grams training has seen."""
    grams = [np.cumsum(tk.unsqueeze(x, 6)) for x in table.column("grams").to_pylist()]
    counts = np.concatenate([tk.unsqueeze(x) for x in table.column("counts").to_pylist()])
    cuts = np.cumsum([0, *map(len, grams)])
    unique, at = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(at, counts, len(unique)).astype(np.int64)
    told = [tk.squeeze(total[at[a:b]]) for a, b in zip(cuts, cuts[1:])]
    bucket = table.column("bucket")[0].as_py()
    return pa.table({
        "block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()), "bucket": pa.array([bucket] * (len(told) + 1), pa.int64()),
        "counts": pa.array([*told, None], pa.binary()), "seen": pa.array([*[None] * len(told), int((total > 0).sum())], pa.int64()),
    })


class Automaton:
    """The part of the automaton that a block's texts can walk.

    Words are block numbers. arcs2: sorted codes history * size + word of the pairs that training has seen, which are
    states as well; arcs3: sorted codes state * size + word. Both with their counts.
    """

    def __init__(self, words: np.ndarray, arcs2: np.ndarray, counts2: np.ndarray, arcs3: np.ndarray, counts3: np.ndarray, n: int, v: int, add: float, smooth: tuple[float, float]):
        self.size, self.arcs2, self.arcs3, self.words = len(words), arcs2, arcs3, words
        root = (words + add) / (n + add * (v + 1))
        b2, b3 = smooth
        history, word = np.divmod(arcs2, self.size)
        two = (counts2 + b2 * root[word]) / (words[history] + b2)
        state, last = np.divmod(arcs3, self.size)
        shorter = np.searchsorted(arcs2, word[state] * self.size + last) if len(arcs3) else np.zeros(0, int)
        three = (counts3 + b3 * two[shorter]) / (counts2[state] + b3)
        self.second = word  # of each state of two words
        self.root, self.two, self.three = (np.log10(x) for x in (root, two, three))
        self.fail2, self.fail3 = np.log10(b2 / (words + b2)), np.log10(b3 / (counts2 + b3))

    def _arc(self, arcs: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(arcs):
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(arcs, code), len(arcs) - 1)
        return at, arcs[at] == code

    def state_after(self, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state of two words (else -1) and of one word (else -1) that a text is in after these words."""
        at, known = self._arc(self.arcs2, before * self.size + word)
        return np.where(known, at, -1), np.where(self.words[word] > 0, word, -1)

    def walk(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
        """log10 probabilities of the texts tokens[start : start + length], each traversed left to right."""
        pieces = -(-lengths // _SEGMENT)
        text = np.repeat(np.arange(len(lengths)), pieces)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _SEGMENT
        length = np.minimum(lengths[text] - begin, _SEGMENT)
        at = starts[text] + begin
        order = np.argsort(-length, kind="stable")
        at, length, inner = at[order], length[order], begin[order]
        last = np.where(inner > 0, tokens[at - 1], end)
        before = np.where(inner > 1, tokens[at - 2], end)
        two, one = self.state_after(before, last)
        two = np.where(inner > 0, two, -1)  # a text begins after END alone
        score = np.zeros(len(at))
        ends = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
        for t, n in enumerate(ends.tolist()):
            word, gained = tokens[at[:n] + t], np.zeros(n)
            pair, has_pair = self._arc(self.arcs2, np.maximum(one[:n], 0) * self.size + word)
            has_pair &= one[:n] >= 0
            deep = np.flatnonzero(two[:n] >= 0)
            arc, hit = self._arc(self.arcs3, two[deep] * self.size + word[deep])
            gained[deep] += np.where(hit, self.three[arc] if len(self.three) else 0, self.fail3[two[deep]])
            done = np.zeros(n, bool)
            done[deep[hit]] = True
            some = np.flatnonzero(~done & has_pair)
            gained[some] += self.two[pair[some]]
            rest = ~done & ~has_pair
            some = np.flatnonzero(rest & (one[:n] >= 0))
            gained[some] += self.fail2[one[some]]
            gained[rest] += self.root[word[rest]]
            score[:n] += gained
            two[:n] = np.where(has_pair, pair, -1)
            one[:n] = np.where(self.words[word] > 0, word, -1)
        return np.bincount(text[order], score, len(lengths))


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(word_buckets: int, buckets: int, n: int, v: int, add: float, smooth: tuple[float, float]):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        given = next(r for r in rows if r["tokens"] is not None)
        own = Block(given, word_buckets, buckets)
        told = sorted((r for r in rows if r["tokens"] is None), key=lambda r: r["bucket"])
        counts = np.empty(len(own.hashes), np.int64)
        counts[own.order] = np.concatenate([tk.unsqueeze(r["counts"]) for r in told])
        del rows, told
        size = len(own.vocabulary)
        words, two, three = counts[:size], counts[size : size + len(own.pairs)], counts[size + len(own.pairs) :]
        arcs2 = np.flatnonzero(two)
        state = np.full(len(two), -1)
        state[arcs2] = np.arange(len(arcs2))  # pairs that training has seen, numbered anew
        arcs3 = np.flatnonzero(three)
        pair, word = np.divmod(own.triples[arcs3], size)
        automaton = Automaton(words, own.pairs[arcs2], two[arcs2], state[pair] * size + word, three[arcs3], n, v, add, smooth)
        m = len(own.lengths)
        ids, null = np.frombuffer(given["doc_ids"][: 8 * m], np.int64), np.frombuffer(given["doc_ids"][8 * m :], np.uint8).astype(bool)
        return pa.table({
            "doc_id": pa.array(ids, mask=null), "held_out": np.frombuffer(given["held"], bool), "n_tokens": own.lengths,
            "n_known": np.add.reduceat((words > 0)[own.tokens].astype(np.int64), own.starts), "train_tokens": np.full(m, n, np.int64),
            "base_score": np.add.reduceat(automaton.root[own.tokens], own.starts), "score": automaton.walk(own.tokens, own.starts, own.lengths, own.end),
        })

    return run


def backoff_scores(spark: SparkSession, docs: DataFrame, held_out, add: float = 0.1, smooth: tuple[float, float] = (20.0, 4.0), per_bucket: int = 2_000_000) -> DataFrame:
    """Scores every text of docs under an automaton learnt from those that aren't held out.

    docs: doc_id, text; held_out: a boolean column expression over doc_id. Words are what lies between ASCII white
    space, with A-Z lowered, and an end closes each text and counts as a token. A null text counts
    as empty: its only token is the end. A null doc_id or a null held_out counts as not held out.
    Rows that repeat are scored, and learnt from, as often as they stand. Texts of any length are walked whole. Without
    training tokens all counts are 0 and both scores are those of the root. Further columns, whatever their names, are left behind.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (root only), score.
    """
    small_batches(spark)
    scratch = Scratch(spark, "ngrams")
    docs = columns_or_null(docs, doc_id="long", text="string").withColumn("held", F.coalesce(held_out, F.lit(False)))
    blocks = scratch.table(docs.mapInArrow(_blocks, _BLOCK))
    vocabulary, n, grams = (int(x or 0) for x in blocks.agg(F.sum(F.length("vocabulary")) / 8, F.sum("train"), F.sum("grams")).first())
    word_buckets, buckets = buckets_for(vocabulary, per_bucket), buckets_for(grams, per_bucket)
    told = []
    for kinds in ROUNDS:
        asked = blocks.mapInArrow(_ask(word_buckets, buckets, kinds), "bucket long, block long, grams binary, counts binary")
        with shuffles_freed(spark):
            told.append(scratch.table(asked.groupBy("bucket").applyInArrow(_tell, _TOLD)))
    told = told[0].union(told[1])
    v = told.where((F.col("block") == -1) & (F.col("bucket") < word_buckets)).agg(F.sum("seen")).first()[0] or 0
    empty = [F.lit(None).cast("binary").alias(c) for c in ("doc_ids", "held", "lengths", "tokens", "vocabulary")]
    parts = blocks.select("block", F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("counts"), "doc_ids", "held", "lengths", "tokens", "vocabulary")
    parts = parts.union(told.where("block >= 0").select("block", "bucket", "counts", *empty))
    return parts.groupBy("block").applyInArrow(_scored(word_buckets, buckets, n, int(v), add, smooth), _SCORES)
