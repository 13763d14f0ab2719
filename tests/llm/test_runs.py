"""Periodic runs against brute force: all texts over small alphabets, words of whole tables, and odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from threadloom.llm import lyndon_runs, queries
from threadloom.llm import textkernel as tk

SF = "/root/testdata/sf0.001"


def brute(text, least=6, periods=4):
    """Stretches by trying every period; a period is smallest if no smaller one has the stretch."""
    found, n = {}, len(text)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if text[i] != text[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and text[j] == text[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q - i), q)  # a multiple of a period gives the same stretch
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def test_all_short_texts():
    for n in range(15):
        for text in itertools.product(range(2), repeat=n):
            assert sorted(lyndon_runs.runs_of(list(text))) == brute(text), text


@pytest.mark.parametrize("letters", [2, 3, 5])
def test_random_texts_with_repetition(letters):
    rng = random.Random(letters)
    for _ in range(400):
        text = []
        while len(text) < 90:
            text += [rng.randrange(letters) for _ in range(rng.randrange(1, 5))] * rng.choice((1, 1, 2, 4, 7))
        assert sorted(lyndon_runs.runs_of(text)) == brute(text)


def test_lyndon_array_by_definition():
    rng = random.Random(1)
    for _ in range(300):
        text = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        after, agree = lyndon_runs.lyndon(text)
        for i in range(len(text)):
            want = next((j for j in range(i + 1, len(text)) if text[j:] < text[i:]), len(text))
            assert after[i] == want
            if want < len(text):
                assert agree[i] == next(k for k in range(len(text)) if want + k == len(text) or text[i + k] != text[want + k])


class Counting(list):
    """A list that counts how often it is read."""

    reads = 0

    def __getitem__(self, i):
        Counting.reads += 1
        return super().__getitem__(i)


def fibonacci(n):
    a, b = [1], [1, 0]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("make", [lambda n: [0] * n, lambda n: [0, 1] * (n // 2), fibonacci, lambda n: [bin(i).count("1") % 2 for i in range(n)], lambda n: [0] * (n // 2) + [1] + [0] * (n // 2), lambda n: list(range(n // 4)) * 4, lambda n: ([0] * 30 + [1]) * (n // 31)])
def test_reads_grow_in_proportion(make):
    """Reused extensions: reads per word stay under a constant however long and repetitive a text is."""
    for n in (2000, 16000):
        text = Counting(make(n))
        Counting.reads = 0
        lyndon_runs.lyndon(text)
        assert Counting.reads <= 14 * n


def test_cuts_keep_every_run():
    rng = random.Random(3)
    for _ in range(200):
        text, docs = [], []
        for d in range(4):
            own = []
            while len(own) < rng.randrange(60):
                own += [rng.randrange(9) for _ in range(rng.randrange(1, 6))] * rng.choice((1, 1, 1, 4, 6))
            text += own
            docs += [d] * len(own)
        got = [(a + s, n, q) for a, b in lyndon_runs.stretches(np.array(text, np.int64), np.array(docs)) for s, n, q in lyndon_runs.runs_of(text[a:b])]
        want, first = [], 0
        for d in range(4):
            n = docs.count(d)
            want += [(first + s, k, q) for s, k, q in brute(text[first : first + n])]
            first += n
        assert sorted(got) == sorted(want)


def test_ranks_tell_words_apart():
    words = [b"a", b"a\0", b"a\0\0", b"", b"abcdefgh", b"abcdefgh\0", b"abcdefghi", b"x" * 64, b"x" * 65, b"x" * 500, b"x" * 499 + b"y", b"a", b"x" * 500]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    ranks = lyndon_runs.word_ranks(raw, ends - [len(w) for w in words], ends).tolist()
    assert [[a == b for a in ranks] for b in ranks] == [[a == b for a in words] for b in words]


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    drop = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{q}\n" for s, k, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a a a a a a"), (5, "a " * 5), (6, "x y " * 4 + "x"), (7, "É b É b " * 3 + "q " * 9), (4, "a a a a a a"), (None, "b b b b b b b c"), (8, "w" * 300 + " c" * 7), (9, "p q r " * 5000)]
    rows += [(i, " ".join(random.Random(i).choices("ab cd efg h".split(), k=i % 40))) for i in range(10, 400)]
    docs = spark.createDataFrame([(i, t, "x", [1]) for i, t in rows], "doc_id long, text string, runs string, period array<int>").repartition(3)
    got = [tuple(r) for r in lyndon_runs.digests(lyndon_runs.periodic_runs(spark, docs, perturb=True)).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted((expected(i, t) for i, t in rows), key=str)
    assert lyndon_runs.digests(lyndon_runs.periodic_runs(spark, docs.limit(0))).count() == 0
    plain = {r["doc_id"]: r for r in lyndon_runs.periodic_runs(spark, docs.where("doc_id in (6, 9)")).collect()}
    assert plain[6]["collapsed"] == "x y" and plain[6]["runs"][0]["period"] == 2 and plain[9]["collapsed"] == "p q r"


def test_query_equals_brute_force_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op13_lyndon_runs(spark, SF).select(*COLUMNS).collect())
    short = [r for r in docs if len((r["text"] or "").split()) < 1500]
    want = {r["doc_id"]: expected(*r) for r in short}
    assert len(got) == len(docs) and sum(x[1] > 0 for x in want.values()) > 5
    assert [x for x in got if x[0] in want] == sorted(want.values())
    assert tk.WHITE.sum() == 6
