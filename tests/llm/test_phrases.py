"""Collocations against brute force, on odd rows and in shards of any size."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from threadloom.llm import phrase_bitmaps, queries
from threadloom.llm.phrase_bitmaps import Bitmaps, extended, popcounts

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, most=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    big = {p: a for p, a in counts.items() if a >= least and len(p) > 2}
    out = []
    for (lang, *p), a in big.items():
        if any(100 * f >= 80 * a and any(q[i : i + len(p)] == tuple(p) for i in range(len(q) - len(p) + 1)) for (x, *q), f in big.items() if x == lang and len(q) > len(p) for q in [tuple(q)]):
            continue
        score, k = min((2000000 * a // (counts[lang, *p[:k]] + counts[lang, *p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, *p[:k]], counts[lang, *p[k:]]))
    rows = []
    for lang in totals:
        for rank, (_, s, a, p, l, r) in enumerate(sorted(x for x in out if x[0] == lang)[:most], 1):
            rows.append((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(rows)


def test_bitmaps_extend_like_strings():
    rng = random.Random(2)
    for _ in range(100):
        items = np.array([rng.choice((-1, 0, 1, 2, 2, 2)) for _ in range(rng.randrange(120))], np.int64)
        words = Bitmaps.of(items)
        assert int(np.bitwise_count(words.mask).sum()) == int((items >= 0).sum())
        _, one, two, mask = extended(words, words, step=7)
        keys, n = popcounts(one << 32 | two, mask)
        want = Counter((int(a), int(b)) for a, b in zip(items, items[1:]) if a >= 0 and b >= 0)
        assert {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(c) for k, c in zip(keys, n)} == want


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = ["a", "b", "New", "york", "É", "c-d", "日本", "'s", "x" * 300, "on", "the"]
    rows = [(None, "en"), ("", "en"), (" \t. ,!", None), ("alone", "xx"), ("a b c d " * 3000, "en"), ("no\x0bstop\x0cjoin\rof\nlines", "en")]
    for _ in range(300):
        words = rng.choices(vocabulary, k=rng.randrange(25))
        rows.append(("".join(w + rng.choice((" ", " ", " ", "\t", "  ", ". ", ", ", "\n")) for w in words), rng.choice(("en", "en", "de", None, "und"))))
    return rows + rows[6:60]


@pytest.mark.parametrize("shard", [100, 8 << 20])
def test_equals_brute_force(spark, texts, shard):
    docs = spark.createDataFrame([(k % 9, t, x, 1, "p") for k, (t, x) in enumerate(texts)], "doc_id long, text string, lang string, n int, phrase string").repartition(3)
    got = [tuple(r) for r in phrase_bitmaps.collocations(spark, docs, least=6, shard_bytes=shard).select(*COLUMNS).collect()]
    assert sorted(got) == brute(texts, 6)
    assert {r[0] for r in got} >= {"en", "de", "und"}
    few = [tuple(r) for r in phrase_bitmaps.collocations(spark, docs, least=6, most=3).select(*COLUMNS).collect()]
    assert sorted(few) == brute(texts, 6, 3)


def test_nothing_frequent_and_no_rows(spark, texts):
    docs = spark.createDataFrame(texts[:4], "text string, lang string")
    assert phrase_bitmaps.collocations(spark, docs).count() == 0
    assert phrase_bitmaps.collocations(spark, docs.limit(0)).count() == 0


def test_score_passes_64_bits(spark):
    row = spark.range(1).selectExpr("10000000000000 as a", "10000000000000 as l", "10000000000001 as r").select(phrase_bitmaps._score().alias("s")).first()
    assert row["s"] == 2000000 * 10**13 // (2 * 10**13 + 1)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    with duckdb.connect() as c:
        c.sql(f"create view documents as from '{sf}/documents.parquet'")
        want = c.sql(queries.SQL["op11_phrase_bitmaps"]).select(*COLUMNS).fetchall()
    got = [tuple(r) for r in queries.op11_phrase_bitmaps(spark, sf).select(*COLUMNS).collect()]
    assert len(got) > 100 and sorted(got) == sorted(want)
