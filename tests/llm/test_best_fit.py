"""Best-fit packing: plans by their laws and against bounds, pieces against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from threadloom.llm import best_fit, queries

SF = "/root/testdata/sf0.001"


def counts_of(lengths, size):
    return np.bincount(lengths, minlength=size + 1)


def spread(kinds):
    return [sum(([x] * n for x, n in items), []) for copies, items in kinds for _ in range(copies)]


@pytest.mark.parametrize("seed", range(60))
def test_plan_uses_every_piece_once_and_fits(seed):
    rng = random.Random(seed)
    size = rng.choice((1, 2, 7, 16, 64))
    lengths = [min(size, 1 + int(rng.expovariate(rng.choice((0.05, 0.3))))) for _ in range(rng.randrange(120))]
    kinds = best_fit.plan(counts_of(lengths, size), size)
    packed = spread(kinds)
    assert sorted(x for s in packed for x in s) == sorted(lengths)
    assert all(0 < sum(s) <= size for s in packed)
    # no worse than first fit, and any two sequences couldn't be one
    first: list[int] = []
    for x in sorted(lengths, reverse=True):
        for k, used in enumerate(first):
            if used + x <= size:
                first[k] += x
                break
        else:
            first.append(x)
    assert len(packed) <= len(first) + 1
    loads = sorted(map(sum, packed))
    assert len(loads) < 2 or loads[0] + loads[1] > size


def test_exact_complements_are_found():
    size = 100
    for rest in ([40], [25, 15], [23, 11, 6]):
        kinds = best_fit.plan(counts_of([60, *rest] * 1000, size), size)
        assert kinds == [(1000, [(60, 1), *((x, 1) for x in rest)])]
    assert best_fit.plan(counts_of([25] * 8, size), size) == [(2, [(25, 4)])]
    assert best_fit.plan(counts_of([50] * 5, size), size) == [(2, [(50, 2)]), (1, [(50, 1)])]


def test_plan_is_small_whatever_the_counts():
    rng = np.random.default_rng(5)
    counts = np.append(0, (1e9 * rng.random(2048) ** 9).astype(np.int64))
    kinds = best_fit.plan(counts, 2048)
    assert len(kinds) < 8192
    total = sum(int(n) * k for k, n in enumerate(counts))
    assert sum(c for c, _ in kinds) <= 1.04 * total / 2048  # half of the pieces are over half of a sequence
    common = np.bincount(np.clip(rng.exponential(600, 20000).astype(int) + 1, 1, 2048), minlength=2049)
    assert sum(c for c, _ in best_fit.plan(common, 2048)) == -(-int((common * np.arange(2049)).sum()) // 2048)
    used = np.zeros(2049, np.int64)
    for copies, items in kinds:
        for x, n in items:
            used[x] += copies * n
    assert (used == counts).all()


def expected_pieces(text, size, library):
    ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
    head = len(ids) % size or size
    cuts = [0, *range(head, len(ids), size), len(ids)] if len(ids) > size else [0, len(ids)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def checked(rows, size):
    """Sequences are filled without gaps from 0 and hold at most `size` tokens."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= size
    return by


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("size", [5, 64])
def test_odd_rows(spark, library, size):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "one two three"), (4, "one two three"), (None, "no id"), (5, "many words " * 500), (6, "x <|endoftext|> y"), (7, "É日本")] + [(i, "ab cd " * (i % 9)) for i in range(10, 200)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, piece int, sequence_id string").repartition(5)
    path = queries.tokenizer_path("byte_bpe_50k.json")
    pieces = best_fit.cut_pieces(spark, docs, path, size)
    placed = best_fit.place(pieces, size)
    rows = placed.collect()
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in rows), key=str)
    assert got == sorted(((i, *p) for i, t in texts for p in expected_pieces(t, size, library)), key=str)
    checked(rows, size)
    whole = {r["sequence_id"]: r["ids"] for r in best_fit.sequences(placed).collect()}
    assert all(whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"] for r in rows)
    assert best_fit.place(best_fit.cut_pieces(spark, docs.limit(0), path, size), size).count() == 0
    with pytest.raises(ValueError):
        best_fit.cut_pieces(spark, docs, path, 0)


def test_query_equals_library_on_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op12_best_fit(spark, SF).collect()
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == sorted((r["doc_id"], *p) for r in docs for p in expected_pieces(r["text"], 2048, library))
    packed = checked(rows, 2048)
    assert len(packed) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1
