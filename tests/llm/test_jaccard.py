"""The Jaccard join: regions that must be cut, repeated ids, and the groups' inner steps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import jaccard_join
from threadloom.llm import textkernel as tk


def brute(texts):
    """Least id of each component."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts if (w := t.split())}
    label = {i: i for i, _ in texts}
    near = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def found(spark, texts):
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark, rows).collect()}


def template(n, shared, own, seed=1):
    """Pages of one template: `shared` words that all have, `own` words of each."""
    r = random.Random(seed)
    head = [f"t{k}" for k in range(shared)]
    return [(i, " ".join(head + [f"{r.random():.9f}" for _ in range(own)])) for i in range(n)]


def test_pages_of_a_template_that_do_not_link(spark, monkeypatch):
    """All lie equally far from each other: pivots can't tell them apart, and they meet in blocks, in few turns."""
    written = []
    real = jaccard_join.Scratch.table
    monkeypatch.setattr(jaccard_join.Scratch, "table", lambda self, df: written.append(1) or real(self, df))
    texts = template(600, 60, 12)
    texts += [(1000 + i, t) for i, t in texts[:5]] + [(2000 + i, t + " more") for i, t in texts[5:9]]
    assert found(spark, texts) == brute(texts)
    assert len(written) <= 30


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_regions_equal_brute_force(spark, monkeypatch, seed):
    """Large regions of random sets in every state: labelled in part, cut, closed, and joined in blocks."""
    monkeypatch.setattr(jaccard_join, "WHOLE", 8)
    turns, real = [], jaccard_join._divided
    monkeypatch.setattr(jaccard_join, "_divided", lambda *a: turns.append(1) or real(*a))
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(12):
        base = rng.choice(500, 40, replace=False)
        for _ in range(15):
            own = set(rng.choice(base, rng.integers(33, 41), replace=False).tolist()) | set((1000 + rng.choice(9000, rng.integers(0, 4), replace=False)).tolist())
            sets.append(np.sort(np.array(list(own), np.uint64)))
    sets = list({s.tobytes(): s for s in sets}.values())
    table = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, n long, hashes binary")
    regions = spark.createDataFrame([(r, i) for r in range(4) for i in range(len(sets)) if r < 2 or i % r == 0], "region long, id long")
    regions = regions.join(table.select("id", F.col("n").alias("w")), "id")
    got = {r["id"]: r["component"] for r in jaccard_join.components_of(jaccard_join.Scratch(spark, "t"), regions, table, 80).collect()}
    label = list(range(len(sets)))
    for _ in range(30):
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if both * 180 >= 80 * (len(sets[a]) + len(sets[b])):
                    label[a] = label[b] = min(label[a], label[b])
    assert [got.get(i, i) for i in range(len(sets))] == label
    assert turns


def test_overlaps():
    rng = np.random.default_rng(1)
    a, b = ([np.unique(rng.integers(0, 300, rng.integers(0, 80))).astype(np.uint64) for _ in range(n)] for n in (7, 9))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert jaccard_join.overlaps(a, b, width=16).tolist() == want


def test_groups_that_span_batches():
    import pyarrow as pa

    keys = [1, 1, 1, 2, 3, 3, 4, 4, 4, 4, 5]
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + 2], "v": list(range(i, min(i + 2, 11)))}) for i in range(0, 11, 2)]
    seen = [[t.column("k")[a].as_py(), b - a] for t in tk.runs(batches, "k") for a, b in tk.groups_of(t, "k")]
    assert seen == [[1, 3], [2, 1], [3, 2], [4, 4], [5, 1]]


def test_repeated_ids_keep_their_texts(spark):
    word = {c: " ".join(f"{c}{k}" for k in range(20)) for c in "ABCDE"}
    rows = [(0, "A"), (1, "A"), (1, "B"), (2, "C"), (2, "D"), (3, "E"), (3, "E"), (4, "E")]
    docs = spark.createDataFrame([(i, word[c], 1, 2, 3) for i, c in rows] + [(9, None, 1, 2, 3), (9, " ", 1, 2, 3), (None, word["A"], 1, 2, 3)], "doc_id long, text string, copy_rank int, mark int, row int")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"] and r["text"][:1]) for r in left.collect()), key=str)
    assert got == sorted([(0, "A"), (1, "B"), (2, "C"), (2, "D"), (3, "E"), (9, None), (9, " "), (None, "A")], key=str)


def test_very_long_texts_are_compared_whole(spark):
    r = random.Random(3)
    long = [f"w{r.randrange(10**6)}" for _ in range(1_200_000)]  # about 9 MB, over a slice's border
    other = long[:200_000] + [f"v{k}" for k in range(1_000_000)]
    texts = [(5, " ".join(long)), (7, " ".join(long[:-1])), (3, " ".join(other)), (8, "a b")]
    assert found(spark, texts) == {5: 5, 7: 5, 3: 3, 8: 8}


def test_empty_documents_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 0
    assert docs.select(F.lit(1)).count() == 0
