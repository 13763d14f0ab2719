"""Scores of toxicity against a noisy-or over sentences written out word by word, its gradient, and recall on held-out rows."""

import math
import re

import numpy as np
import pytest

from threadloom.llm import queries, textkernel as tk, toxicity


def hashed(piece: str, k: int | None = None) -> np.uint64:
    raw = piece.encode()
    h = tk.span_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
    return (h if k is None else tk.mix(h + np.uint64(k)))[0]


def by_hand(text, model) -> float:
    weight = dict(zip(model.known.tolist(), model.weights.tolist()))
    clean, told = math.exp(-model.leak), False
    for sentence in re.split(r"[.!?\n]", text or ""):
        words = re.findall(r"[a-z]+", sentence.lower())
        if not words:
            continue
        told = True
        features = {int(hashed(w)) for w in words} | {int(hashed(w[:k], k)) for w in words for k in (4, 5, 6) if len(w) >= k}
        p, p0 = (1 / (1 + math.exp(-z)) for z in (model.bias + sum(weight.get(f, 0.0) for f in features), model.bias))
        clean *= 1 - (p - p0) / (1 - p0)
    return 1 - clean if told else 0.0


TEXTS = ["You idiots there. Fine words! And idiot idiot", "Fine words here", "grr\nidiotic? grr", None, "", "12 .. !", "grr. " * 300, "fine words. " * 3000, "An item12 of grr and of idiots"]


def test_scores_are_a_noisy_or_over_sentences(spark):
    rows = [(i, f"Fine words here. You {('idiot', 'grr', 'friend', 'item', 'words')[i % 5]} of item{i}. The end.", int(i % 5 < 2 or i % 25 == 3)) for i in range(300)]
    model = toxicity.train(spark, spark.createDataFrame([*rows, (None, "You grr", 1), (900, "friend", 1), (900, "friend", 0)], "doc_id long, text string, toxic int"))
    assert len(model.known) and (model.weights >= 0).all() and model.leak > 0
    asked = spark.createDataFrame([*enumerate(TEXTS), (None, TEXTS[0]), (0, TEXTS[0])], "doc_id long, text string")
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(spark, asked, model).collect()]
    assert len(got) == len(TEXTS) + 2
    for i, score in got:
        assert score == pytest.approx(by_hand(TEXTS[i or 0], model), abs=1e-9)


def test_gradient_of_the_likelihood():
    random = np.random.default_rng(5)
    docs = np.sort(random.integers(0, 8, 20))
    part = toxicity._Part(random.integers(0, 2, 8).astype(np.int8), docs, np.sort(random.integers(0, 20, 60)), random.integers(0, 6, 60))
    share, x = (0.7, 1.9), np.concatenate([random.random(6), [-1.5, -2.0]])

    def loss(x):
        z = x[-2] + np.bincount(part.sentence, weights=x[:-2][part.feature], minlength=20)
        s = np.exp(x[-1]) + np.bincount(part.owner, weights=np.log1p(np.exp(z)) - np.log1p(np.exp(x[-2])), minlength=8)
        return np.where(part.toxic > 0, -share[1] * np.log(1 - np.exp(-s)), share[0] * s).sum()

    steps = np.eye(8) * 1e-6
    assert toxicity._gradient(part, x, share) == pytest.approx([(loss(x + d) - loss(x - d)) / 2e-6 for d in steps], rel=1e-4, abs=1e-6)


def test_most_toxic_rows_held_out_are_found(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.02 * len(clean)
