"""The pipeline's result against a plain one on the smallest tables, and on a table without rows."""

import collections
import hashlib
import re

import numpy as np
import tokenizers

import corpus_pipeline
from threadloom.llm import ppm_language, toxicity
from threadloom.llm.queries import read, tokenizer_path

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def first_of_each_group(docs):
    """doc_ids that stay: of each component of near copies the smallest, and all without words."""
    sets = {i: shingles(t) for i, t in docs.items()}
    up = {i: i for i in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i for i in ids if root(i) == i}


def test_pipeline_equals_plain_stages(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    texts = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
    model = toxicity.train(spark, docs, labels)
    clean = {r["doc_id"] for r in toxicity.keep_clean(spark, docs, model).collect()}
    rest = docs.where(docs["doc_id"].isin(*clean))
    learnt = ppm_language.train(spark, rest)
    known = {r["doc_id"] for r in ppm_language.keep_known(spark, rest, learnt, ppm_language.bounds(spark, rest, learnt)).collect()}
    kept = first_of_each_group({i: texts[i][0] for i in known})
    assert clean < set(texts) and len(known) > 0.9 * len(clean)

    rows = corpus_pipeline.run(spark, SF).collect()
    copies = collections.Counter(r["doc_id"] for r in rows)
    assert set(copies) == kept and max(copies.values()) <= 2
    # the rarest source is read twice, the most frequent once, and what lies between in the order of shares
    words = lambda i: len(re.findall(r"[^\x20\x09-\x0D]+", texts[i][0] or ""))
    once, read_ = collections.Counter(), collections.Counter()
    for i in kept:
        once[texts[i][1]] += words(i)
        read_[texts[i][1]] += words(i) * copies[i]
    often = [read_[s] / once[s] for s in sorted(once, key=once.get)]
    assert 1 <= min(often) and max(often) <= 2.0001 and all(a >= b - 0.2 for a, b in zip(often, often[1:]))
    assert often[0] > 1.8 or len(often) == 1

    library = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    for r in rows[:200]:
        ids = library.encode(texts[r["doc_id"]][0] or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


def test_pipeline_without_documents(spark, tmp_path):
    read(spark, SF, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    read(spark, SF, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
