"""The operators for training data against brute force, on small tables with nulls, repeats and odd texts."""

import math
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import backtrack_bpe, exact_topk, jaccard_join, jump_shards, mixing, multi_index, ngram_automaton, ppm_language, queries, token_files, toxicity
from threadloom.llm import textkernel as tk

SF = "/root/testdata/sf0.001"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ODD = [
    (1, BASE), (2, BASE), (3, BASE + " more"), (4, "x " + BASE + " more"), (5, None), (6, ""), (7, " \n\t "), (8, "A b"), (9, "a B"), (10, "a b c"), (11, "123 ,,"),
    (12, "w" * 3000 + " it's we'll <|endoftext|> Ünïcode ÉÈ 日本 ½"), (1, BASE), (13, BASE.upper()), (None, "no id " + BASE), (14, "y z " * 400), (15, "İx ΣΑΣ don’t 'S"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0, "doc", 1.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n double")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_jaccard_equals_brute_force(spark, odd, none):
    sets = [(i, (w := words(t)) and {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} or set()) for i, t in ODD]
    named = [(i, s) for i, s in sets if i is not None]
    label = {i: i for i, _ in named}
    for _ in range(9):
        for a, s in named:
            for b, t in named:
                if s and t and 100 * len(s & t) >= 80 * len(s | t):
                    label[a] = label[b] = min(label[a], label[b])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark, odd).collect()), key=str)
    assert got == sorted(((i, len(s), None if i is None else label[i]) for i, s in sets), key=str)
    assert jaccard_join.jaccard_components(spark, none).count() == 0


def brute_scores(texts, held, add=0.1, smooth=(20.0, 4.0)):
    """Trigram backoff by dictionaries: (n_tokens, n_known, N, base, score) of each text."""
    tokens = [[*words(t), None] for _, t in texts]
    one, two, three = Counter(), Counter(), Counter()
    for (i, _), w in zip(texts, tokens):
        if not held(i):
            one.update(w)
            two.update(zip([None, *w], w))
            three.update(zip([None, *w], w, w[1:]))
    n, v = sum(one.values()), len(one)
    root = lambda w: (one[w] + add) / (n + add * (v + 1))

    def after(h, w):
        if not h:
            return root(w)
        counts, whole, b = (two, one[h[0]], smooth[0]) if len(h) == 1 else (three, two[h], smooth[1])
        return (counts[(*h, w)] + b * after(h[1:], w)) / (whole + b)

    out = []
    for w in tokens:
        score = math.log10(after((None,), w[0])) + sum(math.log10(after(h, x)) for *h, x in map(tuple, zip([None, *w], w, w[1:])) for h in [tuple(h)])
        out.append((len(w), sum(one[x] > 0 for x in w), n, round(sum(math.log10(root(x)) for x in w), 6), round(score, 6)))
    return out


def test_automaton_equals_brute_force(spark, odd, none):
    held = F.col("doc_id") % 5 == 0
    got = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in ngram_automaton.backoff_scores(spark, odd, held).collect()]
    assert sorted(got) == sorted((str(i), *x) for (i, _), x in zip(ODD, brute_scores(ODD, lambda i: i is not None and i % 5 == 0)))
    assert ngram_automaton.backoff_scores(spark, none, held).count() == 0


def test_automaton_carries_states_through_long_texts(spark):
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(rng.choice(list("abcdefgh"), n))) for i, n in enumerate([3, 511, 512, 513, 1025, 5000, 1, 0])]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in ngram_automaton.backoff_scores(spark, rows, F.col("doc_id") % 2 == 0).collect()}
    assert got == pytest.approx({i: x[4] for (i, _), x in zip(texts, brute_scores(texts, lambda i: i % 2 == 0))})


def test_automaton_leaves_no_shuffle_behind(spark, monkeypatch):
    """What is asked for is twice as much as the texts: words and pairs must be gone from the disk when triples are asked for, and triples when scores are made."""
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(map(str, rng.integers(0, 5000, 400)))) for i in range(200)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    places = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    found = lambda: {p: p.stat().st_size for d in places for p in Path(d).rglob("shuffle_*.data") if p.exists()}
    left, write = [], ngram_automaton.Scratch.table

    def table(self, df):
        there = found()
        back = write(self, df)
        for _ in range(10):  # files go a moment after the run that made them
            if not (size := sum(n for p, n in found().items() if p not in there)):
                break
            time.sleep(0.1)
        left.append(size)
        return back

    monkeypatch.setattr(ngram_automaton.Scratch, "table", table)
    was = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    scores = ngram_automaton.backoff_scores(spark, rows, F.col("doc_id") % 5 == 0)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was
    assert left == [0, 0, 0]
    got = {r["doc_id"]: r["score"] for r in scores.collect()}
    assert got == pytest.approx({i: x[4] for (i, _), x in zip(texts, brute_scores(texts, lambda i: i % 5 == 0))})


def test_automaton_asks_for_each_ngram_in_one_round():
    rng = np.random.default_rng(6)
    vocabulary = np.unique(np.append(rng.integers(0, 1 << 63, 50).astype(np.uint64), ngram_automaton.END))
    tokens, lengths = rng.integers(0, 51, 900), np.array([300, 1, 599])
    row = {"vocabulary": vocabulary.tobytes(), "tokens": tk.squeeze(tokens), "lengths": tk.squeeze(lengths), "held": np.array([False, False, True]).tobytes()}
    whole = list(ngram_automaton.Block(row, 3, 4).sent(3, 4))
    rounds = [list(ngram_automaton.Block(row, 3, 4, kinds).sent(3, 4)) for kinds in ngram_automaton.ROUNDS]
    assert [x for r in rounds for x in r] == whole
    assert [sorted({k for k, *_ in r}) for r in rounds] == [list(range(7)), list(range(7, 11))]


def test_automaton_of_empty_texts_alone(spark):
    texts = [(1, ""), (2, None), (3, " \n")]
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in ngram_automaton.backoff_scores(spark, spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), F.col("doc_id") == 3).collect()]
    assert sorted(got) == [(i, *x) for (i, _), x in zip(texts, brute_scores(texts, lambda i: i == 3))]


def test_weights_of_a_state_sum_to_one():
    """Words 0 and 1 are known, 2 isn't; so are the pairs (0, 0), (0, 1), (1, 0) and one word after each."""
    a = ngram_automaton.Automaton(np.array([4, 3, 0]), np.array([0, 1, 3]), np.array([2, 2, 3]), np.array([1, 3, 6]), np.array([2, 2, 3]), 7, 2, 0.1, (8.0, 1.0))
    for before, last in ((0, 1), (0, 0), (1, 0), (2, 0)):
        tokens = np.array([x for w in range(3) for x in (before, last, w)])
        whole = a.walk(tokens, np.arange(3) * 3, np.full(3, 3), 2)
        head = a.walk(tokens, np.arange(3) * 3, np.full(3, 2), 2)
        assert (10 ** (whole - head)).sum() == pytest.approx(1)


def test_token_files_round_trip(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    token_files.write_token_files(odd, str(tmp_path / "t"), path)
    got = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    ids = {}
    for i, t in ODD:
        ids.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        assert r["ids_crc32"] in [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids[r["doc_id"]]]
    assert [r["doc_id"] for r in got] == sorted([i for i, _ in ODD], key=lambda i: (i is not None, i or 0))
    token_files.write_token_files(none, str(tmp_path / "e"), path)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_select_of_any_offset():
    values = np.cumsum(np.random.default_rng(1).integers(0, 900, 500))
    ef = token_files.EliasFano.of(values)
    assert [int(ef.select(i)[0]) for i in range(500)] == values.tolist()
    assert (len(ef.low) + len(ef.high)) * 8 / 500 < 2 + math.log2(values[-1] / 500) + 1


def test_shards(spark, odd, none):
    def jump(key, n):
        key, b, j = key & (2**64 - 1), -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    rows = jump_shards.assign(spark, odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["shard"] == jump(r["doc_id"] or 0, 8) and r["grown_shard"] == jump(r["doc_id"] or 0, 9)
    for s in range(8):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD}
    assert jump_shards.assign(spark, none).count() == 0


def test_backtracking_equals_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = Counter((r["doc_id"], r["ids"] and bytes(r["ids"]) or b"", r["decoded"]) for r in backtrack_bpe.encode_decode(odd, path).collect())
    want = Counter()
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert backtrack_bpe.encode_decode(none, path, digests=True).count() == 0


def test_special_tokens_in_any_number():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    texts = ["A <|endoftext|>b<|startoftext|>" * 2000, "<|endoftext|>", "<|endoftext|><|endoftext|", "", "<|ENDOFTEXT|> x"]
    ids, bounds = backtrack_bpe.codec(path).encode(texts)
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    rows = [(int(i), (base[i % 30] + rng.normal(size=8) * 0.08).tolist()) for i in range(200)]
    rows += [(200, None), (201, [0.0] * 8), (202, [None] + [1.0] * 7), (203, [float("nan")] * 8), (204, rows[0][1]), (205, rows[0][1]), (206, [1.0, 2.0]), (207, []), (208, [2.0, 4.0])]
    return rows, spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rep string")


def brute_topk(rows, every):
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    asks = {}
    for i, x in whole:
        if i % every == 0:
            asks.setdefault(i, x)
    return {q: [(k + 1, i, -s) for k, (s, i) in enumerate(sorted((-int(x @ y), i) for i, y in whole if i != q and len(y) == len(x))[:5])] for q, x in asks.items()}


def asked(table, **given):
    got = {}
    for r in exact_topk.exact_topk(table, **given).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in got.items()}


def test_topk_equals_brute_force(spark):
    rows, table = vectors(spark)
    want = {q: x for q, x in brute_topk(rows, 10).items() if x}
    assert asked(table, every=10, per_items=64, per_asks=4) == want
    assert exact_topk.exact_topk(table.limit(0)).count() == 0


def test_topk_of_few_repeated_and_null_ids(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (3, [0.5, -0.5]), (3, [0.5, -0.5]), (None, [9.0, 9.0]), (7, [1.0, 2.0, 3.0]), (50, [-1.0, 0.25])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert asked(table) == brute_topk(rows, 50)
    assert [x[1] for x in asked(table)[0]] == [3, 3, 50]


def test_lists_are_not_read_to_their_ends():
    x = np.floor(256 * np.random.default_rng(2).normal(size=(3000, 16)))
    lists, ids = exact_topk.SortedLists(x, np.arange(3000)), np.arange(3000)
    for q in x[:40]:
        score = np.where(ids == 0, -np.inf, x @ q)
        bar = np.sort(score)[-20]  # what another block has found
        assert lists.best(q, 0, bar, 5).tolist() == np.lexsort((ids, -score))[:5].tolist()
    assert 0.1 < lists.read / (40 * x.size) < 0.9


def test_near_duplicates_equal_brute_force(spark):
    rows, table = vectors(spark)
    got = {r["vec_id"]: r for r in multi_index.near_duplicates(spark, table, per_cell=5).collect()}
    whole = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    close = lambda a, b: len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.95
    links = {i: {j for j, y in whole.items() if j != i and close(x, y)} for i, x in whole.items()}
    assert len(got) == len(rows)
    assert all(got[i]["n_links"] <= len(links.get(i, ())) for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * sum(map(len, links.values()))
    assert (got[201]["n_links"], got[201]["component_id"], got[201]["kept"]) == (0, 201, True)
    assert got[206]["n_links"] == 1 and got[208]["component_id"] == 206
    assert multi_index.near_duplicates(spark, table.limit(0)).count() == 0


def test_toxicity_learns_sentences(spark, odd, none):
    rows = [(i, f"Fine words here. You {'idiot' if i % 3 == 0 else 'friend'} of item{i}. The end.", int(i % 3 == 0)) for i in range(120)]
    model = toxicity.train(spark, spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    asked = spark.createDataFrame([(1, "All is well. What an IDIOT he is! Bye."), (2, "All is well."), (3, None), (4, ""), (5, "12 34")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(spark, asked, model).collect()}
    assert [got[i]["predicted"] for i in range(1, 6)] == [1, 0, 0, 0, 0]
    s = got[1]["sentences"][0]
    assert "All is well. What an IDIOT he is! Bye."[s["start"] : s["end"]] == "What an IDIOT he is"
    assert got[3]["score"] == 0
    assert toxicity.score(spark, odd, toxicity.train(spark, none.withColumn("toxic", F.lit(1)))).where("predicted = 1").count() == 0
    assert toxicity.keep_clean(spark, odd, model).count() == len(ODD)


def test_toxicity_of_a_bounded_sample_means_the_same(spark):
    def row(i):
        toxic, word = (int(i % 25 < 2), "grr" if i % 25 in (0, 4, 5) else "idiot" if i % 25 == 1 else "friend")
        return i, f"You {word} there", toxic

    rows = spark.createDataFrame([row(i) for i in range(3000)], "doc_id long, text string, toxic int")
    asked = spark.createDataFrame([(1, "You grr there"), (2, "You idiot there"), (3, "You friend there")], "doc_id long, text string")
    whole, part = ([r["score"] for r in toxicity.score(spark, asked, toxicity.train(spark, rows, most=n)).orderBy("doc_id").collect()] for n in (9000, 600))
    assert whole[0] == pytest.approx(1 / 3, abs=0.05)
    assert part == pytest.approx(whole, abs=0.12)


def test_toxicity_held_out(spark):
    rows = queries.op1_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    said = [r["toxic"] for r in rows if r["predicted"] == 1]
    assert len(said) >= 10 and sum(said) >= 0.9 * len(said)


def test_languages_held_out(spark, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op6_ppm_language(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    model = ppm_language.train(spark, spark.createDataFrame([(1, "abc", "x"), (2, None, "y"), (3, "zz", None)], "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "12!"), (5, "日本")], "doc_id long, text string")
    assert [r["lang_pred"] for r in ppm_language.predict(spark, asked, model).orderBy("doc_id").collect()] == ["x", "und", "und", "und", "x"]
    assert ppm_language.predict(spark, none, ppm_language.train(spark, none)).count() == 0


def brute_bits_in(sample, text, alphabet, seen):
    """Code length under order-3 byte contexts with escapes (method C), by dictionaries; alphabet: symbols in all."""
    counts = {}
    fold = lambda t: [None] * 3 + [b + 32 if 65 <= b <= 90 else b for b in t.encode()]
    for t in sample:
        s = fold(t)
        for k in range(3, len(s)):
            for order in range(4):
                counts.setdefault(tuple(s[k - order : k]), Counter())[s[k]] += 1
    s, bits = fold(text), 0.0
    for k in range(3, len(s)):
        if s[k] not in seen:
            bits += math.log2(256 - len(seen))
        own = s[k] if s[k] in seen else "new"
        for order in (3, 2, 1, 0):
            c = counts.get(tuple(x if x is None or x in seen else "new" for x in s[k - order : k]), Counter())
            n, d = sum(c.values()), len(c)
            if n and c[own]:
                bits += math.log2((n + d) / c[own])
                break
            bits += math.log2((n + d) / d) if n else 0
        else:
            bits += math.log2(alphabet)
    return bits


def test_bits_equal_brute_force(spark):
    """Languages in scripts of their own: every byte counts, and texts of one letter, of bytes never seen, and repeated ones too."""
    own = {"el": ["το σπίτι είναι μεγάλο", "η γάτα κοιμάται εδώ"], "ru": ["мой дядя самых честных правил", "кот спит на диване"], "uk": ["мій дядько найчесніших правил", "кіт спить на дивані"], "en": ["The cat sleeps in the house", "a big house"]}
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in own.items() for t in ts)]
    model = ppm_language.train(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = ["кіт спить у хаті", "кот спит в доме", "σπίτι", "THE big CAT", "日本 cat", "é", "кот"] + ["кот"]
    table = spark.createDataFrame([(i if i != 3 else None, t, "en", 9.0, "r") for i, t in enumerate(asked)], "doc_id long, text string, lang string, score double, rate string")
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in ppm_language.predict(spark, table, model).collect()), key=str)
    every = [t for ts in own.values() for t in ts]
    alphabet = len({b for t in every for b in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode()}) + 2
    known = ppm_language.costs(model)
    for t in asked:
        raw = np.frombuffer(t.encode(), np.uint8)
        before, symbol = ppm_language._codes(raw, np.array([0, len(raw)]), model.symbols, model.size)
        for k, lang in enumerate(model.languages):
            bits = known.tables[k][known.rows[before] * model.size + symbol].astype(float).sum() + known.aside[ppm_language.tk.LOWER[raw]].sum()
            seen = {b for x in every for b in x.lower().encode()}
            assert bits == pytest.approx(brute_bits_in(own[lang], t, alphabet, seen), rel=1e-5), (t, lang)
    assert [x for _, x in got if x == "und"] == [] and dict(got)[0] == "uk" and dict(got)[1] == "ru" and dict(got)[2] == "el" and dict(got)[None] == "en"


def test_mixing(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").when(F.col("doc_id") % 20 == 1, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)))
    plan, t = mixing.plan(spark, docs, max_repetition=2.0)
    rows = plan.collect()
    assert sum(r["weight"] for r in rows) == pytest.approx(1) and max(r["epochs"] for r in rows) <= 2.000001 and min(r["epochs"] for r in rows) >= 0.999999
    mixed = mixing.mix(spark, docs, max_repetition=2.0, block_tokens=5000)
    got = mixed.groupBy("source").agg(F.sum(mixing.token_count(F.col("text"))).alias("n"), F.first("mix_weight").alias("w"), F.countDistinct("doc_id").alias("docs")).collect()
    total = sum(r["n"] for r in got)
    assert all(abs(r["n"] / total - r["w"]) < 0.06 for r in got)
    assert sum(r["docs"] for r in got) == docs.count()
    _, even = mixing.plan(spark, docs, entropy=1.5)
    assert even.entropy == pytest.approx(1.5, abs=1e-4)
    assert mixing.mix(spark, odd, max_repetition=2.0).count() == len(ODD)
    assert mixing.mix(spark, none).count() == 0


def test_pipeline_on_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    left = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_unknown_language(spark, docs, SF), SF)
    assert left.columns == docs.columns
    ids = sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None)
    assert ids == [1, 8, 10, 12, 14, 15]


def test_language_stage_rejects_what_was_not_learnt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz      "), n)).strip() + "qx" for n in (40, 400, 4000)]
    strange = [
        "Litwo, ojczyzno moja, ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił.", "Мой дядя самых честных правил, когда не в шутку занемог",
        "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan, saa'ani sanelemahan", "日本語の文章はこのように書かれています。", *noise,
    ]
    more = spark.createDataFrame([(-i - 1, t, None, "s", len(t)) for i, t in enumerate(strange)], "doc_id long, text string, lang string, source string, n_chars long")
    left = [r["doc_id"] for r in corpus_pipeline.drop_unknown_language(spark, docs.unionByName(more, allowMissingColumns=True), SF).collect()]
    assert not [i for i in left if i < 0]
    assert len(left) == docs.where("text rlike '[a-zA-Z]'").count()


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) >= 100 and {"doc_id", "n_tokens"} <= set(rows[0].asDict())
