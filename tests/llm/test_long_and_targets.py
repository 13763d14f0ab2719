"""Very long texts, repeated rows and clashing names through the operators on texts; blocks and targets of mixing."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import backtrack_bpe, jaccard_join, jump_shards, mixing, ppm_language, queries, token_files, toxicity

LONG = " ".join(f"word{k % 5003} goes on." for k in range(150_000))  # about 2.9 MB: over every slice in which texts are worked on
ROWS = [(1, LONG), (2, "short words here now again"), (2, "short words here now again"), (3, LONG + " You grr there"), (None, "You grr there"), (4, None), (5, "")]


@pytest.fixture(scope="module")
def long(spark):
    rows = [(i, t, 0.5, 1, "k", b"b", 7) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int, key string, bucket binary, n_tokens int").repartition(3)


def got(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows.collect()), key=str)


def test_toxicity_finds_the_last_sentence_of_a_long_text(spark, long):
    known = spark.createDataFrame([(i, "You grr there" if i % 3 == 0 else f"You friend of item{i}", int(i % 3 == 0)) for i in range(120)], "doc_id long, text string, toxic int")
    model = toxicity.train(spark, known)
    rows = toxicity.score(spark, long, model)
    assert got(rows, "doc_id", "predicted") == sorted([(1, 0), (2, 0), (2, 0), (3, 1), (None, 1), (4, 0), (5, 0)], key=str)
    found = next(r for r in rows.collect() if r["doc_id"] == 3)["sentences"]
    assert [(s["start"], s["end"]) for s in found] == [(len(LONG) + 1, len(LONG) + 14)]
    kept = toxicity.keep_clean(spark, long, model)
    assert kept.columns == long.columns and got(kept, "doc_id") == sorted([(1,), (2,), (2,), (4,), (5,)], key=str)


def test_languages_of_long_repeated_and_clashing_rows(spark, long):
    learnt = spark.createDataFrame([(1, "short words go on here", "en"), (2, "ünd öde wärme größe", "de"), (2, "ünd öde wärme größe", "de")], "doc_id long, text string, lang string")
    rows = ppm_language.predict(spark, long, ppm_language.train(spark, learnt))
    assert got(rows, "doc_id", "lang_pred") == sorted([(1, "en"), (2, "en"), (2, "en"), (3, "en"), (None, "en"), (4, "und"), (5, "und")], key=str)
    assert all(0 <= r["score"] <= 1 for r in rows.collect())


def test_tokens_of_long_texts(spark, long, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library, want = Tokenizer.from_file(path), []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode())]
        want.append((i, len(ids), *sha))
    rows = backtrack_bpe.encode_decode(long.select("doc_id", "text"), path, digests=True)
    assert got(rows, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    token_files.write_token_files(long, str(tmp_path / "t"), path)
    want = []
    for i, t in ROWS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert got(token_files.read_token_files(spark, str(tmp_path / "t")), "doc_id", "n_tokens", "ids_crc32") == sorted(want, key=str)


def test_shards_and_sets_of_long_texts(spark, long):
    assert got(jump_shards.assign(spark, long), "doc_id", "size") == sorted([(i, len(t or "") + 1) for i, t in ROWS], key=str)
    n = len({tuple(w) for w in zip(*(LONG.split()[k:] for k in range(5)))})
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark, long).collect()}
    assert rows[1] == (n, 1) and rows[3][1] == 1 and rows[2] == (1, 2) and rows[4] == (0, 4)


def sources(spark):
    sizes = {"a": 3000, "b": 900, "c": 300}
    rows = [(k * 10_000 + i, f"w{i} x y z", k) for k, s in enumerate(sizes) for i in range(sizes[s])]
    names = F.element_at(F.array(*map(F.lit, sizes)), F.col("k") + 1)
    return spark.createDataFrame(rows, "doc_id long, text string, k int").withColumn("source", names).withColumn("mix_block", F.lit("mine")).withColumn("draw", F.lit(0))


def test_every_block_has_the_target_weights(spark):
    docs = sources(spark)
    mixed = mixing.mix(spark, docs, max_repetition=2.0, block_tokens=4000)
    assert set(mixed.columns) == {*docs.columns, "mix_weight", "mix_epoch"}
    rows = mixed.groupBy("mix_block", "source").agg(F.sum(mixing.token_count(F.col("text"))).alias("n"), F.first("mix_weight").alias("w")).collect()
    whole = {}
    for r in rows:
        whole[r["mix_block"]] = whole.get(r["mix_block"], 0) + r["n"]
    assert len(whole) >= 4
    assert all(abs(r["n"] / whole[r["mix_block"]] - r["w"]) < 0.05 for r in rows)
    again = mixing.mix(spark, docs, max_repetition=2.0, block_tokens=4000)
    assert got(mixed, "doc_id", "mix_epoch", "mix_block") == got(again, "doc_id", "mix_epoch", "mix_block")


@pytest.mark.parametrize("budget", [5_000, 20_000])
def test_a_budget_is_spent(spark, budget):
    mixed = mixing.mix(spark, sources(spark), max_repetition=2.0, budget=float(budget))
    assert mixed.agg(F.sum(mixing.token_count(F.col("text")))).first()[0] == pytest.approx(budget, rel=0.01)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


@pytest.mark.parametrize("target", [{"entropy": 1.2}, {"max_repetition": 2.0, "budget": 40_000.0}, {"max_repetition": 0.5}])
def test_targets_out_of_reach_are_errors(spark, target):
    with pytest.raises(ValueError):
        mixing.plan(spark, sources(spark), **target)


def test_the_greatest_entropy_is_that_of_equal_weights(spark):
    plan, t = mixing.plan(spark, sources(spark), entropy=math.log(3))
    assert t.exponent == 0 and all(r["weight"] == pytest.approx(1 / 3) for r in plan.collect())


def test_blocks_come_in_order(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    mixed = mixing.in_order(mixing.mix(spark, sources(spark), max_repetition=2.0, block_tokens=4000))
    rows = mixed.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "mix_block", "source").orderBy("place").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = [r["mix_block"] for r in rows]
    assert blocks == sorted(blocks) and len({r["part"] for r in rows}) > 1
    turns = sum(a["source"] != b["source"] for a, b in zip(rows, rows[1:]))
    assert turns > len(rows) / 4  # sources alternate within a block
    assert mixing.in_order(mixed.limit(0)).count() == 0
