"""What the language model learns from rows that share a doc_id, have none, or are alike."""

import numpy as np
import pytest

from threadloom.llm import ppm_language, queries, token_files

DOC = "doc_id long, text string, lang string"


@pytest.mark.parametrize("doc_id", [1, 4, None])
def test_rows_that_share_a_doc_id_are_all_learnt_within_the_bound(spark, doc_id):
    rows = [(doc_id, f"the {k} and", "en") for k in range(50)] + [(doc_id, f"der {k} und", "de") for k in range(3000)] + [(doc_id, "el mismo texto", "es")] * 3000
    model = ppm_language.train(spark, spark.createDataFrame(rows, DOC), per_language=1000)
    assert model.languages == ["de", "en", "es"]
    # every text has as many contexts of length 0 as bytes: their number tells how many texts were learnt
    told = {}
    for lang, codes, n in zip(model.languages, model.grams, model.counts):
        told[lang] = int(np.sum(n))
    per_text = {lang: told_of(spark, [r for r in rows if r[2] == lang][:1]) for lang in told}
    assert told["es"] == per_text["es"]  # alike in all: once
    assert told["en"] > 45 * per_text["en"] and 900 * per_text["de"] < told["de"] <= 1001 * told_of(spark, [(1, "der 9999 und", "de")])


def told_of(spark, rows):
    return int(sum(np.sum(n) for n in ppm_language.train(spark, spark.createDataFrame(rows, DOC)).counts))


def test_token_files_set_their_own_batch_limits(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    docs = spark.createDataFrame([(k, "some words " * k, "en") for k in range(9)], DOC)
    token_files.write_token_files(docs, str(tmp_path / "f"), queries.tokenizer_path("byte_bpe_50k.json"))
    assert int(spark.conf.get(name)) <= 1000 and token_files.read_token_files(spark, str(tmp_path / "f")).count() == 9
    spark.conf.set(name, before)
