"""A corpus made ready for training: clean, in known languages, without near copies, mixed, encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import backtrack_bpe, jaccard_join, mixing, ppm_language, toxicity
from threadloom.llm.queries import read, tokenizer_path
from threadloom.llm.workdir import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text isn't predicted toxic; the model learns from all labels of the rows at hand."""
    return toxicity.keep_clean(spark, docs, toxicity.train(spark, docs, read(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a predicted language, and costs it no more than its labelled texts do."""
    model = ppm_language.train(spark, docs)
    return ppm_language.keep_known(spark, docs, model, ppm_language.bounds(spark, docs, model))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id; rows without words or without a doc_id stay."""
    return jaccard_join.one_of_each(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once, and rows of small sources again, no source more than twice; block after block of the mixture."""
    return mixing.in_order(mixing.mix(spark, docs, max_repetition=2.0)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each row's ids and decoded text."""
    return backtrack_bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json"), digests=True)


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("near_copies", drop_near_copies), ("mixing", mix_sources), ("encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
