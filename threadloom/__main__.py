"""python -m threadloom: brings a memory up to date from a folder of sessions, asks it the folder's questions, writes answers and measures."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from threadloom.operators import extract
from threadloom.plans.config import Config
from threadloom.plans.lineage import cut
from threadloom.plans.memory import Memory
from threadloom.sources import corpus


def named(path: str):
    """What `module:name` names: a class or function without arguments that makes a model."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="threadloom", description=__doc__)
    p.add_argument("--settings", help="YAML of settings; defaults without")
    p.add_argument("--mode", choices=("load", "add", "force"), help="over the settings' mode")
    p.add_argument("--data", required=True, help="folder with Corpus.json and, for questions, Question.json")
    p.add_argument("--store", required=True, help="folder of the memory")
    p.add_argument("--out", help="folder for results and metrics; without it no question is asked")
    p.add_argument("--model", help="module:name of the text model")
    p.add_argument("--query-model", help="module:name of the model for questions; the same one without")
    p.add_argument("--embedder", help="module:name of the embedding model")
    return p


def run(spark: SparkSession, arguments: list[str] | None = None) -> int:
    """Returns the version of the memory. A mode of `load` reads no sessions."""
    a = parser().parse_args(arguments)
    config = Config.parse(a.settings, **({"mode": a.mode} if a.mode else {}))
    made = [named(x) if x else None for x in (a.model, a.embedder, a.query_model)]
    memory = Memory(spark, a.store, config, made[0] or extract.EchoGenerator, made[1], made[2])
    version = memory.insert(None if config.mode == "load" else corpus.read_sessions(spark, f"{a.data}/Corpus.json"))
    if a.out:
        results = cut(memory.query(corpus.read_questions(spark, f"{a.data}/Question.json")))
        corpus.write_lines(results, f"{a.out}/results")
        corpus.write_lines(memory.evaluate(results), f"{a.out}/metrics")
    return version


if __name__ == "__main__":
    run(SparkSession.builder.appName("threadloom").getOrCreate())
