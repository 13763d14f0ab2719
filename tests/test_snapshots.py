"""Additions write what they touch; the tables read the same as if written whole."""

import pathlib

import pytest
from pyspark.sql import functions as F

from threadloom.plans.config import Config
from threadloom.plans.memory import Memory
from threadloom.sources.snapshots import KEYS, TABLES, Snapshots

NODE = "ordinal long, name string, entity_type string"


class Says:
    """Relations as a dialogue tells them: `A does B`."""

    def generate(self, prompts):
        out = []
        for p in prompts:
            lines = [line.partition(": ")[2].split() for line in p.rpartition("Dialogue:\n")[2].splitlines()]
            out.append("##".join(f'("entity"|{n}|person|x)##' for w in lines if len(w) == 3 for n in (w[0], w[2])) + "##".join(f'("relationship"||S|{w[0]}|{w[2]}|{w[1]}|5)' for w in lines if len(w) == 3) or "END")
        return out


def sessions(spark, *said):
    return spark.createDataFrame([(k, f"S{k}" if len(x) < 30 else "long", "", f'"user": "{x}"') for k, x in said], "doc_id long, session_id string, session_time string, context string")


def size(path):
    return sum(p.stat().st_size for p in pathlib.Path(path).rglob("*.parquet"))


def test_merge_on_read_equals_a_dictionary(spark, tmp_path):
    store, want = Snapshots(spark, str(tmp_path / "m"), buckets=3), {}
    for version in range(4):
        rows = [(version * 100 + k, f"n{(7 * k + version) % 12}", f"t{version}") for k in range(5 if version else 12)]
        want |= {r[1]: r for r in rows}
        df = spark.createDataFrame(rows, NODE)
        store.write({"nodes": df}, 0, next_chunk=0) if version == 0 else store.append({"nodes": df}, version, version - 1, {}, 0)
        got = store.read()["nodes"]
        assert got.columns == [f.split()[0] for f in TABLES["nodes"].split(", ")]
        assert sorted((r["ordinal"], r["name"], r["entity_type"]) for r in got.collect()) == sorted(want.values())
    asked = spark.createDataFrame([("n3",), ("n5",), ("none",), ("n3",)], "name string")
    assert sorted(r["name"] for r in store.touched("nodes", asked, 3).collect()) == ["n3", "n5"]
    assert store.read(1)["nodes"].where("entity_type = 't3'").isEmpty()  # earlier versions stay as they were
    assert store.compact(3) == 4
    store.keep_only(4)
    assert sorted((r["ordinal"], r["name"], r["entity_type"]) for r in store.read()["nodes"].collect()) == sorted(want.values())
    assert store.versions() == [4] and store.read()["edges"].isEmpty() and not (tmp_path / "m/v=0").exists()


def test_touched_reads_only_its_buckets(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "m"), buckets=8)
    store.write({"nodes": spark.range(400).select(F.col("id").alias("ordinal"), F.concat(F.lit("n"), "id").alias("name"), F.lit("t").alias("entity_type"))}, 0, next_chunk=0)
    found = store.touched("nodes", spark.createDataFrame([("n7",)], "name string"), 0)
    files = {r[0] for r in found.select(F.input_file_name()).collect()}
    assert found.count() == 1 and len(files) == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.partition("PartitionFilters")[2].partition("]")[0]


def test_bytes_of_an_addition_do_not_grow_with_the_memory(spark, tmp_path):
    written = []
    for n in (30, 1500):
        m = Memory(spark, str(tmp_path / f"m{n}"), Config(store_buckets=4), generator=Says)
        m.build(sessions(spark, *((k, f"P{k} meets Q{k}") for k in range(n))))
        m.add(sessions(spark, (n, "P1 likes Q1")))
        whole, added = size(tmp_path / f"m{n}/v=0"), size(tmp_path / f"m{n}/v=1")
        written.append(added)
        assert n < 100 or added < whole / 10
        tables = m.store.read()
        assert tables["nodes"].count() == 2 * n and tables["chunks"].count() == n + 1 and tables["summaries"].count() == n + 1
        assert tables["edges"].where("src = 'P1'").first()["session_ids"] == [f"S{n}"]
    assert written[1] < 1.2 * written[0]


@pytest.fixture
def seen(tmp_path):
    folder = tmp_path / "embedded"
    folder.mkdir()
    return folder


def test_an_addition_embeds_new_texts_only(spark, tmp_path, seen):
    where = str(seen)

    class Noting:
        def embed(self, texts):
            import pathlib
            import uuid

            pathlib.Path(where, uuid.uuid4().hex).write_text("\n".join(t.replace("\n", " ") for t in texts))
            return [[1.0, float(len(t))] for t in texts]

    def noted():
        out = sorted(line for p in seen.iterdir() for line in p.read_text().splitlines())
        for p in seen.iterdir():
            p.unlink()
        return out

    m = Memory(spark, str(tmp_path / "m"), Config(compact_after=2, store_buckets=2), generator=Says, embedder=Noting)
    m.build(sessions(spark, (0, "Ann sees Bob"), (1, "Bob sees Cid")))
    assert {x for x in noted() if not x.startswith("Session")} == {"Ann (person): x", "Bob (person): x", "Cid (person): x", "Ann - sees - Bob", "Bob - sees - Cid"}
    assert m.add(sessions(spark, (2, "Ann sees Cid"))) == 1
    assert {x for x in noted() if not x.startswith("Session")} == {"Ann - sees - Cid"}
    assert m.store.read()["nodes"].where("embedding is null").isEmpty()
    assert m.add(sessions(spark, (3, "Ann sees Cid"))) == 3  # folded: the third segment is over the bound
    assert all(len(x) == 1 for x in m.store.manifest(3)["segments"].values())
    edges = {(r["src"], r["tgt"]): r for r in m.store.read()["edges"].collect()}
    assert len(edges) == 3 and edges["Ann", "Cid"]["chunk_ids"] == [2, 3]
    assert set(KEYS) == set(TABLES)
