"""Snapshots of a memory: versions of Parquet tables that share their files, merged on reading.

A version's folder holds what it wrote itself: whole tables, or only the rows that changed since the
version before (a delta row is a whole new row of its key). Its mark names the segments that make up
each table, oldest first, so that an addition writes in proportion to itself. Rows lie in folders by a
hash of their key; what an addition has to look at is read from the buckets of its own keys alone. A
compaction folds the segments of each table into one.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES = {
    "chunks": "chunk_id long, doc_id long, title string, session_id string, session_time string, chunk_idx int, n_turns int, text string",
    "nodes": "ordinal long, name string, entity_type string, chunk_id long, extracted boolean, description string, embedding array<double>",
    "edges": "ordinal long, src string, tgt string, relation string, session_id string, session_time string, chunk_id long, chunk_ids array<long>, session_ids array<string>, session_times array<string>, strength int, weight double, embedding array<double>",
    "summaries": "session_id string, session_time string, keys string, context map<string,string>, summary_status string, embedding array<double>",
}


#: what a row of each table is found by; chunks are only ever added
KEYS = {"chunks": ["chunk_id"], "nodes": ["name"], "edges": ["src", "tgt"], "summaries": ["session_id"]}


class Snapshots:
    """A version is complete once it has its mark: its segments, the next chunk's id, and which stream batches are in it.

    buckets: into how many folders a full version deals its rows; the versions that build on it keep that number.
    """

    def __init__(self, spark: SparkSession, base: str, buckets: int = 16):
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _mark(self, version: int):
        return self._fs(f"{self.base}/v={version}/_DONE")

    def versions(self) -> list[int]:
        path, fs = self._fs(self.base)
        if not fs.exists(path):
            return []
        found = [int(n[2:]) for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.startswith("v=")]
        return sorted(v for v in found if self._mark(v)[1].exists(self._mark(v)[0]))

    def manifest(self, version: int | None) -> dict:
        """Segments of each table, buckets, next chunk and stream batches of a version; of no version, nothing."""
        if version is None:
            return {"segments": {}, "buckets": self.buckets, "next_chunk": 0, "batches": {}}
        path, fs = self._mark(version)
        stream = fs.open(path)
        said = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(said)

    def batches(self, version: int | None) -> dict[str, int]:
        """The last batch of each stream that a version holds."""
        return self.manifest(version)["batches"]

    @staticmethod
    def _bucket(name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*KEYS[name]), F.lit(buckets)).cast("int")

    def _write(self, tables: dict[str, DataFrame], version: int, manifest: dict) -> None:
        path, fs = self._mark(version)
        fs.delete(path, True)
        for name, df in tables.items():
            dealt = df.withColumn("bucket", self._bucket(name, manifest["buckets"]))
            # files of a bucket: as many as its size asks for
            dealt.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/v={version}/{name}")
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()

    def write(self, tables: dict[str, DataFrame], version: int, batches: dict[str, int] | None = None, next_chunk: int | None = None, counts: dict | None = None) -> None:
        """Writes whole tables. A version that is written again isn't complete until its tables are."""
        if next_chunk is None:
            top = tables["chunks"].agg(F.max("chunk_id")).first()[0] if "chunks" in tables else None
            next_chunk = 0 if top is None else top + 1
        self._write(tables, version, {"segments": {name: [version] for name in tables}, "buckets": self.buckets, "next_chunk": next_chunk, "batches": batches or {}, "counts": counts or {}})

    def append(self, tables: dict[str, DataFrame], version: int, onto: int | None, batches: dict[str, int], next_chunk: int, counts: dict | None = None) -> None:
        """Writes a version that is `onto` with the given rows added, or put in the place of those of the same keys. counts: kept in its manifest."""
        old = self.manifest(onto)
        segments = {name: [*old["segments"].get(name, []), *([version] if name in tables else [])] for name in TABLES}
        self._write(tables, version, {"segments": segments, "buckets": old["buckets"], "next_chunk": next_chunk, "batches": batches, "counts": counts or {}})

    def compact(self, version: int) -> int:
        """Folds the segments of each table of a version into one, as the next version, which is returned."""
        old = self.manifest(version)
        self.write(self.read(version), version + 1, old["batches"], old["next_chunk"], old.get("counts"))
        return version + 1

    def _segment(self, name: str, segment: int, buckets: list[int] | None) -> DataFrame:
        rows = self.spark.read.schema(f"{TABLES[name]}, bucket int").parquet(f"{self.base}/v={segment}/{name}")
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket").withColumn("_segment", F.lit(segment))

    def _merged(self, name: str, version: int | None, buckets: list[int] | None = None) -> DataFrame:
        """A table as of a version: of each key the row of the last segment that has it."""
        parts = [self._segment(name, k, buckets) for k in self.manifest(version)["segments"].get(name, [])]
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        base, deltas = parts[0], parts[1:]
        if not deltas:
            return base.drop("_segment")
        if name == "chunks":
            return reduce(DataFrame.union, parts).drop("_segment")
        last = Window.partitionBy(*KEYS[name]).orderBy(F.desc("_segment"))
        deltas = reduce(DataFrame.union, deltas).withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")
        return base.join(deltas.select(*KEYS[name]), KEYS[name], "left_anti").select(*base.columns).union(deltas).drop("_segment")

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """Tables of a version, the newest by default; a table or column that is missing is empty, and so is every table before the first version."""
        version = version if version is not None else max(self.versions(), default=None)
        return {name: self._merged(name, version) for name in TABLES}

    def touched(self, name: str, rows: DataFrame, version: int | None) -> DataFrame:
        """The stored rows with the keys of `rows`, read from their buckets alone."""
        keys = rows.select(*KEYS[name]).distinct()
        buckets = [r[0] for r in keys.select(self._bucket(name, self.manifest(version)["buckets"])).distinct().collect()]  # as many as there are buckets, at most
        return self._merged(name, version, buckets).join(keys, KEYS[name], "left_semi")

    def load(self) -> dict[str, DataFrame]:
        """Tables of the newest version; an error if there is none."""
        if not self.versions():
            raise FileNotFoundError(f"no complete memory in {self.base}")
        return self.read()

    def keep_only(self, version: int) -> None:
        """Deletes all other versions, complete or not, but for segments that this one reads."""
        path, fs = self._fs(self.base)
        used = {version, *(k for parts in self.manifest(version)["segments"].values() for k in parts)}
        for s in fs.listStatus(path):
            name = s.getPath().getName()
            if not name.startswith("v="):
                continue
            if name not in {f"v={k}" for k in used}:
                fs.delete(s.getPath(), True)
            elif name != f"v={version}":
                fs.delete(self._mark(int(name[2:]))[0], True)
