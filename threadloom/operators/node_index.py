"""An index of nodes by coarse cells, for exact top-k by vector.

Centres are fitted on a bounded sample; every node is stored in the folder of its nearest centre's cell,
and each cell knows how far its farthest member is. A question first reads the cell nearest to it; its
k-th score there is a bar. By the triangle inequality no member of a cell is nearer to a query than the
distance of the centre less the cell's radius, so that only cells that may hold a score over the bar are
read after that. Scores are reduced to the best k of each question before they are shuffled.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.retrieve import top
from threadloom.plans.lineage import cut, shared_dir

NODE = "ordinal long, name string, entity_type string, embedding array<double>"
_EPS = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    values = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors by their length, 1e-8 at least, so that a zero vector has cosine 0 with all."""
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-8)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T, 0))


def fit(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of a sample of unit vectors, the first ones spread over it; a centre that loses all of its vectors stays where it is."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)] if len(sample) else np.zeros((0, 0))
    for _ in range(rounds if len(sample) else 0):
        own = _distances(sample, centres).argmin(1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _celled(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_unit(_matrix(batch.column("embedding"))), centres) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], [*batch.schema.names, "cell", "far"])

    return run


def _grouped(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Query vectors of a table in order of question, their types, and where each question begins."""
    questions = np.asarray(part.column("question_id"))
    order = np.argsort(questions, kind="stable")
    firsts = np.flatnonzero(np.concatenate([[True], questions[order][1:] != questions[order][:-1]]))
    return _unit(_matrix(part.column("query_vec")))[order], np.asarray(part.column("query_type").to_pylist(), object)[order], firsts, questions[order][firsts].tolist()


def _best(k: int, weight: float):
    """The k best nodes of a group for each question that reads it."""

    def run(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("question_id", pa.int64()), ("ordinal", pa.int64()), ("name", pa.string()), ("entity_type", pa.string()), ("score", pa.float64())])
        if not nodes.num_rows or not asked.num_rows:
            return schema.empty_table()
        vectors, types, firsts, questions = _grouped(asked)
        unit, ordinal = _unit(_matrix(nodes.column("embedding"))), np.asarray(nodes.column("ordinal"))
        kind = np.asarray(["unknown" if t is None else t for t in nodes.column("entity_type").to_pylist()], object)
        out = []
        for a in range(0, len(firsts), 64):  # a block of questions at a time
            own = firsts[a : a + 64]
            end = firsts[a + 64] if a + 64 < len(firsts) else len(vectors)
            scores = (1 - weight) * (vectors[own[0] : end] @ unit.T) + weight * (types[own[0] : end, None] == kind)
            scores = np.round(np.maximum(np.maximum.reduceat(scores, own - own[0]), 0.0), 6)
            for q, row in zip(questions[a : a + 64], scores):
                keep = np.lexsort((ordinal, -row))[:k]
                part = nodes.select(["ordinal", "name", "entity_type"]).take(pa.array(keep))
                out.append(part.add_column(0, "question_id", pa.array(np.full(len(keep), q, np.int64))).append_column("score", pa.array(row[keep])))
        return pa.concat_tables(out).cast(schema)

    return run


class NodeIndex:
    """An index in a folder that all executors share; `build` writes it, `search` reads it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_INDEX")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        at, fs = self._file()
        return fs.exists(at)

    def build(self, nodes: DataFrame, cells: int | None = None, sample: int = 20_000, per_part: int = 50_000) -> NodeIndex:
        """Stores nodes (ordinal, name, entity_type, embedding), those without a vector left out; all vectors have one length.

        Centres, the square root of the number of nodes unless given and 4,096 at most, are fitted on `sample` vectors by hash; every node is
        indexed. A cell of more than `per_part` nodes is dealt into parts, so that no group holds a crowded cell.
        """
        rows = nodes.where("embedding is not null").select("ordinal", "name", "entity_type", F.col("embedding").cast("array<double>").alias("embedding"))
        n = rows.count()
        share = min(1.0, sample / max(n, 1))
        picked = rows.where(F.pmod(F.xxhash64("ordinal", "name"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("embedding").limit(2 * sample).toArrow()
        centres = fit(_unit(_matrix(picked.column("embedding"))), min(4096, cells or int(n**0.5) + 1)) if picked.num_rows else np.zeros((1, 1))
        schema = f"{NODE}, cell int, far double"
        celled = rows.mapInArrow(_celled(centres), schema) if n else self.spark.createDataFrame([], schema)
        celled.withColumn("part", F.pmod(F.xxhash64("ordinal", "name"), F.lit(1 << 30)).cast("int")).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/nodes")
        stored = self._nodes()
        radius = {r["cell"]: (r["n"], r["far"]) for r in stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row for each cell
        told = [{"cell": c, "n": m, "far": far, "parts": -(-m // per_part), "centre": centres[c].tolist()} for c, (m, far) in sorted(radius.items())]
        at, fs = self._file()
        stream = fs.create(at, True)
        stream.write(bytearray(json.dumps(told).encode()))
        stream.close()
        return self

    def _nodes(self) -> DataFrame:
        return self.spark.read.schema(f"{NODE}, far double, part int, cell int").parquet(f"{self.path}/nodes")

    def cells(self) -> list[dict]:
        at, fs = self._file()
        stream = fs.open(at)
        said = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(said)

    def _bounds(self, questions: DataFrame, weight: float) -> DataFrame:
        """(question_id, cell, bound, place): the greatest score that a cell can hold for a question, best first. As many rows as questions times cells."""
        told = self.cells()
        centres, far, names = np.array([c["centre"] for c in told]), np.array([c["far"] for c in told]), np.array([c["cell"] for c in told], np.int32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = _unit(_matrix(batch.column("query_vec")))
                near = np.maximum(_distances(unit, centres) - far, 0)
                cosine = np.minimum((1 + (unit * unit).sum(1)[:, None] - near**2) / 2, 1.0)
                bound = (1 - weight) * cosine + weight + _EPS
                n = len(names)
                yield pa.RecordBatch.from_arrays([batch.column("question_id").take(pa.array(np.repeat(np.arange(len(unit)), n))), pa.array(np.tile(names, len(unit))), pa.array(bound.ravel())], ["question_id", "cell", "bound"])

        rows = questions.select(F.col("question_id").cast("long").alias("question_id"), F.col("query_vec").cast("array<double>").alias("query_vec")).mapInArrow(run, "question_id long, cell int, bound double")
        return rows.groupBy("question_id", "cell").agg(F.max("bound").alias("bound"))

    def _scored(self, pairs: DataFrame, questions: DataFrame, k: int, weight: float) -> DataFrame:
        """The k best nodes of each question in each part of the cells that it reads (question_id, cell)."""
        told = self.spark.createDataFrame([(c["cell"], c["parts"]) for c in self.cells()], "cell int, parts int")
        asked = pairs.join(told, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(questions.select(F.col("question_id").cast("long").alias("question_id"), F.coalesce("query_type", F.lit("unknown")).alias("query_type"), F.col("query_vec").cast("array<double>").alias("query_vec")), "question_id")
        read = [r[0] for r in pairs.select("cell").distinct().collect()]  # cells, 4,096 at most: only their folders are read
        nodes = self._nodes().where(F.col("cell").isin(read)).join(F.broadcast(told), "cell").withColumn("part", F.pmod("part", "parts").cast("int")).select("ordinal", "name", "entity_type", "embedding", "cell", "part")
        return nodes.groupBy("cell", "part").cogroup(asked.select("question_id", "query_type", "query_vec", "cell", "part").groupBy("cell", "part")).applyInArrow(_best(k, weight), "question_id long, ordinal long, name string, entity_type string, score double")

    def search(self, questions: DataFrame, k: int = 8, type_weight: float = 0.3) -> DataFrame:
        """The k best nodes of each question (question_id, query_type, query_vec, a row for each of its vectors): question_id, ordinal, name, entity_type, score, rank.

        Equal to `entity_scores` over all nodes followed by `top_entities`. After it, `pairs_read` is the number of pairs of a
        question and a node that were scored, and `pairs_all` that of all pairs.
        """
        told = self.cells()
        if not told:
            return self.spark.createDataFrame([], "question_id long, ordinal long, name string, entity_type string, score double, rank int")
        questions = cut(questions.where("query_vec is not null"))
        bounds = cut(self._bounds(questions, type_weight))
        sizes = self.spark.createDataFrame([(c["cell"], c["n"]) for c in told], "cell int, n long")
        # cells in order of their bounds, as many as hold k nodes
        placed = bounds.join(sizes, "cell").withColumn("ahead", F.expr("sum(n) over (partition by question_id order by bound desc, cell rows between unbounded preceding and 1 preceding)"))
        first = cut(placed.where(F.coalesce("ahead", F.lit(0)) < k).select("question_id", "cell"))
        found = cut(top(self._scored(first, questions, k, type_weight), [F.desc("score"), F.col("ordinal")], k))
        bar = found.groupBy("question_id").agg(F.count("*").alias("have"), F.min("score").alias("bar"))
        rest = bounds.join(first, ["question_id", "cell"], "left_anti").join(bar, "question_id").where((F.col("have") < k) | (F.col("bound") >= F.col("bar") - _EPS))
        rest = cut(rest.select("question_id", "cell"))
        whole = found.drop("rank").union(self._scored(rest, questions, k, type_weight))
        self.pairs_read = first.union(rest).join(sizes, "cell").agg(F.sum("n")).first()[0] or 0
        self.pairs_all = questions.select("question_id").distinct().count() * sum(c["n"] for c in told)
        return top(whole, [F.desc("score"), F.col("ordinal")], k)


def scratch_index(spark: SparkSession, nodes: DataFrame, **given) -> NodeIndex:
    """An index of a query's own nodes in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/threadloom/index-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return NodeIndex(spark, path).build(nodes, **given)

