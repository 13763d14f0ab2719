"""Temperature mixing of sources to target weights.

A source with a share p of all tokens gets the weight p^a / sum of p^a. The exponent a is found by bisection so that
the weights reach a target entropy, or so that no source is repeated more than a limit. Weights are then
realised under a token budget: a source with weight w is read w * budget / tokens times, in whole
epochs and a last partial one; each epoch is a permutation of the source's documents by hash, and all
epochs are spread evenly over blocks, so that every block has nearly the target weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.workdir import Scratch, buckets_for

_TOP = float(1 << 63)
TOKEN = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


@dataclass
class Temperature:
    """An exponent and what it does: sum of p^a, its entropy, tokens to spend, and the most repetitions."""

    exponent: float
    norm: float
    entropy: float
    budget: float
    repetition: float


def _judged(totals: DataFrame, exponents: list[float], budget: float | None) -> list[Temperature]:
    """What each exponent does, in one pass over the sources."""
    aggs = [F.min("p").alias("least"), F.max("p").alias("most"), F.min("total").alias("total")]
    for k, a in enumerate(exponents):
        aggs += [F.sum(F.pow("p", F.lit(a))).alias(f"z{k}"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"s{k}")]
    r = totals.agg(*aggs).first()
    out = []
    for k, a in enumerate(exponents):
        z = r[f"z{k}"]
        spend = budget if budget is not None else r["total"] * z * max(r["most"] ** (1 - a), r["least"] ** (1 - a))
        out.append(Temperature(a, z, math.log(z) - a * r[f"s{k}"] / z, spend, spend / (r["total"] * z) * max(r["least"] ** (a - 1), r["most"] ** (a - 1))))
    return out


def temperature(totals: DataFrame, max_repetition: float | None = 2.0, entropy: float | None = None, budget: float | None = None, rounds: int = 6, points: int = 16) -> Temperature:
    """The least exponent that repeats no source more than max_repetition times (1 at most), or whose weights have the entropy (in nats; 64 at most).

    totals: p and total of each source with tokens. Each round narrows the bracket `points` + 1 fold in
    one distributed pass. A target that no exponent meets is a ValueError: an entropy over that of equal
    weights or under what an exponent of 64 gives, or a budget of more than max_repetition times all
    tokens. Without a budget it is the least that reads every source once at least.
    """
    good = (lambda t: t.entropy <= entropy) if entropy is not None else (lambda t: t.repetition <= max_repetition)
    low, high = 0.0, 1.0
    first, last = _judged(totals, [low, high], budget)
    if good(first):
        if entropy is not None and first.entropy < entropy - 1e-6:
            raise ValueError(f"no weights of these sources have an entropy of {entropy}; equal ones have {first.entropy}")
        return first
    if not good(last) and entropy is not None:  # less entropy than the sources have needs an exponent over 1
        for t in _judged(totals, [2.0**k for k in range(1, 7)], budget):
            low, high, last = high, t.exponent, t
            if good(t):
                break
    if last.entropy > entropy + 1e-6 if entropy is not None else last.repetition > max_repetition * (1 + 1e-9):
        raise ValueError(f"no exponent meets the target: at {last.exponent} the entropy is {last.entropy} and sources are read up to {last.repetition} times")
    for _ in range(rounds):
        tried = _judged(totals, [low + (high - low) * k / (points + 1) for k in range(1, points + 1)], budget)
        k = next((k for k, t in enumerate(tried) if good(t)), points)
        low, high = (tried[k - 1].exponent if k else low), (tried[k].exponent if k < points else high)
        last = tried[k] if k < points else last
    return last


def plan(spark: SparkSession, docs: DataFrame, seed: int = 0, per_bucket: int = 50_000, **target) -> tuple[DataFrame, Temperature | None]:
    """For each source its weight, whole epochs, and the draw up to which documents are in the partial epoch."""
    scratch = Scratch(spark, "mixing")
    rows = scratch.table(docs.select(F.col("source").cast("string").alias("source"), draw(seed).alias("draw"), token_count(F.col("text").cast("string")).alias("tokens")))
    sums = scratch.table(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    total = sums.agg(F.sum("tokens")).first()[0]
    kind = "source string, tokens long, weight double, epochs double, whole int, share double, cut long"
    if not total:
        return sums.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs"), F.lit(1).alias("whole"), F.lit(0.0).alias("share"), F.lit(-1).cast("long").alias("cut")), None
    shares = sums.where("tokens > 0").select("source", "tokens", (F.col("tokens") / F.lit(total)).alias("p"), F.lit(float(total)).alias("total"))
    t = temperature(shares, **target)
    weighted = shares.withColumn("weight", F.pow("p", F.lit(t.exponent)) / t.norm)
    weighted = weighted.withColumn("epochs", F.round(F.col("weight") * t.budget / F.col("tokens"), 9))
    weighted = weighted.select("source", "tokens", "weight", "epochs", F.floor("epochs").cast("int").alias("whole"), (F.col("epochs") - F.floor("epochs")).alias("share"))
    # where the partial epoch ends: first the bucket of draws, then the draw within it
    buckets = buckets_for(rows.count(), per_bucket)
    bucket = F.floor(F.col("draw") / F.lit(_TOP / buckets)).cast("int")
    rows = rows.withColumn("bucket", F.least(bucket, F.lit(buckets - 1)))
    upto = Window.partitionBy("source").orderBy("bucket")
    run = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("n")).withColumn("upto", F.sum("n").over(upto))
    goal = weighted.where("share > 0").select(F.col("source").alias("s"), (F.col("share") * F.col("tokens")).alias("goal"))
    edge = run.join(goal, F.col("source").eqNullSafe(F.col("s"))).where("upto > goal").groupBy("s").agg(F.min(F.struct("bucket", "upto", "n", "goal")).alias("e"))
    edge = edge.select("s", "e.bucket", (F.col("e.goal") - F.col("e.upto") + F.col("e.n")).alias("room"))
    inner = rows.withColumnRenamed("bucket", "b").join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("bucket")))
    inner = inner.groupBy("s", "room", "draw").agg(F.sum("tokens").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("draw")))
    cuts = inner.where("upto <= room").groupBy("s").agg(F.max("draw").alias("inside"))
    cuts = edge.join(cuts.withColumnRenamed("s", "c"), F.col("s").eqNullSafe(F.col("c")), "left")
    cuts = cuts.select("s", F.coalesce("inside", F.floor(F.col("bucket") * F.lit(_TOP / buckets)).cast("long") - 1).alias("cut"))
    found = weighted.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select(*[c.split()[0] for c in kind.split(", ")][:-1], F.coalesce("cut", F.lit(-1).cast("long")).alias("cut"))
    bare = sums.where("tokens = 0").select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs"), F.lit(1).alias("whole"), F.lit(0.0).alias("share"), F.lit(-1).cast("long").alias("cut"))
    return scratch.table(found.union(bare)), t


def draw(seed: int) -> Column:
    """A document's place in its source's permutation, from 0 to 2^63; the same for equal rows."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(seed)), 1)


def mix(spark: SparkSession, docs: DataFrame, seed: int = 0, block_tokens: float = 4_000_000, **target) -> DataFrame:
    """Repeats the rows of docs (doc_id, text, source and whatever else) as often as the plan says.

    Adds mix_weight (of the source), mix_epoch (from 0) and mix_block (from 0): blocks read in order, and
    rows within one in any order, have nearly the target weights throughout. target: max_repetition or entropy, and
    budget (see temperature). A null source is a source of its own; a source without tokens is kept once
    and has weight 0, with its rows in block 0. Rows that repeat have the same copies each. No rows: an empty result. Names
    beginning with mix_ are replaced.
    """
    docs = docs.drop("mix_weight", "mix_epoch", "mix_block")
    found, t = plan(spark, docs, seed, **target)
    blocks = max(1, math.ceil((t.budget if t else 0) / block_tokens))
    own = found.select(F.col("source").alias("mix_s"), F.col("weight").alias("mix_weight"), *[F.col(c).alias(f"mix_{c}") for c in ("epochs", "whole", "share", "cut")])
    rows = docs.withColumn("mix_draw", draw(seed)).join(own, F.col("source").cast("string").eqNullSafe(F.col("mix_s")))
    last = F.col("mix_whole") + F.when(F.col("mix_draw") <= F.col("mix_cut"), 1).otherwise(0) - 1
    rows = rows.where(last >= 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), last)))
    place = F.shiftrightunsigned(F.xxhash64("mix_draw", "mix_epoch"), 1) / F.lit(_TOP)
    place = F.when(F.col("mix_epoch") < F.col("mix_whole"), place).otherwise(place * F.col("mix_share"))
    block = F.least(F.floor((F.col("mix_epoch") + place) / F.col("mix_epochs") * blocks), F.lit(blocks - 1))
    block = F.when(F.col("mix_weight") > 0, block).otherwise(0).cast("long")
    return rows.withColumn("mix_block", block).select(*docs.columns, "mix_weight", "mix_epoch", "mix_block")


def in_order(mixed: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of mix() block after block, over partitions and within them; those of a block, whatever their source and epoch, by hash."""
    place = F.xxhash64(F.col("doc_id").cast("long"), F.col("mix_epoch"), F.lit(seed))
    return mixed.withColumn("mix_place", place).repartitionByRange("mix_block", "mix_place").sortWithinPartitions("mix_block", "mix_place").drop("mix_place")
