"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.llm.draws import even, split
from quillmesh.plans.lineage import broadcast_if, cut

LAW = "rows"
_ROW = (1 << 33) - 1


def communication_matrix(rows: list[int], shards: int, seed: int = 42) -> list[list[int]]:
    """How many rows of each partition go to each shard under a uniform shuffle.

    Partition after partition draws from what room the shards have left: row sums are
    ``rows``, column sums the even shard sizes, and the matrix has the law that a
    uniform permutation of all rows gives it.
    """
    rng, room, out = np.random.default_rng(seed), even(sum(rows), shards), []
    for n in rows:
        out.append(split(rng, room, n))
        room = [a - b for a, b in zip(room, out[-1])]
    return out


def row_hash(df: DataFrame, seed: int) -> Column:
    """A hash of the whole row; map columns enter as JSON."""
    cols = [F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(F.lit(seed), *cols)


def shuffle_into_shards(df: DataFrame, shards: int = 24, seed: int = 42, bucket_rows: int = 1 << 16, max_broadcast_rows: int = 100_000) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: a uniform shuffle into shards whose sizes differ by one at most.

    Each partition is put in a random order (by a seeded hash of the row), its rows
    are dealt by the matrix to the shards, every row crosses the exchange once, and
    each shard is permuted again; ``slot`` counts from 0 without gaps. The first
    order is written to the shared folder, so a lost executor changes nothing. A
    shard is permuted in buckets of about ``bucket_rows``, so no task holds a shard.
    Repeated rows, nulls and an empty ``df`` need no care; columns of ``df`` named
    ``shard`` or ``slot`` are replaced. The matrix has one row an input partition on
    the driver.
    """
    df = df.drop("shard", "slot")
    names = df.columns
    local = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), row_hash(df, seed).alias("r")).sortWithinPartitions("r")
    placed = cut(local.select("row", F.monotonically_increasing_id().alias("i")))
    placed = placed.select("row", "i", F.shiftright("i", 33).alias("block"), F.col("i").bitwiseAND(F.lit(_ROW)).alias("rank"))
    sizes = sorted((r["block"], r["count"]) for r in placed.groupBy("block").count().collect())
    matrix = communication_matrix([n for _, n in sizes], shards, seed)
    cuts = [(b, np.cumsum(m)[:-1].tolist()) for (b, _), m in zip(sizes, matrix)]
    table = df.sparkSession.createDataFrame(cuts, "block long, cuts array<long>")
    dealt = placed.join(broadcast_if(table, len(cuts), max_broadcast_rows), "block")
    dealt = dealt.withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("rank"))))
    total = sum(n for _, n in sizes)
    buckets = max(1, -(-total // (shards * bucket_rows)))
    dealt = dealt.select("row", "shard", F.xxhash64(F.lit(seed + 1), "i").alias("r"), "i").withColumn("bucket", F.pmod("r", F.lit(buckets)))
    within = Window.partitionBy("shard", "bucket").orderBy("r", "i")
    dealt = dealt.withColumn("slot", (F.row_number().over(within) - 1).cast("long"))
    if buckets > 1:
        counts = cut(dealt.groupBy("shard", "bucket").count())
        before = F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
        dealt = dealt.join(broadcast_if(offsets, shards * buckets, max_broadcast_rows), ["shard", "bucket"])
        dealt = dealt.withColumn("slot", F.col("slot") + F.col("before"))
    return dealt.select("row.*", "shard", "slot")
