"""Bounded samples for models that learn on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.plans.lineage import broadcast_if, cut


def draw(*columns, seed: int = 42) -> Column:
    """A number from 0 to below 1 that the columns' values decide."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def sample(rows: DataFrame, group: str, most: Column, seed: int = 42, max_broadcast_rows: int = 100_000) -> DataFrame:
    """Up to ``most`` distinct rows of each ``group``, the same in every run, whatever the size of a group.

    Rows whose draw is too high to be among the first ``most`` are left before any
    exchange (about four times as many as are wanted stay, by an estimate of the
    different rows), then the first by draw are taken.
    Rows with a null group are left out; rows that repeat count once.
    """
    rows = rows.where(F.col(group).isNotNull())
    sizes = cut(rows.groupBy(F.col(group).alias("__group")).agg(F.approx_count_distinct(F.xxhash64(*rows.columns)).alias("__n")))
    known = rows.withColumn("__draw", draw(*rows.columns, seed=seed)).join(broadcast_if(sizes, sizes.count(), max_broadcast_rows), F.col(group) == F.col("__group"))
    some = known.where(F.col("__draw") * F.col("__n") < 4.0 * most + 50).select(*rows.columns, "__draw").distinct()
    first = F.row_number().over(Window.partitionBy(group).orderBy("__draw"))
    return some.withColumn("__first", first).where(F.col("__first") <= most).drop("__draw", "__first")
