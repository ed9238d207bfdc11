"""Two-dimensional projection of node vectors by principal components."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.plans.lineage import cut


def _signed(points: DataFrame, axis: str) -> Column:
    """The axis turned so that its largest coordinate is positive."""
    row = points.agg(F.max(axis).alias("high"), F.min(axis).alias("low")).first()
    return F.col(axis) * (-1.0 if row["high"] is not None and abs(row["low"]) > abs(row["high"]) else 1.0)


def project(embeddings: DataFrame, joint: bool = True) -> DataFrame:
    """``slice_id, entity_id, x, y``: one fit over all slices, or one for each.

    Fewer than two rows lie at the origin, as do slices of one row.
    """
    if not joint:
        ids = [r["slice_id"] for r in embeddings.select("slice_id").distinct().orderBy("slice_id").collect()]
        parts = [project(embeddings.where(F.col("slice_id") == i)) for i in ids]
        out = parts[0] if parts else project(embeddings)
        for p in parts[1:]:
            out = out.union(p)
        return out
    embeddings = cut(embeddings.select("slice_id", "entity_id", "embedding"))
    rows = embeddings.select("slice_id", "entity_id", array_to_vector("embedding").alias("v"))
    if len(embeddings.limit(2).collect()) < 2:
        return embeddings.select("slice_id", "entity_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    points = model.transform(rows).withColumn("p", vector_to_array("p")).select("slice_id", "entity_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    points = cut(points)
    return points.select("slice_id", "entity_id", _signed(points, "x").alias("x"), _signed(points, "y").alias("y"))


def with_scores(points: DataFrame, scores: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Points with each entity's highest composite (0 where there is none) and its label, or id without one."""
    best = scores.groupBy("entity_id").agg(F.max("composite_score").alias("composite_score"))
    out = points.drop("composite_score", "label").join(best, "entity_id", "left")
    if nodes is not None:
        out = out.join(nodes.groupBy("entity_id").agg(F.max("entity_label").alias("entity_label")), "entity_id", "left")
    else:
        out = out.withColumn("entity_label", F.lit(None).cast("string"))
    label = F.coalesce(F.nullif("entity_label", F.lit("")), "entity_id")
    return out.select("slice_id", "entity_id", "x", "y", label.alias("label"), F.coalesce("composite_score", F.lit(0.0)).alias("composite_score"))
