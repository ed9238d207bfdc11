"""How entities change between adjacent slices: four signals, their composite, and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import vectors as vx
from quillmesh.operators import graph
from quillmesh.plans.lineage import cut, spread

SCORE_KEYS = ("slice_id_prev", "slice_id_curr", "entity_id")


def transitions(slice_nodes: DataFrame) -> DataFrame:
    """Adjacent pairs of the slices there are, in the order of their names; gaps are skipped.

    The window runs over distinct slice names only: a row a year.
    """
    after = F.lead("slice_id").over(Window.orderBy("slice_id"))
    pairs = slice_nodes.select("slice_id").distinct().select(F.col("slice_id").alias("slice_id_prev"), after.alias("slice_id_curr"))
    return pairs.where("slice_id_curr IS NOT NULL")


def _tagged(df: DataFrame, steps: DataFrame) -> DataFrame:
    """Every row of a slice once for each transition that the slice is part of; ``is_prev`` says as which side.

    The steps are two rows a year and are broadcast, so nothing else moves: what follows
    is one aggregate by transition and entity in place of a join for each side.
    """
    sides = steps.select(F.col("slice_id_prev").alias("slice_id"), *SCORE_KEYS[:2], F.lit(True).alias("is_prev"))
    sides = sides.union(steps.select("slice_id_curr", *SCORE_KEYS[:2], F.lit(False)))
    return df.join(F.broadcast(sides), "slice_id")


def scored_entities(slice_nodes: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Entities of both slices of each transition."""
    rows = _tagged(slice_nodes.select("slice_id", "entity_id"), transitions(slice_nodes) if steps is None else steps)
    both = rows.groupBy(*SCORE_KEYS).agg(F.bool_or("is_prev").alias("p"), F.bool_and("is_prev").alias("only_p"))
    return both.where("p AND NOT only_p").select(*SCORE_KEYS)


def _steps_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(*SCORE_KEYS[:2]).distinct()


def _sides(pairs: DataFrame, table: DataFrame, value: str, steps: DataFrame | None) -> DataFrame:
    """``pairs`` with ``value`` of both slices as ``prev`` and ``curr``, null where missing."""
    rows = _tagged(table.select("slice_id", "entity_id", F.col(value).alias("value")), _steps_of(pairs) if steps is None else steps)
    one = lambda side, name: F.first(F.when(side, F.col("value")), ignorenulls=True).alias(name)
    values = rows.groupBy(*SCORE_KEYS).agg(one(F.col("is_prev"), "prev"), one(~F.col("is_prev"), "curr"))
    return pairs.join(values, list(SCORE_KEYS), "left")


def neighbor_drift(pairs: DataFrame, edges: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Jaccard distance of the neighbour sets; a node without edges has none.

    Neighbours that stay are the edges of both slices, found once for both ends where all
    slices of an edge meet; with the sizes of the two sets they give the union. Sizes are
    combined before the shuffle, so a hub's neighbours are never gathered.
    """
    steps = _steps_of(pairs) if steps is None else steps
    sizes = graph.arcs(edges).groupBy("slice_id", "entity_id").agg(F.count("*").alias("size"))
    sizes = _tagged(sizes, steps).select(*SCORE_KEYS, "size", F.lit(0).alias("common"))
    seen = _tagged(spread(edges.select("slice_id", "u", "v"), "u", "v"), steps).groupBy(*SCORE_KEYS[:2], "u", "v").agg(F.bool_or("is_prev").alias("p"), F.bool_and("is_prev").alias("only_p"))
    stays = seen.where("p AND NOT only_p").select(*SCORE_KEYS[:2], F.explode(F.when(F.col("u") == F.col("v"), F.array("u")).otherwise(F.array("u", "v"))).alias("entity_id"))
    counts = sizes.union(stays.select(*SCORE_KEYS, F.lit(0), F.lit(1))).groupBy(*SCORE_KEYS).agg(F.sum("common").alias("common"), (F.sum("size") - F.sum("common")).alias("union"))
    both = pairs.join(counts, list(SCORE_KEYS), "left")
    value = F.when(F.col("union").isNull(), 0.0).otherwise(1 - F.col("common") / F.col("union"))
    return both.select(*SCORE_KEYS, value.alias("neighbor_drift"))


def embedding_drift(pairs: DataFrame, embeddings: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Cosine distance; 0.5 where one vector is missing and 0 where both are."""
    both = _sides(pairs, embeddings, "embedding", steps)
    one = F.col("prev").isNotNull() | F.col("curr").isNotNull()
    value = F.when(F.col("prev").isNotNull() & F.col("curr").isNotNull(), vx.clip(vx.cosine_distance(F.col("prev"), F.col("curr")))).when(one, 0.5).otherwise(0.0)
    return both.select(*SCORE_KEYS, value.alias("embedding_drift"))


def centrality_drift(pairs: DataFrame, centrality: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Absolute change of betweenness; a missing value is 0."""
    both = _sides(pairs, centrality, "betweenness", steps).fillna(0.0, ["prev", "curr"])
    return both.select(*SCORE_KEYS, vx.clip(F.abs(F.col("curr") - F.col("prev"))).alias("centrality_drift"))


def community_drift(pairs: DataFrame, labels: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """1 where fewer than half of an entity's former companions share its community now, else 0.

    An entity that was alone has 0. Companions who left count against it. Members are
    counted by (transition, former community, present community), so a community of any size
    costs one row a member and no pairs.
    """
    step = list(SCORE_KEYS[:2])
    rows = _tagged(labels.select("slice_id", "entity_id", "community"), _steps_of(pairs) if steps is None else steps)
    one = lambda side, name: F.first(F.when(side, F.col("community")), ignorenulls=True).alias(name)
    moved = rows.groupBy(*SCORE_KEYS).agg(one(F.col("is_prev"), "prev"), one(~F.col("is_prev"), "curr")).where("prev IS NOT NULL")
    together = moved.groupBy(*step, "prev", "curr").agg(F.count("*").alias("together"))
    sizes = together.groupBy(*step, "prev").agg(F.sum("together").alias("size"))
    joined = moved.where("curr IS NOT NULL").join(sizes, [*step, "prev"]).join(together, [*step, "prev", "curr"])
    value = F.when(F.col("size") <= 1, 0.0).when((F.col("together") - 1) / F.greatest(F.col("size") - 1, F.lit(1)) >= 0.5, 0.0).otherwise(1.0)
    found = joined.select(*SCORE_KEYS, value.alias("community_drift"))
    return pairs.join(found, list(SCORE_KEYS), "left").fillna(0.0, ["community_drift"])


def score_all(slice_nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, centrality: DataFrame | None = None, labels: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """All four signals and the composite of every entity of every transition.

    Centrality and communities are computed once a slice unless they are given.
    """
    centrality = graph.betweenness(slice_nodes, edges) if centrality is None else centrality
    labels = graph.communities(slice_nodes, edges) if labels is None else labels
    steps = cut(transitions(slice_nodes))
    pairs = scored_entities(slice_nodes, steps)
    keys = list(SCORE_KEYS)
    out = embedding_drift(pairs, embeddings, steps).join(neighbor_drift(pairs, edges, steps), keys)
    out = out.join(centrality_drift(pairs, centrality, steps), keys).join(community_drift(pairs, labels, steps), keys)
    return out.withColumn("composite_score", vx.composite(weights))


def parse_transition(transition: str | None) -> tuple[str, str] | None:
    """``prev->curr`` as a pair; None for anything else."""
    parts = (transition or "").split("->")
    return (parts[0], parts[1]) if len(parts) == 2 else None


def top_drifters(scores: DataFrame, n: int = 20, transition: str | None = None, score: str = "composite_score") -> DataFrame:
    """The ``n`` highest scores; ties by transition and entity. A malformed transition filters nothing."""
    step = parse_transition(transition)
    rows = scores.where((F.col("slice_id_prev") == step[0]) & (F.col("slice_id_curr") == step[1])) if step else scores
    return rows.orderBy(F.desc(score), "slice_id_prev", "entity_id").limit(n)


def bridge_alerts(scores: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Scores with ``is_bridge``: whether centrality changed by the threshold or more."""
    return scores.withColumn("is_bridge", F.col("centrality_drift") >= threshold)


def churn(slice_nodes: DataFrame) -> DataFrame:
    """Entities that each transition keeps, loses and gains."""
    rows = _tagged(slice_nodes.select("slice_id", "entity_id"), transitions(slice_nodes))
    both = rows.groupBy(*SCORE_KEYS).agg(F.bool_or("is_prev").alias("p"), F.bool_or(~F.col("is_prev")).alias("c"))
    counts = [F.count_if(F.col("p") & F.col("c")).alias("kept"), F.count_if(~F.col("c")).alias("prev_only"), F.count_if(~F.col("p")).alias("curr_only")]
    return both.groupBy("slice_id_prev", "slice_id_curr").agg(*counts)
