"""Connected components by alternating large-star and small-star steps, or in one task where the edges are counted and few."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from quillmesh.plans.lineage import cut


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


#: Nodes that one union and find holds before it passes on what it has.
HELD = 500_000


def _unite(batches, held: int | None = HELD):
    """``(a, b)`` of every node ``a`` seen and the smallest node ``b`` that the batches tie it to, a fresh start every ``held`` nodes."""
    at: dict = {}
    up: list[int] = []
    kind = None

    def rows():
        names = list(at)
        least = list(range(len(up)))
        for i in range(len(up)):
            x = i
            while up[x] != x:
                up[x] = x = up[up[x]]
            if names[i] < names[least[x]]:
                least[x] = i
            up[i] = x
        columns = [pa.array(names, kind), pa.array([names[least[x]] for x in up], kind)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = at.setdefault(a, len(up)), len(up)
            if x == y:
                up.append(x)
            y = at.setdefault(b, len(up))
            if y == len(up):
                up.append(y)
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x != y:
                up[y] = x
        if held and len(up) >= held:
            yield rows()
            at, up = {}, []
    if up:
        yield rows()


def _in_one_task(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` of ``pairs(a, b)`` by union and find."""

    def unite(batches):
        yield from (b.rename_columns(["node", "component"]) for b in _unite(batches, held=None))

    kind = pairs.schema["a"].dataType.simpleString()
    return cut(pairs.select("a", "b").coalesce(1).mapInArrow(unite, f"node {kind}, component {kind}"))


def _contracted(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that tie the same nodes, far fewer where neighbours lie together, and the leaves taken off them.

    Each task unites the edges it holds, those of a run of nodes, and passes on every
    node with the smallest one tied to it. A node that only one task saw and that is no
    task's smallest follows that one: it is a leaf, and goes on without another exchange.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    runs = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * pairs.sparkSession.sparkContext.defaultParallelism)
    ties = cut(pairs.select("a", "b").repartitionByRange(runs, "b").mapInArrow(_unite, f"a {kind}, b {kind}"))
    seen = ties.select("a", "b", F.lit(1).alias("n")).union(ties.where("a <> b").select("b", "b", F.lit(2)).distinct())
    seen = cut(seen.groupBy("a").agg(F.sum("n").alias("n"), F.min("b").alias("b")))
    leaves = seen.where("n = 1 AND a <> b").select("a", "b")
    return cut(ties.join(leaves.select("a"), "a", "left_anti").distinct()), leaves


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, task_edges: int = 200_000) -> DataFrame:
    """Map every node of an undirected edge list to the smallest node it can reach.

    Returns ``(node, component)``. Null endpoints are dropped; a self-loop keeps its
    node as a component of one. Every round aggregates minima per node (combined
    before the shuffle) and joins them back, so a hub of any degree is only ever a
    skewed join side, which the adaptive planner splits. The rounds are logarithmic
    in the number of nodes; each ends with a checkpoint. Up to ``task_edges`` edges
    of whole numbers or strings are united in one task instead, as a round of exchanges
    costs more than they do; more of them are first united within tasks (``_contracted``),
    so the rounds see only nodes that several tasks share. The result is the same.
    """
    pairs = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s IS NOT NULL AND d IS NOT NULL")
    pairs = pairs.select(F.greatest("s", "d").alias("a"), F.least("s", "d").alias("b"))
    simple = isinstance(pairs.schema["a"].dataType, (IntegralType, StringType))
    pairs = cut(pairs if simple else pairs.distinct())
    if simple and pairs.count() <= task_edges:
        return _in_one_task(pairs)
    if simple:
        rest, leaves = _contracted(pairs)
        found = _in_one_task(rest) if rest.count() <= task_edges else cut(_by_stars(rest, max_rounds))
        led = leaves.join(found, leaves.b == found.node).select(F.col("a").alias("node"), "component")
        return found.union(led)
    return _by_stars(pairs, max_rounds)


def _by_stars(pairs: DataFrame, max_rounds: int) -> DataFrame:
    """``(node, component)`` of different ``pairs(a, b)`` with ``a >= b`` by star contraction."""
    loops = pairs.where("a = b").select(F.col("a").alias("node"))
    star = pairs.where("a <> b")
    state = _checksum(star)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        star = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _checksum(star)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = star.select(F.col("a").alias("node"), F.col("b").alias("component"))
    rest = star.select(F.col("b").alias("node")).union(loops).distinct().join(found, "node", "left_anti")
    return found.union(rest.select("node", F.col("node").alias("component")))
