"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.samples import draw
from quillmesh.plans.lineage import cut

#: Code length, and the number of its substrings of 16 bits each.
BITS, PARTS = 256, 16
WIDTH = BITS // PARTS
_ONES = np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint32))
#: All substring values by their distance from 0: a probe within r takes the first ``_WITHIN[r]`` of them.
_NEAR = np.argsort(_ONES, kind="stable").astype(np.uint16)
_WITHIN = np.cumsum(np.bincount(_ONES))


def _distance(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)


@dataclass
class Codes:
    """Projection to ``BITS`` rotated axes; the signs are the code. ``radius``: where probing starts."""

    projection: np.ndarray
    radius: int = 0

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """One row of ``PARTS`` substrings for each unit vector."""
        return np.packbits(unit @ self.projection > 0, axis=1).view(np.uint16)


def _turned(axes: np.ndarray, unit: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """``axes`` rotated so that the signs of the projections lose least (iterative quantisation)."""
    flat = unit @ axes
    turn = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(flat.T @ np.where(flat @ turn > 0, 1.0, -1.0))
        turn = u @ v
    return axes @ turn


def learn(vectors: np.ndarray, k: int = 5, rounds: int = 20, recall: float = 0.95, queries: int = 256, seed: int = 42) -> Codes:
    """Codes by iterative quantisation, and the radius that holds ``recall`` of the neighbours among the sample.

    The code has as many learned rotations of the principal axes as fill it, each
    from a start of its own. Neighbours are farther in a sample than in the whole
    table, so the radius errs to the safe side.
    """
    rng = np.random.default_rng(seed)
    unit = _unit(vectors)
    axes = np.linalg.svd(unit.T @ unit)[0][:, :BITS]
    turns, filled = [], 0
    while filled < BITS:
        turns.append(_turned(axes, unit, rounds, rng))
        filled += axes.shape[1]
    codes = Codes(np.concatenate(turns, axis=1)[:, :BITS])
    code = codes.encode(unit)
    far = [0]
    for i in rng.permutation(len(unit))[:queries]:
        cosine = unit @ unit[i]
        cosine[i] = -2
        best = np.argsort(-cosine)[: min(k, len(unit) - 1)]
        far += _distance(code[best], code[i]).tolist()
    codes.radius = int(np.quantile(far, recall))
    return codes


class MultiIndex:
    """One posting list for each value of each substring of the codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows, self.values, self.starts = [], [], []
        for j in range(PARTS):
            order = np.argsort(codes[:, j], kind="stable")
            values, first = np.unique(codes[order, j], return_index=True)
            self.rows.append(order)
            self.values.append(values)
            self.starts.append(np.append(first, len(codes)))
        self.touched = 0

    def _lists(self, j: int, value: np.uint16, r: int) -> np.ndarray:
        """Places among the substring's values of those within ``r``: by probing the ball, or the values if those are fewer."""
        values = self.values[j]
        if _WITHIN[r] >= len(values):
            return np.flatnonzero(_ONES[values ^ value] <= r)
        ball = value ^ _NEAR[: _WITHIN[r]]
        at = np.searchsorted(values, ball)
        at[at == len(values)] = 0
        return at[values[at] == ball]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row at ``radius`` or fewer differing bits.

        By the pigeonhole principle such a row is within ``radius // PARTS`` in one of the
        first ``radius % PARTS + 1`` substrings or within one less in one of the others.
        """
        seen = np.zeros(len(self.codes), bool)
        each, more = divmod(radius, PARTS)
        for j in range(PARTS):
            r = min(each if j <= more else each - 1, WIDTH)
            if r >= 0:
                lists = self._lists(j, code[j], r)
                first, last = self.starts[j][lists], self.starts[j][lists + 1]
                marks = np.zeros(len(seen) + 1, np.int8)
                marks[first] += 1  # lists are distinct and don't overlap
                marks[last] -= 1
                seen[self.rows[j][np.cumsum(marks[:-1], dtype=np.int8).view(bool)]] = True
        found = np.flatnonzero(seen)
        self.touched += len(found)
        return found[_distance(self.codes[found], code) <= radius]


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null nor zero, and all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of doubles, each scaled by a power of two to components below 1: cosines stay, and no square over- or underflows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return np.ldexp(values, -np.frexp(np.abs(values).max(axis=1, initial=0.0))[1][:, None])


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _best(index: MultiIndex, ids: np.ndarray, v: np.ndarray, norm: np.ndarray, qid: np.ndarray, q: np.ndarray, codes: Codes, k: int) -> list[tuple[np.ndarray, ...]]:
    got = []
    q_norm = np.sqrt((q * q).sum(axis=1))
    for i, code in enumerate(codes.encode(q / q_norm[:, None])):
        radius = codes.radius
        while True:
            found = index.within(code, radius)
            found = found[ids[found] != qid[i]]
            if len(found) >= k or radius >= BITS:
                break
            radius = min(radius + 8, BITS)
        score = (v[found] * q[i]).sum(axis=1) / (norm[found] * q_norm[i])
        if len(found) > k:
            keep = score >= np.partition(score, -k)[-k]
            found, score = found[keep], score[keep]
        best = np.lexsort((ids[found], -score))[:k]
        got.append((np.full(len(best), qid[i]), ids[found[best]], score[best]))
    return got


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 4096, shard_rows: int = 1 << 15, seed: int = 42) -> DataFrame:
    """``(query_id, rank, id, score)``: each query's ``k`` nearest rows found by cosine, itself left out.

    Vectors that are null, zero or not finite take no part, and vectors of different
    lengths are no neighbours. For each length codes are learned from up to ``sample``
    rows; every row is indexed. The rows are dealt evenly into shards of about
    ``shard_rows``, each a multi-index of its own, through which all queries of that
    length stream: rows cross the exchange once, and each task holds one shard. A
    shard returns ``k`` rows a query at most. A query takes all codes within the
    learned radius, or a larger one until it has ``k``, and ranks them by the
    cosine of the original vectors in double precision; ties go to the smaller id. Rows
    that share the query's id are not its neighbours; of queries that share an id
    the one with the least vector is asked. An empty table gives no rows.
    """
    spark, out = table.sparkSession, "query_id long, id long, score double"

    def sound(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("width", F.size("v"))

    rows = cut(sound(table).withColumn("at", F.monotonically_increasing_id()))
    sizes = sorted((r["width"], r["count"]) for r in rows.groupBy("width").count().collect())
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    learned, shards, starts, total = {}, {}, {}, 0
    for width, n in sizes:
        some = rows.where(F.col("width") == width).orderBy(draw("id", "at", seed=seed)).limit(sample).select("v").toArrow()
        learned[width] = learn(_matrix(some.column("v")), k, seed=seed)
        shards[width], starts[width] = max(1, -(-n // shard_rows)), total
        total += shards[width]
    of = lambda known: F.element_at(F.create_map(*[F.lit(x) for item in known.items() for x in item]), F.col("width"))
    asked = sound(queries).groupBy("id", "width").agg(F.min("v").alias("v"))
    asked = asked.join(asked.groupBy("id").agg(F.min("width").alias("width")), ["id", "width"]) if len(sizes) > 1 else asked
    first = of(starts)
    indexed = rows.select("id", "v", "width", F.lit(False).alias("asks"), (first + F.pmod(F.xxhash64("at", F.lit(seed + 1)), of(shards))).cast("int").alias("shard"))
    asking = asked.where(F.col("width").isin([w for w, _ in sizes])).select("id", "v", "width", F.lit(True).alias("asks"), F.explode(F.sequence(first, first + of(shards) - 1)).alias("shard"))

    def search(batches):
        now, held, ready = None, [], None
        for batch in batches:
            shard, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(shard) != 0) | (asks[1:] != asks[:-1])) + 1
            for low, high in zip([0, *edges], [*edges, len(shard)]):
                part = batch.slice(low, high - low)
                if not len(part):
                    continue
                if shard[low] != now:
                    now, held, ready = shard[low], [], None
                width = part.column("width")[0].as_py()
                ids, v = part.column("id").to_numpy(), _matrix(part.column("v"))
                if not asks[low]:
                    held.append((ids, v))
                    continue
                if ready is None and held:
                    mine, vectors = (np.concatenate(x) for x in zip(*held))
                    norm = np.sqrt((vectors * vectors).sum(axis=1))
                    ready, held = (MultiIndex(learned[width].encode(vectors / norm[:, None])), mine, vectors, norm), []
                if ready is not None:
                    got = _best(*ready, ids, v, learned[width], k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], names=["query_id", "id", "score"])

    dealt = indexed.unionByName(asking).repartitionById(total, "shard").sortWithinPartitions("shard", "asks")
    found = dealt.mapInArrow(search, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
