"""All pairs of vectors of one type that are near enough, a pair of blocks a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Room for the rounding of a matrix product; pairs let through are measured exactly.
SLACK = 1e-9


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows padded with zeros, their norms summed in order, and their lengths."""
    sizes = np.asarray(pc.list_value_length(column))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), int(sizes.max(initial=1))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    norm = np.zeros(len(out))
    for d in range(out.shape[1]):
        norm += out[:, d] * out[:, d]
    return out, np.sqrt(norm), sizes


def _cosine(columns: np.ndarray, norm: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of the pairs, products added in order as ``vectors.cosine_similarity`` adds them."""
    total, size = np.zeros(len(x)), norm[x] * norm[y]
    for column in columns:
        total += column[x] * column[y]
    return np.where((sizes[x] != sizes[y]) | (size == 0), 0.0, total / np.where(size == 0, 1.0, size))


def _loose(kind: pa.DataType) -> pa.DataType:
    """``kind`` with every field nullable, as a schema in words declares it."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _loose(f.type)) for f in kind])
    return pa.list_(pa.field("element", _loose(kind.value_type))) if pa.types.is_list(kind) else kind


class _Forms:
    """At most how similar two forms can be: the letters they share over the longer length."""

    def __init__(self, column: pa.Array):
        coded = column.dictionary_encode()
        forms = coded.dictionary.to_pylist()
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        self.length = np.array([len(f) for f in forms], np.float32)
        self.letters = np.array([np.bincount([ord(c) % 32 for c in f], minlength=32) for f in forms], np.int16).T.copy()

    def most(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        (a, at), (b, to) = (np.unique(self.code[r], return_inverse=True) for r in (rows, others))
        shared = np.zeros((len(a), len(b)), np.int16)
        for letter in self.letters:
            shared += np.minimum.outer(letter[a], letter[b])
        longest = np.maximum.outer(self.length[a], self.length[b])
        return np.where(longest == 0, 1.0, shared / np.maximum(longest, 1))[at][:, to]


def near_pairs(rows: DataFrame, key: str, least: float, kind: str = "entity_type", vector: str = "embedding", form: str | None = None, weights: tuple[float, float] = (1.0, 0.0), block: int = 2048) -> DataFrame:
    """``a, b, cosine``: the pairs of rows of one ``kind`` that may reach ``least``, oriented by ``key``.

    All pairs are compared, a matrix product of two blocks of a kind at a time, so a task
    holds two blocks and the tasks are the pairs of blocks. The score is the cosine, or with
    ``form`` the weighted sum of the cosine and a similarity of the forms, which is at most
    their common letters over the longer length; pairs which that bound lets through are
    returned for the caller to score. None that reaches ``least`` is left out. ``a`` and
    ``b`` hold the columns of ``rows`` but the vector.
    """
    rows = rows.where(F.col(kind).isNotNull() & F.col(key).isNotNull() & F.col(vector).isNotNull())
    counts = rows.groupBy(F.col(kind).alias("__kind")).agg(F.ceil(F.count("*") / block).cast("int").alias("__blocks"))
    groups = counts.agg(F.sum(F.col("__blocks").cast("long") * (F.col("__blocks") + 1) / 2)).first()[0]
    dealt = rows.join(counts, F.col(kind) == F.col("__kind")).withColumn("__block", F.pmod(F.xxhash64(key), "__blocks").cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    dealt = dealt.withColumns({"__low": F.least("__block", "__other"), "__high": F.greatest("__block", "__other")}).drop("__blocks", "__other")
    dealt = dealt.repartition(int(max(1, min(2 * (groups or 1), 2000))), "__kind", "__low", "__high")
    names = [c for c in rows.columns if c != vector]
    side = T.StructType([rows.schema[c] for c in names]).simpleString()

    def compare(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by(key).combine_chunks()
        whole = table.to_batches()[0]
        vectors, norm, sizes = _vectors(whole[vector])
        unit = vectors / np.where(norm == 0, 1.0, norm)[:, None]
        columns = vectors.T.copy()
        keys = whole[key]
        rank = np.concatenate([[0], np.cumsum(np.asarray(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))))])
        part = whole["__block"].to_numpy()
        low, high = group[1].as_py(), group[2].as_py()
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        forms = _Forms(whole[form]) if form else None
        fields = [pa.field(c, _loose(whole[c].type)) for c in names]
        taken = pa.StructArray.from_arrays([whole[f.name].cast(f.type) for f in fields], fields=fields)
        for start in range(0, len(left), 256):
            x = left[start : start + 256]
            cosine = unit[x] @ unit[right].T
            if sizes.min() < sizes.max():
                cosine[sizes[x][:, None] != sizes[right]] = 0.0
            need = least if forms is None else (least - weights[1] * forms.most(x, right)) / weights[0]
            at, to = np.nonzero(~(cosine < need - SLACK))
            u, v = x[at], right[to]
            if low == high:
                u, v = u[u < v], v[u < v]
            u, v = np.minimum(u, v), np.maximum(u, v)
            u, v = u[rank[u] < rank[v]], v[rank[u] < rank[v]]
            for first in range(0, len(u), 20_000):
                a, b = u[first : first + 20_000], v[first : first + 20_000]
                found = [taken.take(pa.array(a)), taken.take(pa.array(b)), pa.array(_cosine(columns, norm, sizes, a, b))]
                yield pa.RecordBatch.from_arrays(found, names=["a", "b", "cosine"])

    return dealt.groupBy("__kind", "__low", "__high").applyInArrow(compare, f"a {side}, b {side}, cosine double")
