"""SimHash near-duplicate detection by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.components import connected_components
from quillmesh.plans.lineage import broadcast_if, cut

BITS = 64
#: Shingles whose bits are counted at once, to bound memory on very long texts.
COUNT_BLOCK = 1 << 16
#: Variants that a task expands at once; larger balls are split by further bits first.
EXPAND_BLOCK = 1 << 21


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one UTF-8 text over word shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(length + 1) - (length + 1)
    n = len(words) - shingle + 1
    end = start[shingle - 1 :] + length[shingle - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for low in range(0, n, COUNT_BLOCK):
        spans = zip(start[low : min(n, low + COUNT_BLOCK)].tolist(), end[low : low + COUNT_BLOCK].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """Signed 64-bit fingerprints of a text column, computed in Arrow batches."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), np.uint64)
        for low in range(0, len(texts), 256):
            block = texts.slice(low, 256).cast(pa.large_binary()).to_pylist()
            out[low : low + len(block)] = [fingerprint(t, shingle, seed) for t in block]
        return pa.array(out.view(np.int64))

    return of(text)


def ball_masks(bits: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` set bits among the lowest ``bits``, as uint64."""
    out = [0]
    for r in range(1, radius + 1):
        out += [sum(1 << b for b in chosen) for chosen in combinations(range(bits), r)]
    return np.array(out, np.uint64)


def _ball_size(bits: int, radius: int) -> int:
    return sum(comb(bits, r) for r in range(radius + 1))


def _collisions(codes: np.ndarray, left: np.ndarray, bits: int):
    """Pairs (first, other) of rows whose balls share a variant of the lowest ``bits`` bits.

    ``left`` is how many bits each row may still flip. Rows that share a variant
    are linked to the first of them only, so a group of m rows gives m - 1 pairs a
    variant, not m squared. Where the balls of all rows exceed the block, the next
    bit splits the variant space and each half is expanded on its own.
    """
    if len(codes) < 2:
        return
    budgets = range(int(left.max()) + 1)
    sizes = sum(_ball_size(bits, r) * int((left == r).sum()) for r in budgets)
    if sizes > EXPAND_BLOCK and bits:
        top = np.uint64(1) << np.uint64(bits - 1)
        for side in (np.uint64(0), top):
            flips = ((codes & top) != side).astype(left.dtype)
            keep = np.flatnonzero(left >= flips)
            for a, b in _collisions(codes[keep], left[keep] - flips[keep], bits - 1):
                yield keep[a], keep[b]
        return
    low = np.uint64((1 << bits) - 1)
    parts, owners = [], []
    for r in budgets:
        rows = np.flatnonzero(left == r)
        if len(rows):
            masks = ball_masks(bits, r)
            parts.append(((codes[rows] & low)[:, None] ^ masks[None, :]).ravel())
            owners.append((rows, len(masks)))
    variants = np.concatenate(parts)
    held = np.sort(variants)
    twice = np.unique(held[1:][held[1:] == held[:-1]])
    if not len(twice):
        return
    met = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, variants), len(twice) - 1)] == variants)
    met = met[np.argsort(variants[met], kind="stable")]
    held = variants[met]
    same = np.flatnonzero(held[1:] == held[:-1]) + 1
    lead = np.ones(len(held), bool)
    lead[same] = False
    first = np.maximum.accumulate(np.where(lead, np.arange(len(held)), 0))[same]
    ends = np.cumsum([len(p) for p in parts])
    owner = np.empty((2, len(same)), np.int64)
    for k, at in enumerate((met[first], met[same])):
        which = np.searchsorted(ends, at, side="right")
        for i, (rows, width) in enumerate(owners):
            mine = which == i
            owner[k, mine] = rows[(at[mine] - (ends[i] - len(parts[i]))) // width]
    pairs = np.unique(owner, axis=1)
    yield pairs[0], pairs[1]


def _forest(codes: np.ndarray, left: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """Label of each row: the smallest row it reaches over verified links inside one bucket."""
    label = np.arange(len(codes))
    links = []
    for a, b in _collisions(codes, left, bits):
        near = (a != b) & (np.bitwise_count(codes[a] ^ codes[b]) <= radius)
        links.append(np.stack([a[near], b[near]]))
    if links:
        a, b = np.concatenate(links, axis=1)
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            label = label[label]
            if (label == before).all() and (label[a] == label[b]).all():
                break
    return label


def ball_links(nodes: DataFrame, radius: int = 4, bucket_rows: int = 1024, task_rows: int = 1 << 19) -> DataFrame:
    """Links ``(src, dst)`` that connect every two fingerprints at ``radius`` or fewer differing bits.

    ``nodes``: distinct ``(fp, node)``. Two fingerprints within the radius share a
    variant that lies within half of it of both. Every fingerprint goes to each
    prefix that one of its variants has, once a prefix; the rest of the variant is
    spelled out on the receiving side, so the exchange carries a few dozen rows a
    fingerprint instead of two thousand. A bucket returns a spanning forest of its
    verified collisions: at most one link a row, whatever the size of a group.
    The exchange has a task for every ``task_rows`` rows, sorted by bucket; a task
    holds one bucket at a time.
    """
    half = radius // 2
    if radius % 2:
        raise ValueError("the radius is even: each side flips half of it")
    rows = nodes.count()
    prefix = int(np.clip(np.ceil(np.log2(max(rows, 1) / bucket_rows)), 4, BITS - 8))
    rest = BITS - prefix
    masks = ball_masks(prefix, half)

    def scatter(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            node = batch.column("node").to_numpy()
            step = max(1, (1 << 18) // len(masks))
            for low in range(0, len(fp), step):
                f, n = fp[low : low + step], node[low : low + step]
                to = (f >> np.uint64(rest))[:, None] ^ masks[None, :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.ravel().astype(np.int64)), pa.array(np.repeat(f, len(masks)).view(np.int64)), pa.array(np.repeat(n, len(masks)))],
                    names=["bucket", "fp", "node"],
                )

    def links(bucket: int, codes: np.ndarray, node: np.ndarray):
        left = half - np.bitwise_count((codes >> np.uint64(rest)) ^ np.uint64(bucket)).astype(np.int8)
        label = _forest(codes, left, rest, radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return node[moved], node[label[moved]]

    def gather(batches):
        now, held = None, []
        for batch in batches:
            bucket, fp, node = (batch.column(c).to_numpy() for c in ("bucket", "fp", "node"))
            edges = np.flatnonzero(np.diff(bucket)) + 1
            found = []
            for low, high in zip([0, *edges], [*edges, len(bucket)]):
                if low < high:
                    if bucket[low] != now and held:
                        found.append(links(now, *(np.concatenate(x) for x in zip(*held))))
                        held = []
                    now = bucket[low]
                    held.append((fp[low:high].view(np.uint64), node[low:high]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["src", "dst"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(now, *(np.concatenate(x) for x in zip(*held)))], names=["src", "dst"])

    spread = nodes.select("fp", "node").mapInArrow(scatter, "bucket long, fp long, node long")
    tasks = max(1, -(-rows * len(masks) // task_rows))
    return spread.repartition(tasks, "bucket").sortWithinPartitions("bucket", "node").mapInArrow(gather, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """One row a document: ``(id, fp, component)``.

    ``fp`` is the signed fingerprint of the whole text (null, empty and blank texts:
    0, linked like any other); ``component`` is the smallest id reachable over
    links of at most ``radius`` differing bits. Repeated rows stay repeated. A row
    without an id gets its group's component but links nothing itself.
    """
    marked = cut(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle, seed).alias("fp")))
    nodes = cut(marked.groupBy("fp").agg(F.min("id").alias("node")).where("node IS NOT NULL"))
    found = connected_components(ball_links(nodes, radius))
    labels = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return marked.join(labels, "fp", "left").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = 2_000_000, finder=near_duplicates, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that with the smallest id.

    ``finder`` gives the groups: ``near_duplicates`` of this module or of ``jaccard``.
    Of rows that repeat a kept id one stays; rows without an id all stay, as no id
    names them. The texts are not shuffled unless the ids to
    drop exceed ``max_broadcast_rows`` (16 bytes each) or ids repeat.
    """
    groups = cut(finder(docs, id_col, text_col, **options))
    drop = groups.where("id <> component").select("id").distinct()
    repeats = groups.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select("id")
    drop, repeats = cut(drop), cut(repeats)
    lost = broadcast_if(drop.withColumnRenamed("id", id_col), drop.count(), max_broadcast_rows)
    kept = docs.join(lost, id_col, "left_anti")
    if not repeats.isEmpty():
        again = broadcast_if(repeats.withColumnRenamed("id", id_col), repeats.count(), max_broadcast_rows)
        kept = kept.join(again, id_col, "left_anti").unionByName(kept.join(again, id_col, "left_semi").dropDuplicates([id_col]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
