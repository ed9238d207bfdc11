"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks."""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.draws import even, split
from quillmesh.llm.words import word_count
from quillmesh.plans.lineage import broadcast_if, cut

WEIGHTS = (5, 2, 1)
#: Bits of a row's place that one step of the search for a source's cut looks at, and those a place has.
STEP_BITS, PLACE_BITS = 12, 60
#: Sources whose blocks one task splits among the shards.
GROUP_SOURCES = 4096
_INDEX = (1 << 33) - 1


def splitting_tree(quotas: list[int], room: list[int], rng: np.random.Generator) -> list[list[int]]:
    """Blocks of each source that each shard gets: ``[shard][source]``; shard ``k`` gets ``room[k]``.

    The shards are halved again and again; each half draws its exact number of blocks
    from what its parent has, without replacement.
    """

    def below(have: list[int], low: int, high: int) -> list[list[int]]:
        if high - low == 1:
            return [have]
        mid = (low + high) // 2
        left = split(rng, have, sum(room[low:mid]))
        return below(left, low, mid) + below([a - b for a, b in zip(have, left)], mid, high)

    return below(quotas, 0, len(room))


def place(seed: int = 42) -> Column:
    """A row's place in its source's random order, from ``doc_id`` and ``text``: 0 to below two to the ``PLACE_BITS``."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 64 - PLACE_BITS)


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``no``: their place by code point, null last. Only a count a partition reaches the driver."""
    placed = cut(sources.orderBy(F.col("source").isNull(), "source").withColumn("__i", F.monotonically_increasing_id()))
    part = F.shiftright("__i", 33)
    offset, offsets = 0, {}
    for p, n in sorted((r["p"], r["count"]) for r in placed.groupBy(part.alias("p")).count().collect()):
        offsets[p], offset = offset, offset + n
    table = F.create_map(*[F.lit(x) for item in offsets.items() for x in item]) if offsets else F.lit(None).cast("map<long,int>")
    return placed.withColumn("no", (F.element_at(table, part) + F.col("__i").bitwiseAND(F.lit(_INDEX))).cast("long")).drop("__i")


def with_targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources(no, words, ...)`` with ``target``: the words to take of each.

    ``share`` of all words by the repeating ``weights``, at most ``most`` times a
    source's own. What a capped source cannot take is shared again by weight among
    the others until none is above its cap. The driver holds the sums only.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    known = sources.withColumn("weight", weight)
    cap = most * F.col("words")
    total = share * (known.agg(F.sum("words")).first()[0] or 0)
    left, open_weight, capped = total, None, F.lit(False)
    while True:
        row = known.agg(F.sum(F.when(~capped, F.col("weight"))).alias("w"), F.sum(F.when(capped, cap)).alias("c")).first()
        if not row["w"] or row["w"] == open_weight:
            break
        left, open_weight = total - (row["c"] or 0.0), row["w"]
        capped = F.lit(left) * F.col("weight") / F.lit(open_weight) > cap
    return known.withColumn("target", F.when(capped, cap).otherwise(F.lit(left) * F.col("weight") / F.lit(open_weight or 1.0))).drop("weight")


def _cuts(slim: DataFrame, sources: DataFrame, n: int, max_broadcast_rows: int, bucket_rows: int) -> DataFrame:
    """``(no, cut)``: the place up to which a source gives rows once more, so that their words come nearest ``rest``.

    The words are summed by the leading bits of the places; the bucket that the rest
    cuts through is looked at by its next bits, until it has about ``bucket_rows``
    rows, which are put in order. A bucket table has at most 4096 rows a source.
    """
    state = sources.where("rest > 0").select("source", "no", F.col("rest").alias("need"), F.lit(0).cast("long").alias("head"))
    here = F.col("source").eqNullSafe(F.col("known"))
    for level in range(1, PLACE_BITS // STEP_BITS + 1):
        shift = PLACE_BITS - STEP_BITS * level
        inside = slim.join(broadcast_if(state.withColumnRenamed("source", "known"), n, max_broadcast_rows), here & (F.shiftright("place", shift + STEP_BITS) == F.col("head")))
        sums = inside.groupBy("no", "known", "need", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        end = F.sum("words").over(Window.partitionBy("no").orderBy("bucket"))
        through = sums.withColumn("end", end).where("end >= need").groupBy("no").agg(F.min_by(F.struct("known", (F.col("need") - F.col("end") + F.col("words")).alias("need"), "bucket", "n"), "bucket").alias("x"))
        state = cut(through.select("no", F.col("x.known").alias("source"), "x.need", F.col("x.bucket").alias("head"), "x.n"))
        if (state.agg(F.max("n")).first()[0] or 0) <= bucket_rows:
            break
    inside = slim.join(broadcast_if(state.withColumnRenamed("source", "known").drop("n"), n, max_broadcast_rows), here & (F.shiftright("place", shift) == F.col("head")))
    upto = F.sum("size").over(Window.partitionBy("no").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("upto", upto).where("upto - size / 2.0 <= need").groupBy("no").agg(F.max("place").alias("last"))
    return state.join(last, "no", "left").select("no", F.coalesce("last", F.shiftleft("head", shift) - 1).alias("cut"))


def _dealt(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(no, cuts, factor, start)`` for ``sources(no, uses)``.

    ``cuts``: where a source's permuted block uses pass from shard to shard. A tree
    splits the quotas of groups of sources, and one task a group those of its sources,
    which together have the law of one tree over all sources.
    """
    grouped = sources.select("no", "uses", F.expr(f"no div {GROUP_SOURCES}").alias("grp"))
    quotas = sorted((r["grp"], r["n"]) for r in grouped.groupBy("grp").agg(F.sum("uses").alias("n")).collect())
    tree = splitting_tree([q for _, q in quotas], even(sum(q for _, q in quotas), shards), np.random.default_rng(seed)) if quotas else []
    rooms = {g: [leaf[i] for leaf in tree] for i, (g, _) in enumerate(quotas)}

    def deal(key, table):
        group = key[0].as_py()
        table = table.sort_by("no")
        uses = table.column("uses").to_pylist()
        rng = np.random.default_rng([seed, 1, group])
        leaves = splitting_tree(uses, rooms[group], rng)
        steps = []
        for n in uses:
            step = int(rng.integers(1, max(n, 2)))
            while gcd(step, max(n, 1)) > 1:
                step = step % n + 1
            steps.append((step, int(rng.integers(0, max(n, 1)))))
        cuts = [np.cumsum([leaf[i] for leaf in leaves])[:-1].tolist() for i in range(len(uses))]
        return pa.table({"no": table.column("no"), "cuts": pa.array(cuts, pa.list_(pa.int64())), "factor": pa.array([s for s, _ in steps], pa.int64()), "start": pa.array([s for _, s in steps], pa.int64())})

    return grouped.groupBy("grp").applyInArrow(deal, "no long, cuts array<long>, factor long, start long")


@dataclass
class Plan:
    """What a mix takes of which source.

    ``rows``: ``(doc_id, source, size, place)`` of every document. ``sources``: one row
    a source with ``words, target``, its blocks and where their uses go.
    """

    rows: DataFrame
    sources: DataFrame
    n_rows: int
    n_sources: int
    shards: int
    seed: int
    max_broadcast_rows: int

    def joined(self, df: DataFrame, source: str = "source") -> DataFrame:
        """``df`` with ``__plan``: its source's row."""
        table = self.sources.select(F.col("source").alias("__known"), F.struct("words", "target", "passes", "cut", "blocks", "uses", "cuts", "factor", "start").alias("__plan"))
        return df.join(broadcast_if(table, self.n_sources, self.max_broadcast_rows), F.col(source).eqNullSafe(F.col("__known")), "left").drop("__known")

    def shards_of(self, at: Column) -> Column:
        """The output shard of each copy of the row at place ``at``, given ``__plan``."""
        p = F.col("__plan")
        block = F.shiftright(F.shiftright(at, PLACE_BITS - 30) * p["blocks"], 30)
        rank = lambda turn: ((turn * p["blocks"] + block) * p["factor"] + p["start"]) % p["uses"]
        copies = p["passes"] + (at <= p["cut"]).cast("long")
        return F.transform(F.filter(F.sequence(F.lit(0).cast("long"), p["passes"]), lambda t: t < copies), lambda t: F.size(F.filter(p["cuts"], lambda c: c <= rank(t))))


def plan(docs: DataFrame, size: Column | None = None, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, shards: int = 16, block_rows: int = 1024, seed: int = 42, max_broadcast_rows: int = 500_000, bucket_rows: int = 1 << 16) -> Plan:
    """Targets of all sources, the rows that reach them, and the shards of their blocks.

    ``size`` defaults to the number of words; null texts have none. Sources sort by code
    point, null last, and take the repeating ``weights``. A source's rows have
    random places (by a hash of ``doc_id`` and text); blocks are runs of about
    ``block_rows`` places. A source gives whole passes over all its blocks, and for
    the rest of its target the rows up to the place where their words come nearest.
    Identical rows share a place and so a fate. A source without words has target 0
    and gives nothing; an empty table has no sources. Neither sources nor rows
    have a limit: both stay tables, of which the driver sees sums.
    """
    size = word_count(F.col("text")) if size is None else size
    rows = cut(docs.select("doc_id", "source", size.alias("size"), place(seed).alias("place")))
    stats = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    known = with_targets(_numbered(stats), weights, share, most)
    known = known.withColumn("passes", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("long"))
    known = cut(known.withColumn("rest", F.col("target") - F.col("passes") * F.col("words")).withColumn("blocks", F.ceil(F.col("n") / F.lit(block_rows)).cast("long")))
    n = known.count()
    known = known.join(_cuts(rows, known, n, max_broadcast_rows, bucket_rows), "no", "left").withColumn("cut", F.coalesce("cut", F.lit(-1).cast("long")))
    more = F.shiftright(F.shiftright("cut", PLACE_BITS - 30) * F.col("blocks"), 30) + 1
    known = cut(known.withColumn("uses", F.col("passes") * F.col("blocks") + F.when(F.col("cut") >= 0, more).otherwise(0)))
    return Plan(rows, cut(known.join(_dealt(known, shards, seed), "no")), rows.count(), n, shards, seed, max_broadcast_rows)


def _other(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def assign(docs: DataFrame, planned: Plan | None = None, column: str = "mix", **options) -> DataFrame:
    """``docs`` with the struct ``column``: ``size, source_size, target, shards``.

    ``shards`` lists the output shard of every copy taken, so its length is how often
    the document is used: 0 up to ``ceil(most)``. Rows look their source up and never
    cross an exchange. A column of that name is replaced. ``options`` are those of ``plan``.
    """
    size = options.get("size")
    planned = planned or plan(docs, **options)
    names = [c for c in docs.columns if c != column]
    found = planned.joined(docs)
    given = F.struct((word_count(F.col("text")) if size is None else size).alias("size"), F.col("__plan.words").alias("source_size"), F.col("__plan.target").alias("target"), planned.shards_of(place(planned.seed)).alias("shards"))
    return found.select(*[F.col(f"`{c}`") for c in names], given.alias(column))


def mix(docs: DataFrame, planned: Plan | None = None, task_rows: int = 2048, column: str | None = "shard", **options) -> DataFrame:
    """The mixed documents: one row for each copy taken, dealt to shard ``column`` and in random order within it.

    A shard is shuffled in parts of about ``task_rows`` documents, so that tasks stay as
    small as the input grows. Columns are those of ``docs`` and ``column``, which
    replaces one of that name; with ``column=None`` those of ``docs`` alone.
    """
    planned = planned or plan(docs, **options)
    names = [c for c in docs.columns if c != column]
    inner = _other("__shard", docs.columns)
    parts = max(1, -(-planned.n_rows // (planned.shards * task_rows)))
    copies = planned.joined(docs).select(*[F.col(f"`{c}`") for c in names], F.posexplode(planned.shards_of(place(planned.seed))).alias("__copy", inner))
    salted = copies.withColumn("__at", F.xxhash64(F.lit(planned.seed + 4), "doc_id", "text", "__copy"))
    dealt = salted.repartition(planned.shards * parts, inner, F.pmod("__at", F.lit(parts))).sortWithinPartitions(inner, "__at")
    return dealt.select(*[F.col(f"`{c}`") for c in names], *([] if column is None else [F.col(inner).alias(column)]))
