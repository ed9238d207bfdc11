"""Alias candidates: pairs of mentions of one type, scored, explained, and clustered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as tx
from quillmesh.functions import vectors as vx
from quillmesh.operators.components import connected_components
from quillmesh.operators.pairs import near_pairs
from quillmesh.plans.lineage import cut

COSINE_WEIGHT, LEXICAL_WEIGHT, THRESHOLD, THRESHOLD_VERSION = 0.7, 0.3, 0.7, "v1"
#: The sentences that explain a pair.
REASONS = {
    "strong": "Strong embedding match across reports",
    "moderate": "Moderate embedding match across reports",
    "exact": "Exact normalized match across separate documents",
    "very_similar": "Very similar spellings and formatting",
    "similar": "Similar spellings with minor variation",
    "overlap": "Overlapping entity tokens support a manual review",
    "repeated": "Observed repeatedly across multiple source reports",
    "fallback": "Similarity exceeded the configured review threshold",
}


def doc_spread(mentions: DataFrame) -> DataFrame:
    """Number of documents in which each form of each type occurs."""
    return mentions.groupBy("normalized_form", "entity_type").agg(F.countDistinct("doc_id").alias("n_docs"))


def similarity() -> dict[str, Column]:
    """Lexical similarity and token overlap of the sides ``a`` and ``b``."""
    either = F.size(F.array_union("a.words", "b.words"))
    return {
        "lexical": tx.levenshtein_similarity(F.col("a.normalized_form"), F.col("b.normalized_form")),
        "overlap": F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect("a.words", "b.words")) / either),
    }


def blended() -> Column:
    """0.7 cosine and 0.3 lexical; at most 1."""
    return F.least(COSINE_WEIGHT * F.col("cosine") + LEXICAL_WEIGHT * F.col("lexical"), F.lit(1.0))


def reasons() -> Column:
    """Why a pair is proposed, in a fixed order; a fallback where nothing stands out."""
    say = lambda key: F.lit(REASONS[key])
    found = F.array_compact(
        F.array(
            F.when(F.col("cosine") >= 0.9, say("strong")).when(F.col("cosine") >= 0.75, say("moderate")),
            F.when(F.lower("a.normalized_form") == F.lower("b.normalized_form"), say("exact")),
            F.when(F.col("lexical") >= 0.9, say("very_similar")).when(F.col("lexical") >= 0.7, say("similar")),
            F.when(F.col("overlap") > 0.5, say("overlap")),
            F.when((F.col("docs_a") > 1) | (F.col("docs_b") > 1), say("repeated")),
        )
    )
    return F.when(F.size(found) == 0, F.array(say("fallback"))).otherwise(found)


def evidence() -> Column:
    return F.struct(
        *[F.col(f"{s}.extractor_{c}").alias(f"extractor_{c}_{s}") for c in ("name", "label", "confidence") for s in "ab"],
        F.round("cosine", 4).alias("embedding_similarity"),
        F.round("lexical", 4).alias("lexical_similarity"),
        F.round("overlap", 4).alias("token_overlap"),
        F.col("docs_a").alias("surface_a_doc_count"),
        F.col("docs_b").alias("surface_b_doc_count"),
        F.when(F.col("a.doc_id") == F.col("b.doc_id"), 1).otherwise(2).alias("pair_doc_coverage"),
        F.col("a.context").alias("context_a"),
        F.col("b.context").alias("context_b"),
    )


def pairs_of(mentions: DataFrame, key: str = "mention_id", block: list[str] | None = None) -> DataFrame:
    """Every unordered pair of rows that agree on ``block`` (default: entity type), as structs ``a`` and ``b``.

    An equi-join on the block with the order of keys as residual condition, so the
    adaptive planner may broadcast or split a skewed type. Pairs are oriented by key.
    """
    block = block or ["entity_type"]
    a, b = (mentions.select(*[F.col(c).alias(f"__{c}") for c in block], F.struct("*").alias(s)) for s in "ab")
    return a.join(b, [f"__{c}" for c in block]).where(F.col(f"a.{key}") < F.col(f"b.{key}")).select("a", "b")


def _pairs_with(rows: DataFrame, mention_id: str) -> DataFrame:
    """The pairs that hold one mention, oriented by key: a join with its row."""
    one = rows.where(F.col("mention_id") == mention_id).select(F.col("entity_type").alias("__type"), F.struct("*").alias("one"))
    both = rows.select("entity_type", F.struct("*").alias("other")).join(F.broadcast(one), F.col("entity_type") == F.col("__type"))
    both = both.where(F.col("one.mention_id") != F.col("other.mention_id"))
    first = F.col("one.mention_id") < F.col("other.mention_id")
    side = lambda yes, no, name: F.when(first, F.col(yes)).otherwise(F.col(no)).alias(name)
    return both.select(side("one", "other", "a"), side("other", "one", "b"))


def generate_candidates(mentions: DataFrame, threshold: float = THRESHOLD, skip_same_doc: bool = False, zero_as_missing: bool = False, token_blocking: bool = False, of: str | None = None) -> DataFrame:
    """Candidate pairs of embedded mentions of one type that score ``threshold`` or more.

    The unrounded score is compared; ids depend on the pair and the threshold's
    version only, so reruns agree. All pairs are compared, by blocks. ``token_blocking``
    compares only forms that share a word: cheaper on large types, but pairs without a
    common word are not seen. ``of`` gives the pairs of one mention at the cost of its own.
    """
    rows = mentions.where(F.size("embedding") > 0)
    if zero_as_missing:
        rows = rows.where(~vx.is_missing(F.col("embedding")))
    spread = doc_spread(rows).withColumnRenamed("n_docs", "docs")
    rows = rows.join(spread, ["normalized_form", "entity_type"], "left")
    context = tx.compact_context(F.col("context_left"), F.col("surface_form"), F.col("context_right"))
    rows = rows.select(
        *("mention_id", "doc_id", "entity_type", "normalized_form", "embedding", "docs", "extractor_name", "extractor_label", "extractor_confidence"),
        tx.tokens(F.col("normalized_form")).alias("words"), context.alias("context"),
    )
    if token_blocking:
        pairs = pairs_of(rows.withColumn("word", F.explode("words")), block=["entity_type", "word"])
        pairs = pairs.where(F.col("a.word") == F.array_min(F.array_intersect("a.words", "b.words")))
    elif of is not None:
        pairs = _pairs_with(rows, of)
    else:
        pairs = near_pairs(rows, "mention_id", threshold, form="normalized_form", weights=(COSINE_WEIGHT, LEXICAL_WEIGHT))
    if "cosine" not in pairs.columns:
        pairs = pairs.withColumn("cosine", vx.cosine_similarity(F.col("a.embedding"), F.col("b.embedding")))
    if skip_same_doc:
        pairs = pairs.where("a.doc_id <> b.doc_id")
    scored = pairs.withColumns(similarity()).withColumn("raw", blended()).where(F.col("raw") >= threshold)
    scored = scored.withColumns({"docs_a": F.coalesce("a.docs", F.lit(1)), "docs_b": F.coalesce("b.docs", F.lit(1))})
    return scored.select(
        tx.stable_id(F.col("a.mention_id"), F.col("b.mention_id"), F.lit(THRESHOLD_VERSION)).alias("candidate_id"),
        F.col("a.mention_id").alias("mention_id_a"),
        F.col("b.mention_id").alias("mention_id_b"),
        F.round("raw", 4).alias("score"),
        reasons().alias("reasons"),
        evidence().alias("evidence"),
        F.lit("pending").alias("status"),
        F.lit(THRESHOLD_VERSION).alias("threshold_version"),
    )


def build_clusters(pairs: DataFrame) -> DataFrame:
    """Connected components of the pairs not rejected, with their members and mean score.

    Of a repeated pair the one with the greatest candidate id counts. Every cluster
    has two members at least. The pairs are written once, so what makes them runs once.
    """
    active = pairs.where("status <> 'rejected'").select(F.least("mention_id_a", "mention_id_b").alias("src"), F.greatest("mention_id_a", "mention_id_b").alias("dst"), "score", "candidate_id")
    one = cut(active.groupBy("src", "dst").agg(F.max_by("score", "candidate_id").alias("score")))
    found = connected_components(one)
    means = one.join(found, one.src == found.node).groupBy("component").agg(F.avg("score").alias("mean"))
    members = found.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("member_mentions")).where(F.size("member_mentions") >= 2)
    return members.join(means, "component").select(
        tx.stable_id(F.concat_ws(",", "member_mentions")).alias("cluster_id"), "member_mentions", F.round("mean", 4).alias("cluster_score"), F.lit("pending").alias("status")
    )


def golden_metrics(judged: DataFrame, predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """One row: true and false positives, false negatives, precision (0 where nothing is predicted)."""
    p, t = F.col(predicted), F.col(truth)
    counts = judged.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return counts.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)))

