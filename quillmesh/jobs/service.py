"""The calls of the review service, as functions over the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmesh import schemas
from quillmesh.operators import embed, review
from quillmesh.sources import tables


def health() -> dict[str, str]:
    return {"status": "ok"}


def list_mentions(spark: SparkSession, store: str, doc_id: str | None = None, entity_type: str | None = None) -> DataFrame:
    return tables.load_table(spark, f"{store}/mentions", schemas.MENTIONS, doc_id=doc_id, entity_type=entity_type)


def list_candidates(spark: SparkSession, store: str, status: str | None = None) -> DataFrame:
    return tables.load_table(spark, f"{store}/candidate_pairs", schemas.CANDIDATE_PAIRS, status=status)


def get_candidate(spark: SparkSession, store: str, candidate_id: str):
    """The candidate's row; KeyError where there is none."""
    row = tables.load_table(spark, f"{store}/candidate_pairs", schemas.CANDIDATE_PAIRS, candidate_id=candidate_id).limit(1).collect()
    if not row:
        raise KeyError(candidate_id)
    return row[0]


def submit_decision(spark: SparkSession, store: str, decision: dict) -> DataFrame:
    """Log one decision and set its candidate's status."""
    rows = spark.createDataFrame([tuple(decision.get(n) for n in schemas.REVIEW_DECISIONS.names)], schemas.REVIEW_DECISIONS)
    return review.submit(rows, f"{store}/decisions", f"{store}/candidate_pairs")


def list_decisions(spark: SparkSession, store: str) -> DataFrame:
    return tables.load_table(spark, f"{store}/decisions", schemas.REVIEW_DECISIONS)


def search_mentions(spark: SparkSession, store: str, query: str, limit: int = 10) -> DataFrame:
    """The ``limit`` (1 to 100) mentions nearest to a query text."""
    return embed.search(list_mentions(spark, store), query, limit)
