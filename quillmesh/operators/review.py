"""Analyst decisions: an append-only log, the latest view, and its effect on candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh import schemas
from quillmesh.sources.sinks import latest, upsert
from quillmesh.sources.tables import load_table


def log_latest(decisions: DataFrame, order: str = "created_at") -> DataFrame:
    """One row a decision id: the last."""
    return latest(decisions, "decision_id", order)


def with_status(candidates: DataFrame, decisions: DataFrame, order: str = "created_at") -> DataFrame:
    """Candidates with the status of their last decision, where there is one."""
    last = decisions.groupBy("candidate_id").agg(F.max_by("decision", F.struct(order)).alias("__decision"))
    joined = candidates.join(last, "candidate_id", "left")
    return joined.withColumn("status", F.coalesce("__decision", "status")).select(candidates.columns)


def pending_queue(candidates: DataFrame) -> DataFrame:
    return candidates.where("status = 'pending'")


def submit(decision: DataFrame, log_path: str, candidates_path: str) -> DataFrame:
    """Merge decisions into the log by id and set their candidates' status; returns the candidates."""
    spark = decision.sparkSession
    bad = decision.where(~F.col("decision").isin(*schemas.DECISIONS))
    if not bad.isEmpty():
        raise ValueError(f"a decision is one of {', '.join(schemas.DECISIONS)}")
    upsert(decision, log_path, schemas.REVIEW_DECISIONS, "decision_id")
    old = load_table(spark, candidates_path, schemas.CANDIDATE_PAIRS)
    touched = old.join(decision.select("candidate_id").distinct(), "candidate_id", "left_semi")
    return upsert(with_status(touched, decision), candidates_path, schemas.CANDIDATE_PAIRS, "candidate_id")


def effective_status(candidates: DataFrame, local: DataFrame) -> DataFrame:
    """Candidates whose ``status`` gives way to a local one: ``local`` has ``candidate_id, local_status``."""
    joined = candidates.join(local, "candidate_id", "left")
    return joined.withColumn("status", F.coalesce("local_status", "status")).select(candidates.columns)
