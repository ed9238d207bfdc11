"""The driver tables seen as entities, relations, mentions and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import graph


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _code(letter: str, key: str, width: int):
    return F.concat(F.lit(letter), F.lpad(F.col(key).cast("string"), width, "0"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between customers and suppliers: one a line item, dated by its order."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.with_slice(
        joined.select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("edge_id"),
            _code("C", "o_custkey", 9).alias("source_entity_id"),
            _code("S", "l_suppkey", 9).alias("target_entity_id"),
            F.col("l_returnflag").alias("relation_type"),
            F.col("l_quantity").alias("weight"),
            F.col("l_orderkey").cast("string").alias("source_doc_id"),
            F.to_date("o_orderdate").alias("report_date"),
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
            "o_custkey",
            "l_suppkey",
        )
    )


def traders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as nodes."""
    c = read(spark, sf_dir, "customer").select(_code("C", "c_custkey", 9).alias("entity_id"), F.col("c_name").alias("entity_label"), F.lit("ORG").alias("entity_type"), F.col("c_acctbal").alias("balance"))
    s = read(spark, sf_dir, "supplier").select(_code("S", "s_suppkey", 9).alias("entity_id"), F.col("s_name").alias("entity_label"), F.lit("VESSEL").alias("entity_type"), F.col("s_acctbal").alias("balance"))
    return c.union(s)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as embedded mentions: the label is the type, a part's name the form."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), F.col("p_name").alias("name"))
    return e.join(p, "vec_id", "left").select(
        _code("M", "vec_id", 9).alias("mention_id"),
        F.concat(F.lit("D"), (F.col("vec_id") % 97).cast("string")).alias("doc_id"),
        F.lit(1).alias("page"),
        F.coalesce("name", F.lit("")).alias("surface_form"),
        F.coalesce("name", F.lit("")).alias("normalized_form"),
        F.concat(F.lit("T"), F.col("label").cast("string")).alias("entity_type"),
        F.lit("").alias("context_left"),
        F.lit("").alias("context_right"),
        F.lit("").alias("chunk_text"),
        "embedding",
        F.lit("given").alias("model_name"),
        F.lit("table").alias("extractor_name"),
        F.lit("").alias("extractor_label"),
        F.lit(1.0).cast("float").alias("extractor_confidence"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a decision log: the user is the candidate, the type the decision; ``seq`` orders it."""
    e = read(spark, sf_dir, "events")
    said = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "click", "needs_review").otherwise("pending")
    return e.select(
        _code("E", "event_id", 9).alias("decision_id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("candidate_id"),
        F.lit("analyst").alias("reviewer"), said.alias("decision"), F.col("event_id").alias("seq"), F.col("ts").alias("created_at"),
    )
