"""Entity-resolution stages: ``python -m quillmesh.jobs.resolution STAGE``.

Each stage reads its predecessor's table under the store and merges or overwrites its own.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh import schemas
from quillmesh.operators import embed, extract, resolve, review
from quillmesh.sources import sinks, tables


def fetch(spark: SparkSession, cfg: schemas.RunConfig) -> DataFrame:
    """Set the status of pending manifest rows from the files under ``raw``."""
    path = f"{cfg.data_dir}/manifest"
    manifest = tables.load_manifest(spark, path)
    now = sinks.fetch_status(manifest, tables.file_inventory(spark, f"{cfg.data_dir}/raw"))
    sinks.save_manifest(now, path + ".next")
    return now


def parse(spark: SparkSession, cfg: schemas.RunConfig) -> DataFrame:
    """Chunks of the fetched files; the name of a file is its document's id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{cfg.data_dir}/raw")
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    chunks = tables.parse_pages(files, name).where("error IS NULL").drop("error").withColumn("created_at", F.current_timestamp())
    sinks.save(chunks.select(schemas.CHUNKS.names), f"{cfg.store_dir}/chunks")
    return tables.load_table(spark, f"{cfg.store_dir}/chunks", schemas.CHUNKS)


def extract_mentions(spark: SparkSession, cfg: schemas.RunConfig) -> DataFrame:
    chunks = tables.load_table(spark, f"{cfg.store_dir}/chunks", schemas.CHUNKS)
    return sinks.upsert(extract.extract_mentions(chunks, extract.build_extractor(cfg.extractor), cfg.extractor), f"{cfg.store_dir}/mentions", schemas.MENTIONS, "mention_id")


def embed_mentions(spark: SparkSession, cfg: schemas.RunConfig) -> DataFrame:
    path = f"{cfg.store_dir}/mentions"
    sinks.swap(embed.embed_missing(tables.load_table(spark, path, schemas.MENTIONS)), path)
    return tables.load_table(spark, path, schemas.MENTIONS)


def resolve_aliases(spark: SparkSession, cfg: schemas.RunConfig) -> DataFrame:
    """Candidates and clusters; pairs that were decided keep their status."""
    mentions = tables.load_table(spark, f"{cfg.store_dir}/mentions", schemas.MENTIONS)
    found = resolve.generate_candidates(mentions, cfg.threshold, zero_as_missing=True)
    log = tables.load_table(spark, f"{cfg.store_dir}/decisions", schemas.REVIEW_DECISIONS)
    candidates = sinks.upsert(review.with_status(found, log), f"{cfg.store_dir}/candidate_pairs", schemas.CANDIDATE_PAIRS, "candidate_id")
    sinks.upsert(resolve.build_clusters(candidates), f"{cfg.store_dir}/candidate_clusters", schemas.CANDIDATE_CLUSTERS, "cluster_id")
    return candidates


STAGES = {"fetch-reports": fetch, "parse": parse, "extract-mentions": extract_mentions, "embed-mentions": embed_mentions, "resolve-aliases": resolve_aliases}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("stage", choices=[*STAGES])
    chosen = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"resolution-{chosen.stage}").getOrCreate()
    print(chosen.stage, STAGES[chosen.stage](spark, schemas.RunConfig.from_env()).count())


if __name__ == "__main__":
    main()
