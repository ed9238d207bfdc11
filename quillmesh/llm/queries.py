"""The registered queries over the operators of this package, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import ann, bpe, langid, mixing, quality, quality_sql, sharding, simhash, toxicity, urls, warc
from quillmesh.llm.words import word_count
from quillmesh.plans.lineage import fresh_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(of: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def tokenizer_spec(spark: SparkSession, path: str | None = None):
    """Broadcast of the tokenizer file's content (about 2 MB)."""
    return spark.sparkContext.broadcast(bpe.read_spec(path or public_tokenizers.path("byte_bpe_50k.json")))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, seed=42, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shuffle_into_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    text = F.coalesce("text", F.lit(""))
    size, digest = (F.octet_length(text) + 8).cast("long"), F.crc32(text.cast("binary"))
    return dealt.select("doc_id", size.alias("size"), digest.alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    found = ann.nearest(rows, rows.where("vec_id % 50 = 0"), k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(F.coalesce(remainder(3), F.lit(0)) != 1))
    said = docs.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), langid.language_column(model, F.col("text")).alias("said"))
    return said.select("doc_id", "held_out", F.col("said.lang").alias("lang_pred"), F.col("said.score").alias("score"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"), floor=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe.digest_column(tokenizer_spec(spark), F.col("text")).alias("d")).select("doc_id", "d.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder(5) != 0))
    scored = docs.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), toxicity.score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    planned = mixing.plan(docs)
    out = mixing.mix(docs, planned=planned)
    copies = out.groupBy(F.col("doc_id").alias("__id"), mixing.place(planned.seed).alias("__place")).agg(F.sum(word_count(F.col("text"))).alias("words"))
    alike = planned.joined(planned.rows.groupBy("doc_id", "source", "size", "place").agg(F.count("*").cast("int").alias("many")))
    found = alike.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("place") == F.col("__place")), "left")
    taken = F.expr("coalesce(words, 0L) div many")
    given = found.select("doc_id", "size", F.col("__plan.words").alias("source_size"), F.col("__plan.target").alias("target"), taken.alias("taken"), F.explode(F.array_repeat(F.lit(0), F.col("many"))).alias("__each"))
    return given.drop("__each")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read_archives(warc.archive(read(spark, sf_dir, "pages")))
    return back.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_sharding, op3_url_filters, op4_ann, op5_language_id, op6_quality_rules, op7_bpe, op8_toxicity, op9_mixing, op10_warc)}

_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * k + 1, 5))::INT >> {shift}) & 31) + 1, 1)"

#: The others rest on XXH64, random draws, trained models or a tokenizer; tests hold those against brute force.
ORACLES: dict[str, str] = {
    "op6_quality_rules": quality_sql.oracle(),
    "op10_warc": f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 8), lambda k: {' || '.join(_BASE32.format(shift=s) for s in (15, 10, 5, 0))}), 'string_agg', '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
}
