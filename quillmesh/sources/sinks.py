"""Writers: overwrite, insert if absent, and merge by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh import schemas
from quillmesh.sources.tables import load_table, path_exists


def latest(df: DataFrame, key: str, order: str = "created_at") -> DataFrame:
    """The last row of each key by ``order``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` replaces the rows of ``old`` with its keys: an anti join and a union."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(old.columns))


def swap(df: DataFrame, path: str) -> None:
    """Write beside ``path`` and rename, so that ``df`` may read from it."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path + ".new")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    store = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(fs_path(path)):
        store.delete(fs_path(path), True)
    store.rename(fs_path(path + ".new"), fs_path(path))


def upsert(new: DataFrame, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Merge ``new`` into the table at ``path`` by ``key`` and return the table. Nulls stay null."""
    spark = new.sparkSession
    swap(merged(load_table(spark, path, schema), new, key), path)
    return spark.read.schema(schema).parquet(path)


def ensure_tables(spark: SparkSession, store: str, names: tuple[str, ...] = ("documents", "mentions", "candidate_pairs", "candidate_clusters")) -> dict[str, bool]:
    """Create the store's tables that are absent; says of each whether it was there."""
    there = {}
    for name in names:
        there[name] = path_exists(spark, f"{store}/{name}")
        if not there[name]:
            spark.createDataFrame([], schemas.TABLES[name]).write.parquet(f"{store}/{name}")
    return there


def save(df: DataFrame, path: str, by: str | None = None) -> str:
    """Overwrite a Parquet table, partitioned by ``by``; an empty frame writes nothing and returns ""."""
    if df.isEmpty():
        return ""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return path


def save_manifest(df: DataFrame, path: str) -> str:
    """Overwrite the manifest CSV, one file; an empty frame writes nothing."""
    if df.isEmpty():
        return ""
    df.select(schemas.MANIFEST.names).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def save_slices(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges, each partitioned by slice."""
    nodes.write.mode("overwrite").partitionBy("slice_id").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("slice_id").parquet(f"{path}/edges")


def encode_nested(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, for stores and dashboards that hold plain columns; vectors stay arrays."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType)) and f.name != "embedding"]
    return df.withColumns({c: F.to_json(c) for c in nested})


def fetch_status(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Next status of pending rows, from an inventory ``(local_path, checksum)`` of the files present.

    A present file whose checksum the row names, or for which it names none, is
    fetched; the row then carries the checksum. Others have failed. Rows that are not
    pending keep their status.
    """
    have = inventory.select("local_path", F.col("checksum").alias("found"))
    joined = manifest.join(have, "local_path", "left")
    good = F.col("found").isNotNull() & ((F.coalesce("checksum", F.lit("")) == "") | (F.col("checksum") == F.col("found")))
    status = F.when(F.col("status") != "pending", F.col("status")).when(good, F.lit("fetched")).otherwise(F.lit("failed"))
    checksum = F.when((F.col("status") == "pending") & good, F.col("found")).otherwise(F.col("checksum"))
    return joined.withColumn("new_status", status).withColumn("checksum", checksum).withColumn("status", F.col("new_status")).select(manifest.columns)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``(local_path, checksum, length)`` of the files under ``path``: SHA-256 in hex."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("local_path"), F.sha2("content", 256).alias("checksum"), "length")
