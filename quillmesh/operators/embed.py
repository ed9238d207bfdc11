"""Text vectors by feature hashing, and exact nearest mentions."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions import vectors as vx
from quillmesh.functions.text import input_text

DIMENSIONS, MODEL = 384, "hashing-char-3-5"


def hash_vector(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vector of signed counts of character n-grams of length 3 to 5; zeros for an empty text."""
    padded = f" {text.lower()} ".encode()
    out = np.zeros(dimensions, np.float32)
    for n in (3, 4, 5):
        for i in range(len(padded) - n + 1):
            h = zlib.crc32(padded[i : i + n])
            out[h % dimensions] += 1.0 if h >> 31 else -1.0
    size = np.linalg.norm(out)
    return out / size if size and text else np.zeros(dimensions, np.float32)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: hash_vector(t or ""))


def embed_missing(mentions: DataFrame, embed=embed_text, model: str = MODEL) -> DataFrame:
    """Embeds the mentions whose vector is null, empty or zero; leaves the others alone."""
    todo = vx.is_missing(F.col("embedding"))
    vector = F.when(todo, embed(input_text(F.col("context_left"), F.col("surface_form"), F.col("context_right")))).otherwise(F.col("embedding"))
    return mentions.withColumns({"model_name": F.when(todo, F.lit(model)).otherwise(F.col("model_name")), "embedding": vector})


def nearest_mentions(mentions: DataFrame, query: list[float], limit: int = 10, vector: str = "embedding", key: str = "mention_id") -> DataFrame:
    """The ``limit`` (1 to 100) nearest rows by exact L2 distance; ties by key."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    target = F.lit([float(x) for x in query])
    return mentions.where(F.size(vector) > 0).withColumn("distance", vx.l2_distance(F.col(vector), target)).orderBy("distance", key).limit(limit)


def search(mentions: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Nearest mentions to a query text."""
    return nearest_mentions(mentions, hash_vector(text).tolist(), limit)
