"""Mention extraction: an extractor is a function of a text column that gives spans."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh import schemas
from quillmesh.functions import text as tx

SPANS = "array<struct<text:string,label:string,score:double,start:int,end:int>>"
#: What the built-in extractor looks for, by label, in order of precedence.
PATTERNS = {
    "VESSEL": r"\b(?:M/?V|MT|vessel) [A-Z][A-Za-z]+(?: [A-Z0-9][A-Za-z0-9]*)*",
    "ORGANIZATION": r"\b[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)* (?:Corporation|Corp|Company|Co|Bank|Group|Bureau|Ltd|Agency)\b",
    "PERSON": r"\b(?:Mr|Mrs|Ms|Dr|Captain)\.? [A-Z][a-z]+(?: [A-Z][a-z'-]+)*",
    "GPE": r"\b(?:port|city|town) of [A-Z][a-z]+",
}


def pattern_extractor(patterns: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """A deterministic extractor by regular expressions; of spans that overlap the earlier pattern's stays."""
    compiled = [(label, re.compile(p)) for label, p in (patterns or PATTERNS).items()]

    def spans(text: str | None) -> list[dict]:
        taken: list[tuple[int, int]] = []
        out = []
        for label, pattern in compiled:
            for m in pattern.finditer(text or ""):
                if all(m.end() <= a or m.start() >= b for a, b in taken):
                    taken.append(m.span())
                    out.append({"text": m.group(), "label": label, "score": 1.0, "start": m.start(), "end": m.end()})
        return sorted(out, key=lambda s: s["start"])

    @F.pandas_udf(SPANS)
    def extract(texts: pd.Series) -> pd.Series:
        return texts.map(spans)

    return extract


def gazetteer_extractor(forms: dict[str, str]) -> Callable[[Column], Column]:
    """An extractor of listed surface forms: ``{form: label}``, the longest form first."""
    by_label: dict[str, list[str]] = {}
    for form, label in forms.items():
        by_label.setdefault(label, []).append(form)
    return pattern_extractor({g: r"\b(?:" + "|".join(re.escape(x) for x in sorted(fs, key=len, reverse=True)) + r")\b" for g, fs in by_label.items()})


#: Extractors by name. A model-backed one registers a factory that takes the model's name.
EXTRACTORS: dict[str, Callable[[str | None], Callable[[Column], Column]]] = {"pattern": lambda model: pattern_extractor()}


def build_extractor(kind: str = "pattern", model: str | None = None) -> Callable[[Column], Column]:
    """The extractor named ``kind`` (case and space around it aside); ValueError for an unknown one."""
    name = kind.strip().lower()
    if name not in EXTRACTORS:
        raise ValueError(f"unknown extractor {kind!r}; known: {', '.join(sorted(EXTRACTORS))}")
    return EXTRACTORS[name](model)


def extract_mentions(chunks: DataFrame, extractor: Callable[[Column], Column] | None = None, name: str = "pattern", title: bool = True) -> DataFrame:
    """One row a mention, with its normal form, type and context; embeddings are null.

    ``chunks``: ``doc_id, page, text``. Blank chunks, spans of other types and mentions
    without a normal form are dropped. ``title=False`` leaves case alone.
    """
    extractor = extractor or build_extractor(name)
    rows = chunks.where(tx.strip(F.col("text")) != "")
    spans = rows.withColumn("span", F.explode(extractor(F.col("text"))))
    typed = spans.withColumn("entity_type", tx.map_label(F.col("span.label"))).where(F.col("entity_type").isin(*schemas.ENTITY_TYPES))
    form = tx.normalize_surface(F.col("span.text"), F.col("entity_type")) if title else tx.squeeze(F.col("span.text"))
    named = typed.withColumn("normalized_form", form).where("normalized_form <> ''")
    return named.select(
        tx.stable_id("doc_id", "page", F.col("span.start"), F.col("span.end"), F.col("entity_type")).alias("mention_id"),
        "doc_id",
        F.col("page").cast("int").alias("page"),
        F.col("span.text").alias("surface_form"),
        "normalized_form",
        "entity_type",
        tx.context_left(F.col("text"), F.col("span.start")).alias("context_left"),
        tx.context_right(F.col("text"), F.col("span.end")).alias("context_right"),
        F.col("text").alias("chunk_text"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.lit("").alias("model_name"),
        F.lit(name).alias("extractor_name"),
        F.col("span.label").alias("extractor_label"),
        F.col("span.score").cast("float").alias("extractor_confidence"),
        F.current_timestamp().alias("created_at"),
    )
