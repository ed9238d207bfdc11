"""Text expressions: normal forms, contexts, lexical similarity. All but ``title_case`` stay in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space, as Python's str methods see it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
CONTEXT = 50
#: Extractor labels and the entity types they stand for; others count as ORG.
LABEL_TYPES = {
    "ORG": "ORG", "ORGANIZATION": "ORG", "PERSON": "PERSON", "PER": "PERSON", "GPE": "LOCATION",
    "LOC": "LOCATION", "LOCATION": "LOCATION", "FAC": "LOCATION", "SHIP": "VESSEL", "VESSEL": "VESSEL",
}


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize_page(text: Column) -> Column:
    """Page text: at most one blank line in a row, no white space at line ends, none at either end.

    The steps keep that order, so lines of spaces only are not collapsed.
    """
    fewer = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(fewer, r"(?U)[^\S\n]+(?=\n|\z)", ""))


@F.pandas_udf(T.StringType())
def title_case(text: pd.Series) -> pd.Series:
    """Python's title(): a capital after every character that is not a letter, unlike ``initcap``."""
    return text.str.title()


def normalize_surface(surface: Column, entity_type: Column) -> Column:
    """Squeezed surface form; title case for organisations and persons."""
    flat = squeeze(surface)
    return F.when(entity_type.isin("ORG", "PERSON"), title_case(flat)).otherwise(flat)


def map_label(label: Column) -> Column:
    """Entity type of an extractor's label, whatever its case."""
    table = F.create_map(*[F.lit(x) for pair in LABEL_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(label)), F.lit("ORG"))


def context_left(text: Column, start: Column, width: int = CONTEXT) -> Column:
    """Up to ``width`` characters before the 0-based ``start``, line breaks as spaces, stripped."""
    begin = F.greatest(start - width, F.lit(0))
    return strip(F.translate(F.substring(text, begin + 1, start - begin), "\n", " "))


def context_right(text: Column, end: Column, width: int = CONTEXT) -> Column:
    """Up to ``width`` characters from the 0-based ``end`` on, line breaks as spaces, stripped."""
    return strip(F.translate(F.substring(text, end + 1, F.lit(width)), "\n", " "))


def input_text(left: Column, surface: Column, right: Column) -> Column:
    """What the embedder reads: context, surface form, context; empty parts left out."""
    return F.concat_ws(" ", F.nullif(left, F.lit("")), surface, F.nullif(right, F.lit("")))


def compact_context(left: Column, surface: Column, right: Column) -> Column:
    """The three parts stripped, empty ones dropped, white space squeezed."""
    return squeeze(F.concat_ws(" ", *[F.nullif(strip(p), F.lit("")) for p in (left, surface, right)]))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 for equal strings (both empty included), 0 where one is empty, else ``1 - distance / longer length``."""
    longest = F.greatest(F.length(a), F.length(b))
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(a == b, 1.0).when(empty, 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def tokens(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), SPACE), ""))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words; 1 where neither has any."""
    both = F.size(F.array_union(tokens(a), tokens(b)))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(tokens(a), tokens(b))) / both)


def stable_id(*parts: Column | str) -> Column:
    """A deterministic id of the parts, so that reruns agree."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string"), F.lit("")) for p in parts]), 256)


def short_title(text: Column, most: int = 40, keep: int = 38) -> Column:
    """Titles over ``most`` characters are cut to ``keep`` and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(keep)), F.lit("…"))).otherwise(text)


def transition_label(prev: Column, curr: Column, arrow: str = "->") -> Column:
    return F.concat(prev, F.lit(arrow), curr)
