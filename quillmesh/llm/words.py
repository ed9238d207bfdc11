"""Native word helpers shared by the operators: words are ``[^\\x20\\x09-\\x0D]+``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six characters that part words.
SPACES = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts give an empty array."""
    blank = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5)
    return F.array_remove(F.split(blank, " "), "")


def word_count(text: Column) -> Column:
    """Number of words as long; null text gives 0."""
    return F.size(words(text)).cast("long")
