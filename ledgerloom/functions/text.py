"""Word splitting and token counting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.core import as_column

# Every character that separates words; none lies above U+3000.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def words(text: Column | str) -> Column:
    """Whitespace-separated words, without empty ones.

    All separators are first mapped to a blank: splitting at one plain character needs no regex.
    """
    blanks = F.translate(as_column(text), WHITESPACE, " " * len(WHITESPACE))
    return F.array_remove(F.split(blanks, " "), "")


def token_count(text: Column | str) -> Column:
    """Number of words; null text has 0."""
    return F.coalesce(F.size(words(text)), F.lit(0))
