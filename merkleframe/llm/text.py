"""Text columns that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, as in [\x20\x09-\x0D].
BLANK = " \t\n\x0b\x0c\r"
BLANKS = r"[\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def split_words(c: Column, separators: str) -> Column:
    """The non-empty pieces between matches of a pattern; null has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), separators), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the frame doesn't have, whatever its own are called; Spark tells no capitals apart."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
