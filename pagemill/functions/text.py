"""Text primitives as native column expressions: spacing, tokens, text-layer class, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the wide sense, with the separators that Java leaves out.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
#: Most visible characters of a page without, and of one with little, text layer.
MISSING_MOST, LOW_MOST = 19, 99
#: A word: letters and digits.
WORD = r"[\p{L}\p{N}]+"
#: A number: grouped figures with an optional decimal part.
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def visible(c: Column) -> Column:
    """Number of characters that are no white space."""
    return F.length(F.regexp_replace(c, SPACE, "")).cast("bigint")


def lowered(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case, in order, with repeats."""
    return F.regexp_extract_all(lowered(c), F.lit(WORD), F.lit(0))


def text_layer(n: Column) -> Column:
    return F.when(n <= MISSING_MOST, "text_layer_missing").when(n <= LOW_MOST, "low_text").otherwise("ok")


def control_chars(c: Column) -> Column:
    """Number of control characters that are no white space."""
    return F.length(F.regexp_replace(c, r"[^\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]", "")).cast("bigint")


def light_stem(c: Column) -> Column:
    """Drops ``-ing`` of words over five letters and ``-s`` of words over four."""
    return F.when((F.length(c) > 5) & c.endswith("ing"), c.substr(F.lit(1), F.length(c) - 3)).when((F.length(c) > 4) & c.endswith("s"), c.substr(F.lit(1), F.length(c) - 1)).otherwise(c)


def as_decimal(c: Column) -> Column:
    """A number written with grouped thousands, or in accounting brackets for negatives; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^\((.*)\)$", "-$1"), ",", "")
    shaped = F.trim(c).rlike(r"^\(?-?[0-9][0-9,]*(\.[0-9]+)?\)?$") & (F.trim(c).startswith("(") == F.trim(c).endswith(")"))
    return F.when(shaped, bare).try_cast("decimal(38,6)")


def plain_decimal(c: Column) -> Column:
    """A decimal as text without trailing zeros; integers keep theirs."""
    s = c.cast("string")
    s = F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(s == "-0", "0").otherwise(s)
