"""Numbers in texts: parsing, units, comparison, support on pages, a calculator, quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import NUMBER, as_decimal, lowered, plain_decimal, squeeze


def numbers(text: Column) -> Column:
    """The numbers of a text as an array of plain decimals, each once, in order of first mention."""
    raw = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(raw, lambda x: plain_decimal(as_decimal(F.rtrim(x, F.lit(","))))))


def hours(value: Column, unit: Column) -> Column:
    """A duration in hours, for minutes, hours and days in singular or plural; null for other units."""
    u = F.regexp_replace(F.lower(F.trim(unit)), "s$", "")
    return F.when(u == "minute", value / 60).when(u == "hour", value).when(u == "day", value * 24)


def compared(left: Column, right: Column) -> Column:
    """Signed difference, its size and its direction."""
    d = left - right
    return F.struct(d.alias("difference"), F.abs(d).alias("size"), F.when(d > 0, "greater").when(d < 0, "less").otherwise("equal").alias("direction"))


def calculated(op: Column, args: Column) -> Column:
    """The result of an operation over an array of doubles; null for a wrong number of operands or a zero divisor."""
    a, b = F.try_element_at(args, F.lit(1)), F.try_element_at(args, F.lit(2))
    two = F.size(args) == 2
    total = F.aggregate(args, F.lit(0.0), lambda s, x: s + x)
    return (
        F.when((op == "add") & two, a + b)
        .when((op == "subtract") & two, a - b)
        .when((op == "multiply") & two, a * b)
        .when((op == "divide") & two, F.try_divide(a, b))
        .when((op == "ratio") & two, F.try_divide(a, b))
        .when((op == "percent_change") & two, F.try_divide(100 * (b - a), F.abs(a)))
        .when((op == "sum") & (F.size(args) > 0), total)
        .when((op == "mean") & (F.size(args) > 0), total / F.size(args))
    )


def quoted(page: Column, quote: Column) -> Column:
    """Whether a quote stands on a page, but for case and spacing."""
    return F.contains(squeeze(lowered(page)), squeeze(lowered(quote)))


def supported(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """``claim, number, pages``: the pages of the claim's document that hold each of its numbers.

    claims: ``claim, doc_id, text``; pages: ``doc_id, page, text``. Joined on the plain form of the numbers.
    """
    c = claims.select("claim", "doc_id", F.explode(numbers(F.col("text"))).alias("number"))
    p = pages.select("doc_id", "page", F.explode(numbers(F.col("text"))).alias("number")).join(c.select("doc_id", "number").distinct(), ["doc_id", "number"], "left_semi")
    hit = c.join(p, ["doc_id", "number"], "left")
    return hit.groupBy("claim", "number").agg(F.count("page").alias("pages"), F.min("page").alias("first_page"))


def common_page(support: DataFrame, claims: DataFrame, pages: DataFrame) -> DataFrame:
    """``claim, page``: the first page that holds every number of a claim."""
    c = claims.select("claim", "doc_id", F.explode(numbers(F.col("text"))).alias("number")).distinct()
    need = c.groupBy("claim").agg(F.count("*").alias("need"))
    p = pages.select("doc_id", "page", F.explode(numbers(F.col("text"))).alias("number"))
    full = c.join(p, ["doc_id", "number"]).groupBy("claim", "page").agg(F.count("*").alias("n")).join(need, "claim").filter("n = need")
    return full.groupBy("claim").agg(F.min("page").alias("page"))


def unique_match(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``doc_id, rule, value, page``: values of rules ``(name, pattern with one group)`` found exactly once in a document."""
    out = None
    for name, pattern in rules:
        hit = pages.select("doc_id", "page", F.lit(name).alias("rule"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("value"))
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy("doc_id", "rule").agg(F.count("*").alias("n"), F.min("value").alias("value"), F.min("page").alias("page")).filter("n = 1").drop("n")
