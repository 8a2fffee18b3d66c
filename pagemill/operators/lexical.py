"""Page ranking by BM25 within each document.

Statistics (pages, mean length, document frequencies) are those of a question's own document, so one plan
over all documents replaces an index per document. Pages without a query term are ranked too, with score 0.
Scores are rounded to nine digits before they are ranked, so the order does not depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import WORD, lowered, tokens

K1, B = 1.2, 0.75


def postings(pages: DataFrame) -> DataFrame:
    """``doc_id, page, term, tf`` of pages ``(doc_id, page, text)``."""
    words = pages.select("doc_id", "page", F.explode(tokens(F.col("text"))).alias("term"))
    return words.groupBy("doc_id", "page", "term").agg(F.count("*").alias("tf"))


def page_lengths(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.coalesce(F.regexp_count(lowered(F.col("text")), F.lit(WORD)), F.lit(0)).cast("bigint").alias("dl"))


def document_stats(lengths: DataFrame) -> DataFrame:
    """``doc_id, pages, avgdl``; a document without a word has a mean length of 1."""
    mean = F.avg("dl")
    return lengths.groupBy("doc_id").agg(F.count("*").alias("pages"), F.when(mean > 0, mean).otherwise(1.0).alias("avgdl"))


def idf(pages: Column, df: Column) -> Column:
    return F.log(1 + (pages - df + 0.5) / (df + 0.5))


def query_terms(questions: DataFrame, once: bool = False) -> DataFrame:
    """``question_id, doc_id, term, qtf``; with ``once`` a repeated word weighs as one."""
    words = tokens(F.col("question"))
    words = F.array_distinct(words) if once else words
    return questions.select("question_id", "doc_id", F.explode(words).alias("term")).groupBy("question_id", "doc_id", "term").agg(F.count("*").alias("qtf"))


def asked_postings(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, page, term, tf`` of the words that a question of the document asks for; the others are left out before they are counted."""
    words = pages.select("doc_id", "page", F.explode(tokens(F.col("text"))).alias("term"))
    return words.join(terms.select("doc_id", "term").distinct(), ["doc_id", "term"], "left_semi").groupBy("doc_id", "page", "term").agg(F.count("*").alias("tf"))


def bm25(questions: DataFrame, pages: DataFrame, once: bool = False, k1: float = K1, b: float = B, pool: DataFrame | None = None) -> DataFrame:
    """``question_id, doc_id, page, score`` of every page of a question's document, or of those in ``pool`` only.

    questions: ``question_id, doc_id, question``; pages: ``doc_id, page, text``, one row each; pool: ``question_id,
    doc_id, page``. Statistics are those of the whole document either way. Questions of unknown documents give no
    row; null texts count as empty.
    """
    terms, lengths = query_terms(questions, once), page_lengths(pages)
    post, stats = asked_postings(pages, terms), document_stats(lengths)
    df = post.groupBy("doc_id", "term").agg(F.count("*").alias("df"))
    weighed = terms.join(df, ["doc_id", "term"]).join(stats, "doc_id").select("question_id", "doc_id", "term", "avgdl", (F.col("qtf") * idf(F.col("pages"), F.col("df"))).alias("w"))
    every = questions.select("question_id", "doc_id").join(pages.select("doc_id", "page"), "doc_id")
    if pool is not None:
        pool = pool.select("question_id", "doc_id", "page").distinct()
        every = every.join(pool, ["question_id", "doc_id", "page"], "left_semi")
        post = post.join(pool, ["doc_id", "page"], "left_semi")
    hits = weighed.join(post.join(lengths, ["doc_id", "page"]), ["doc_id", "term"])
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("question_id", "page").agg(F.sum(part).alias("s"))
    return every.join(scored, ["question_id", "page"], "left").select("question_id", "doc_id", "page", F.round(F.coalesce("s", F.lit(0.0)), 9).alias("score"))


def ranked(scores: DataFrame, k: int | None = None, group: str = "question_id") -> DataFrame:
    """Adds ``rank`` from 1: score descending, then document, then page; the first ``k`` only."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "doc_id", "page")
    out = scores.withColumn("rank", F.row_number().over(w))
    return (out.filter(F.col("rank") <= k) if k else out).withColumn("rank", F.col("rank").cast("bigint"))


def snippets(hits: DataFrame, pages: DataFrame, questions: DataFrame, width: int = 300, step: int = 50) -> DataFrame:
    """``question_id, page, start, cover``: the window of each hit page whose different query words weigh most.

    Windows of ``width`` characters start every ``step``; the earliest wins a tie.
    """
    stats = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    own = query_terms(questions, True)
    df = asked_postings(pages, own).groupBy("doc_id", "term").agg(F.count("*").alias("df"))
    terms = own.join(df, ["doc_id", "term"]).join(stats, "doc_id").select("question_id", "term", idf(F.col("pages"), F.col("df")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(step))
    parts = hits.select("question_id", "doc_id", "page").join(pages, ["doc_id", "page"]).select("question_id", "page", "text", F.explode(starts).alias("start"))
    cut = F.substring(F.col("text"), F.col("start") + 1, F.lit(width))
    found = parts.select("question_id", "page", "start", F.explode(F.array_distinct(tokens(cut))).alias("term")).join(terms, ["question_id", "term"])
    cover = found.groupBy("question_id", "page", "start").agg(F.round(F.sum("w"), 6).alias("cover"))
    every = parts.select("question_id", "page", "start").join(cover, ["question_id", "page", "start"], "left").withColumn("cover", F.coalesce("cover", F.lit(0.0)))
    best = every.groupBy("question_id", "page").agg(F.max_by(F.struct("start", "cover"), F.struct("cover", -F.col("start"))).alias("b"))
    return best.select("question_id", "page", F.col("b.start").cast("bigint").alias("start"), F.col("b.cover").alias("cover"))
