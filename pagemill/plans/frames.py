"""Frames that several queries start from, and the SQL of the same frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.plans.tables import table


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, page, text``: each page once."""
    rows = table(spark, folder, "page_records").filter("doc_id is not null and page is not null")
    return rows.groupBy("doc_id", "page").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def extents(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "page_records").filter("doc_id is not null and page is not null")
    return rows.groupBy("doc_id").agg(F.max("page").alias("last"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """``question_id, doc_id, question``: each question once, its document as named in its id."""
    rows = table(spark, folder, "reasoning_inputs").filter("question_id is not null and question is not null")
    return rows.groupBy("question_id").agg(F.min("question").alias("question")).select("question_id", F.substring_index("question_id", "::", 1).alias("doc_id"), "question")


def gold(spark: SparkSession, folder: str) -> DataFrame:
    """``question_id, doc_id, page``: pages listed as a question's oracle evidence."""
    rows = table(spark, folder, "reasoning_inputs").filter("condition = 'oracle_page'")
    return rows.select("question_id", F.substring_index("question_id", "::", 1).alias("doc_id"), F.explode("evidence_pages").alias("page")).distinct()


def stored_run(spark: SparkSession, folder: str) -> DataFrame:
    """``question_id, doc_id, page, score, rank``: the scored pages of the stored results, all ranks."""
    rows = table(spark, folder, "bm25_results").filter("score is not null and not isnan(score) and question_id is not null and doc_id is not null and page is not null")
    best = rows.groupBy("question_id", "doc_id", "page").agg(F.max("score").alias("score"))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id", "page")
    return best.withColumn("rank", F.row_number().over(w))


def listed_run(spark: SparkSession, folder: str) -> DataFrame:
    """``question_id, doc_id, page, rank``: the pages given as evidence under real retrieval, in their order."""
    rows = table(spark, folder, "reasoning_inputs").filter("condition = 'real_retrieval' and evidence_pages is not null")
    one = rows.groupBy("question_id").agg(F.min_by("evidence_pages", "input_id").alias("p"))
    return one.select("question_id", F.substring_index("question_id", "::", 1).alias("doc_id"), F.posexplode(F.array_distinct("p")).alias("rank", "page")).withColumn("rank", F.col("rank") + 1)


PAGES = "pages AS (SELECT doc_id, page, min(coalesce(text, '')) AS text FROM page_records WHERE doc_id IS NOT NULL AND page IS NOT NULL GROUP BY doc_id, page)"
EXTENTS = "extents AS (SELECT doc_id, max(page) AS last FROM page_records WHERE doc_id IS NOT NULL AND page IS NOT NULL GROUP BY doc_id)"
QUESTIONS = "questions AS (SELECT question_id, split_part(question_id, '::', 1) AS doc_id, min(question) AS question FROM reasoning_inputs WHERE question_id IS NOT NULL AND question IS NOT NULL GROUP BY question_id)"
GOLD = "gold AS (SELECT DISTINCT question_id, split_part(question_id, '::', 1) AS doc_id, unnest(evidence_pages) AS page FROM reasoning_inputs WHERE condition = 'oracle_page')"
STORED = """best AS (
  SELECT question_id, doc_id, page, max(score) AS score FROM bm25_results
  WHERE score IS NOT NULL AND NOT isnan(score) AND question_id IS NOT NULL AND doc_id IS NOT NULL AND page IS NOT NULL GROUP BY question_id, doc_id, page
), stored AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, page) AS rank FROM best)"""
LISTED = """lists AS (
  SELECT question_id, arg_min(evidence_pages, input_id) AS p FROM reasoning_inputs WHERE condition = 'real_retrieval' AND evidence_pages IS NOT NULL GROUP BY question_id
), spread AS (SELECT question_id, split_part(question_id, '::', 1) AS doc_id, unnest(p) AS page, generate_subscripts(p, 1) AS pos FROM lists
), firsts AS (SELECT question_id, doc_id, page, min(pos) AS pos FROM spread GROUP BY question_id, doc_id, page
), listed AS (SELECT question_id, doc_id, page, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS rank FROM firsts)"""
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def words(c: str) -> str:
    return rf"regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')"


BM25 = f"""tok AS (SELECT doc_id, page, unnest({words('text')}) AS term FROM pages
), post AS (SELECT doc_id, page, term, count(*) AS tf FROM tok GROUP BY ALL
), len AS (SELECT doc_id, page, len({words('text')}) AS dl FROM pages
), stats AS (SELECT doc_id, count(*) AS n, CASE WHEN avg(dl) > 0 THEN avg(dl) ELSE 1 END AS avgdl FROM len GROUP BY doc_id
), df AS (SELECT doc_id, term, count(*) AS df FROM post GROUP BY ALL)"""


def scores(distinct: bool) -> str:
    terms = words("question")
    terms = f"list_distinct({terms})" if distinct else terms
    return f"""qtok AS (SELECT question_id, doc_id, unnest({terms}) AS term FROM questions
), qt AS (SELECT question_id, doc_id, term, count(*) AS qtf FROM qtok GROUP BY ALL
), hit AS (
  SELECT q.question_id, p.page, sum(qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * l.dl / s.avgdl))) AS s
  FROM qt q JOIN df d ON q.doc_id = d.doc_id AND q.term = d.term JOIN stats s ON s.doc_id = q.doc_id
  JOIN post p ON p.doc_id = q.doc_id AND p.term = q.term JOIN len l ON l.doc_id = p.doc_id AND l.page = p.page GROUP BY ALL
), scored AS (
  SELECT q.question_id, q.doc_id, p.page, round(coalesce(h.s, 0)::DOUBLE, 9) AS score
  FROM questions q JOIN pages p ON q.doc_id = p.doc_id LEFT JOIN hit h ON h.question_id = q.question_id AND h.page = p.page
), ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, page) AS rank FROM scored)"""
