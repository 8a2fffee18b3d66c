"""Queries of this subpackage, by name, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import cross_split, languages, leaks, natural_cuts, packing, scan_repair, text_kinds, text_stats, tied_splits, top_items
from pagemill.plans.tables import table


def _unique_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "page_records").filter("doc_id is not null and page is not null")


def _page_key() -> F.Column:
    return F.concat("doc_id", F.lit("::p"), F.col("page").cast("string"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").filter("doc_id is not null")
    texts = docs.select(F.lit("document").alias("unit"), F.col("doc_id").cast("string").alias("item_key"), "text")
    texts = texts.unionByName(_unique_pages(spark, folder).select(F.lit("page").alias("unit"), _page_key().alias("item_key"), "text"))
    return text_kinds.not_prose(texts, [F.col("unit"), F.col("item_key")])


def p1_statistics(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").filter("doc_id is not null")
    low = F.col("low_text_pages") / F.col("page_count")
    share = F.when((F.col("page_count") > 0) & low.between(0, 1), F.round(low, 6))
    docs = docs.select(F.lit("document").alias("unit"), F.col("doc_id").cast("string").alias("item_key"), F.lit(None).cast("bigint").alias("stored"), share.alias("low_text_share"), (F.col("low_text_pages").isNotNull() & share.isNull()).alias("odd"), "text")
    pages = _unique_pages(spark, folder).select(F.lit("page").alias("unit"), _page_key().alias("item_key"), F.col("non_whitespace_chars").cast("bigint").alias("stored"), F.lit(None).cast("double").alias("low_text_share"), F.lit(False).alias("odd"), "text")
    # rows delivered twice count once; of several texts of one key the first in string order
    own = F.min(F.struct("text", "stored", "low_text_share", "odd")).alias("x")
    one = docs.unionByName(pages).groupBy("unit", "item_key").agg(own).select("unit", "item_key", "x.text", "x.stored", "x.low_text_share", "x.odd")
    out = text_stats.with_stats(one).drop("text")
    wrong = F.when(F.col("unit") == "page", ~F.col("stored").eqNullSafe(F.col("visible"))).otherwise(F.col("odd"))
    return out.withColumn("stored_count_wrong", wrong).drop("stored", "odd")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_repair.damaged_lines(_unique_pages(spark, folder))


def p2_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scan_repair.repaired(_unique_pages(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return tied_splits.record_groups(table(spark, folder, "reasoning_inputs")).filter("size >= 2").select("question_id", "group_id")


def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    return tied_splits.assign_splits(table(spark, folder, "reasoning_inputs"), table(spark, folder, "split_targets"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split.cross_split_pairs(*(table(spark, folder, n) for n in ("reasoning_inputs", "page_records", "doc_store")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder)


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split.overlap_report(_pairs(spark, folder), table(spark, folder, "reasoning_inputs"), table(spark, folder, "doc_store"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_items.top_items(table(spark, folder, "bm25_results"), "question_id", ["doc_id", "page"], "score", 5).select("question_id", "pos", "doc_id", "page")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return natural_cuts.wrong_pieces(_unique_pages(spark, folder), table(spark, folder, "dense_chunks"), table(spark, folder, "size_limits"))


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return natural_cuts.cut_pages(_unique_pages(spark, folder), table(spark, folder, "size_limits"))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    size, _ = natural_cuts._limit(table(spark, folder, "size_limits"), "pack_large")
    return packing.packed(table(spark, folder, "documents"), size)


def p7_packed_small(spark: SparkSession, folder: str) -> DataFrame:
    size, _ = natural_cuts._limit(table(spark, folder, "size_limits"), "pack_small")
    return packing.packed(table(spark, folder, "documents"), size)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("item_id", "doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return languages.mislabelled(table(spark, folder, "documents"))


def p9_stretches(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").filter("doc_id is not null")
    found = languages.detect(text_kinds.with_kind(docs.select("doc_id", "text")), languages.fitted(docs))
    part = found.select("doc_id", F.col("lang").alias("doc_lang"), F.round("confidence", 6).alias("doc_confidence"), F.explode_outer("parts").alias("p"))
    return part.select("doc_id", "doc_lang", "doc_confidence", "p.lang", F.round("p.confidence", 6).alias("confidence"), F.col("p.first").alias("first_unit"), F.col("p.last").alias("last_unit"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_statistics, p2_found, p2_repaired, p3_found, p3_splits, p4_found, p4_report, p5_found, p6_found, p6_pieces, p7_packed, p7_packed_small, p8_found, p9_found, p9_stretches)}


SQL: dict[str, str] = {}

SQL["p5_found"] = """
WITH best AS (
  SELECT question_id, doc_id, page, max(score) AS s FROM bm25_results
  WHERE score IS NOT NULL AND NOT isnan(score) AND question_id IS NOT NULL AND doc_id IS NOT NULL AND page IS NOT NULL
  GROUP BY question_id, doc_id, page
), ranked AS (
  SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY s DESC, doc_id, page) AS INTEGER) AS pos, doc_id, page FROM best
)
SELECT question_id, pos, doc_id, page FROM ranked WHERE pos <= 5
"""

_FOLD = "regexp_replace(strip_accents(lower(author)), '[\\s.,;:!?]+$', '')"
SQL["p3_found"] = f"""
WITH RECURSIVE keys AS (
  SELECT DISTINCT question_id AS q, 'd:' || regexp_replace(regexp_replace(regexp_replace(lower(trim(d)), '\\.[a-z]{{2,4}}$', ''), '[^a-z0-9]+', '', 'g'), '^(urn)?(uuid)?', '') AS k
  FROM (SELECT question_id, doc_id AS d FROM reasoning_inputs UNION ALL SELECT question_id, split_part(question_id, '::', 1) FROM reasoning_inputs) WHERE d IS NOT NULL
  UNION
  SELECT question_id, 'a:' || regexp_replace({_FOLD}, '[\\s\\x{{a0}}]+', '', 'g') FROM reasoning_inputs
  WHERE author IS NOT NULL AND trim(lower(author)) NOT IN ('', '-', 'n/a', 'unknown')
), reach AS (
  SELECT DISTINCT q AS a, q AS b FROM keys
  UNION
  SELECT r.a, k2.q FROM reach r JOIN keys k1 ON r.b = k1.q JOIN keys k2 ON k1.k = k2.k
), grp AS (SELECT a AS question_id, min(b) AS group_id, count(DISTINCT b) AS n FROM reach GROUP BY a)
SELECT question_id, group_id FROM grp WHERE n >= 2
"""

SQL["p6_found"] = """
WITH p AS (
  SELECT doc_id, page, regexp_extract_all(min(coalesce(text, '')), '\\S+') AS w FROM page_records
  WHERE doc_id IS NOT NULL AND page IS NOT NULL GROUP BY doc_id, page
), c AS (
  SELECT DISTINCT doc_id, page, chunk_index, coalesce(text, '') AS text FROM dense_chunks WHERE doc_id IS NOT NULL AND page IS NOT NULL AND chunk_index IS NOT NULL
), o AS (
  SELECT c.doc_id, c.page, chunk_index, ' ' || array_to_string(w, ' ') || ' ' AS flat, regexp_extract_all(text, '\\S+') AS own,
    lag(regexp_extract_all(text, '\\S+')) OVER s AS before, lead(chunk_index) OVER s IS NULL AS last
  FROM c JOIN p ON p.doc_id = c.doc_id AND p.page = c.page WHERE len(w) > 0
  WINDOW s AS (PARTITION BY c.doc_id, c.page ORDER BY chunk_index, text)
), l AS (SELECT max(max_size) AS size, max(overlap) AS overlap FROM size_limits WHERE limit_name = 'dense_chunk')
SELECT DISTINCT doc_id, page, chunk_index FROM o CROSS JOIN l
WHERE len(own) = 0 OR len(own) > size OR NOT contains(flat, ' ' || array_to_string(own, ' ') || ' ')
  OR (before IS NULL AND NOT starts_with(flat, ' ' || array_to_string(own, ' ') || ' '))
  OR (last AND NOT ends_with(flat, ' ' || array_to_string(own, ' ') || ' '))
  OR (before IS NOT NULL AND array_to_string(own[1:overlap], ' ') <> array_to_string(before[greatest(len(before) - overlap + 1, 1):len(before)], ' '))
  OR (NOT last AND NOT regexp_matches(own[len(own)], '[.!?]["''»”’)\\]}]*$')
      AND len(list_filter(own[greatest(len(own) - 24, 1):len(own)], lambda x: regexp_matches(x, '[.!?]["''»”’)\\]}]*$'))) > 0)
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
