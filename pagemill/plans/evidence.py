"""Queries on evidence: packages, coverage by windows and expansion, audits, chains, hybrid search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.text import squeeze, text_layer, visible
from pagemill.operators import dense, lexical, ranking
from pagemill.plans import frames
from pagemill.plans.frames import EXTENTS, GOLD, LISTED, PAGES, SPACE
from pagemill.plans.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"""WITH {LISTED}, {PAGES}, t AS (SELECT l.question_id, l.rank, l.page, trim(regexp_replace(p.text, '{SPACE}', ' ', 'g')) AS text FROM listed l JOIN pages p ON p.doc_id = l.doc_id AND p.page = l.page WHERE l.rank <= 5)
SELECT question_id, count(*) AS pages, string_agg(page::VARCHAR, ',' ORDER BY rank) AS page_list, md5(string_agg('[p' || page || '] ' || text, chr(10) || chr(10) ORDER BY rank)) AS digest FROM t GROUP BY question_id""")
def evidence_package(spark, folder):
    l = frames.listed_run(spark, folder).filter("rank <= 5")
    t = l.join(frames.pages(spark, folder), ["doc_id", "page"])
    part = F.concat(F.lit("[p"), F.col("page").cast("string"), F.lit("] "), squeeze(F.col("text")))
    own = t.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "page", part.alias("t")))).alias("x"))
    return own.select("question_id", F.size("x").cast("bigint").alias("pages"), F.concat_ws(",", F.transform("x", lambda r: r["page"].cast("string"))).alias("page_list"), F.md5(F.concat_ws("\n\n", F.transform("x", lambda r: r["t"]))).alias("digest"))


@query(f"""WITH {GOLD}, {PAGES}, s AS (SELECT g.question_id, CASE WHEN p.text IS NULL THEN 3 WHEN length(regexp_replace(p.text, '{SPACE}', '', 'g')) <= 19 THEN 2 WHEN length(regexp_replace(p.text, '{SPACE}', '', 'g')) <= 99 THEN 1 ELSE 0 END AS worst FROM gold g LEFT JOIN pages p ON p.doc_id = g.doc_id AND p.page = g.page)
SELECT question_id, ['ok', 'low_text', 'text_layer_missing', 'absent'][1 + max(worst)] AS status, count(*) AS pages FROM s GROUP BY question_id""")
def gold_text_status(spark, folder):
    g = frames.gold(spark, folder).join(frames.pages(spark, folder), ["doc_id", "page"], "left")
    n = visible(F.col("text"))
    worst = F.when(F.col("text").isNull(), 3).when(n <= 19, 2).when(n <= 99, 1).otherwise(0)
    names = F.array(*map(F.lit, ("ok", "low_text", "text_layer_missing", "absent")))
    return g.groupBy("question_id").agg(F.max(worst).alias("w"), F.count("*").alias("pages")).select("question_id", F.element_at(names, F.col("w") + 1).alias("status"), "pages")


@query(f"""WITH {LISTED}, {EXTENTS}, {GOLD}, off AS (SELECT unnest([-1, 0, 1]) AS off), pool AS (SELECT DISTINCT l.question_id, l.doc_id, l.page + off AS page FROM listed l CROSS JOIN off JOIN extents e ON e.doc_id = l.doc_id WHERE l.page + off BETWEEN 1 AND e.last),
size AS (SELECT question_id, count(*) AS n FROM pool GROUP BY question_id), hit AS (SELECT g.question_id, count(*) AS gold, count(p.page) AS found FROM gold g LEFT JOIN pool p ON p.question_id = g.question_id AND p.page = g.page WHERE g.question_id IN (SELECT question_id FROM size) GROUP BY g.question_id)
SELECT count(*) AS questions, count(*) FILTER (found > 0) AS any_found, count(*) FILTER (found = gold) AS all_found, min(n) AS least, max(n) AS most, round(avg(n) + 1e-9, 4) AS mean FROM hit JOIN size USING (question_id)""")
def expansion_coverage(spark, folder):
    pool = ranking.expand(frames.listed_run(spark, folder), frames.extents(spark, folder), 1).select("question_id", "doc_id", "page")
    size = pool.groupBy("question_id").agg(F.count("*").alias("n"))
    g = frames.gold(spark, folder).join(size, "question_id", "left_semi")
    hit = g.join(pool.withColumn("f", F.lit(1)), ["question_id", "doc_id", "page"], "left").groupBy("question_id").agg(F.count("*").alias("gold"), F.count("f").alias("found"))
    return hit.join(size, "question_id").agg(F.count("*").alias("questions"), F.count_if(F.col("found") > 0).alias("any_found"), F.count_if(F.col("found") == F.col("gold")).alias("all_found"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n") + 1e-9, 4).alias("mean"))


@query(f"""WITH {LISTED}, {EXTENTS}, {GOLD}, w AS (SELECT DISTINCT question_id, l.doc_id, greatest(1, least(page - 1, last - 2)) AS start FROM listed l JOIN extents e ON l.doc_id = e.doc_id WHERE last >= 3),
c AS (SELECT g.question_id, g.page, count(w.start) > 0 AS inside FROM gold g LEFT JOIN w ON w.question_id = g.question_id AND g.page BETWEEN w.start AND w.start + 2 GROUP BY g.question_id, g.page)
SELECT question_id, count(*) AS gold, count(*) FILTER (inside) AS inside FROM c GROUP BY question_id""")
def window_coverage(spark, folder):
    w = ranking.anchored(frames.listed_run(spark, folder), frames.extents(spark, folder), 3)
    inside = w.select("question_id", F.explode(F.sequence("start", F.col("start") + 2)).alias("page")).distinct().withColumn("f", F.lit(1))
    c = frames.gold(spark, folder).join(inside, ["question_id", "page"], "left")
    return c.groupBy("question_id").agg(F.count("*").alias("gold"), F.count("f").alias("inside"))


@query(f"""WITH {LISTED}, {PAGES}, p AS (SELECT l.question_id, l.page, l.rank, regexp_matches(t.text, '\\([0-9]+\\)|n/a') AS preferred FROM listed l JOIN pages t ON t.doc_id = l.doc_id AND t.page = l.page)
SELECT question_id, page, row_number() OVER (PARTITION BY question_id ORDER BY NOT preferred, rank) AS pos FROM p""")
def preferred_first(spark, folder):
    p = frames.listed_run(spark, folder).join(frames.pages(spark, folder), ["doc_id", "page"])
    w = Window.partitionBy("question_id").orderBy(~F.col("text").rlike(r"\([0-9]+\)|n/a"), "rank")
    return p.select("question_id", "page", F.row_number().over(w).cast("bigint").alias("pos"))


@query(f"""WITH {PAGES}, o AS (SELECT doc_id, page, right(rtrim(text, chr(10) || chr(13) || chr(9) || ' '), 1) NOT IN ('.', '!', '?', '') AS open FROM pages), b AS (SELECT *, CASE WHEN lag(open) OVER w AND lag(page) OVER w = page - 1 THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page) AS chain FROM b) SELECT doc_id, min(page) AS first, max(page) AS last FROM c GROUP BY doc_id, chain HAVING count(*) > 1""")
def continuation_chains(spark, folder):
    p = frames.pages(spark, folder)
    w = Window.partitionBy("doc_id").orderBy("page")
    open_ = ~F.substring(F.rtrim("text", F.lit("\n\r\t ")), -1, 1).isin(".", "!", "?", "")
    o = p.select("doc_id", "page", open_.alias("open"))
    o = o.withColumn("fresh", F.when(F.lag("open").over(w) & (F.lag("page").over(w) == F.col("page") - 1), 0).otherwise(1))
    c = o.withColumn("chain", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("doc_id", "chain").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count("*").alias("n")).filter("n > 1").select("doc_id", "first", "last")


@query("""SELECT count(*) AS rows_seen, count(DISTINCT (doc_id, page)) AS pages, count(*) - count(DISTINCT (doc_id, page, text)) AS delivered_again, count(*) FILTER (extraction_status IS NULL) AS no_status, count(*) FILTER (non_whitespace_chars IS NULL) AS no_count FROM page_records WHERE doc_id IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL""")
def corpus_audit(spark, folder):
    p = table(spark, folder, "page_records").filter("doc_id is not null and page is not null and text is not null")
    return p.agg(F.count("*").alias("rows_seen"), F.count_distinct("doc_id", "page").alias("pages"), (F.count("*") - F.count_distinct("doc_id", "page", "text")).alias("delivered_again"), F.count_if(F.col("extraction_status").isNull()).alias("no_status"), F.count_if(F.col("non_whitespace_chars").isNull()).alias("no_count"))


@query(rf"""WITH {PAGES}, n AS (SELECT doc_id, page, length(regexp_replace(text, '{SPACE}', '', 'g')) AS c FROM pages), s AS (SELECT doc_id, page, CASE WHEN c <= 19 THEN 'text_layer_missing' WHEN c <= 99 THEN 'low_text' ELSE 'ok' END AS status FROM n),
t AS (SELECT doc_id, page, min(lower(extraction_status)) AS told FROM page_records WHERE doc_id IS NOT NULL AND page IS NOT NULL GROUP BY ALL)
SELECT coalesce(told, 'none') AS told, status, count(*) AS pages FROM s JOIN t USING (doc_id, page) GROUP BY ALL""")
def status_drift(spark, folder):
    s = frames.pages(spark, folder).select("doc_id", "page", text_layer(visible(F.col("text"))).alias("status"))
    t = table(spark, folder, "page_records").filter("doc_id is not null and page is not null").groupBy("doc_id", "page").agg(F.min(F.lower("extraction_status")).alias("told"))
    return s.join(t, ["doc_id", "page"]).groupBy(F.coalesce("told", F.lit("none")).alias("told"), "status").agg(F.count("*").alias("pages"))


@query("""SELECT result_id, question_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id, page ORDER BY scored_at DESC NULLS LAST, result_id DESC) AS k FROM bm25_results WHERE CAST(scored_at AS DATE) >= batch_date) WHERE k = 1""")
def late_rows_dropped(spark, folder):
    w = Window.partitionBy("question_id", "doc_id", "page").orderBy(F.col("scored_at").desc_nulls_last(), F.desc("result_id"))
    r = table(spark, folder, "bm25_results").filter(F.col("scored_at").cast("date") >= F.col("batch_date"))
    return r.withColumn("k", F.row_number().over(w)).filter("k = 1").select("result_id", "question_id")


@query("""WITH e AS (SELECT question_id, list_sort(list_distinct(list(condition))) AS c FROM reasoning_inputs WHERE question_id IS NOT NULL AND condition IS NOT NULL GROUP BY question_id) SELECT CASE WHEN len(c) = 1 THEN c[1] ELSE 'mixed' END AS kind, array_to_string(c, '+') AS conditions, count(*) AS questions FROM e GROUP BY ALL""")
def evidence_type(spark, folder):
    e = table(spark, folder, "reasoning_inputs").filter("question_id is not null and condition is not null").groupBy("question_id").agg(F.array_sort(F.collect_set("condition")).alias("c"))
    return e.groupBy(F.when(F.size("c") == 1, F.col("c")[0]).otherwise("mixed").alias("kind"), F.concat_ws("+", "c").alias("conditions")).agg(F.count("*").alias("questions"))


@query("""WITH m AS (SELECT id, map_concat(map {'pages': page_count::VARCHAR}, map {'source': source, 'split': split}) AS q FROM doc_store WHERE source IS NOT NULL AND split IS NOT NULL AND page_count IS NOT NULL) SELECT id, q['source'] AS source, coalesce(q['none'], '-') AS missing, cardinality(q)::BIGINT AS entries FROM m""")
def qualifier_maps(spark, folder):
    d = table(spark, folder, "doc_store").filter("source is not null and split is not null and page_count is not null")
    q = F.map_filter(F.map_concat(F.create_map(F.lit("pages"), F.col("page_count").cast("string")), F.create_map(F.lit("source"), "source", F.lit("split"), "split")), lambda k, v: v != "")
    m = d.select("id", q.alias("q"))
    return m.select("id", F.try_element_at("q", F.lit("source")).alias("source"), F.coalesce(F.try_element_at("q", F.lit("none")), F.lit("-")).alias("missing"), F.map_keys("q").alias("k")).select("id", "source", "missing", F.size("k").cast("bigint").alias("entries"))


@query("""SELECT id, page_count, row_number() OVER (ORDER BY created_at DESC, id) AS pos FROM doc_store ORDER BY created_at DESC, id LIMIT 20""")
def newest_documents(spark, folder):
    top = table(spark, folder, "doc_store").orderBy(F.desc("created_at"), "id").limit(20)
    return top.select("id", "page_count", F.row_number().over(Window.orderBy(F.desc("created_at"), "id")).cast("bigint").alias("pos"))


@query()
def hybrid_search(spark, folder):
    """BM25 and hashed vectors fused; vectors of a question meet the pages of its own document only."""
    q, p = frames.questions(spark, folder), frames.pages(spark, folder)
    first = lexical.ranked(lexical.bm25(q, p), 10)
    scored = dense.hashed_similarity(q, p)
    return ranking.fuse([first, lexical.ranked(scored, 10)]).filter("rank <= 10")
