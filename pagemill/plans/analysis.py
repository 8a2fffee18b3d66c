"""Queries on facts, joins, samples, resampling, folds and logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.text import as_decimal, light_stem, plain_decimal, tokens
from pagemill.operators import facts, folds, stats
from pagemill.plans import frames
from pagemill.plans.frames import GOLD, LISTED, PAGES, QUESTIONS, SPACE, STORED, words
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


# numbers and text ------------------------------------------------------------------------------------

_PLAIN = "regexp_replace(regexp_replace({0}::DECIMAL(38,6)::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
_RAW = "regexp_extract_all({0}, '[0-9][0-9,]*(?:\\.[0-9]+)?')"


def _nums(c: str) -> str:
    plain = _PLAIN.format("try_cast(replace(x, ',', '') AS DECIMAL(38,6))")
    return f"list_transform({_RAW.format(c)}, lambda x: {plain})"


@query(f"""WITH {QUESTIONS}, n AS (SELECT question_id, unnest({_RAW.format('question')}) AS raw FROM questions), d AS (SELECT DISTINCT question_id, rtrim(raw, ',') AS raw FROM n)
SELECT question_id, raw, {_PLAIN.format("replace(raw, ',', '')")} AS value FROM d""")
def numeric_parse(spark, folder):
    q = frames.questions(spark, folder)
    n = q.select("question_id", F.explode(F.regexp_extract_all("question", F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))).alias("raw"))
    return n.select("question_id", F.rtrim("raw", F.lit(",")).alias("raw")).distinct().select("question_id", "raw", plain_decimal(as_decimal(F.col("raw"))).alias("value"))


@query(f"""WITH {PAGES}, v AS (SELECT doc_id, page, unnest(regexp_extract_all(text, '\\([0-9][0-9,]*(?:\\.[0-9]+)?\\)')) AS raw FROM pages)
SELECT doc_id, count(*) AS negatives, round(sum(-(replace(substring(raw, 2, length(raw) - 2), ',', '')::DECIMAL(38,6)))::DOUBLE, 4) AS total FROM v GROUP BY doc_id""")
def accounting_negatives(spark, folder):
    v = frames.pages(spark, folder).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\([0-9][0-9,]*(?:\.[0-9]+)?\)"), F.lit(0))).alias("raw"))
    return v.groupBy("doc_id").agg(F.count("*").alias("negatives"), F.round(F.sum(as_decimal(F.col("raw"))).cast("double"), 4).alias("total"))


_CLAIMS = f"claims AS (SELECT question_id AS claim, doc_id, unnest(list_distinct({_nums('question')})) AS number FROM questions), pn AS (SELECT doc_id, page, unnest(list_distinct({_nums('text')})) AS number FROM pages)"


def _claims(spark, folder):
    return frames.questions(spark, folder).select(F.col("question_id").alias("claim"), "doc_id", F.col("question").alias("text"))


@query(f"""WITH {PAGES}, {QUESTIONS}, {_CLAIMS} SELECT c.claim, c.number, count(p.page) AS pages, min(p.page) AS first_page FROM claims c LEFT JOIN pn p ON p.doc_id = c.doc_id AND p.number = c.number GROUP BY c.claim, c.number""")
def citation_support(spark, folder):
    return facts.supported(_claims(spark, folder), frames.pages(spark, folder))


@query(f"""WITH {PAGES}, {QUESTIONS}, {_CLAIMS}, need AS (SELECT claim, count(*) AS need FROM claims GROUP BY claim), f AS (SELECT c.claim, p.page, count(*) AS n FROM claims c JOIN pn p ON p.doc_id = c.doc_id AND p.number = c.number GROUP BY ALL)
SELECT f.claim, min(f.page) AS page FROM f JOIN need ON f.claim = need.claim AND f.n = need.need GROUP BY f.claim""")
def citation_repair(spark, folder):
    return facts.common_page(None, _claims(spark, folder), frames.pages(spark, folder))


_RULES = [("share", r"(?:the share stood at|la part était de|la parte era del|der Anteil lag im Jahr \d+ bei) ([0-9.]+)"), ("spent", r"(?:spent|a dépensé|gastó|zahlte) ([0-9,]+)")]


@query("WITH " + PAGES + ", h AS (" + " UNION ALL ".join(f"SELECT doc_id, page, '{n}' AS rule, unnest(regexp_extract_all(text, '{p}', 1)) AS value FROM pages" for n, p in _RULES) + ") SELECT doc_id, rule, min(value) AS value, min(page) AS page FROM h GROUP BY doc_id, rule HAVING count(*) = 1")
def unique_pattern_facts(spark, folder):
    return facts.unique_match(frames.pages(spark, folder), _RULES)


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_quantity AS b, ['add', 'subtract', 'multiply', 'divide', 'percent_change', 'mean'][1 + (l_orderkey % 6)::INT] AS op FROM lineitem)
SELECT l_orderkey, l_linenumber, op, round(CASE op WHEN 'add' THEN a + b WHEN 'subtract' THEN a - b WHEN 'multiply' THEN a * b WHEN 'divide' THEN a / nullif(b, 0) WHEN 'percent_change' THEN 100 * (b - a) / nullif(abs(a), 0) ELSE (a + b) / 2 END, 7) AS result FROM p""")
def calculator(spark, folder):
    ops = F.array(*map(F.lit, ("add", "subtract", "multiply", "divide", "percent_change", "mean")))
    op = F.element_at(ops, (F.col("l_orderkey") % 6 + 1).cast("int"))
    p = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", op.alias("op"), F.array("l_extendedprice", "l_quantity").alias("x"))
    return p.select("l_orderkey", "l_linenumber", "op", F.round(facts.calculated(F.col("op"), F.col("x")), 7).alias("result"))


@query(f"""WITH {PAGES}, c AS (SELECT doc_id, page, chunk_index, min(text) AS quote FROM dense_chunks WHERE chunk_index IS NOT NULL GROUP BY ALL)
SELECT c.doc_id, c.page, c.chunk_index, contains(trim(regexp_replace(replace(lower(p.text), 'ß', 'ss'), '{SPACE}', ' ', 'g')), trim(regexp_replace(replace(lower(c.quote), 'ß', 'ss'), '{SPACE}', ' ', 'g'))) AS on_page FROM c JOIN pages p USING (doc_id, page)""")
def quote_check(spark, folder):
    c = table(spark, folder, "dense_chunks").filter("chunk_index is not null").groupBy("doc_id", "page", "chunk_index").agg(F.min("text").alias("quote"))
    return c.join(frames.pages(spark, folder), ["doc_id", "page"]).select("doc_id", "page", "chunk_index", facts.quoted(F.col("text"), F.col("quote")).alias("on_page"))


@query(f"""WITH d AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL), p AS (SELECT user_id, max(CASE WHEN event_type = 'click' THEN v END) AS a, max(CASE WHEN event_type = 'view' THEN v END) AS b FROM d GROUP BY user_id)
SELECT user_id, round(a - b, 4) AS difference, round(abs(a - b), 4) AS size, CASE WHEN a - b > 0 THEN 'greater' WHEN a - b < 0 THEN 'less' ELSE 'equal' END AS direction FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def comparison_result(spark, folder):
    v = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    p = table(spark, folder, "events").groupBy("user_id").agg(v("click").alias("a"), v("view").alias("b")).filter("a is not null and b is not null")
    c = p.select("user_id", facts.compared(F.col("a"), F.col("b")).alias("c"))
    return c.select("user_id", F.round("c.difference", 4).alias("difference"), F.round("c.size", 4).alias("size"), "c.direction")


@query(f"""WITH {QUESTIONS}, t AS (SELECT question_id, unnest(list_distinct({words('question')})) AS w FROM questions), s AS (SELECT question_id, CASE WHEN length(w) > 5 AND ends_with(w, 'ing') THEN left(w, length(w) - 3) WHEN length(w) > 4 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END AS stem FROM t WHERE w NOT IN ('the', 'of', 'in', 'that', 'a', 'to', 'and'))
SELECT stem, count(DISTINCT question_id) AS questions FROM s GROUP BY stem""")
def stem_counts(spark, folder):
    t = frames.questions(spark, folder).select("question_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("w")).filter(~F.col("w").isin("the", "of", "in", "that", "a", "to", "and"))
    return t.select("question_id", light_stem(F.col("w")).alias("stem")).groupBy("stem").agg(F.count_distinct("question_id").alias("questions"))


@query("""SELECT event_type, count(*) AS events, count(DISTINCT json_extract_string(props, '$.k')) AS keys, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type""")
def json_props(spark, folder):
    k = F.from_json("props", "k bigint", {"mode": "FAILFAST"})["k"]
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct(k).alias("keys"), F.sum(k).alias("total"))


# joins and sets ---------------------------------------------------------------------------------------


@query(f"""WITH {LISTED}, p AS (SELECT DISTINCT doc_id, page FROM page_records), n AS (SELECT question_id, doc_id, page + 3 AS page FROM listed) SELECT l.question_id, l.page FROM n l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = l.doc_id AND p.page = l.page)""")
def orphan_anti_join(spark, folder):
    """Pages three after the listed ones that no file has."""
    p = table(spark, folder, "page_records").select("doc_id", "page").distinct()
    return frames.listed_run(spark, folder).withColumn("page", F.col("page") + 3).join(p, ["doc_id", "page"], "left_anti").select("question_id", "page")


@query(f"""WITH {GOLD} SELECT g.question_id, g.page + 3 AS page, f.page_count FROM gold g JOIN doc_store f ON f.id = g.doc_id WHERE g.page + 3 NOT BETWEEN 1 AND f.page_count""")
def range_violation_join(spark, folder):
    f = table(spark, folder, "doc_store").select(F.col("id").alias("doc_id"), "page_count")
    return frames.gold(spark, folder).withColumn("page", F.col("page") + 3).join(f, "doc_id").filter(~F.col("page").between(1, F.col("page_count"))).select("question_id", "page", "page_count")


@query("""WITH a AS (SELECT DISTINCT split_part(question_id, '::', 1) AS d FROM reasoning_inputs WHERE split = 'development_tune'), b AS (SELECT DISTINCT split_part(question_id, '::', 1) AS d FROM reasoning_inputs WHERE split <> 'development_tune') SELECT d AS doc_id FROM a EXCEPT SELECT d FROM b""")
def split_anti_join(spark, folder):
    r = table(spark, folder, "reasoning_inputs").filter("question_id is not null").select(F.substring_index("question_id", "::", 1).alias("doc_id"), "split")
    return r.filter("split = 'development_tune'").select("doc_id").distinct().join(r.filter("split <> 'development_tune'"), "doc_id", "left_anti")


@query("""WITH r AS (SELECT DISTINCT split_part(question_id, '::', 1) AS d, split FROM reasoning_inputs WHERE question_id IS NOT NULL) SELECT a.split AS split_a, b.split AS split_b, count(*) AS documents FROM r a JOIN r b ON a.d = b.d AND a.split < b.split GROUP BY ALL""")
def split_disjointness(spark, folder):
    r = table(spark, folder, "reasoning_inputs").filter("question_id is not null").select(F.substring_index("question_id", "::", 1).alias("d"), "split").distinct()
    pairs = r.groupBy("d").agg(F.array_sort(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)  # a handful of splits
    both = pairs.select(F.posexplode("s").alias("i", "split_a"), "s").select("split_a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("split_b"))
    return both.groupBy("split_a", "split_b").agg(F.count("*").alias("documents"))


@query("""WITH e AS (SELECT DISTINCT split_part(question_id, '::', 1) AS d FROM reasoning_inputs WHERE condition = 'oracle_page'), q AS (SELECT DISTINCT question_id, split_part(question_id, '::', 1) AS d FROM reasoning_inputs WHERE condition = 'closed_book')
SELECT question_id FROM q WHERE d IN (SELECT d FROM e)""")
def pool_semi_join(spark, folder):
    r = table(spark, folder, "reasoning_inputs").filter("question_id is not null").select("question_id", "condition", F.substring_index("question_id", "::", 1).alias("d"))
    e = r.filter("condition = 'oracle_page'").select("d")
    return r.filter("condition = 'closed_book'").select("question_id", "d").distinct().join(e, "d", "left_semi").select("question_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY asked_at DESC NULLS LAST, question_id, condition, coalesce(doc_id, '')) AS n FROM reasoning_inputs WHERE input_id IS NOT NULL) SELECT input_id, question_id, condition FROM r WHERE n = 1""")
def last_record_wins(spark, folder):
    w = Window.partitionBy("input_id").orderBy(F.col("asked_at").desc_nulls_last(), "question_id", "condition", F.coalesce("doc_id", F.lit("")))
    r = table(spark, folder, "reasoning_inputs").filter("input_id is not null").withColumn("n", F.row_number().over(w))
    return r.filter("n = 1").select("input_id", "question_id", "condition")


@query("""SELECT DISTINCT question_id FROM reasoning_inputs WHERE question_id IS NOT NULL AND question_id NOT IN (SELECT question_id FROM bm25_results WHERE question_id IS NOT NULL AND score > 20)""")
def resume_anti_join(spark, folder):
    done = table(spark, folder, "bm25_results").filter("score > 20 and question_id is not null").select("question_id")
    return table(spark, folder, "reasoning_inputs").filter("question_id is not null").select("question_id").distinct().join(done, "question_id", "left_anti")


@query(f"""WITH {PAGES}, o AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY chunk_index, text) AS t FROM (SELECT DISTINCT doc_id, page, chunk_index, text FROM dense_chunks WHERE lower(extraction_status) <> 'ok' AND text IS NOT NULL) GROUP BY ALL)
SELECT p.doc_id, p.page, o.t IS NOT NULL AS replaced, md5(coalesce(o.t, p.text)) AS digest FROM pages p LEFT JOIN o USING (doc_id, page)""")
def corpus_overlay(spark, folder):
    c = table(spark, folder, "dense_chunks").filter("lower(extraction_status) <> 'ok' and text is not null").select("doc_id", "page", "chunk_index", "text").distinct()
    o = c.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("x")).select("doc_id", "page", F.concat_ws("\n", F.transform("x", lambda x: x["text"])).alias("t"))
    return frames.pages(spark, folder).join(o, ["doc_id", "page"], "left").select("doc_id", "page", F.col("t").isNotNull().alias("replaced"), F.md5(F.coalesce("t", "text")).alias("digest"))


@query(f"""WITH {QUESTIONS}, r AS (SELECT i.input_id, sha256(i.question || '|' || i.condition) AS h, i.question_id FROM (SELECT DISTINCT input_id, question_id, condition, question FROM reasoning_inputs WHERE input_id IS NOT NULL AND question IS NOT NULL) i)
SELECT input_id, h AS request, row_number() OVER (PARTITION BY h ORDER BY input_id, question_id) = 1 AS sent, count(*) OVER (PARTITION BY h) AS uses FROM r""")
def request_dedup(spark, folder):
    r = table(spark, folder, "reasoning_inputs").filter("input_id is not null and question is not null").select("input_id", "question_id", "condition", "question").distinct()
    r = r.select("input_id", "question_id", F.sha2(F.concat_ws("|", "question", "condition"), 256).alias("request"))
    w = Window.partitionBy("request")
    return r.select("input_id", "request", (F.row_number().over(w.orderBy("input_id", "question_id")) == 1).alias("sent"), F.count("*").over(w).alias("uses"))


@query("""SELECT split, count(*) AS n, sha256(string_agg(q, chr(10) ORDER BY q)) AS digest FROM (SELECT DISTINCT split, question_id AS q FROM reasoning_inputs WHERE question_id IS NOT NULL AND split IS NOT NULL) GROUP BY split""")
def id_set_hash(spark, folder):
    r = table(spark, folder, "reasoning_inputs").filter("question_id is not null and split is not null").select("split", "question_id").distinct()
    return r.groupBy("split").agg(F.count("*").alias("n"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("question_id"))), 256).alias("digest"))


@query(f"""WITH {STORED}, {LISTED}, a AS (SELECT question_id, list(page ORDER BY rank) AS p FROM listed WHERE rank <= 5 GROUP BY question_id), g AS (SELECT question_id, list(DISTINCT page) AS g FROM (SELECT question_id, unnest(evidence_pages) AS page FROM reasoning_inputs WHERE condition = 'oracle_page') GROUP BY question_id)
SELECT question_id, len(list_intersect(p, g))::BIGINT AS shared, len(list_filter(p, lambda x: NOT list_contains(g, x)))::BIGINT AS outside, len(list_filter(g, lambda x: NOT list_contains(p, x)))::BIGINT AS missing FROM a JOIN g USING (question_id)""")
def page_set_algebra(spark, folder):
    l = frames.listed_run(spark, folder).filter("rank <= 5").groupBy("question_id").agg(F.collect_set("page").alias("p"))
    g = frames.gold(spark, folder).groupBy("question_id").agg(F.collect_set("page").alias("g"))
    n = lambda c: F.size(c).cast("bigint")
    return l.join(g, "question_id").select("question_id", n(F.array_intersect("p", "g")).alias("shared"), n(F.array_except("p", "g")).alias("outside"), n(F.array_except("g", "p")).alias("missing"))


# samples and resampling --------------------------------------------------------------------------------


@query("""SELECT question_id FROM (SELECT DISTINCT question_id FROM reasoning_inputs WHERE question_id IS NOT NULL) ORDER BY sha256('20260101:' || question_id), question_id LIMIT 50""")
def hash_sample(spark, folder):
    q = table(spark, folder, "reasoning_inputs").filter("question_id is not null").select("question_id").distinct()
    return stats.hash_sample(q, "question_id", "20260101", 50)


@query("""WITH q AS (SELECT question_id, min(source) AS source FROM reasoning_inputs WHERE question_id IS NOT NULL AND source IS NOT NULL GROUP BY question_id), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || question_id), question_id) AS pos FROM q) SELECT question_id, source, pos FROM r WHERE pos <= 5""")
def stratified_quota(spark, folder):
    q = table(spark, folder, "reasoning_inputs").filter("question_id is not null and source is not null").groupBy("question_id").agg(F.min("source").alias("source"))
    return stats.quota_sample(q, "question_id", "source", "7", 5)


@query("""SELECT doc_id, min(question_id) AS question_id FROM (SELECT question_id, split_part(question_id, '::', 1) AS doc_id FROM reasoning_inputs WHERE question_id IS NOT NULL) GROUP BY doc_id""")
def one_per_group(spark, folder):
    q = table(spark, folder, "reasoning_inputs").filter("question_id is not null")
    return q.groupBy(F.substring_index("question_id", "::", 1).alias("doc_id")).agg(F.min("question_id").alias("question_id"))


_ANSWERED = f"""{STORED}, {GOLD}, top AS (SELECT question_id, max(CASE WHEN rank = 1 THEN round(score, 1) END) AS confidence FROM stored GROUP BY question_id), ok AS (SELECT DISTINCT s.question_id FROM stored s JOIN gold g ON g.question_id = s.question_id AND g.doc_id = s.doc_id AND g.page = s.page WHERE s.rank <= 5),
rows_ AS (SELECT t.question_id, t.confidence, (o.question_id IS NOT NULL)::BIGINT AS correct FROM top t JOIN (SELECT DISTINCT question_id FROM gold) g ON g.question_id = t.question_id LEFT JOIN ok o ON o.question_id = t.question_id)"""


def _answered(spark, folder) -> DataFrame:
    s, g = frames.stored_run(spark, folder), frames.gold(spark, folder)
    top = s.filter("rank = 1").select("question_id", F.round("score", 1).alias("confidence"))
    ok = s.filter("rank <= 5").join(g, ["question_id", "doc_id", "page"], "left_semi").select("question_id").distinct().withColumn("ok", F.lit(1).cast("bigint"))
    return top.join(g.select("question_id").distinct(), "question_id", "left_semi").join(ok, "question_id", "left").select("question_id", "confidence", F.coalesce("ok", F.lit(0).cast("bigint")).alias("correct"))


@query(f"""WITH {_ANSWERED}, r AS (SELECT question_id, confidence, count(*) OVER w AS answered, (sum(1 - correct) OVER w)::BIGINT AS errors, count(*) OVER () AS n FROM rows_ WINDOW w AS (ORDER BY confidence DESC, question_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT question_id, confidence, answered, errors, round(answered / n, 6) AS coverage, round(errors / answered, 6) AS risk FROM r""")
def risk_coverage_curve(spark, folder):
    return stats.risk_coverage(_answered(spark, folder))


@query(f"""WITH {_ANSWERED}, g AS (SELECT confidence, count(*) AS n, sum(1 - correct) AS e FROM rows_ GROUP BY confidence), r AS (SELECT confidence, sum(n) OVER w AS answered, sum(e) OVER w AS errors, sum(n) OVER () AS total FROM g WINDOW w AS (ORDER BY confidence DESC)), t AS (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS target),
b AS (SELECT target, confidence, answered, errors, row_number() OVER (PARTITION BY target ORDER BY answered DESC) AS k FROM r CROSS JOIN t WHERE answered / total <= target)
SELECT target, confidence AS threshold, answered::BIGINT AS answered, round((errors / answered)::DOUBLE, 6) AS risk FROM b WHERE k = 1""")
def operating_points(spark, folder):
    return stats.operating_points(_answered(spark, folder), [0.25, 0.5, 0.75, 1.0])


@query(f"""WITH {_ANSWERED}, d AS (SELECT split_part(question_id, '::', 1) AS doc_id, sum(correct) AS s, count(*) AS c FROM rows_ GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM d), n AS (SELECT count(*) AS n FROM d),
draws AS (SELECT rep, (('0x' || substr(sha256('s:' || rep || ':' || place), 1, 8))::BIGINT % n) AS i FROM n, range(200) a(rep), LATERAL (SELECT unnest(range(n)) AS place)), m AS (SELECT rep, sum(s) / sum(c) AS m FROM draws JOIN i USING (i) GROUP BY rep)
SELECT round((SELECT sum(s) / sum(c) FROM d)::DOUBLE, 6) AS point, round(quantile_cont(m::DOUBLE, 0.025), 6) AS low, round(quantile_cont(m::DOUBLE, 0.975), 6) AS high, count(*) AS replicates FROM m""")
def cluster_bootstrap_hash(spark, folder):
    rows = _answered(spark, folder).select(F.substring_index("question_id", "::", 1).alias("doc_id"), F.col("correct").alias("value"))
    return stats.cluster_bootstrap(rows, 200)


_BOTH = f"""{STORED}, {LISTED}, {GOLD}, ha AS (SELECT DISTINCT s.question_id FROM stored s JOIN gold g ON g.question_id = s.question_id AND g.doc_id = s.doc_id AND g.page = s.page WHERE s.rank <= 5), hb AS (SELECT DISTINCT l.question_id FROM listed l JOIN gold g ON g.question_id = l.question_id AND g.page = l.page WHERE l.rank <= 5),
pair AS (SELECT question_id, split_part(question_id, '::', 1) AS doc_id, (question_id IN (SELECT question_id FROM ha))::BIGINT - (question_id IN (SELECT question_id FROM hb))::BIGINT AS v FROM (SELECT DISTINCT question_id FROM gold))"""


@query(f"""WITH {_BOTH}, d AS (SELECT doc_id, sum(v) AS s, count(*) AS c FROM pair GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM d), n AS (SELECT count(*) AS n FROM d),
draws AS (SELECT rep, (('0x' || substr(sha256('p:' || rep || ':' || place), 1, 8))::BIGINT % n) AS i FROM n, range(200) a(rep), LATERAL (SELECT unnest(range(n)) AS place)), m AS (SELECT rep, sum(s) / sum(c) AS m FROM draws JOIN i USING (i) GROUP BY rep)
SELECT round((SELECT sum(s) / sum(c) FROM d)::DOUBLE, 6) AS point, round(quantile_cont(m::DOUBLE, 0.025), 6) AS low, round(quantile_cont(m::DOUBLE, 0.975), 6) AS high, count(*) AS replicates FROM m""")
def paired_bootstrap_hash(spark, folder):
    g = frames.gold(spark, folder)
    hit = lambda run, c: run.filter("rank <= 5").join(g, ["question_id", "doc_id", "page"], "left_semi").select("question_id").distinct().withColumn(c, F.lit(1))
    q = g.select("question_id", "doc_id").distinct().join(hit(frames.stored_run(spark, folder), "a"), "question_id", "left").join(hit(frames.listed_run(spark, folder), "b"), "question_id", "left")
    rows = q.select("doc_id", (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).cast("bigint").alias("value"))
    return stats.cluster_bootstrap(rows, 200, "p")


@query("""SELECT coalesce(condition, '?') AS system, count(*) AS rows_seen, count(DISTINCT question_id) AS questions, round(avg(len(evidence_pages)), 4) AS mean_pages, count(*) FILTER (len(evidence_pages) = 0) AS without_pages, round(avg(length(question)), 4) AS mean_length FROM reasoning_inputs GROUP BY 1""")
def system_point_estimates(spark, folder):
    r = table(spark, folder, "reasoning_inputs")
    n = F.when(F.col("evidence_pages").isNotNull(), F.size("evidence_pages"))
    return r.groupBy(F.coalesce("condition", F.lit("?")).alias("system")).agg(F.count("*").alias("rows_seen"), F.count_distinct("question_id").alias("questions"), F.round(F.avg(n), 4).alias("mean_pages"), F.count_if(n == 0).alias("without_pages"), F.round(F.avg(F.length("question")), 4).alias("mean_length"))


@query("""WITH s AS (SELECT question_id, unnest(['split=' || split, 'source=' || source, 'condition=' || condition]) AS stratum FROM reasoning_inputs WHERE question_id IS NOT NULL) SELECT stratum, count(DISTINCT question_id) AS questions FROM s WHERE stratum IS NOT NULL GROUP BY stratum""")
def strata_counts(spark, folder):
    r = table(spark, folder, "reasoning_inputs").filter("question_id is not null")
    s = r.select("question_id", F.explode(F.array(*[F.concat(F.lit(f"{c}="), c) for c in ("split", "source", "condition")])).alias("stratum")).filter("stratum is not null")
    return s.groupBy("stratum").agg(F.count_distinct("question_id").alias("questions"))


# folds, running totals, logs ---------------------------------------------------------------------------


@query("""SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 2) AS spent FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL""")
def running_spend(spark, folder):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, folder, "events").filter("user_id is not null and value is not null").select("event_id", "user_id", F.round(F.sum("value").over(w), 2).alias("spent"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, round(value * 100)::BIGINT AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
f AS (SELECT user_id, event_id, k, c AS total, 1::BIGINT AS batch FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN f.total > 0 AND f.total + o.c > 10000 THEN o.c ELSE f.total + o.c END, CASE WHEN f.total > 0 AND f.total + o.c > 10000 THEN f.batch + 1 ELSE f.batch END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, event_id, batch FROM f""")
def budget_batches(spark, folder):
    return folds.budget_batches(table(spark, folder, "events"), "user_id", "event_id", "value", 100.0)


@query("""WITH d AS (SELECT DISTINCT question_id, unnest(evidence_pages) AS page FROM reasoning_inputs WHERE condition = 'real_retrieval'), k AS (SELECT question_id, page, page - row_number() OVER (PARTITION BY question_id ORDER BY page) AS k FROM d) SELECT question_id, min(page) AS first, max(page) AS last FROM k GROUP BY question_id, k""")
def page_runs(spark, folder):
    r = table(spark, folder, "reasoning_inputs").filter("condition = 'real_retrieval' and question_id is not null")
    return folds.runs(r.select("question_id", F.explode("evidence_pages").alias("page")), "question_id", "page")


@query()
def consecutive_prefix(spark, folder):
    r = table(spark, folder, "reasoning_inputs").filter("condition = 'real_retrieval' and question_id is not null and evidence_pages is not null")
    return r.groupBy("question_id").agg(F.min_by("evidence_pages", "input_id").alias("p")).select("question_id", folds.consecutive_prefix(F.array_sort("p")).cast("bigint").alias("run"))


@query()
def line_anchors(spark, folder):
    return folds.line_anchors(table(spark, folder, "events").filter("user_id is not null and value is not null"), "user_id", "value", 2.0)


@query(f"""WITH {PAGES}, t AS (SELECT a.doc_id, a.page, b.page AS next_page, right(rtrim(a.text, chr(10) || chr(13) || chr(9) || ' '), 1) NOT IN ('.', '!', '?', '') AS open FROM pages a JOIN pages b ON b.doc_id = a.doc_id AND b.page = a.page + 1)
SELECT doc_id, count(*) AS pairs, count(*) FILTER (open) AS open_ends FROM t GROUP BY doc_id""")
def page_continuation(spark, folder):
    p = frames.pages(spark, folder)
    w = Window.partitionBy("doc_id").orderBy("page")
    end = F.substring(F.rtrim("text", F.lit("\n\r\t ")), -1, 1)
    nxt = p.select("doc_id", "page", end.alias("e"), F.lead("page").over(w).alias("n")).filter(F.col("n") == F.col("page") + 1)
    return nxt.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.count_if(~F.col("e").isin(".", "!", "?", "")).alias("open_ends"))


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS calls, round(sum(value), 2) AS spent FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def call_log_hourly(spark, folder):
    e = table(spark, folder, "events").filter("ts is not null")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("spent"))


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value > 50) AS ok FROM events WHERE user_id IS NOT NULL GROUP BY ALL) SELECT user_id, event_type, n, round((ok + 1)::DOUBLE / (n + 2), 6) AS prior FROM g""")
def smoothed_prior(spark, folder):
    g = table(spark, folder, "events").filter("user_id is not null").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("ok"))
    return g.select("user_id", "event_type", "n", F.round((F.col("ok") + 1) / (F.col("n") + 2), 6).alias("prior"))


@query("""SELECT event_type, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.5), 6) AS middle, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY event_type""")
def exact_percentiles(spark, folder):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, folder, "events").groupBy("event_type").agg(p(0.025).alias("low"), p(0.5).alias("middle"), p(0.975).alias("high"))
