"""Queries on routes, comparisons, picks, boxes and complete joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import comparison as c
from pagemill.operators import stats
from pagemill.plans import frames
from pagemill.plans.analysis import _ANSWERED, _answered
from pagemill.plans.frames import LISTED, PAGES, QUESTIONS, SPACE, STORED, words
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


def _hit(text: str, *patterns: str) -> str:
    """The first match in lower case, null if there is none."""
    one = [f"nullif(lower(regexp_extract({text}, '(?i){p}', 0)), '')" for p in patterns]
    return f"coalesce({', '.join(one)})"


@query(f"""WITH {PAGES}, {QUESTIONS}, seen AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (length(regexp_replace(text, '{SPACE}', '', 'g')) > 0) AS filled FROM pages GROUP BY doc_id),
h AS (SELECT question_id, doc_id, {_hit('question', c.ACROSS, *c.WHOLE_DOCUMENT)} AS whole, {_hit('question', c.VISUAL)} AS visual FROM questions)
SELECT question_id, CASE WHEN whole IS NOT NULL THEN 'r3_document_global' WHEN filled = 0 THEN 'r2_scanned_document' WHEN visual IS NOT NULL THEN 'r1_local_visual' ELSE 'r0_text' END AS route,
CASE WHEN whole IS NOT NULL THEN whole WHEN filled = 0 THEN 'zero_native_text_pages' ELSE visual END AS signal, pages, filled FROM h JOIN seen USING (doc_id)""")
def visual_routes(spark, folder):
    return c.routed(frames.questions(spark, folder), frames.pages(spark, folder))


_ASKED = f"SELECT question_id, {_hit('question', *c.DIFFERENCE)} IS NOT NULL AS d, lower(regexp_extract(question, '(?i){c.DIRECTIONAL}', 1)) AS w FROM questions"


@query(f"""WITH {QUESTIONS}, i AS ({_ASKED}) SELECT question_id, CASE WHEN d THEN 'absolute_difference' WHEN w <> '' THEN 'left_minus_right' END AS operation, CASE WHEN NOT d AND w <> '' THEN w END AS word FROM i""")
def comparison_intent(spark, folder):
    q = frames.questions(spark, folder).select("question_id", c.intent(F.col("question")).alias("i"))
    return q.select("question_id", "i.operation", "i.word")


_ALL_SCOPES = " UNION ALL ".join([f"SELECT '{k}' AS category, question_id FROM questions WHERE regexp_matches(question, '(?i){p}')" for k, p in c.SCOPES.items()])


@query(f"""WITH {QUESTIONS}, s AS ({_ALL_SCOPES}) SELECT category, count(*) AS questions FROM (SELECT * FROM s UNION ALL SELECT DISTINCT 'any', question_id FROM s UNION ALL SELECT 'all', question_id FROM questions) GROUP BY category""")
def comparison_scope(spark, folder):
    return c.scope_counts(frames.questions(spark, folder))


@query(f"""WITH {QUESTIONS}, p AS (SELECT question_id, question, list_transform(string_split(question, ','), lambda x: trim(x, ' ,')) AS parts FROM questions),
k AS (SELECT question_id, CASE WHEN len(parts) = 1 THEN [trim(question, ' ')] WHEN NOT list_contains(parts, '') THEN parts END AS parts FROM p)
SELECT question_id, coalesce(len(parts), 0)::BIGINT AS clauses, array_to_string(parts, '|') AS text FROM k""")
def explicit_clauses(spark, folder):
    q = frames.questions(spark, folder).select("question_id", c.clauses(F.col("question"), ",").alias("p"))
    return q.select("question_id", F.coalesce(F.when(F.col("p").isNotNull(), F.size("p")), F.lit(0)).cast("bigint").alias("clauses"), F.when(F.col("p").isNotNull(), F.concat_ws("|", "p")).alias("text"))


_UNITS = (("hours", "minutes"), ("minutes", "Hour"), ("report", "reports"), ("cars", "bikes"), ("visits", "visits"))


def _unit(at: int) -> str:
    return "CASE l_orderkey % 5 " + " ".join(f"WHEN {k} THEN '{u[at]}'" for k, u in enumerate(_UNITS)) + " END"


@query(f"""WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity::DECIMAL(38,10) AS a, CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END * l_linenumber::DECIMAL(38,10) * 7 AS b, {_unit(0)} AS ua, {_unit(1)} AS ub, 'It is ' || (l_quantity - l_linenumber * 7)::BIGINT || CASE WHEN l_linenumber % 2 = 0 THEN ' more.' ELSE ' fewer.' END AS answer FROM lineitem),
n AS (SELECT *, lower(ua) IN ('hour', 'hours', 'minute', 'minutes') AND lower(ub) IN ('hour', 'hours', 'minute', 'minutes') AS t, rtrim(lower(ua), 's') = rtrim(lower(ub), 's') AS s FROM f),
p AS (SELECT l_orderkey, l_linenumber, answer, CASE WHEN t AND lower(ua) IN ('minute', 'minutes') THEN a::DOUBLE / 60 ELSE a::DOUBLE END AS x, CASE WHEN t AND lower(ub) IN ('minute', 'minutes') THEN b::DOUBLE / 60 ELSE b::DOUBLE END AS y, CASE WHEN t THEN 'hours' WHEN ends_with(lower(ua), 's') THEN lower(ua) WHEN ends_with(lower(ub), 's') THEN lower(ub) ELSE lower(ua) END AS unit FROM n WHERE t OR s),
d AS (SELECT *, CASE WHEN x > y THEN 'more' WHEN x < y THEN 'fewer' ELSE 'equal' END AS direction, len(list_filter(regexp_extract_all(answer, '(?:^|[^A-Za-z0-9])([-+]?\\d+(?:\\.\\d+)?)', 1), lambda z: abs(abs(z::DOUBLE) - abs(x - y)) <= 0.01 + 1e-9)) > 0 AS magnitude_right FROM p),
e AS (SELECT *, CASE direction WHEN 'more' THEN contains(answer, 'more') AND NOT contains(answer, 'fewer') WHEN 'fewer' THEN contains(answer, 'fewer') AND NOT contains(answer, 'more') ELSE NOT contains(answer, 'more') AND NOT contains(answer, 'fewer') END AS direction_right FROM d)
SELECT l_orderkey, l_linenumber, unit, direction, round(abs(x - y), 4) AS magnitude, magnitude_right, direction_right, magnitude_right AND direction_right AS accepted FROM e""")
def answer_consistency(spark, folder):
    n = F.col("l_linenumber")
    b = F.concat(F.when(n % 3 == 0, "(").otherwise(""), (n * 7).cast("string"), F.when(n % 3 == 0, ")").otherwise(""))
    answer = F.concat(F.lit("It is "), F.round(F.col("l_quantity") - n * 7).cast("bigint").cast("string"), F.when(n % 2 == 0, " more.").otherwise(" fewer."))
    pair = c.fact_pair(F.col("l_quantity").cast("string"), F.expr(_unit(0)), b, F.expr(_unit(1)))
    f = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", answer.alias("answer"), pair.alias("p")).filter("p is not null")
    f = f.select("l_orderkey", "l_linenumber", "p", c.consistent(F.col("p"), F.col("answer")).alias("k"))
    return f.select("l_orderkey", "l_linenumber", "p.unit", "p.direction", F.round(F.abs(F.col("p.left") - F.col("p.right")).cast("double"), 4).alias("magnitude"), "k.magnitude_right", "k.direction_right", "k.accepted")


@query(f"""WITH {QUESTIONS}, n AS (SELECT question_id, replace(question, ',', '') AS t FROM questions), m AS (SELECT question_id, t, regexp_extract_all(t, '[-+]?\\d+(?:\\.\\d+)?') AS x FROM n),
v AS (SELECT question_id, CASE len(x) WHEN 1 THEN try_cast(x[1] AS DECIMAL(38,6)) WHEN 2 THEN abs(try_cast(x[1] AS DECIMAL(38,6)) - try_cast(x[2] AS DECIMAL(38,6))) ELSE try_cast(nullif(regexp_extract(t, '(?i)\\bdifference\\s+(?:is\\s+)?(?:calculated\\s+as\\s+)?([-+]?\\d+(?:\\.\\d+)?)', 1), '') AS DECIMAL(38,6)) END AS v FROM m)
SELECT question_id, round(v::DOUBLE, 4) AS number FROM v""")
def expected_numbers(spark, folder):
    return frames.questions(spark, folder).select("question_id", F.round(c.expected_number(F.col("question")).cast("double"), 4).alias("number"))


_KINDS = "CASE event_type WHEN 'click' THEN 'Chart' WHEN 'view' THEN 'title' WHEN 'purchase' THEN 'table' WHEN 'login' THEN 'figure' ELSE event_type END"


@query(f"""WITH e AS (SELECT DISTINCT user_id, CASE lower({_KINDS}) WHEN 'chart' THEN 'chart' WHEN 'title' THEN 'text' WHEN 'table' THEN 'table' WHEN 'figure' THEN 'image_figure' ELSE 'other' END AS k FROM events)
SELECT user_id, CASE WHEN count(*) = 1 THEN min(k) ELSE 'mixed' END AS modality FROM e GROUP BY user_id""")
def evidence_modality(spark, folder):
    e = table(spark, folder, "events").groupBy("user_id").agg(F.collect_set(F.expr(_KINDS)).alias("e"))  # a handful of names
    return e.select("user_id", c.modality(F.col("e")).alias("modality"))


_TITLE = r"(?m)^[ \t]*\d+\.\d+[ \t]+(\p{Lu}[^\n]*)"
_SCOPE = r"\b(?:how many|which|what)\b"


@query(rf"""WITH {PAGES}, {QUESTIONS}, s AS (SELECT doc_id, page, regexp_extract(text, '(?m)^[ \t]*(\d+\.\d+)[ \t]+\p{{Lu}}', 1) AS section, regexp_extract(text, '{_TITLE}', 1) AS title FROM pages WHERE regexp_matches(text, '{_TITLE}')),
m AS (SELECT q.question_id, s.section, s.page AS start_page, len(list_intersect(list_distinct({words('q.question')}), list_filter(list_distinct({words('s.title')}), lambda x: x NOT IN ('and', 'of', 'the'))))::BIGINT AS shared FROM questions q JOIN s USING (doc_id) WHERE regexp_matches(q.question, '(?i){_SCOPE}'))
SELECT question_id, section, start_page, shared FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY shared DESC, start_page, section) AS r FROM m WHERE shared >= 2) WHERE r = 1""")
def section_choice(spark, folder):
    p = frames.pages(spark, folder).filter(F.col("text").rlike(_TITLE))
    s = p.select("doc_id", F.col("page").alias("start_page"), F.regexp_extract("text", r"(?m)^[ \t]*(\d+\.\d+)[ \t]+\p{Lu}", 1).alias("section"), F.regexp_extract("text", _TITLE, 1).alias("title"))
    return c.linked_section(frames.questions(spark, folder), s, scope=_SCOPE)


@query("""SELECT l_orderkey, l_suppkey AS rotation FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_quantity / 10) DESC, l_discount DESC, l_tax DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def best_reading(spark, folder):
    l = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("rotation"), F.round(F.col("l_quantity") / 10).alias("mass"), F.col("l_discount").alias("mean"), F.col("l_tax").alias("words"), F.col("l_linenumber").alias("preference"))
    return c.best_reading(l, "l_orderkey")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity / 3 - 1 AS x1, l_tax * 100 AS y1, l_quantity / 2 AS x2, l_discount * 150 AS y2 FROM lineitem)
SELECT l_orderkey, l_linenumber, floor(x1)::BIGINT AS "left", floor(y1)::BIGINT AS top, ceil(x2)::BIGINT AS "right", ceil(y2)::BIGINT AS bottom FROM b WHERE x1 >= 0 AND y1 >= 0 AND x2 > x1 AND y2 > y1""")
def pixel_boxes(spark, folder):
    box = c.pixel_box(F.col("l_quantity") / 3 - 1, F.col("l_tax") * 100, F.col("l_quantity") / 2, F.col("l_discount") * 150)
    b = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).filter("b is not null")
    return b.select("l_orderkey", "l_linenumber", "b.left", "b.top", "b.right", "b.bottom")


@query(f"""WITH {STORED}, {LISTED}, a AS (SELECT question_id, count(*) AS n, min(doc_id) AS d FROM stored WHERE rank = 1 GROUP BY 1), b AS (SELECT question_id, count(*) AS n, min(doc_id) AS d FROM listed WHERE rank <= 2 GROUP BY 1),
j AS (SELECT coalesce(a.question_id, b.question_id) AS question_id, CASE WHEN b.n IS NULL THEN 'left_only' WHEN a.n IS NULL THEN 'right_only' WHEN a.n > 1 OR b.n > 1 THEN 'twice' WHEN a.d IS DISTINCT FROM b.d THEN 'drift' END AS problem FROM a FULL JOIN b ON a.question_id = b.question_id)
SELECT question_id, problem FROM j WHERE problem IS NOT NULL""")
def join_problems(spark, folder):
    a, b = frames.stored_run(spark, folder).filter("rank = 1"), frames.listed_run(spark, folder).filter("rank <= 2")
    return c.join_problems(a, b, ["question_id"], ["doc_id"])


@query(f"""WITH {STORED}, {LISTED}, u AS (SELECT question_id, page, 0 AS turn, rank FROM stored WHERE rank <= 10 UNION ALL SELECT question_id, page, 1, rank FROM listed WHERE rank <= 10), o AS (SELECT question_id, page, min(turn * 1000 + rank) AS o FROM u GROUP BY ALL)
SELECT question_id, page, row_number() OVER (PARTITION BY question_id ORDER BY o, page) AS pos FROM o""")
def ordered_union(spark, folder):
    return c.ordered_union(frames.stored_run(spark, folder), frames.listed_run(spark, folder), 10)


@query(f"""WITH {_ANSWERED}, r AS (SELECT count(*) OVER w AS answered, sum(1 - correct) OVER w AS errors FROM rows_ WINDOW w AS (ORDER BY confidence DESC, question_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT count(*) AS answered, round(avg(errors / answered)::DOUBLE, 6) AS aurc FROM r""")
def area_under_risk(spark, folder):
    return stats.area_under_risk(_answered(spark, folder))
