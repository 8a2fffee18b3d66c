"""Routing and comparison of questions, checks of answers against facts, picks, boxes, joins that must be complete.

Patterns are arguments with the usual ones as defaults; all of it is column expressions or joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import as_decimal, plain_decimal, tokens, visible

#: Wordings that decide a route, in order of precedence.
WHOLE_DOCUMENT = (r"\bacross\s+the\s+entire\s+document\b", r"\bthroughout\s+the\s+(?:entire\s+)?document\b", r"\bin\s+the\s+(?:entire|whole)\s+document\b", r"\bacross\s+all\s+pages\b")
ACROSS = r"\bacross\s+the\s+document\b"
VISUAL = r"\b(?:bar\s+chart|chart|figure|diagram|graph|image|illustration|map|table)\b"
#: Names of the routes.
ROUTES = {"text": "r0_text", "visual": "r1_local_visual", "scanned": "r2_scanned_document", "document": "r3_document_global"}
#: Wordings of comparisons.
DIFFERENCE = (r"\b(?:what|how much)\b.*\bdifference\b.*\bbetween\b", r"\bcompared\s+to\b.*\bwhat\s+is\s+the\s+difference\b")
DIRECTIONAL = r"\b(more|greater|higher|larger|fewer|less|lower)\b.*\b(?:than|compared\s+to)\b"
MORE, FEWER = r"\b(?:more|greater|higher|larger)\b", r"\b(?:fewer|less|lower)\b"
SCOPES = {"strict_more_than": r"\bmore\b.*\bthan\b", "strict_less_than": r"\bless\b.*\bthan\b", "directional_compared_to": r"\b(?:more|higher|larger|less|lower|fewer)\b.*\bcompared to\b", "difference_wording": r"\bdifference\b|\bdiffer(?:ed|s)?\b"}
#: Kinds of page elements by the names annotators give them.
ELEMENTS = {"table": ("table",), "chart": ("chart",), "image_figure": ("image", "figure"), "text": ("text", "paragraph_title", "title")}
SECTION_SCOPE, TITLE_STOPWORDS = r"\b(?:chapter|across\s+all\s+listed)\b", ("and", "of", "the")
TIME_UNITS = ("hour", "hours", "minute", "minutes")


def _found(text: Column, pattern: str) -> Column:
    """The first match in lower case, null if there is none."""
    hit = F.regexp_extract(text, f"(?i){pattern}", 0)
    return F.when(hit != "", F.lower(hit))


def routed(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """``question_id, route, signal, pages, filled``: whole-document wording, then documents without text, then visual words, then text.

    questions: ``question_id, doc_id, question``; pages: ``doc_id, page, text``, one row each. Questions of unknown
    documents give no row.
    """
    seen = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(visible(F.col("text")) > 0).alias("filled"))
    q = F.col("question")
    whole, visual = F.coalesce(_found(q, ACROSS), *[_found(q, p) for p in WHOLE_DOCUMENT]), _found(q, VISUAL)
    route = F.when(F.col("whole").isNotNull(), ROUTES["document"]).when(F.col("filled") == 0, ROUTES["scanned"]).when(F.col("visual").isNotNull(), ROUTES["visual"]).otherwise(ROUTES["text"])
    signal = F.when(F.col("whole").isNotNull(), F.col("whole")).when(F.col("filled") == 0, "zero_native_text_pages").otherwise(F.col("visual"))
    return questions.select("question_id", "doc_id", whole.alias("whole"), visual.alias("visual")).join(seen, "doc_id").select("question_id", route.alias("route"), signal.alias("signal"), "pages", "filled")


def intent(question: Column) -> Column:
    """Struct ``operation, word`` of a comparison; both null where none is asked."""
    difference = F.coalesce(*[_found(question, p) for p in DIFFERENCE]).isNotNull()
    word = F.regexp_extract(question, f"(?i){DIRECTIONAL}", 1)
    operation = F.when(difference, "absolute_difference").when(word != "", "left_minus_right")
    return F.struct(operation.alias("operation"), F.when(~difference & (word != ""), F.lower(word)).alias("word"))


def scope_counts(questions: DataFrame) -> DataFrame:
    """``category, questions``: questions of each comparison wording, of any of them (``any``) and of all (``all``)."""
    q = questions.select("question_id", *[_found(F.col("question"), p).isNotNull().alias(k) for k, p in SCOPES.items()])
    tags = F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in SCOPES]), lambda x: x.isNotNull())
    tags = F.concat(tags, F.when(F.size(tags) > 0, F.array(F.lit("any"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("all")))
    return q.select(F.explode(tags).alias("category")).groupBy("category").agg(F.count("*").alias("questions"))


def clauses(question: Column, separator: str = "—") -> Column:
    """Clauses between separators without blanks and commas around them; null if one of several is empty."""
    parts = F.transform(F.split(question, f"\\Q{separator}\\E"), lambda p: F.trim(p, F.lit(" ,")))
    return F.when(F.size(parts) == 1, F.array(F.trim(question))).when(~F.exists(parts, lambda p: p == ""), parts)


def fact_pair(left: Column, left_unit: Column, right: Column, right_unit: Column) -> Column:
    """Struct ``left, right, unit, direction`` of two facts in one unit; null for values or units that do not go together.

    Hours and minutes become hours; other units must be equal but for a plural.
    """
    a, b = (as_decimal(v).cast("decimal(38,10)") for v in (left, right))
    u, v = (F.lower(F.trim(x)) for x in (left_unit, right_unit))
    time = u.isin(*TIME_UNITS) & v.isin(*TIME_UNITS)
    hours = lambda x, unit: F.when(unit.isin("minute", "minutes"), (x / 60).cast("decimal(38,10)")).otherwise(x)
    same = (F.rtrim(u, F.lit("s")) == F.rtrim(v, F.lit("s"))) & (F.rtrim(u, F.lit("s")) != "")
    x, y = F.when(time, hours(a, u)).when(same, a), F.when(time, hours(b, v)).when(same, b)
    unit = F.when(time, "hours").when(u.endswith("s"), u).otherwise(F.when(v.endswith("s"), v).otherwise(u))
    direction = F.when(x > y, "more").when(x < y, "fewer").otherwise("equal")
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("left"), y.alias("right"), unit.alias("unit"), direction.alias("direction")))


def consistent(pair: Column, answer: Column, tolerance: float = 0.01) -> Column:
    """Struct ``magnitude_right, direction_right, accepted``: whether an answer agrees with two facts; null without facts or answer."""
    size = F.abs(pair["left"] - pair["right"])
    raw = F.regexp_extract_all(answer, F.lit(r"(?<![A-Za-z0-9])[-+]?\d+(?:\.\d+)?"), F.lit(0))
    near = F.exists(raw, lambda n: F.abs(F.abs(n.try_cast("decimal(38,10)")) - size) <= F.lit(str(tolerance)).cast("decimal(38,10)"))
    more, fewer = answer.rlike(f"(?i){MORE}"), answer.rlike(f"(?i){FEWER}")
    side = F.when(pair["direction"] == "more", more & ~fewer).when(pair["direction"] == "fewer", fewer & ~more).otherwise(~more & ~fewer)
    near = F.coalesce(near, F.lit(False))
    return F.when(pair.isNotNull() & (F.trim(answer) != ""), F.struct(near.alias("magnitude_right"), side.alias("direction_right"), (near & side).alias("accepted")))


def expected_number(answer: Column) -> Column:
    """The number that an answer states: its only one, the distance of its two, or the one named as difference; else null."""
    text = F.replace(answer, F.lit(","), F.lit(""))
    n = F.transform(F.regexp_extract_all(text, F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("decimal(38,6)"))
    cue = F.regexp_extract(text, r"(?i)\bdifference\s+(?:is\s+)?(?:calculated\s+as\s+)?([-+]?\d+(?:\.\d+)?)", 1).try_cast("decimal(38,6)")
    out = F.when(F.size(n) == 1, F.try_element_at(n, F.lit(1))).when(F.size(n) == 2, F.abs(F.try_element_at(n, F.lit(1)) - F.try_element_at(n, F.lit(2)))).otherwise(cue)
    return plain_decimal(out.cast("decimal(38,6)"))


def modality(elements: Column) -> Column:
    """What an array of element names is made of: one kind, ``mixed`` or ``none``."""

    def kind(x: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, known in ELEMENTS.items():
            out = out.when(F.lower(x).isin(*known), name)
        return out.otherwise("other")

    kinds = F.array_distinct(F.transform(elements, kind))
    return F.when(F.coalesce(F.size(kinds), F.lit(0)) <= 0, "none").when(F.size(kinds) == 1, kinds[0]).otherwise("mixed")


def linked_section(questions: DataFrame, sections: DataFrame, least: int = 2, scope: str = SECTION_SCOPE) -> DataFrame:
    """``question_id, section, start_page, shared``: the section whose title shares most words with a question that names a scope.

    sections: ``doc_id, section, title, start_page``. Equal overlaps go to the earlier page, then by name.
    """
    q = questions.filter(F.col("question").rlike(f"(?i){scope}")).select("question_id", "doc_id", F.array_distinct(tokens(F.col("question"))).alias("qt"))
    title = F.array_except(tokens(F.col("title")), F.array(*map(F.lit, TITLE_STOPWORDS)))
    met = q.join(sections.select("doc_id", "section", "start_page", title.alias("tt")), "doc_id")
    met = met.withColumn("shared", F.size(F.array_intersect("qt", "tt")).cast("bigint")).filter(F.col("shared") >= least)
    best = met.groupBy("question_id").agg(F.min_by(F.struct("section", "start_page", "shared"), F.struct(-F.col("shared"), "start_page", "section")).alias("b"))
    return best.select("question_id", "b.section", "b.start_page", "b.shared")


def best_reading(candidates: DataFrame, key: str) -> DataFrame:
    """``key, rotation``: the reading with the most confidence mass, then mean, then words, then first preference.

    candidates: ``key, rotation, mass, mean, words, preference``. Readings equal in all of these go by the smaller rotation.
    """
    return candidates.groupBy(key).agg(F.max_by("rotation", F.struct("mass", "mean", "words", -F.col("preference"), -F.col("rotation"))).alias("rotation"))


def pixel_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Struct ``left, top, right, bottom``: a box rounded outwards; null for boxes without area or with a negative origin."""
    fine = (x1 >= 0) & (y1 >= 0) & (x2 > x1) & (y2 > y1)
    return F.when(fine, F.struct(F.floor(x1).alias("left"), F.floor(y1).alias("top"), F.ceil(x2).alias("right"), F.ceil(y2).alias("bottom")))


def join_problems(left: DataFrame, right: DataFrame, keys: list[str], frozen: list[str] = ()) -> DataFrame:
    """``*keys, problem``: keys that stand in the way of a complete one-to-one join.

    problem is ``left_only``, ``right_only``, ``twice`` (a key more than once on a side) or ``drift`` (a column of
    ``frozen`` differs). No rows: the join is complete.
    """
    side = lambda df, k: df.groupBy(*keys).agg(F.count("*").alias(f"n{k}"), *[F.min(F.struct(c)).alias(f"{c}_{k}") for c in frozen])
    both = side(left, "l").join(side(right, "r"), keys, "full_outer")
    drift = F.lit(False)
    for c in frozen:
        drift = drift | ~F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r"))
    problem = F.when(F.col("nr").isNull(), "left_only").when(F.col("nl").isNull(), "right_only").when((F.col("nl") > 1) | (F.col("nr") > 1), "twice").when(drift, "drift")
    return both.select(*keys, problem.alias("problem")).filter("problem is not null")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], frozen: list[str] = ()) -> DataFrame:
    """The inner join of two sides that must be complete; raises with the number of problems otherwise."""
    wrong = {r[0]: r[1] for r in join_problems(left, right, keys, frozen).groupBy("problem").count().collect()}
    if wrong:
        raise ValueError(f"the join is not complete: {wrong}")
    return left.join(right.drop(*frozen), keys)


def ordered_union(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """``question_id, page, pos``: the first ``k`` pages of two rankings, those of the first before new ones of the second."""
    a, b = (r.filter(F.col("rank") <= k).select("question_id", "page", F.struct(F.lit(n).alias("turn"), "rank").alias("o")) for n, r in enumerate((left, right)))
    one = a.unionByName(b).groupBy("question_id", "page").agg(F.min("o").alias("o"))
    return one.select("question_id", "page", F.row_number().over(Window.partitionBy("question_id").orderBy("o", "page")).cast("bigint").alias("pos"))
