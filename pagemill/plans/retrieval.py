"""Queries on pages, postings, vectors and rankings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.text import control_chars, squeeze, text_layer, tokens, visible
from pagemill.operators import dense, lexical, ranking
from pagemill.plans import frames
from pagemill.plans.frames import BM25, EXTENTS, GOLD, LISTED, PAGES, QUESTIONS, SPACE, STORED, scores, words
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


@query(rf"""WITH {PAGES}, n AS (SELECT *, CAST(length(regexp_replace(text, '{SPACE}', '', 'g')) AS BIGINT) AS chars FROM pages)
SELECT doc_id, page, chars, CASE WHEN chars <= 19 THEN 'text_layer_missing' WHEN chars <= 99 THEN 'low_text' ELSE 'ok' END AS status,
  md5(trim(regexp_replace(text, '{SPACE}', ' ', 'g'))) AS digest FROM n""")
def page_records(spark, folder):
    p = frames.pages(spark, folder)
    return p.select("doc_id", "page", visible(F.col("text")).alias("chars"), text_layer(visible(F.col("text"))).alias("status"), F.md5(squeeze(F.col("text"))).alias("digest"))


@query(f"""WITH {PAGES}, n AS (SELECT doc_id, length(regexp_replace(text, '{SPACE}', '', 'g')) AS c FROM pages)
SELECT coalesce(doc_id, '*') AS doc_id, count(*) AS pages, count(*) FILTER (c <= 19) AS missing, count(*) FILTER (c BETWEEN 20 AND 99) AS low, count(*) FILTER (c > 99) AS ok
FROM n GROUP BY ROLLUP (doc_id)""")
def text_layer_audit(spark, folder):
    n = frames.pages(spark, folder).select("doc_id", visible(F.col("text")).alias("c"))
    return n.rollup("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.col("c") <= 19).alias("missing"), F.count_if(F.col("c").between(20, 99)).alias("low"), F.count_if(F.col("c") > 99).alias("ok")).withColumn("doc_id", F.coalesce("doc_id", F.lit("*")))


@query(rf"""WITH {PAGES}, c AS (SELECT doc_id, sum(length(regexp_replace(text, '[^\x00-\x08\x0e-\x1b\x7f-\x{{84}}\x{{86}}-\x{{9f}}]', '', 'g'))) AS bad, sum(length(regexp_replace(text, '{SPACE}', '', 'g'))) AS n FROM pages GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN n > 0 THEN bad / n ELSE 0 END::DOUBLE, 6) AS ratio, CASE WHEN n > 0 THEN bad / n > 0.05 ELSE false END AS garbled FROM c""")
def control_char_ratio(spark, folder):
    c = frames.pages(spark, folder).groupBy("doc_id").agg(F.sum(control_chars(F.col("text"))).alias("bad"), F.sum(visible(F.col("text"))).alias("n"))
    ratio = F.coalesce(F.try_divide("bad", "n"), F.lit(0.0))
    return c.select("doc_id", F.round(ratio, 6).alias("ratio"), (ratio > 0.05).alias("garbled"))


@query("""WITH seen AS (SELECT doc_id, count(DISTINCT page) AS pages, min(page) AS lo, max(page) AS hi FROM page_records WHERE doc_id IS NOT NULL AND page IS NOT NULL GROUP BY doc_id)
SELECT coalesce(s.doc_id, f.id) AS doc_id, coalesce(s.pages, 0)::BIGINT AS pages, f.page_count, coalesce(s.lo = 1 AND s.hi = s.pages, false) AS contiguous, coalesce(s.pages = f.page_count, false) AS agrees
FROM seen s FULL JOIN doc_store f ON s.doc_id = f.id""")
def corpus_integrity(spark, folder):
    p = table(spark, folder, "page_records").filter("doc_id is not null and page is not null")
    seen = p.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), F.min("page").alias("lo"), F.max("page").alias("hi"))
    f = table(spark, folder, "doc_store").select("id", "page_count")
    j = seen.join(f, seen["doc_id"] == f["id"], "full_outer")
    no = F.lit(False)
    return j.select(F.coalesce("doc_id", "id").alias("doc_id"), F.coalesce("pages", F.lit(0)).alias("pages"), "page_count", F.coalesce((F.col("lo") == 1) & (F.col("hi") == F.col("pages")), no).alias("contiguous"), F.coalesce(F.col("pages") == F.col("page_count"), no).alias("agrees"))


@query(f"""WITH t AS (SELECT doc_id, {words('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - 1, 0), 48)) AS pos FROM t)
SELECT doc_id, CAST(floor(pos / 48) AS BIGINT) AS chunk, CAST(len(w[pos + 1 : pos + 64]) AS BIGINT) AS size, md5(array_to_string(w[pos + 1 : pos + 64], ' ')) AS digest FROM s""")
def token_chunks(spark, folder):
    t = table(spark, folder, "documents").filter("doc_id is not null and text is not null").select("doc_id", tokens(F.col("text")).alias("w"))
    s = t.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(48))).alias("at"))
    part = F.slice("w", F.col("at") + 1, F.lit(64))
    return s.select("doc_id", (F.col("at") / 48).cast("bigint").alias("chunk"), F.size(part).cast("bigint").alias("size"), F.md5(F.concat_ws(" ", part)).alias("digest"))


def _bm25(spark, folder, once=False, k=10):
    s = lexical.bm25(frames.questions(spark, folder), frames.pages(spark, folder), once)
    return lexical.ranked(s, k)


def _six(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 4))


_TOP = "SELECT question_id, doc_id, page, round(score, 4) AS score, rank FROM ranked WHERE rank <= 10"


@query(f"WITH {PAGES}, {QUESTIONS}, {BM25}, {scores(False)} {_TOP}")
def bm25_topk(spark, folder):
    return _six(_bm25(spark, folder))


@query(f"WITH {PAGES}, {QUESTIONS}, {BM25}, {scores(True)} {_TOP}")
def bm25_dedup_topk(spark, folder):
    return _six(_bm25(spark, folder, True))


@query(f"""WITH {PAGES}, {BM25} SELECT d.doc_id, d.term, d.df, round(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5))::DOUBLE, 6) AS idf FROM df d JOIN stats s USING (doc_id)""")
def postings_stats(spark, folder):
    p = frames.pages(spark, folder)
    df = lexical.postings(p).groupBy("doc_id", "term").agg(F.count("*").alias("df"))
    st = lexical.document_stats(lexical.page_lengths(p))
    return df.join(st, "doc_id").select("doc_id", "term", "df", F.round(lexical.idf(F.col("pages"), F.col("df")), 6).alias("idf"))


_COS = """unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN n > 0 THEN x::DOUBLE / n ELSE 0 END) AS v FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)),
cos AS (SELECT q.vec_id AS query, c.label AS page, c.vec_id AS chunk, round(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])), 9) AS score FROM unit q CROSS JOIN unit c WHERE q.vec_id % 100 = 0)"""


def _vectors(spark, folder):
    v = table(spark, folder, "embeddings").filter("vec_id is not null and embedding is not null")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return q, v.select(F.col("label").alias("page"), F.col("vec_id").alias("chunk"), F.col("embedding").alias("vector"))


@query(f"""WITH {_COS}, one AS (SELECT query, page, max(score) AS score FROM cos GROUP BY ALL), first AS (SELECT c.query, c.page, min(c.chunk) AS chunk, o.score FROM cos c JOIN one o ON c.query = o.query AND c.page = o.page AND c.score = o.score GROUP BY c.query, c.page, o.score),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, page) AS rank FROM first) SELECT query, page::BIGINT AS page, chunk, round(score, 4) AS score, rank FROM r WHERE rank <= 5""")
def dense_topk(spark, folder):
    return _six(dense.top_pages(dense.best_chunk(dense.scored(*_vectors(spark, folder), top=5)), 5))


@query(f"""WITH {_COS} SELECT query, chunk, score FROM (SELECT query, chunk, round(score, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS r FROM cos) WHERE r <= 10""")
def vector_search(spark, folder):
    s = dense.scored(*_vectors(spark, folder), k=10)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "chunk")
    return _six(s.withColumn("r", F.row_number().over(w)).filter("r <= 10").select("query", "chunk", "score"))


@query(f"""WITH {_COS}, q AS (SELECT label AS query, vec_id AS part FROM embeddings WHERE vec_id % 100 = 0),
best AS (SELECT q.query, q.part, c.page, max(c.score) AS m FROM cos c JOIN q ON c.query = q.part GROUP BY ALL)
SELECT query, page::BIGINT AS page, round(sum(m), 6) AS score FROM best GROUP BY query, page""")
def late_interaction(spark, folder):
    v = table(spark, folder, "embeddings").filter("vec_id is not null and embedding is not null")
    q = v.filter("vec_id % 100 = 0").select(F.col("label").alias("query"), F.col("vec_id").alias("part"), F.col("embedding").alias("vector"))
    return dense.late_interaction(q, v.select(F.col("label").alias("page"), F.col("vec_id").alias("part"), F.col("embedding").alias("vector")))


@query("""SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim, len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AS finite, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings""")
def vector_check(spark, folder):
    e = F.col("embedding")
    return table(spark, folder, "embeddings").select("vec_id", F.size(e).cast("bigint").alias("dim"), F.forall(e, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("finite"), F.round(F.sqrt(dense.dot(e, e)), 6).alias("norm"))


@query(f"""WITH {STORED}, {LISTED}, u AS (SELECT question_id, doc_id, page, 1.0::DOUBLE / (60 + rank) AS s FROM stored WHERE rank <= 10 UNION ALL SELECT question_id, doc_id, page, 1.0::DOUBLE / (60 + rank) FROM listed WHERE rank <= 10),
f AS (SELECT question_id, doc_id, page, round(sum(s), 9) AS score FROM u GROUP BY ALL) SELECT question_id, doc_id, page, round(score, 4) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, page) AS rank FROM f""")
def rrf_fusion(spark, folder):
    return _six(ranking.fuse([frames.stored_run(spark, folder), frames.listed_run(spark, folder)]))


@query(f"""WITH {STORED}, {PAGES}, {QUESTIONS}, {BM25}, {scores(False)}, pool AS (SELECT s.question_id, s.doc_id, s.page, s.score FROM scored s JOIN stored p ON p.question_id = s.question_id AND p.doc_id = s.doc_id AND p.page = s.page WHERE p.rank <= 10)
SELECT question_id, doc_id, page, round(score, 4) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, page) AS rank FROM pool""")
def candidate_rerank(spark, folder):
    pool = frames.stored_run(spark, folder).filter("rank <= 10")
    return _six(lexical.ranked(lexical.bm25(frames.questions(spark, folder), frames.pages(spark, folder), pool=pool)))


_DEPTHS = f"""{STORED}, {GOLD}, size AS (SELECT question_id, count(*) AS gold FROM gold GROUP BY question_id), ks AS (SELECT unnest([1, 3, 5, 10])::BIGINT AS k),
hits AS (SELECT g.question_id, s.rank FROM gold g JOIN stored s ON s.question_id = g.question_id AND s.doc_id = g.doc_id AND s.page = g.page WHERE s.rank <= 10),
per AS (SELECT z.question_id, k, z.gold, count(h.rank) AS tp, min(h.rank) AS first, coalesce(sum(1.0::DOUBLE / log2(h.rank + 1)), 0) AS dcg FROM size z CROSS JOIN ks LEFT JOIN hits h ON h.question_id = z.question_id AND h.rank <= k GROUP BY z.question_id, k, z.gold),
m AS (SELECT question_id, k, gold, tp, (tp > 0)::BIGINT AS any_hit, (tp = gold)::BIGINT AS complete, round(tp::DOUBLE / gold, 6) AS recall, round(tp::DOUBLE / k, 6) AS precision,
  round(CASE WHEN tp > 0 THEN 2 * (tp::DOUBLE / gold) * (tp::DOUBLE / k) / (tp::DOUBLE / gold + tp::DOUBLE / k) ELSE 0 END, 6) AS f1, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr,
  round(dcg / (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM range(1, least(gold, k) + 1) t(i)), 6) AS ndcg FROM per)"""


@query(f"WITH {_DEPTHS} SELECT * FROM m")
def score_at_k(spark, folder):
    return ranking.at_depths(frames.stored_run(spark, folder), frames.gold(spark, folder))


_SLICES = """tags AS (SELECT question_id, min(source) AS source, min(split) AS split, CASE WHEN count(DISTINCT condition) = 1 THEN min(condition) ELSE 'mixed' END AS kind FROM reasoning_inputs WHERE question_id IS NOT NULL GROUP BY question_id)"""


@query(f"""WITH {_DEPTHS}, {_SLICES} SELECT k, coalesce(source, '*') AS source, coalesce(split, '*') AS split, coalesce(kind, '*') AS kind, count(*) AS questions, round(avg(any_hit) + 1e-9, 4) AS mean_any_hit, round(avg(complete) + 1e-9, 4) AS mean_complete, round(avg(recall) + 1e-9, 4) AS mean_recall, round(avg(precision) + 1e-9, 4) AS mean_precision, round(avg(rr) + 1e-9, 4) AS mean_rr, round(avg(ndcg) + 1e-9, 4) AS mean_ndcg,
sum(tp)::BIGINT AS tp, sum(gold)::BIGINT AS gold, round((sum(tp) / sum(gold))::DOUBLE, 6) AS micro_recall, round((sum(tp) / sum(k))::DOUBLE, 6) AS micro_precision
FROM m JOIN tags USING (question_id) GROUP BY GROUPING SETS ((k), (k, source), (k, split), (k, kind))""")
def score_slices_grouping_sets(spark, folder):
    m = ranking.at_depths(frames.stored_run(spark, folder), frames.gold(spark, folder))
    rows = table(spark, folder, "reasoning_inputs").filter("question_id is not null")
    tags = rows.groupBy("question_id").agg(F.min("source").alias("source"), F.min("split").alias("split"), F.when(F.count_distinct("condition") == 1, F.min("condition")).otherwise("mixed").alias("kind"))
    j = m.join(tags, "question_id")
    c = {n: F.col(n) for n in ("k", "source", "split", "kind")}
    out = j.groupingSets([[c["k"]], [c["k"], c["source"]], [c["k"], c["split"]], [c["k"], c["kind"]]], *c.values()).agg(*ranking.macro_micro())
    return out.withColumns({n: F.coalesce(n, F.lit("*")) for n in ("source", "split", "kind")})


@query(f"""WITH {STORED}, {LISTED}, {GOLD}, ks AS (SELECT unnest([1, 3, 5, 10]) AS k), qs AS (SELECT DISTINCT question_id FROM gold WHERE question_id IN (SELECT question_id FROM stored) AND question_id IN (SELECT question_id FROM listed)),
h AS (SELECT q.question_id, k, count(DISTINCT CASE WHEN s.rank <= k THEN s.page END) > 0 AS a, count(DISTINCT CASE WHEN l.rank <= k THEN l.page END) > 0 AS b FROM qs q CROSS JOIN ks JOIN gold g ON g.question_id = q.question_id LEFT JOIN stored s ON s.question_id = g.question_id AND s.doc_id = g.doc_id AND s.page = g.page LEFT JOIN listed l ON l.question_id = g.question_id AND l.page = g.page GROUP BY q.question_id, k)
SELECT k::BIGINT AS k, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS first_only, count(*) FILTER (b AND NOT a) AS second_only, count(*) FILTER (NOT a AND NOT b) AS neither FROM h GROUP BY k""")
def paired_outcomes(spark, folder):
    g = frames.gold(spark, folder)
    a, b = frames.stored_run(spark, folder), frames.listed_run(spark, folder)
    both = g.select("question_id").distinct().join(a.select("question_id").distinct(), "question_id", "left_semi").join(b.select("question_id").distinct(), "question_id", "left_semi")
    on = ["question_id", "doc_id", "page"]
    r = g.join(both, "question_id", "left_semi").join(a.select(*on, F.col("rank").alias("ra")), on, "left").join(b.select(*on, F.col("rank").alias("rb")), on, "left")
    first = r.groupBy("question_id").agg(F.min("ra").alias("ra"), F.min("rb").alias("rb")).withColumn("k", F.explode(F.array(*map(F.lit, (1, 3, 5, 10))).cast("array<bigint>")))
    x, y = (F.coalesce(F.col(c) <= F.col("k"), F.lit(False)) for c in ("ra", "rb"))
    return first.groupBy("k").agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("first_only"), F.count_if(y & ~x).alias("second_only"), F.count_if(~x & ~y).alias("neither"))


@query(f"""WITH {LISTED}, {EXTENTS}, off AS (SELECT * FROM (VALUES (0, 0), (1, -1), (2, 1), (3, -2), (4, 2)) t(turn, off)),
near AS (SELECT question_id, l.doc_id, l.page + off AS page, min(struct_pack(r := l.rank, t := turn)) AS o FROM listed l CROSS JOIN off JOIN extents e ON e.doc_id = l.doc_id WHERE l.page + off BETWEEN 1 AND e.last GROUP BY ALL)
SELECT question_id, doc_id, page, row_number() OVER (PARTITION BY question_id ORDER BY o) AS pos FROM near""")
def adjacent_expansion(spark, folder):
    return ranking.expand(frames.listed_run(spark, folder), frames.extents(spark, folder), 2)


_W = f"WITH {PAGES}, {QUESTIONS}, {BM25}, {scores(False)}"


@query(f"""{_W}, w AS (SELECT question_id, doc_id, page AS start, round(sum(score) OVER x, 6) AS score, count(*) OVER x AS n FROM scored WINDOW x AS (PARTITION BY question_id, doc_id ORDER BY page ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT question_id, doc_id, start, score FROM w WHERE n = 3""")
def sliding_windows(spark, folder):
    return ranking.sliding(lexical.bm25(frames.questions(spark, folder), frames.pages(spark, folder)), 3)


@query(f"""WITH {LISTED}, {EXTENTS}, a AS (SELECT question_id, l.doc_id, greatest(1, least(page - 1, last - 2))::BIGINT AS start, rank, page FROM listed l JOIN extents e ON l.doc_id = e.doc_id WHERE last >= 3)
SELECT question_id, doc_id, start, string_agg(page::VARCHAR, ',' ORDER BY rank, page) AS anchors FROM a GROUP BY ALL""")
def anchor_windows(spark, folder):
    return ranking.anchored(frames.listed_run(spark, folder), frames.extents(spark, folder), 3)


@query()
def greedy_windows(spark, folder):
    w = ranking.sliding(lexical.bm25(frames.questions(spark, folder), frames.pages(spark, folder)), 3)
    return ranking.apart(w, 3, 3)


@query(f"""WITH {STORED}, m AS (SELECT question_id, max(CASE WHEN rank = 1 THEN score END) AS a, max(CASE WHEN rank = 2 THEN score END) AS b, max(CASE WHEN rank = 3 THEN score END) AS c FROM stored WHERE rank <= 3 GROUP BY question_id)
SELECT question_id, round(a - b, 6) AS margin_2, round(a - c, 6) AS margin_3, round((a - b) / greatest(abs(a), abs(b), 1e-12), 6) AS relative FROM m""")
def score_margins(spark, folder):
    return ranking.margins(frames.stored_run(spark, folder))


@query(f"""WITH {STORED}, {LISTED}, a AS (SELECT question_id, page, rank FROM stored WHERE rank <= 10 AND doc_id = split_part(question_id, '::', 1)), b AS (SELECT question_id, page, rank FROM listed WHERE rank <= 10)
SELECT question_id, count(a.rank + b.rank) AS shared, round(avg(abs(a.rank - b.rank)), 6) AS mean_shift, count(*) AS pooled FROM a FULL JOIN b USING (question_id, page) GROUP BY question_id""")
def rank_agreement(spark, folder):
    a = frames.stored_run(spark, folder).filter(F.col("doc_id") == F.substring_index("question_id", "::", 1))
    return ranking.agreement(a, frames.listed_run(spark, folder), 10)


@query(rf"""WITH {PAGES}, {EXTENTS}, h AS (SELECT doc_id, page, regexp_extract(text, '(?m)^[ \t]*(\d+\.\d+)[ \t]+\p{{Lu}}', 1) AS section FROM pages WHERE regexp_matches(text, '(?m)^[ \t]*\d+\.\d+[ \t]+\p{{Lu}}'))
SELECT h.doc_id, section, page AS start_page, coalesce(lead(page) OVER (PARTITION BY h.doc_id ORDER BY page) - 1, last) AS end_page FROM h JOIN extents USING (doc_id)""")
def section_spans(spark, folder):
    p = frames.pages(spark, folder)
    pattern = r"(?m)^[ \t]*(\d+\.\d+)[ \t]+\p{Lu}"
    h = p.filter(F.col("text").rlike(pattern)).select("doc_id", "page", F.regexp_extract("text", pattern, 1).alias("section"))
    nxt = F.lead("page").over(Window.partitionBy("doc_id").orderBy("page")) - 1
    return h.join(frames.extents(spark, folder), "doc_id").select("doc_id", "section", F.col("page").alias("start_page"), F.coalesce(nxt, F.col("last")).alias("end_page"))


@query(f"""WITH {LISTED}, {PAGES}, {QUESTIONS}, {BM25}, qw AS (SELECT question_id, doc_id, unnest(list_distinct({words('question')})) AS term FROM questions), qi AS (SELECT q.question_id, q.term, ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) AS w FROM qw q JOIN df d ON d.doc_id = q.doc_id AND d.term = q.term JOIN stats s ON s.doc_id = q.doc_id),
parts AS (SELECT l.question_id, l.page, p.text, unnest(generate_series(0, greatest(length(p.text) - 1, 0), 50)) AS start FROM listed l JOIN pages p ON p.doc_id = l.doc_id AND p.page = l.page WHERE l.rank <= 3),
toks AS (SELECT question_id, page, start, unnest(list_distinct({words('substring(text, (start + 1)::BIGINT, 300)')})) AS term FROM parts), cov AS (SELECT t.question_id, t.page, t.start, round(sum(w), 6) AS cover FROM toks t JOIN qi ON qi.question_id = t.question_id AND qi.term = t.term GROUP BY ALL),
e AS (SELECT p.question_id, p.page, p.start, coalesce(c.cover, 0) AS cover FROM parts p LEFT JOIN cov c USING (question_id, page, start))
SELECT question_id, page, start, cover FROM (SELECT *, row_number() OVER (PARTITION BY question_id, page ORDER BY cover DESC, start) AS r FROM e) WHERE r = 1""")
def snippet_window(spark, folder):
    return lexical.snippets(frames.listed_run(spark, folder).filter("rank <= 3"), frames.pages(spark, folder), frames.questions(spark, folder))


@query(f"""WITH {LISTED}, {PAGES}, {QUESTIONS}, ev AS (SELECT l.question_id, list_distinct(flatten(list({words('p.text')}))) AS e FROM listed l JOIN pages p ON p.doc_id = l.doc_id AND p.page = l.page GROUP BY l.question_id)
SELECT q.question_id, len(e)::BIGINT AS evidence_tokens, len(list_distinct({words('question')}))::BIGINT AS query_tokens, len(list_intersect(list_distinct({words('question')}), e))::BIGINT AS covered FROM questions q JOIN ev USING (question_id)""")
def query_coverage(spark, folder):
    l, p, q = frames.listed_run(spark, folder), frames.pages(spark, folder), frames.questions(spark, folder)
    ev = l.join(p, ["doc_id", "page"]).groupBy("question_id").agg(F.array_distinct(F.flatten(F.collect_list(F.array_distinct(tokens(F.col("text")))))).alias("e"))
    w = F.array_distinct(tokens(F.col("question")))
    return q.join(ev, "question_id").select("question_id", F.size("e").cast("bigint").alias("evidence_tokens"), F.size(w).cast("bigint").alias("query_tokens"), F.size(F.array_intersect(w, F.col("e"))).cast("bigint").alias("covered"))


@query("""WITH c AS (SELECT DISTINCT doc_id, page, chunk_index, coalesce(text, '') AS text FROM dense_chunks WHERE doc_id IS NOT NULL AND page IS NOT NULL AND chunk_index IS NOT NULL), one AS (SELECT doc_id, page, chunk_index, min(text) AS text FROM c GROUP BY ALL)
SELECT a.doc_id, a.page, a.chunk_index, count(*) AS parts, md5(string_agg(b.text, chr(10) ORDER BY b.chunk_index)) AS digest FROM one a JOIN one b ON a.doc_id = b.doc_id AND a.page = b.page AND b.chunk_index BETWEEN a.chunk_index - 2 AND a.chunk_index + 1 GROUP BY a.doc_id, a.page, a.chunk_index""")
def chunk_neighbourhood(spark, folder):
    c = table(spark, folder, "dense_chunks").filter("doc_id is not null and page is not null and chunk_index is not null")
    one = c.groupBy("doc_id", "page", "chunk_index").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    near = one.select("doc_id", "page", F.col("chunk_index").alias("of"), "text", F.explode(F.array(*map(F.lit, (-1, 0, 1, 2)))).alias("o")).withColumn("chunk_index", F.col("of") + F.col("o"))
    got = near.join(one.select("doc_id", "page", "chunk_index"), ["doc_id", "page", "chunk_index"], "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("of", "text")))
    return got.groupBy("doc_id", "page", "chunk_index").agg(F.count("*").alias("parts"), F.md5(F.concat_ws("\n", F.transform(parts, lambda x: x["text"]))).alias("digest"))
