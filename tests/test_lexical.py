from math import log

import pytest

from pagemill.operators import lexical

PAGES = [("d", 1, "Alpha alpha beta"), ("d", 2, "beta gamma"), ("d", 3, ""), ("e", 1, "alpha")]


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame(PAGES, "doc_id string, page int, text string")


def asked(spark, text, doc="d"):
    return spark.createDataFrame([("q", doc, text)], "question_id string, doc_id string, question string")


def by_hand(query, doc="d"):
    own = {p: t.lower().split() for d, p, t in PAGES if d == doc}
    n, avg = len(own), sum(map(len, own.values())) / len(own)
    out = {}
    for p, words in own.items():
        s = 0.0
        for t in query.lower().split():
            df = sum(t in w for w in own.values())
            tf = words.count(t)
            if tf:
                s += log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
        out[p] = round(s, 6)
    return out


def test_scores_by_hand_and_zero_pages(spark, pages):
    got = {r.page: round(r.score, 6) for r in lexical.bm25(asked(spark, "alpha beta beta"), pages).collect()}
    assert got == by_hand("alpha beta beta")
    assert got[3] == 0


def test_repeated_words_weigh_unless_dropped(spark, pages):
    once = {r.page: round(r.score, 6) for r in lexical.bm25(asked(spark, "beta beta"), pages, once=True).collect()}
    assert once == by_hand("beta")


def test_ties_go_by_page(spark, pages):
    got = [(r["page"], r["rank"]) for r in lexical.ranked(lexical.bm25(asked(spark, "unknown"), pages)).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3)]


def test_unknown_document_and_empty_query(spark, pages):
    assert lexical.bm25(asked(spark, "alpha", "none"), pages).count() == 0
    assert [r.score for r in lexical.bm25(asked(spark, "?!"), pages).collect()] == [0, 0, 0]


def test_document_without_words(spark):
    p = spark.createDataFrame([("d", 1, ""), ("d", 2, None)], "doc_id string, page int, text string")
    assert [r.score for r in lexical.bm25(asked(spark, "x"), p).collect()] == [0, 0]


def test_snippet_prefers_the_earliest_window(spark):
    filler = "zeta " * 200
    p = spark.createDataFrame([("d", 1, filler + "the needle is here " + filler), ("d", 2, "other words")], "doc_id string, page int, text string")
    q = asked(spark, "needle here")
    hits = spark.createDataFrame([("q", "d", 1), ("q", "d", 2)], "question_id string, doc_id string, page int")
    got = {r.page: r for r in lexical.snippets(hits, p, q).collect()}
    assert got[1].start == 750 and got[2].start == 0 and got[2].cover == 0
