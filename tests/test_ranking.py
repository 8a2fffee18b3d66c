from conftest import rows

from pagemill.operators import ranking


def run(spark, items):
    return spark.createDataFrame([("q", "d", p, r, s) for p, r, s in items], "question_id string, doc_id string, page int, rank int, score double")


def test_fusion_adds_and_breaks_ties_by_page(spark):
    a, b = run(spark, [(1, 1, 0.0), (2, 2, 0.0), (9, 11, 0.0)]), run(spark, [(2, 1, 0.0), (1, 2, 0.0)])
    got = ranking.fuse([a, b]).orderBy("rank").collect()
    assert [(r["page"], r["rank"]) for r in got] == [(1, 1), (2, 2)]
    assert got[0].score == round(1 / 61 + 1 / 62, 9)


def test_metrics_with_no_hit_and_more_gold_than_depth(spark):
    r = run(spark, [(5, 1, 0.0), (3, 2, 0.0)])
    gold = spark.createDataFrame([("q", "d", 3), ("q", "d", 4), ("none", "d", 1)], "question_id string, doc_id string, page int")
    got = {(x.question_id, x.k): x for x in ranking.at_depths(r, gold, (1, 3)).collect()}
    assert got["none", 3].tp == 0 and got["none", 3].ndcg == 0
    assert got["q", 1].any_hit == 0 and got["q", 3].recall == 0.5 and got["q", 3].rr == 0.5
    assert got["q", 3].precision == round(1 / 3, 6)


def test_expansion_order_and_clipping(spark):
    r = run(spark, [(1, 1, 0.0), (4, 2, 0.0)])
    ext = spark.createDataFrame([("d", 4)], "doc_id string, last int")
    assert [x["page"] for x in ranking.expand(r, ext, 1).orderBy("pos").collect()] == [1, 2, 4, 3]


def test_windows_full_only_and_greedy(spark):
    s = run(spark, [(p, p, v) for p, v in enumerate([1.0, 5.0, 1.0, 1.0, 5.0, 1.0], 1)])
    w = ranking.sliding(s, 3)
    assert rows(w, "start", "score") == [(1, 7.0), (2, 7.0), (3, 7.0), (4, 7.0)]
    assert ranking.apart(w, 3, 5).collect()[0].starts == "1,4"
    assert ranking.sliding(s, 7).count() == 0


def test_anchors_stay_inside(spark):
    r = run(spark, [(1, 1, 0.0), (6, 2, 0.0), (5, 3, 0.0)])
    ext = spark.createDataFrame([("d", 6)], "doc_id string, last int")
    assert rows(ranking.anchored(r, ext, 3), "start", "anchors") == [(1, "1"), (4, "6,5")]


def test_margins_with_few_results(spark):
    got = ranking.margins(run(spark, [(1, 1, 2.0), (2, 2, 1.0)])).collect()[0]
    assert (got.margin_2, got.margin_3, got.relative) == (1.0, None, 0.5)
