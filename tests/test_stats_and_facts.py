from decimal import Decimal

from conftest import rows
from pyspark.sql import functions as F

from pagemill.functions.text import as_decimal, light_stem, plain_decimal, squeeze, tokens
from pagemill.operators import facts, folds, stats


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).collect()[0][0]


def test_tokens_and_spacing(spark):
    assert one(spark, tokens, "Straße_²Über-x\t9") == ["strasse", "²über", "x", "9"]
    assert one(spark, tokens, None) is None
    assert one(spark, squeeze, " a　b\x1cc  ") == "a b c"


def test_numbers(spark):
    assert one(spark, as_decimal, "(1,250.50)") == Decimal("-1250.5")
    assert one(spark, as_decimal, "(1,250") is None
    for raw, plain in (("-0.00", "0"), ("0.50", "0.5"), ("1.00", "1"), ("100", "100")):
        assert one(spark, lambda c: plain_decimal(as_decimal(c)), raw) == plain
    assert one(spark, facts.numbers, "in 2,000 of 2000, 3.50") == ["2000", "3.5"]


def test_stems(spark):
    assert [one(spark, light_stem, w) for w in ("running", "ring", "pages", "bus", "")] == ["runn", "ring", "page", "bus", ""]


def test_calculator(spark):
    def calc(op, xs):
        df = spark.createDataFrame([(op, xs)], "op string, x array<double>")
        return df.select(facts.calculated(F.col("op"), F.col("x"))).collect()[0][0]

    assert calc("percent_change", [50.0, 75.0]) == 50
    assert calc("divide", [1.0, 0.0]) is None and calc("add", [1.0]) is None and calc("mean", []) is None


def test_support_and_common_page(spark):
    claims = spark.createDataFrame([("c", "d", "1,000 and 7"), ("x", "d", "99")], "claim string, doc_id string, text string")
    pages = spark.createDataFrame([("d", 1, "1000"), ("d", 2, "7 of 1,000"), ("e", 1, "99")], "doc_id string, page int, text string")
    assert rows(facts.supported(claims, pages)) == [("c", "1000", 2, 1), ("c", "7", 1, 2), ("x", "99", 0, None)]
    assert rows(facts.common_page(None, claims, pages)) == [("c", 2)]


def test_risk_coverage_and_ties(spark):
    df = spark.createDataFrame([("a", 0.9, 1), ("b", 0.5, 0), ("c", 0.5, 1), ("d", 0.1, 1)], "question_id string, confidence double, correct bigint")
    assert rows(stats.risk_coverage(df), "question_id", "answered", "errors") == [("a", 1, 0), ("b", 2, 1), ("c", 3, 1), ("d", 4, 1)]
    got = {r.target: (r.threshold, r.answered) for r in stats.operating_points(df, [0.25, 0.5, 0.8]).collect()}
    assert got == {0.25: (0.9, 1), 0.5: (0.9, 1), 0.8: (0.5, 3)}
    assert stats.risk_coverage(df.limit(0)).count() == 0


def test_bootstrap_is_the_same_twice_and_with_other_partitions(spark):
    df = spark.createDataFrame([(f"d{k % 7}", float(k % 3)) for k in range(40)], "doc_id string, value double")
    a, b = stats.cluster_bootstrap(df, 50).collect(), stats.cluster_bootstrap(df.repartition(3), 50).collect()
    assert a == b and a[0].low <= a[0].point <= a[0].high


def test_budget_batches(spark):
    df = spark.createDataFrame([("g", k, c) for k, c in enumerate([6.0, 4.0, 1.0, 12.0, 3.0])] + [(None, 1, 1.0)], "g string, k bigint, c double")
    assert rows(folds.budget_batches(df, "g", "k", "c", 10.0)) == [("g", 0, 1), ("g", 1, 1), ("g", 2, 2), ("g", 3, 3), ("g", 4, 4)]


def test_prefix_lines_and_runs(spark):
    assert one(spark, folds.consecutive_prefix, [1, 1, 2, 4, 3], "array<int>") == 3
    w = spark.createDataFrame([("p", 1.0), ("p", 1.8), ("p", 2.6), ("p", 9.0)], "page string, top double")
    assert rows(folds.line_anchors(w, "page", "top", 1.0)) == [("p", 4, 3)]
    r = spark.createDataFrame([("g", 1), ("g", 2), ("g", 2), ("g", 5)], "g string, p int")
    assert rows(folds.runs(r, "g", "p")) == [("g", 1, 2), ("g", 5, 5)]
