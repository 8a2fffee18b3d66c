import random

from conftest import rows

from pagemill.llm.top_items import top_items


def brute(data, n):
    best = {}
    for g, d, p, s in data:
        if g is not None and d is not None and p is not None and s is not None and s == s:
            best[g, d, p] = max(s, best.get((g, d, p), s))
    out = []
    for g in {k[0] for k in best}:
        items = sorted(((-s, d, p) for (q, d, p), s in best.items() if q == g))[:n]
        out += [(g, k + 1, d, p, -s) for k, (s, d, p) in enumerate(items)]
    return sorted(out)


def made(spark, data):
    return spark.createDataFrame(data, "q string, d string, p int, s double")


def test_against_brute_force_with_a_hot_group_ties_and_repeats(spark):
    r = random.Random(1)
    data = [("hot" if r.random() < 0.4 else f"q{r.randrange(30)}", f"d{r.randrange(9)}", r.randrange(40), r.choice([None, float("nan"), round(r.random() * 3, 1)])) for _ in range(3000)]
    data += data[:50] + [(None, "d", 1, 1.0), ("q1", None, 1, 9.0), ("q1", "d", None, 9.0)]
    assert rows(top_items(made(spark, data), "q", ["d", "p"], "s", 5)) == brute(data, 5)


def test_all_scores_equal_and_groups_smaller_than_n(spark):
    data = [("a", "x", k, 1.0) for k in range(9)] + [("b", "y", 1, 1.0)]
    assert rows(top_items(made(spark, data), "q", ["d", "p"], "s", 5)) == brute(data, 5)


def test_empty_and_no_scores(spark):
    assert top_items(made(spark, []), "q", ["d", "p"], "s", 5).count() == 0
    assert top_items(made(spark, [("a", "x", 1, None)]), "q", ["d", "p"], "s", 5).count() == 0


def test_clashing_columns(spark):
    df = made(spark, [("a", "x", 1, 1.0), ("a", "x", 2, 2.0)]).selectExpr("*", "1 as g", "2 as i0", "3 as pos", "4 as have")
    assert rows(top_items(df, "q", ["d", "p"], "s", 1)) == [("a", 1, "x", 2, 2.0)]
