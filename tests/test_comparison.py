import pytest
from conftest import rows
from pyspark.sql import functions as F

from pagemill.operators import comparison as c


def test_routes_in_order_of_precedence(spark):
    q = spark.createDataFrame([("a", "d", "Across the  document, which table?"), ("b", "d", "Which Bar Chart?"), ("c", "e", "Which chart?"), ("x", "e", "in the whole document?"), ("n", "d", "plain"), ("u", "none", "plain")], "question_id string, doc_id string, question string")
    p = spark.createDataFrame([("d", 1, "x"), ("d", 2, " "), ("e", 1, ""), ("e", 2, "\n")], "doc_id string, page int, text string")
    got = {r.question_id: (r.route, r.signal, r.pages, r.filled) for r in c.routed(q, p).collect()}
    assert got == {"a": ("r3_document_global", "across the  document", 2, 1), "b": ("r1_local_visual", "bar chart", 2, 1), "c": ("r2_scanned_document", "zero_native_text_pages", 2, 0), "x": ("r3_document_global", "in the whole document", 2, 0), "n": ("r0_text", None, 2, 1)}


def _one(spark, expr, *values):
    names = [f"v{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expr(*map(F.col, names)).alias("x")).head()[0]


def test_intents(spark):
    ask = lambda t: tuple(_one(spark, c.intent, t))
    assert ask("What is the difference in cost between A and B?") == ("absolute_difference", None)
    assert ask("A compared to B: what is the difference?") == ("absolute_difference", None)
    assert ask("How many MORE visits than in May?") == ("left_minus_right", "more")
    assert ask("How many visits?") == (None, None)


def test_clauses(spark):
    assert _one(spark, c.clauses, "one, — two ,—three") == ["one", "two", "three"]
    assert _one(spark, c.clauses, " whole ") == ["whole"] and _one(spark, c.clauses, "one — , — two") is None


def test_facts_and_answers(spark):
    def check(a, u, b, v, answer):
        out = spark.createDataFrame([(a, u, b, v, answer)], "a string, u string, b string, v string, t string").select(c.fact_pair(F.col("a"), F.col("u"), F.col("b"), F.col("v")).alias("p"), "t").select("p", c.consistent(F.col("p"), F.col("t")).alias("k")).head()
        return None if out.p is None else (out.p.unit, out.p.direction, out.k and (out.k.magnitude_right, out.k.direction_right))

    assert check("2", "hours", "90", "Minutes", "0.5 more") == ("hours", "more", (True, True))
    assert check("1,200", "report", "(300)", "reports", "1500 fewer") == ("reports", "more", (True, False))
    assert check("5", "cars", "5", "cars", "the same, 0") == ("cars", "equal", (True, True))
    assert check("5", "cars", "5", "bikes", "x") is None and check("five", "cars", "5", "cars", "x") is None
    assert check("5", "cars", "4", "cars", " ") == ("cars", "more", None)


def test_numbers_of_answers(spark):
    number = lambda t: _one(spark, c.expected_number, t)
    assert number("It is 1,250.50.") == "1250.5" and number("40 and 100") == "60"
    assert number("10, 20; the difference is 10") == "10" and number("1 2 3") is None and number("none") is None


def test_modality_boxes_and_readings(spark):
    kinds = [([], "none"), (["Chart"], "chart"), (["title", "paragraph_title"], "text"), (["figure", "image"], "image_figure"), (["x"], "other"), (["x", "table"], "mixed"), (None, "none")]
    df = spark.createDataFrame([(e,) for e, _ in kinds], "e array<string>")
    assert [r[0] for r in df.select(c.modality(F.col("e"))).collect()] == [k for _, k in kinds]
    boxes = spark.createDataFrame([(0.2, 1.9, 3.1, 4.0), (-1.0, 0.0, 2.0, 2.0), (2.0, 0.0, 2.0, 2.0)], "a double, b double, c double, d double")
    got = [r[0] and tuple(r[0]) for r in boxes.select(c.pixel_box(*map(F.col, "abcd"))).collect()]
    assert got == [(0, 1, 4, 4), None, None]
    read = spark.createDataFrame([("p", 0, 5.0, 1.0, 3, 0), ("p", 90, 5.0, 1.0, 3, 1), ("p", 180, 4.0, 9.0, 9, 2)], "id string, rotation int, mass double, mean double, words int, preference int")
    assert rows(c.best_reading(read, "id")) == [("p", 0)]


def test_readings_equal_in_all_columns_do_not_depend_on_the_order_of_rows(spark):
    for rotations in ((0, 90, 180), (180, 90, 0), (90, 0, 180)):
        read = spark.createDataFrame([("p", x, 5.0, 1.0, 3, 0) for x in rotations], "id string, rotation int, mass double, mean double, words int, preference int").coalesce(1)
        assert rows(c.best_reading(read, "id")) == [("p", 0)]


def test_complete_joins(spark):
    a = spark.createDataFrame([("k1", "x", 1), ("k2", "x", 2), ("k4", "x", 3), ("k5", "x", 3), ("k5", "x", 4)], "k string, f string, v int")
    b = spark.createDataFrame([("k1", "x", 5), ("k2", "y", 6), ("k3", "x", 7), ("k5", "x", 8)], "k string, f string, w int")
    assert rows(c.join_problems(a, b, ["k"], ["f"])) == [("k2", "drift"), ("k3", "right_only"), ("k4", "left_only"), ("k5", "twice")]
    with pytest.raises(ValueError):
        c.checked_join(a, b, ["k"], ["f"])
    assert rows(c.checked_join(a.filter("k = 'k1'"), b.filter("k = 'k1'"), ["k"], ["f"])) == [("k1", "x", 1, 5)]


def test_sections_and_unions(spark):
    q = spark.createDataFrame([("q", "d", "In the chapter on harbour fees of the port"), ("r", "d", "harbour fees")], "question_id string, doc_id string, question string")
    s = spark.createDataFrame([("d", "1.2", "Harbour fees", 9), ("d", "1.1", "The harbour and fees", 4), ("d", "1.3", "Fees", 1)], "doc_id string, section string, title string, start_page int")
    assert rows(c.linked_section(q, s)) == [("q", "1.1", 4, 2)]
    run = lambda p: spark.createDataFrame([("q", x, k) for k, x in enumerate(p, 1)], "question_id string, page int, rank int")
    assert [r.page for r in c.ordered_union(run([3, 1, 2]), run([1, 9, 8]), 2).orderBy("pos").collect()] == [3, 1, 9]
