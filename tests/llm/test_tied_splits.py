import random
import time

from conftest import rows

from pagemill.llm.tied_splits import assign_splits, author_key, components, document_key, flow, record_groups, whole

SCHEMA = "question_id string, doc_id string, author string, split string"


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_keys_are_blind_to_spelling(spark):
    d = ["urnuuid0a1b-2c", "{0A1B-2C}", " urn:uuid:0a1b-2c ", "URNUUID0A1B2C", "0a1b-2c.pdf"]
    df = spark.createDataFrame([(x,) for x in d], "x string")
    assert len(set(rows(df.select(document_key(df.x).alias('k'))))) == 1
    a = ["Löa Press  Office", "LÖA PRESS OFFICE.", "loa press office", "Löa Press Office"]
    df = spark.createDataFrame([(x,) for x in a], "x string")
    assert len(set(rows(df.select(author_key(df.x).alias('k'))))) == 1
    df = spark.createDataFrame([(x,) for x in ("", "-", "N/A", " unknown ", "...", None)], "x string")
    assert set(rows(df.select(author_key(df.x).alias('k')))) == {(None,)}


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(f"n{k:03}", f"n{k + 1:03}") for k in range(60)] + [("hub", f"leaf{k}") for k in range(200)] + [("x", "x")]
    got = dict(components(spark.createDataFrame(edges, "a string, b string")).collect())
    assert {got[f"n{k:03}"] for k in range(1, 61)} == {"n000"}
    assert {got[f"leaf{k}"] for k in range(200)} == {"hub"}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_groups(spark):
    data = [("a::q1", None, "Ann", "t"), ("b::q1", None, "ANN.", "t"), ("b::q2", "zz", None, "t"), ("c::q1", " {B} ", "-", "t"), ("d::q1", None, "unknown", "t"), (None, "a", None, "t"), ("a::q1", None, "Ann", "t")]
    assert rows(record_groups(table(spark, data))) == [("a::q1", "a::q1", 4), ("b::q1", "a::q1", 4), ("b::q2", "a::q1", 4), ("c::q1", "a::q1", 4), ("d::q1", "d::q1", 1)]
    assert record_groups(table(spark, [])).count() == 0


def test_flow_keeps_and_meets_quotas():
    sent = flow({"x": 60, "y": 40}, {"a": 50.0, "b": 50.0}, {"x": "a", "y": "b"})
    assert sent == {"x": {"a": 50, "b": 10}, "y": {"a": 0, "b": 40}}
    given = whole([("x", 7, 4)], {"x": {"a": 14, "b": 14}}, {"a": 14.0, "b": 14.0})
    assert given == {"x": {"a": 2, "b": 2}}


def test_splits_near_shares_and_never_within_a_group(spark):
    r = random.Random(3)
    data = [(f"{r.choice('abcdefghijklmnop')}{k % 40}::q{k}", None, None, r.choice(["t", "e", None])) for k in range(600)]
    targets = spark.createDataFrame([("t", 0.6), ("e", 0.4)], "split string, share double")
    got = assign_splits(table(spark, data), targets).collect()
    assert len(got) == 600
    assert abs(sum(x.split == "t" for x in got) / 600 - 0.6) < 0.02
    by = {}
    for x in got:
        by.setdefault(x.group_id, set()).add(x.split)
    assert all(len(s) == 1 for s in by.values())
    again = assign_splits(table(spark, data).repartition(7), targets).collect()
    assert {tuple(x) for x in got} == {tuple(x) for x in again}


def test_flow_over_many_bundles_is_quick():
    r = random.Random(4)
    now = ["a", "b", "c"]
    supply = {(k, s): k * r.randrange(1, 50) for k in range(1, 5000) for s in r.sample(now, 2)}
    total = sum(supply.values())
    began = time.time()
    sent = flow(supply, {"a": 0.7 * total, "b": 0.1 * total, "c": 0.2 * total}, {b: b[1] for b in supply})
    assert time.time() - began < 5 and all(sum(sent[b].values()) == n for b, n in supply.items())
    assert abs(sum(x["a"] for x in sent.values()) - 0.7 * total) <= 1
