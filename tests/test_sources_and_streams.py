import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pagemill.operators import plugs
from pagemill.sources import records
from pagemill.streaming import calllog


def test_pages_round_trip_and_blank_line(spark, tmp_path):
    df = spark.createDataFrame([("d", 1, "a b", 2, "ok")], records.PAGE)
    records.write_pages(df, str(tmp_path / "p"))
    assert rows(records.read_pages(spark, str(tmp_path / "p"))) == [("d", 1, "a b", 2, "ok")]
    with pytest.raises(Exception, match="already exists"):
        records.write_pages(df, str(tmp_path / "p"))
    (tmp_path / "bad.json").write_text('{"doc_id":"d","page":1}\n\n')
    with pytest.raises(Exception, match="blank line"):
        records.read_pages(spark, str(tmp_path / "bad.json")).collect()


def test_locked_split(spark):
    with pytest.raises(PermissionError):
        records.read_questions(spark, "none", "locked_test", ("development_tune",))


def test_scan_and_classes(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one\fshort text page " + "w" * 120 + "\f")
    got = records.scan_files(spark, str(tmp_path), lambda b: b.decode().split("\f"))
    assert [(r["page"], r["extraction_status"]) for r in got.orderBy("page").collect()] == [(1, "text_layer_missing"), (2, "ok"), (3, "text_layer_missing")]


def test_integrity_and_guards(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 1), ("c", 1)], "doc_id string, page int")
    assert rows(records.integrity(df)) == [("b", False, True), ("c", True, False)]
    s = spark.createDataFrame([], "x struct<gold:int, ok:int>, y array<struct<gold:int>>").schema
    assert records.forbidden_fields(s, frozenset({"gold"})) == ["x.gold", "y[].gold"]
    assert records.canonical_json({"b": 1, "a": "é"}) == '{\n  "a": "é",\n  "b": 1\n}\n'.encode()


def test_word_table_and_vectors(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("conf\ttext\n95\tword\n-1\tx\n60\t \n40\tlow\n")
    q = records.word_quality(records.read_word_table(spark, str(tmp_path / "w.tsv"))).collect()[0]
    assert (q.words, q.mean_conf, q.sure) == (2, 67.5, 0.5)
    spark.createDataFrame([([1.0, float("nan")],)], "embedding array<float>").write.parquet(str(tmp_path / "v"))
    with pytest.raises(Exception, match="not finite"):
        records.read_vectors(spark, str(tmp_path / "v")).collect()


def test_overlay_refuses_other_pages(spark):
    old = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "doc_id string, page int, text string")
    new = old.filter("page = 2").withColumn("text", F.lit("B"))
    assert rows(records.overlay(old, new, new), "page", "text") == [(1, "a"), (2, "B")]
    with pytest.raises(ValueError):
        records.overlay(old, new, old)


def log(spark, path, n=60):
    start = datetime.datetime(2024, 1, 1)
    data = [(k, start + datetime.timedelta(minutes=7 * k), k % 3, "click" if k % 2 else "view", float(k % 5), "{}") for k in range(n)]
    spark.createDataFrame(data + data[:5], calllog.LOG).repartition(3).write.parquet(path)


def test_stream_equals_batch(spark, tmp_path):
    log(spark, str(tmp_path / "log"))
    hours = []
    calllog.drained(calllog.hourly(calllog.read_log(spark, str(tmp_path / "log"))), "complete", "", str(tmp_path / "c"), lambda b, n: hours.append(sorted((r.hour, r.event_type, r.calls) for r in b.collect())))
    batch = spark.read.parquet(str(tmp_path / "log")).groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "event_type").agg(F.count("*").alias("calls"))
    assert hours[-1] == sorted((r.hour, r.event_type, r.calls) for r in batch.collect())


def test_dedup_stream_and_rerun(spark, tmp_path):
    log(spark, str(tmp_path / "log"))
    src, out = calllog.read_log(spark, str(tmp_path / "log")), str(tmp_path / "out")
    calllog.drained(calllog.once(src, "30 days"), "append", out, str(tmp_path / "c1"))
    assert spark.read.parquet(out).count() == 60
    for turn in ("c2", "c3"):  # a rerun from the start adds nothing
        calllog.drained(src, "append", "", str(tmp_path / turn), calllog.keep_new(str(tmp_path / "kept"), ["event_id"]))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 60


def test_capped_state(spark, tmp_path):
    log(spark, str(tmp_path / "log"), 30)
    out = str(tmp_path / "out")
    calllog.drained(calllog.capped(calllog.read_log(spark, str(tmp_path / "log")), 9.0), "append", out, str(tmp_path / "c"))
    got = spark.read.parquet(out)
    assert got.filter("spent > 9").count() == 0 and got.filter("not accepted").count() > 0


def test_plugs(spark):
    df = spark.createDataFrame([("a b a",), (None,)], "t string")
    assert [sum(r.vector) for r in plugs.encoded(df, "t").collect()] == [3.0, 0.0]
    assert [list(r.vector) for r in plugs.encoded(df, "t", lambda ts: [[float(len(t))] for t in ts]).collect()] == [[5.0], [0.0]]
    req = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", "y"), ("3", "z")], "request string, body string")
    known = spark.createDataFrame([("2", "old")], "request string, answer string")

    def call(body):
        if body == "z":
            raise ValueError("no")
        return body * 2

    assert rows(plugs.answered(req, known, call), "request", "answer", "status") == [("1", "xx", "ok"), ("2", "old", "known"), ("3", "no", "error")]
    assert rows(plugs.answered(req, known), "request", "status") == [("1", "pending"), ("2", "known"), ("3", "pending")]


def test_expected_keys_missing_parts_and_outside_values(spark, tmp_path):
    import pytest

    from pagemill.sources.records import answered_by, expected, missing_parts, read_page_files

    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "k string, d string")
    assert expected(a, a, "k").count() == 3
    for bad in (a.filter("k != 'x'"), a.unionByName(a), a.unionByName(spark.createDataFrame([("w", "4")], "k string, d string"))):
        with pytest.raises(ValueError):
            expected(bad, a, "k")
    done = spark.createDataFrame([("x", "1"), ("y", "9")], "k string, d string")
    assert sorted(tuple(r) for r in missing_parts(a, done, "k", "d").collect()) == [("y", "2", "changed"), ("z", "3", "new")]
    local = spark.createDataFrame([("x", "h", "own"), ("y", "h", None), ("z", "h", None)], "k string, h string, v string")
    outer = spark.createDataFrame([("y", "h", "out")], "k string, h string, v string")
    assert sorted((r.k, r.v) for r in answered_by(local, outer, ["k"], "v", "h").collect()) == [("x", "own"), ("y", "out"), ("z", None)]
    with pytest.raises(Exception, match="another input"):
        answered_by(local, outer.selectExpr("k", "'g' as h", "v"), ["k"], "v", "h").collect()
    for n in (1, 2, 3):
        (tmp_path / f"page-{n}.txt").write_text("text")
    assert read_page_files(spark, str(tmp_path)).count() == 3
    (tmp_path / "page-2.txt").unlink()
    with pytest.raises(ValueError):
        read_page_files(spark, str(tmp_path))
