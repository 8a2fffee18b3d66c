"""Operations on rankings: fusion, metrics at several depths, comparison, expansion, windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, DEPTH = 60, 10


def fuse(rankings: list[DataFrame], depth: int = DEPTH, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of rankings ``(question_id, doc_id, page, rank)``: ``…, score, rank``."""
    cut = [r.filter(F.col("rank") <= depth).select("question_id", "doc_id", "page", (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("s")) for r in rankings]
    score = reduce(DataFrame.unionByName, cut).groupBy("question_id", "doc_id", "page").agg(F.round(F.sum("s"), 9).alias("score"))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id", "page")
    return score.withColumn("rank", F.row_number().over(w).cast("bigint"))


def at_depths(run: DataFrame, gold: DataFrame, depths: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Metrics of each question and depth; gold ``(question_id, doc_id, page)``, each once.

    Every question with gold gets its rows, found or not. The ranking is made once and cut at each depth.
    """
    size = gold.groupBy("question_id").agg(F.count("*").alias("gold"))
    hits = gold.join(run.filter(F.col("rank") <= max(depths)), ["question_id", "doc_id", "page"]).select("question_id", "rank")
    grid = size.withColumn("k", F.explode(F.array(*map(F.lit, depths)).cast("array<bigint>")))
    inside = F.when(F.col("rank") <= F.col("k"), F.col("rank"))
    gain = 1.0 / F.log2(inside + 1)
    per = grid.join(hits, "question_id", "left").groupBy("question_id", "k", "gold").agg(F.count(inside).alias("tp"), F.min(inside).alias("first"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("gold", "k").cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    recall, precision = F.col("tp") / F.col("gold"), F.col("tp") / F.col("k")
    r6 = lambda c: F.round(c, 6)
    return per.select(
        "question_id", "k", "gold", "tp",
        (F.col("tp") > 0).cast("bigint").alias("any_hit"), (F.col("tp") == F.col("gold")).cast("bigint").alias("complete"),
        r6(recall).alias("recall"), r6(precision).alias("precision"),
        r6(F.when(F.col("tp") > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)).alias("f1"),
        r6(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("rr"), r6(F.col("dcg") / ideal).alias("ndcg"),
    )


def macro_micro() -> list[Column]:
    """Aggregates of question metrics: means over questions and ratios of totals."""
    mean = lambda c: F.round(F.avg(c) + 1e-9, 4).alias(f"mean_{c}")
    return [
        F.count("*").alias("questions"), mean("any_hit"), mean("complete"), mean("recall"), mean("precision"), mean("rr"), mean("ndcg"),
        F.sum("tp").alias("tp"), F.sum("gold").alias("gold"),
        F.round(F.try_divide(F.sum("tp"), F.sum("gold")), 6).alias("micro_recall"), F.round(F.try_divide(F.sum("tp"), F.sum("k")), 6).alias("micro_precision"),
    ]


def expand(ranked: DataFrame, extents: DataFrame, radius: int) -> DataFrame:
    """Pages within ``radius`` of the ranked ones, each once, in order: seed, before, after, next seed.

    ranked: ``question_id, doc_id, page, rank``; extents: ``doc_id, last``. The band is an explode of the few
    offsets, so there is no range join.
    """
    off = [0, *(o for r in range(1, radius + 1) for o in (-r, r))]
    at = F.posexplode(F.array(*map(F.lit, off))).alias("turn", "off")
    near = ranked.select("question_id", "doc_id", "page", "rank", at).join(extents, "doc_id")
    near = near.withColumn("page", F.col("page") + F.col("off")).filter((F.col("page") >= 1) & (F.col("page") <= F.col("last")))
    first = near.groupBy("question_id", "doc_id", "page").agg(F.min(F.struct("rank", "turn")).alias("o"))
    w = Window.partitionBy("question_id").orderBy("o")
    return first.select("question_id", "doc_id", "page", F.row_number().over(w).cast("bigint").alias("pos"))


def sliding(scores: DataFrame, width: int) -> DataFrame:
    """Sums of ``width`` neighbouring pages, full windows only: ``question_id, doc_id, start, score``."""
    w = Window.partitionBy("question_id", "doc_id").orderBy("page").rowsBetween(0, width - 1)
    full = scores.select("question_id", "doc_id", F.col("page").alias("start"), F.round(F.sum("score").over(w), 6).alias("score"), F.count("*").over(w).alias("n"))
    return full.filter(F.col("n") == width).drop("n")


def anchored(ranked: DataFrame, extents: DataFrame, width: int) -> DataFrame:
    """Windows centred at ranked pages and kept within the document; anchors in order of rank."""
    half = width // 2
    at = ranked.join(extents.filter(F.col("last") >= width), "doc_id")
    start = F.greatest(F.lit(1), F.least(F.col("page") - half, F.col("last") - width + 1))
    got = at.groupBy("question_id", "doc_id", start.alias("start")).agg(F.array_sort(F.collect_list(F.struct("rank", "page"))).alias("a"))
    return got.select("question_id", "doc_id", F.col("start").cast("bigint").alias("start"), F.concat_ws(",", F.transform("a", lambda x: x["page"].cast("string"))).alias("anchors"))


def apart(windows: DataFrame, width: int, take: int) -> DataFrame:
    """Greedy choice of the best windows that do not overlap: ``question_id, doc_id, starts``.

    The windows of one question and document are one document's pages; the fold stays in the engine.
    """
    own = windows.groupBy("question_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("start").alias("p")))).alias("w"))
    empty = F.array().cast("array<int>")
    pick = F.aggregate("w", empty, lambda got, x: F.when((F.size(got) < take) & ~F.exists(got, lambda p: F.abs(p - x["p"]) < width), F.concat(got, F.array(x["p"]))).otherwise(got))
    return own.select("question_id", "doc_id", F.concat_ws(",", F.transform(pick, lambda p: p.cast("string"))).alias("starts"))


def margins(ranked: DataFrame) -> DataFrame:
    """Distances of the best score to the second and third, plain and relative."""
    s = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    g = ranked.filter("rank <= 3").groupBy("question_id").agg(s(1).alias("a"), s(2).alias("b"), s(3).alias("c"))
    norm = (F.col("a") - F.col("b")) / F.greatest(F.abs("a"), F.abs("b"), F.lit(1e-12))
    return g.select("question_id", F.round(F.col("a") - F.col("b"), 6).alias("margin_2"), F.round(F.col("a") - F.col("c"), 6).alias("margin_3"), F.round(norm, 6).alias("relative"))


def agreement(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Shared pages of two rankings at ``k``, their mean distance in rank, and the union in order."""
    a, b = (r.filter(F.col("rank") <= k).select("question_id", "page", F.col("rank").alias(n)) for r, n in ((left, "ra"), (right, "rb")))
    both = a.join(b, ["question_id", "page"], "full_outer")
    return both.groupBy("question_id").agg(F.count(F.col("ra") + F.col("rb")).alias("shared"), F.round(F.avg(F.abs(F.col("ra") - F.col("rb"))), 6).alias("mean_shift"), F.count("*").alias("pooled"))
