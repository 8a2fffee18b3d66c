"""Risk and coverage, bootstrap intervals, hash-ordered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.storage import stored


def ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``part``: consecutive ranges of an order, so running totals need no task that holds all rows.

    Stored, as the ranges must stay the same in every use; stored before as well, as finding the ranges reads the rows twice.
    """
    return stored(stored(rows, "unranged").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")


def totals_before(parts: DataFrame, **sums: Column) -> DataFrame:
    """``part`` and for each sum its total over the ranges before; one row for each range."""
    each = parts.groupBy("part").agg(*[c.alias(n) for n, c in sums.items()])
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("part", *[F.coalesce(F.sum(n).over(over), F.lit(0)).alias(n) for n in sums])


def risk_coverage(rows: DataFrame) -> DataFrame:
    """Prefix risks by confidence, then id: ``question_id, answered, errors, coverage, risk``.

    Running totals within ranges of the order, with the totals of the ranges before; equal confidences may be any share.
    """
    wrong = 1 - F.col("correct")
    parts = ranged(rows, F.desc("confidence"), F.col("question_id"))
    before = totals_before(parts, n0=F.count("*"), e0=F.sum(wrong))
    run = Window.partitionBy("part").orderBy(F.desc("confidence"), "question_id").rowsBetween(Window.unboundedPreceding, 0)
    at = parts.select("question_id", "confidence", "part", F.count("*").over(run).alias("n"), F.sum(wrong).over(run).alias("e")).join(before, "part")
    at = at.select("question_id", "confidence", (F.col("n") + F.col("n0")).alias("answered"), (F.col("e") + F.col("e0")).alias("errors"))
    total = parts.agg(F.count("*").alias("total"))
    return at.crossJoin(total).select("question_id", "confidence", "answered", "errors", F.round(F.col("answered") / F.col("total"), 6).alias("coverage"), F.round(F.col("errors") / F.col("answered"), 6).alias("risk"))


def area_under_risk(rows: DataFrame) -> DataFrame:
    """``answered, aurc``: the mean of the prefix risks, one row; null for no rows."""
    curve = risk_coverage(rows)
    return curve.agg(F.count("*").alias("answered"), F.round(F.avg(F.col("errors") / F.col("answered")), 6).alias("aurc"))


def operating_points(rows: DataFrame, targets: list[float]) -> DataFrame:
    """The last confidence whose whole tie group keeps coverage within each target."""
    groups = ranged(rows.groupBy("confidence").agg(F.count("*").alias("n"), F.sum(1 - F.col("correct")).alias("e")), F.desc("confidence"))
    before = totals_before(groups, n0=F.sum("n"), e0=F.sum("e"))
    w = Window.partitionBy("part").orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    run = groups.select("confidence", "part", F.sum("n").over(w).alias("n"), F.sum("e").over(w).alias("e")).join(before, "part")
    run = run.select("confidence", (F.col("n") + F.col("n0")).alias("answered"), (F.col("e") + F.col("e0")).alias("errors")).crossJoin(groups.agg(F.sum("n").alias("total")))
    goal = run.withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    ok = goal.filter(F.col("answered") / F.col("total") <= F.col("target"))
    last = ok.groupBy("target").agg(F.max_by(F.struct("confidence", "answered", "errors"), "answered").alias("p"))
    return last.select("target", F.col("p.confidence").alias("threshold"), F.col("p.answered").alias("answered"), F.round(F.col("p.errors") / F.col("p.answered"), 6).alias("risk"))


def draw(seed: str, replicate: Column, place: Column, n: Column) -> Column:
    """A number below ``n`` derived from a hash, the same in every engine."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), replicate.cast("string"), place.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), n)


def cluster_bootstrap(rows: DataFrame, replicates: int, seed: str = "s", name: str = "value") -> DataFrame:
    """Mean of ``value`` with a percentile interval from resampled clusters (``doc_id``).

    Rows are summed to clusters first, so a replicate draws from one row per cluster. A replicate whose
    denominator is 0 is left out.
    """
    per = ranged(rows.groupBy("doc_id").agg(F.sum(name).alias("s"), F.count(name).alias("c")), F.col("doc_id"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) - 1 + F.col("before")
    per = per.join(totals_before(per, before=F.count("*")), "part").select("doc_id", "s", "c", number.cast("bigint").alias("i"))
    n = per.count()
    # every draw is a row of its own range of numbers, so no task makes all of them
    draws = rows.sparkSession.range(replicates * n).select(F.expr(f"id div {max(n, 1)}").cast("int").alias("rep"), (F.col("id") % max(n, 1)).alias("place"))
    draws = draws.select("rep", draw(seed, F.col("rep"), F.col("place"), F.lit(n).cast("bigint")).alias("i"))
    reps = draws.join(per, "i").groupBy("rep").agg(F.try_divide(F.sum("s"), F.sum("c")).alias("m")).filter("m is not null")
    point = per.agg(F.round(F.try_divide(F.sum("s"), F.sum("c")), 6).alias("point"))
    q = reps.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"), F.count("*").alias("replicates"))
    return point.crossJoin(q)


def hash_sample(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The ``n`` rows whose seeded hash is smallest."""
    return rows.withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256)).orderBy("h", key).limit(n).drop("h")


def quota_sample(rows: DataFrame, key: str, stratum: str, seed: str, quota: int) -> DataFrame:
    """At most ``quota`` rows of each stratum by seeded hash."""
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256), key)
    return rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= quota).withColumn("pos", F.col("pos").cast("bigint"))
