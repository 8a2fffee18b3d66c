"""Best N items of every group by descending score bands.

The scores of all rows give a few band limits (an aggregate over the whole table); the rows are written once, each
into its band. The bands are read from the top: groups already filled are anti-joined away before the band is
aggregated, and a band's rows are ranked exactly, so ties never straddle two bands. The rank filter prunes every group
to a constant number of rows before its shuffle, so a group that holds a third of all rows is never gathered in one
task. How the anti-join is done is the planner's choice by the size of the stored table of groups.

Defined results: null and NaN scores are no scores; rows with a null group or a null item column are
ignored; an item counts once with its best score; ties go by the item columns ascending; repeated rows
change nothing; an empty table gives an empty result; further columns of the input, whatever their
names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.storage import discard, stored

#: Shares of the rows below the lower limits of the bands, from the top.
BANDS = (0.9, 0.6, 0.3)


def top_items(rows: DataFrame, group: str, items: list[str], score: str, n: int, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """``group, pos, *items, score``: the best ``n`` items of each group, pos from 1."""
    keys = [f"i{k}" for k in range(len(items))]
    scored = rows.select(F.col(group).alias("g"), *[F.col(c).alias(k) for c, k in zip(items, keys)], F.col(score).cast("double").alias("s"))
    valid = scored.filter(F.col("s").isNotNull() & ~F.isnan("s") & F.col("g").isNotNull() & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    limits = sorted(set(valid.agg(F.percentile_approx("s", list(bands), 1000).alias("q")).head()[0] or []), reverse=True)
    number = reduce(lambda c, k: c.when(F.col("s") >= limits[k], k), range(len(limits)), F.when(F.lit(False), 0)).otherwise(len(limits))
    table = stored(valid.withColumn("band", number), "top-rows", by=("band",))
    rank = Window.partitionBy("g").orderBy(F.desc("s"), *keys)
    done: list[DataFrame] = []
    for k in range(len(limits) + 1):
        band = table.filter(F.col("band") == k).drop("band")
        if done:
            before = reduce(DataFrame.unionByName, done)
            have = stored(before.groupBy("g").agg(F.count("*").alias("have")), "top-have")
            band = band.join(have.filter(F.col("have") >= n).select("g"), "g", "left_anti")
        best = band.groupBy("g", *keys).agg(F.max("s").alias("s"))
        # at most n earlier items can be among the first 2n, so n new ones are left
        best = best.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= 2 * n).drop("r")
        if done:
            best = best.join(before.select("g", *keys), ["g", *keys], "left_anti").join(have, "g", "left").withColumn("have", F.coalesce("have", F.lit(0)))
        else:
            best = best.withColumn("have", F.lit(0).cast("bigint"))
        best = best.withColumn("pos", (F.row_number().over(rank) + F.col("have")).cast("int")).filter(F.col("pos") <= n)
        done.append(stored(best.select("g", "pos", *keys, "s"), "top-band"))
    discard(table)
    return reduce(DataFrame.unionByName, done).select(F.col("g").alias(group), "pos", *[F.col(k).alias(c) for c, k in zip(items, keys)], F.col("s").alias(score))
