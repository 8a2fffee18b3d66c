"""Order-dependent folds and runs of neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import ship


def _in_order(rows: DataFrame, group: str, order: list[Column], value: Column) -> DataFrame:
    """``g, o, v`` with the groups whole and sorted within partitions, so a task walks through them row by row."""
    ship(rows.sparkSession)
    own = rows.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), *[c.alias(f"o{k}") for k, c in enumerate(order)], value.alias("v")).filter("v is not null")
    return own.repartition("g").sortWithinPartitions("g", *[f"o{k}" for k in range(len(order))])


def budget_batches(rows: DataFrame, group: str, order: str, cost: str, cap: float) -> DataFrame:
    """``group, order, batch``: items in order; a new batch starts when the next item would pass the cap.

    Costs are summed exactly in hundredths. The rule depends on all items before, so a group stays in one
    task; it streams through with two numbers of state, however long it is. Null groups and costs are left out.
    """
    limit = round(cap * 100)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, number = None, 0, 1
        for batch in batches:
            out = []
            for g, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if g != at:
                    at, total, number = g, 0, 1
                if total > 0 and total + v > limit:
                    total, number = 0, number + 1
                total += v
                out.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=[group, order, "batch"])

    cents = F.round(F.col(cost) * 100).cast("bigint")
    return _in_order(rows, group, [F.col(order)], cents).mapInArrow(run, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, batch bigint")


def consecutive_prefix(markers: Column) -> Column:
    """How far an array of integers counts 1, 2, 3, … in order; repeats are passed over."""
    return F.aggregate(markers, F.lit(0), lambda n, x: F.when(x == n + 1, n + 1).otherwise(n))


def line_anchors(words: DataFrame, group: str, at: str, tolerance: float) -> DataFrame:
    """Lines of positioned words: a new line starts beyond the tolerance of the line's first position.

    A group streams through one task with three numbers of state.
    """
    kind = dict(words.dtypes)[group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, top, n, lines = None, None, 0, 0
        for batch in batches:
            done: list[tuple] = []
            for g, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if g != key:
                    if n:
                        done.append((key, n, lines))
                    key, top, n, lines = g, None, 0, 0
                n += 1
                if top is None or abs(v - top) > tolerance:
                    top, lines = v, lines + 1
            yield _anchors(done, batch.schema.field(0).type, group)
            kind_of = batch.schema.field(0).type
        if n:
            yield _anchors([(key, n, lines)], kind_of, group)

    return _in_order(words, group, [F.col(at)], F.col(at).cast("double")).mapInArrow(run, f"`{group}` {kind}, words bigint, lines bigint")


def _anchors(rows: list[tuple], kind: pa.DataType, group: str) -> pa.RecordBatch:
    cols = [[r[k] for r in rows] for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=[group, "words", "lines"])


def runs(rows: DataFrame, group: str, at: str) -> DataFrame:
    """Runs of neighbouring integers: ``group, first, last``."""
    one = rows.select(group, at).distinct()
    key = F.col(at) - F.row_number().over(Window.partitionBy(group).orderBy(at))
    return one.withColumn("k", key).groupBy(group, "k").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("k")
