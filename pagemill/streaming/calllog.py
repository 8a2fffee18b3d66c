"""Streams over an append-only call log, each with the same result as its batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream of files; event time as an instant, as watermarks need it."""
    return spark.readStream.schema(LOG).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(log: DataFrame, late: str = "2 hours") -> DataFrame:
    """Calls and spending of each hour and kind; rows later than ``late`` are dropped."""
    w = F.window("ts", "1 hour")
    return log.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("spent")).select(F.col("window.start").alias("hour"), "event_type", "calls", "spent")


def sliding(log: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    w = F.window("ts", width, step)
    return log.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("calls")).select(F.col("window.start").alias("start"), "calls")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Bursts of calls of each user, ended by a pause."""
    w = F.session_window("ts", gap)
    return log.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("calls")).select("user_id", F.col("session_window.start").alias("start"), "calls")


def once(log: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


CAPPED = "user_id bigint, event_id bigint, spent double, accepted boolean"


def capped(log: DataFrame, cap: float) -> DataFrame:
    """Running spending of each user with a cap checked before each call: a call beyond it is refused and not charged.

    State is one number for each user. Within a batch a user's calls are taken in order of event id; null
    users and values are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values("event_id")
        out = []
        for e, v in zip(rows["event_id"], rows["value"]):
            ok = spent + v <= cap
            spent += v if ok else 0.0
            out.append((key[0], int(e), spent, ok))
        state.update((spent,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "spent", "accepted"])

    rows = log.filter("user_id is not null and value is not null").select("user_id", "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(step, CAPPED, "spent double", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str, target: str, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None) -> None:
    """Runs a stream over all that is there now, into Parquet (append) or through ``write`` for each batch."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.foreachBatch(write) if write else w.format("parquet").option("path", target)
    w.start().awaitTermination()


def keep_new(target: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that adds only rows whose keys the target does not hold: a rerun changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(keys)
        path = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).exists(path):  # not before the first batch
            rows = rows.join(batch.sparkSession.read.parquet(target).select(*keys), keys, "left_anti")
        rows.write.mode("append").parquet(target)

    return write
