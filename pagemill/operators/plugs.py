"""Places for outside effects: encoders, page readers, model calls. Each has a default without any."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.dense import hashed_counts


class Encoder(Protocol):
    """Turns texts into vectors of one length."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def encoded(rows: DataFrame, text: str, encoder: Encoder | None = None, size: int = 64) -> DataFrame:
    """Adds ``vector``: by the encoder, in Arrow batches, or by hashed word counts inside the engine."""
    if encoder is None:
        return rows.withColumn("vector", hashed_counts(F.coalesce(F.col(text), F.lit("")), size))

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(encoder(s.fillna("").tolist()))

    return rows.withColumn("vector", run(F.col(text)))


Answer = Callable[[str], str]


def answered(requests: DataFrame, known: DataFrame, call: Answer | None = None) -> DataFrame:
    """``request, body, answer, status``: answers from the table of known ones; the rest through ``call`` if given.

    Equal requests are sent once. A call that fails is a row with status ``error``, never a lost row.
    """
    one = requests.select("request", "body").dropDuplicates(["request"])
    have = one.join(known.select("request", "answer"), "request", "left")
    done = have.filter("answer is not null").withColumn("status", F.lit("known"))
    open_ = have.filter("answer is null").select("request", "body")
    if call is None:
        return done.unionByName(open_.withColumn("answer", F.lit(None).cast("string")).withColumn("status", F.lit("pending")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r, body in zip(b["request"], b["body"]):
                try:
                    out.append((r, body, call(body), "ok"))
                except Exception as e:  # noqa: BLE001
                    out.append((r, body, str(e)[:200], "error"))
            yield pd.DataFrame(out, columns=["request", "body", "answer", "status"])

    return done.unionByName(open_.mapInPandas(run, "request string, body string, answer string, status string"))
