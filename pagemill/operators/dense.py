"""Ranking by vectors: best chunk of each page, late interaction, candidate pools, hashed encoder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import tokens
from pagemill.session import ship

#: Vectors of the query set that are sent to the tasks at once.
BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector with length 1; a zero vector stays zero."""
    # the length is computed once for the vector, not once for each of its values
    norms = F.array_repeat(F.sqrt(dot(v, v)), F.size(v))
    return F.zip_with(v, norms, lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """The query set in blocks of ``BLOCK`` vectors, one at a time on the driver."""
    ids, vectors = [], []
    for r in queries.select("query", "vector").toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == BLOCK:
            yield ids, np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield ids, np.array(vectors, np.float64)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best_of_page(scores: np.ndarray, pages: np.ndarray, chunks: np.ndarray, top: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the best chunk of each page for each query, the first of equals; of the ``top`` pages only."""
    order = np.lexsort((chunks, pages))
    s, p = scores[:, order], pages[order]
    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    best = np.maximum.reduceat(s, starts, axis=1)
    of = np.cumsum(np.concatenate([[0], (p[1:] != p[:-1]).astype(np.int64)]))
    first = np.minimum.reduceat(np.where(s == best[:, of], np.arange(s.shape[1]), s.shape[1]), starts, axis=1)
    row, page = np.indices(best.shape).reshape(2, -1) if top is None else _best_of_all(best, top)
    return row, order[first[row, page]]


def _best_of_all(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best for each query, with all that equal the last."""
    if scores.shape[1] <= k:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return np.nonzero(scores >= least[:, None])


def scored(queries: DataFrame, chunks: DataFrame, k: int | None = None, top: int | None = None) -> DataFrame:
    """``query, page, chunk, score``: cosines of queries ``(query, vector)`` with chunks ``(page, chunk, vector)``.

    The query set goes to the tasks in blocks and each Arrow batch of chunks is one matrix product. A batch
    hands on only what can still win: the ``k`` best chunks of each query, or the best chunk of each of the ``top``
    best pages (a page among these is so in the batch of its best chunk), so the product of both sides is never a
    table. Without both, the best chunk of every page is kept, for sums over pages. Rows with a null id or vector
    are left out.
    """
    ship(chunks.sparkSession)
    sc = chunks.sparkSession.sparkContext
    own = chunks.filter("page is not null and chunk is not null and vector is not null").select(F.col("page").cast("bigint").alias("page"), F.col("chunk").cast("bigint").alias("chunk"), "vector")
    out = None
    for block in _blocks(queries.filter("query is not null and vector is not null")):
        sent = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            ids, q = np.array(ids, np.int64), _unit_rows(q)
            for batch in batches:
                if not batch.num_rows:
                    continue
                pages, numbers = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                s = np.round(q @ _unit_rows(flat.reshape(batch.num_rows, -1)).T, 9)
                at, col = _best_of_page(s, pages, numbers, top) if k is None else _best_of_all(s, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(pages[col]), pa.array(numbers[col]), pa.array(s[at, col])], names=["query", "page", "chunk", "score"])

        part = own.mapInArrow(run, "query bigint, page bigint, chunk bigint, score double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else chunks.sparkSession.createDataFrame([], "query bigint, page bigint, chunk bigint, score double")


def best_chunk(scores: DataFrame) -> DataFrame:
    """``query, page, chunk, score``: the best chunk of each page, the first of equals."""
    best = scores.groupBy("query", "page").agg(F.max_by(F.struct("chunk", "score"), F.struct("score", -F.col("chunk"))).alias("b"))
    return best.select("query", "page", "b.chunk", "b.score")


def top_pages(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "page")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def late_interaction(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """``query, page, score``: for each query vector its best page vector, summed over the query's vectors.

    queries: ``query, part, vector`` with parts of their own numbers; pages: ``page, part, vector``.
    """
    best = scored(queries.select(F.col("part").alias("query"), "vector"), pages.withColumnRenamed("part", "chunk"))
    one = best.groupBy(F.col("query").alias("part"), "page").agg(F.max("score").alias("m"))
    return one.join(queries.select("query", "part"), "part").groupBy("query", "page").agg(F.round(F.sum("m"), 6).alias("score"))


def hashed_counts(text: Column, size: int = 64) -> Column:
    """A vector of word counts in ``size`` places by hash: the default encoder, with no model behind it."""
    places = F.transform(tokens(text), lambda w: F.pmod(F.crc32(F.encode(w, "utf-8")), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double"))


def hashed_similarity(queries: DataFrame, pages: DataFrame, size: int = 64) -> DataFrame:
    """``question_id, doc_id, page, score``: cosine of hashed word counts within each question's document.

    Counts stay sparse rows ``(place, n)``, so the products are one join and one sum.
    """

    def sparse(rows: DataFrame, text: str, *key: str) -> DataFrame:
        place = F.pmod(F.crc32(F.encode("w", "utf-8")), F.lit(size)).alias("place")
        c = rows.select(*key, F.explode(tokens(F.col(text))).alias("w")).groupBy(*key, place).agg(F.count("*").alias("n"))
        norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(*key)))
        return c.select(*key, "place", (F.col("n") / norm).alias("v"))

    q = sparse(queries, "question", "question_id", "doc_id").withColumnRenamed("v", "qv")
    p = sparse(pages, "text", "doc_id", "page")
    return q.join(p, ["doc_id", "place"]).groupBy("question_id", "doc_id", "page").agg(F.round(F.sum(F.col("qv") * F.col("v")), 9).alias("score"))
