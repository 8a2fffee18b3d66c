"""Oversized texts cut at natural boundaries, with overlap, by pointer doubling.

Every word of a text is a boundary. Its successor is the start of the next piece if a piece started
there: the farthest legal end (the size limit, drawn back to the last sentence end among the closing
words if there is one) less the overlap. All successors of all texts of a batch are one array; squaring
it (``next = next[next]``) while marking what is reached from the first words gives every cut of every
text in as many rounds as the logarithm of the longest text's pieces, never piece by piece.

A word is a run without white space; a sentence ends at a word that ends in ``.``, ``!`` or ``?``, with
closing quotes or brackets after it or not.

Defined results: a null text is an empty one; a text without words gives one empty piece when cut, and no
finding when checked; rows with a null key are ignored; rows delivered twice count once; of several texts
of one page the first in string order counts; pieces of pages that are not in the page table are not
judged; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import ship

#: Closing words of a piece in which a sentence end is looked for.
CLOSING = 25
_CLOSERS = "\"'»”’)]}"
_LAST = frozenset(_CLOSERS + ".!?")


def ends_sentence(word: str) -> bool:
    return word[-1] in _LAST and word.rstrip(_CLOSERS)[-1:] in (".", "!", "?")


def cuts(texts: list[list[str]], size: int, overlap: int, closing: int = CLOSING) -> list[list[tuple[int, int]]]:
    """Pieces of each text as ``(first word, end)``; a text within the size is one piece."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    closing = max(1, min(closing, size - overlap - 1))
    count = np.fromiter(map(len, texts), np.int64, len(texts))
    last = np.cumsum(count)
    first = last - count
    total = int(last[-1]) if len(texts) else 0
    if not total:
        return [[(0, 0)] for _ in texts]
    end = np.fromiter(map(ends_sentence, chain.from_iterable(texts)), bool, total)
    # latest sentence end at or before each position, as a position after a word
    latest = np.zeros(total + 1, np.int64)
    latest[1:] = np.maximum.accumulate(np.where(end, np.arange(1, total + 1), 0))
    at = np.arange(total)
    stop = np.repeat(last, count)
    far = np.minimum(at + size, stop)
    natural = latest[far]
    until = np.where((far < stop) & (natural > far - closing), natural, far)
    nothing = total
    step = np.append(np.where(until < stop, until - overlap, nothing), nothing)
    reached = np.zeros(total + 1, bool)
    reached[first[count > 0]] = True
    while True:
        reached[step[np.flatnonzero(reached)]] = True
        step = step[step]
        if (step == nothing).all():
            break
    starts = np.flatnonzero(reached[:total])
    of = np.searchsorted(last, starts, side="right")
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for k, s, e in zip(of.tolist(), (starts - first[of]).tolist(), (until[starts] - first[of]).tolist()):
        out[k].append((s, e))
    return [x or [(0, 0)] for x in out]


def _limit(limits: DataFrame, name: str) -> tuple[int, int]:
    row = limits.filter(F.col("limit_name") == name).select("max_size", "overlap").head()
    if row is None:
        raise ValueError(f"no limit is named {name}")
    return int(row[0]), int(row[1] or 0)


def cut_pages(pages: DataFrame, limits: DataFrame, name: str = "dense_chunk") -> DataFrame:
    """``doc_id, page, chunk_index, text``: the pieces of each page, chunk_index from 0."""
    size, overlap = _limit(limits, name)
    ship(pages.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, nums, texts = (c.to_pylist() for c in batch.columns)
            out: tuple[list, list, list, list] = ([], [], [], [])
            for lo in range(0, len(texts), 500):
                spans = [[m.span() for m in re.finditer(r"\S+", t or "")] for t in texts[lo : lo + 500]]
                found = cuts([[t[a:b] for a, b in s] for t, s in zip(texts[lo : lo + 500], spans)], size, overlap)
                for k, pieces in enumerate(found):
                    for n, (s, e) in enumerate(pieces):
                        out[0].append(docs[lo + k])
                        out[1].append(nums[lo + k])
                        out[2].append(n)
                        out[3].append(texts[lo + k][spans[k][s][0] : spans[k][e - 1][1]] if e > s else "")
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], names=["doc_id", "page", "chunk_index", "text"])

    rows = pages.filter("doc_id is not null and page is not null").groupBy("doc_id", "page").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.mapInArrow(cut, "doc_id string, page int, chunk_index int, text string")


class _Judge:
    """Judges the stored pieces of one page after the other; holds one page and one piece."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, overlap
        self.key, self.words, self.flat, self.pieces = None, [], " ", []
        self.pending, self.before, self.order, self.sound = None, None, 0, True
        self.found: list[tuple] = []

    def page(self, key, words: list[str], pieces) -> None:
        self.close()
        self.key, self.words, self.flat, self.pieces = key, words, f" {' '.join(words)} ", pieces
        self.before, self.order, self.sound = None, 0, True

    def piece(self, key, index: int, text: str) -> None:
        if key != self.key:
            self.close()
            self.key, self.words = key, []
        if not self.words or self.pending == (index, text):
            return
        if self.pending:
            self._judge(False)
        self.pending = (index, text)

    def close(self) -> None:
        if self.pending:
            self._judge(True)
        self.pending = None

    def _judge(self, last: bool) -> None:
        index, text = self.pending
        own = text.split()
        if self.order < len(self.pieces):
            s, e = self.pieces[self.order]
            same = own == self.words[s:e] and last == (self.order == len(self.pieces) - 1)
        else:
            same = False
        # a piece as the operator cuts it, after one like that, is right; others are checked by the rules
        if not (same and self.sound) and self._wrong(own, last):
            self.found.append((*self.key, index))
        self.sound = same
        self.before = own
        self.order += 1

    def _wrong(self, own: list[str], last: bool) -> bool:
        flat = f" {' '.join(own)} "
        if not own or len(own) > self.size or flat not in self.flat:
            return True
        if self.before is None and not self.flat.startswith(flat):
            return True
        if last and not self.flat.endswith(flat):
            return True
        if self.before is not None and self.overlap and own[: self.overlap] != self.before[-self.overlap :]:
            return True
        return not last and not ends_sentence(own[-1]) and any(map(ends_sentence, own[-CLOSING:]))


def wrong_pieces(pages: DataFrame, chunks: DataFrame, limits: DataFrame, name: str = "dense_chunk") -> DataFrame:
    """``doc_id, page, chunk_index``: stored pieces that break the rules of the cutter."""
    size, overlap = _limit(limits, name)
    ship(pages.sparkSession)
    keyed = "doc_id is not null and page is not null"
    a = pages.filter(keyed).select("doc_id", "page", F.lit(-1).alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    b = chunks.filter(keyed).filter("chunk_index is not null").select("doc_id", "page", F.col("chunk_index").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    rows = a.unionByName(b).repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "n", "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = _Judge(size, overlap), None
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                docs, nums, order, texts = (c.to_pylist() for c in batch.slice(lo, 2000).columns)
                own = [k for k, n in enumerate(order) if n == -1]
                split = [texts[k].split() for k in own]
                cut = dict(zip(own, zip(split, cuts(split, size, overlap))))
                for k, key in enumerate(zip(docs, nums)):
                    if order[k] == -1:
                        if key != at:
                            at = key
                            state.page(key, *cut[k])
                    else:
                        state.piece(key, order[k], texts[k])
            yield _rows(state)
        state.close()
        yield _rows(state)

    return rows.mapInArrow(judge, "doc_id string, page int, chunk_index int").distinct()


def _rows(state: _Judge) -> pa.RecordBatch:
    got, state.found = state.found, []
    return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], names=["doc_id", "page", "chunk_index"])
