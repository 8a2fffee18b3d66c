"""Evaluation texts that turn up, whole or in part, inside corpus documents.

Greedy string tiling. Runs of ``SEED`` words that an item and a document share (codes of a Karp-Rabin
window over the words) give the pairs worth tiling; the tiles of a pair are its longest matches that do
not overlap, found by Karp-Rabin windows of falling length and marked longest first, wherever they stand,
so reordered passages count towards an item's coverage too. Coverage is the threshold; a stretch is then
checked exactly on the alignment around the tiles.

The items travel to the tasks as arrays of word codes, in blocks of at most ``BLOCK_WORDS`` words, so what
is sent at once is bounded; documents are read where they are and never shuffled. A document is a single
row, so a worker holds one round of texts at a time.

Defined results: null and empty texts hold nothing; items without a word are never found; a null id is
ignored; repeated rows count once; an item shorter than the stretch must be there whole; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.textcodes import prepared, rounds, windows, words
from pagemill.session import ship

#: Words of a seed. A stretch of 24 words with two errors keeps a run of 7 words, a shorter item with one error 5.
SEED = 5
STRETCH, PER_ERROR = 24, 12
#: Words of evaluation items sent to the tasks at once.
BLOCK_WORDS = 2_000_000


def tiles(a: np.ndarray, b: np.ndarray, least: int = 3) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two code arrays: ``(start in a, start in b, length)`` of the tiles, longest first marked."""
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(48, len(a), len(b)))
    while True:
        wa, wb = windows(a, size), windows(b, size)
        if len(wa) and len(wb):
            order = np.argsort(wa, kind="stable")
            at = np.searchsorted(wa[order], wb)
            at[at == len(wa)] = 0
            where: list[tuple[int, int, int]] = []
            seen = set()
            for j in np.flatnonzero(wa[order][at] == wb):
                k = at[j]
                while k < len(order) and wa[order[k]] == wb[j]:
                    i = int(order[k])
                    k += 1
                    if not (free_a[i : i + size].all() and free_b[j : j + size].all()):
                        continue
                    s, t = i, int(j)
                    while s and t and free_a[s - 1] and free_b[t - 1] and a[s - 1] == b[t - 1]:
                        s, t = s - 1, t - 1
                    if (s, t) in seen:
                        continue
                    seen.add((s, t))
                    e = i + size
                    while e < len(a) and t + e - s < len(b) and free_a[e] and free_b[t + e - s] and a[e] == b[t + e - s]:
                        e += 1
                    where.append((e - s, s, t))
            again = False
            for n, s, t in sorted(where, key=lambda x: (-x[0], x[1], x[2])):
                if free_a[s : s + n].all() and free_b[t : t + n].all():
                    free_a[s : s + n] = free_b[t : t + n] = False
                    out.append((s, t, n))
                else:
                    again = True
            if again:  # what is left of an overlapped match may still be long enough
                continue
        if size == least:
            return sorted(out)
        size = max(least, size // 2)


def stretch(item: np.ndarray, doc: np.ndarray, found: list[tuple[int, int, int]]) -> bool:
    """Whether a stretch of the item is in the document with at most one error in ``PER_ERROR`` words."""
    n = len(item)
    need = min(STRETCH, n)

    def enough(lo: int, hi: int, errors: int) -> bool:
        more = max(0, need - (hi - lo))  # words beside the aligned part count as errors
        return hi - lo + more <= n and (errors + more) * PER_ERROR <= hi - lo + more

    for k, (s, t, m) in enumerate(found):
        lo, hi, at, errors = s, s + m, t + m, 0
        if enough(lo, hi, 0):
            return True
        for s2, t2, m2 in found[k + 1 :]:
            if s2 >= hi and 0 <= t2 - at <= 8 and s2 - hi <= 8:
                errors += max(s2 - hi, t2 - at)
                hi, at = s2 + m2, t2 + m2
                if enough(lo, hi, errors):
                    return True
    # exact alignment around each tile, for errors that stand too close for tiles
    for s, t, _ in found:
        lo, hi = max(0, t - s - 6), min(len(doc), t + (n - s) + 6)
        if _aligned(item, doc[lo:hi], need):
            return True
    return False


def _aligned(item: np.ndarray, part: np.ndarray, need: int) -> bool:
    """Aligns the item with a part of a document and looks for a stretch with few errors."""
    n, m = len(item), len(part)
    same = item[:, None] == part[None, :]
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[1:, 0] = np.arange(1, n + 1)
    ramp = np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.empty(m + 1, np.int32)
        row[0] = i
        row[1:] = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + ~same[i - 1])
        cost[i] = np.minimum.accumulate(row - ramp) + ramp
    i, j = n, int(np.argmin(cost[n]))
    errors = np.zeros(n + 1, np.int64)  # errors charged to each word of the item
    while i > 0:
        if j > 0 and cost[i, j] == cost[i - 1, j - 1] + (not same[i - 1, j - 1]):
            errors[i] += not same[i - 1, j - 1]
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + 1:
            errors[i] += 1
            i -= 1
        else:
            errors[i] += 1
            j -= 1
    total = np.cumsum(errors)
    for lo in range(n - need + 1):
        spans = np.arange(lo + need, n + 1)
        if ((total[spans] - total[lo]) * PER_ERROR <= spans - lo).any():
            return True
    return False


class _Items:
    """A block of items with the codes of their seeds."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = words([prepared(t) for t in texts])
        self.ids = ids
        self.codes = [w.code[w.first[k] : w.first[k + 1]] for k in range(len(ids))]
        length = np.array([len(c) for c in self.codes], np.int64)
        need = np.minimum(STRETCH, length)
        #: Seeds that are left when every allowed error breaks as many as it can.
        self.least = np.maximum(1, need - SEED + 1 - SEED * (need // PER_ERROR))
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(SEED, len(c)) for c in self.codes if len(c)}):
            parts = [(windows(c, size), k) for k, c in enumerate(self.codes) if len(c) and min(SEED, len(c)) == size]
            code = np.concatenate([p[0] for p in parts])
            of = np.concatenate([np.full(len(p[0]), p[1], np.int64) for p in parts])
            at = np.concatenate([np.arange(len(p[0])) for p in parts])
            order = np.argsort(code, kind="stable")
            self.sizes[size] = code[order], of[order], at[order]

    def hits(self, w) -> list[tuple[int, int]]:
        """Pairs of text and item that share as many seeds as a stretch leaves at least."""
        out: list[tuple[int, int]] = []
        for size, (seeds, of, at) in self.sizes.items():
            win = windows(w.code, size)
            if not len(win):
                continue
            flags = np.zeros(1 << 20, bool)
            flags[seeds >> np.uint64(44)] = True
            near = np.flatnonzero(flags[win >> np.uint64(44)])
            near = near[w.text[near] == w.text[near + size - 1]]
            lo, hi = np.searchsorted(seeds, win[near], "left"), np.searchsorted(seeds, win[near], "right")
            many = hi - lo
            text = np.repeat(w.text[near], many)
            k = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            # a stretch with few errors stays near one diagonal: bands of 16 words, each overlapping the next by half
            band = (np.repeat(near - w.first[w.text[near]], many) - at[k]) >> 3
            band = np.concatenate([band, band + 1]) + (1 << 31)
            text, item, place = (np.concatenate([x, x]) for x in (text, of[k], at[k]))
            _, of_pair, times = np.unique(text * len(self.ids) + item, return_inverse=True, return_counts=True)  # only pairs that meet
            enough = times[of_pair] >= 2 * self.least[item]
            text, item, place, band = text[enough], item[enough], place[enough], band[enough]
            order = np.lexsort((place, band, item, text))
            text, item, place, band = text[order], item[order], place[order], band[order]
            if not len(text):
                continue
            group = np.ones(len(text), bool)
            group[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
            fresh = group.copy()
            fresh[1:] |= place[1:] != place[:-1]
            starts = np.flatnonzero(group)
            count = np.add.reduceat(fresh.astype(np.int64), starts)
            good = starts[count >= self.least[item[starts]]]
            out += zip(text[good].tolist(), item[good].tolist())
        return sorted(set(out))


def leaked(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, doc_id, covered``: documents that hold a stretch of an item; covered is the tiled share of the item."""
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rows = items.filter(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("bigint").alias("i"), F.col(text).alias("t")).distinct().orderBy("i", "t")
    blocks: list[tuple[list[int], list[str]]] = [([], [])]
    size = 0
    for r in rows.toLocalIterator():
        n = len(r["t"]) // 2 + 1
        if size + n > BLOCK_WORDS and blocks[-1][0]:
            blocks.append(([], []))
            size = 0
        size += n
        blocks[-1][0].append(r["i"])
        blocks[-1][1].append(r["t"])
    small = docs.filter(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).cast("bigint").alias("d"), F.col(text).alias("t"))
    out = None
    for ids, texts in blocks:
        sent = sc.broadcast((ids, texts))

        def found(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = _Items(*sent.value)
            for batch in batches:
                keys, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                got: list[tuple[int, int, float]] = []
                for lo, hi in rounds(all_texts):
                    w = words([prepared(x) for x in all_texts[lo:hi]])
                    for k, n in block.hits(w):
                        a, b = block.codes[n], w.code[w.first[k] : w.first[k + 1]]
                        need = min(STRETCH, len(a))
                        tiled = tiles(a, b, min(3, len(a)))
                        covered = sum(x[2] for x in tiled)
                        if covered >= need - 3 * (need // PER_ERROR) - 2 and stretch(a, b, tiled):
                            got.append((block.ids[n], keys[lo + k], covered / len(a)))
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())], names=["item_id", "doc_id", "covered"])

        part = small.mapInArrow(found, "item_id bigint, doc_id bigint, covered double")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("item_id", "doc_id").agg(F.max("covered").alias("covered"))
