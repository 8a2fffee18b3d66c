"""Same or nearly same records on both sides of a split.

Copies with the same words are one class; classes are compared once and expanded at the end. What may match is
verified on the words in order.

Candidates are complete. Questions must have the same numbers, then, as for pages, the lengths must allow the share of
words. All pairs within the numbers and the range of lengths are compared, block against block: a block of training
records has a map of bits over its records for each word, and a text adds up the maps of its rarer words for all
records at once (``Maps``). A record without enough of these cannot have the share of all words; what is left has its
bags of words compared. Both lose no pair. Pages are made of the same frequent words and phrases, so a filter
that loses no pair at 70 percent of the words and joins on words or short runs meets more often than there are pairs
(README); the comparison of all pairs is the cheaper one, but grows with the product of the two sides.

*Chosen paths* (``chosen_paths``) select pairs in less than that, but lose some; ``candidates`` uses neither them nor
``_parities`` and ``_bags``.

Defined results: null and empty texts match nothing; rows with a null key or an unknown split are ignored;
rows delivered twice count once; a key on both sides is not paired with itself; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.textcodes import mix, prepared, rounds, words
from pagemill.operators.storage import discard, stored
from pagemill.session import ship

TRAINING, EVALUATION = ("development_tune",), ("development_calibration", "locked_test")
#: Hashed places for the counts of words; a fixed size, as the counts travel to the tasks.
SLOTS = 1 << 18
#: Paths that a text opens, words that continue each word of a path, and the positions in which those are looked for.
ANCHORS, BRANCH, GAP, WINDOW = 25.0, 1.2, 5, 8
#: A path ends when its expected number of chance occurrences is below two to this power, or at this many words.
RARITY, DEPTH = -3.0, 6
#: Bits of a code; codes that meet by chance only add candidates.
CODE = np.uint64((1 << 40) - 1)
#: Share of their paths that pairs at the threshold have in common, rounded down to whole paths; one at least.
SHARED = 0.1
#: Setting for the rows that a Python worker gets at once.
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Records and bytes of words of a block of each side (training is the side with maps), and pairs of blocks that a task gets at once.
BLOCK, BLOCK_BYTES, HELD = {True: 1 << 14, False: 1 << 12}, {True: 3 << 22, False: 1 << 22}, 1
#: Maps of a block, those among them that rare words share, texts that add up maps together, and records below which no maps are added up.
MAPS, SHARED_MAPS, TOGETHER, SMALL = 1 << 13, 1 << 10, 12, 256
#: A text adds up maps until a record needs this many times the words expected by chance, and this many more. Any values lose no pair.
CLEAR, BEYOND = 1.5, 24
_BROKEN = re.compile(r"[-¬­‐][ \t]*\n\s*")
_GROUPED = re.compile(r"(\d)(?<!\d{4})[,.'\u2019\u0020\u00a0\u202f\u2009](?=\d{3}(?!\d))")
_NUMBER = re.compile(r"\d+")


def _ungrouped(text: str) -> str:
    """The text with its grouped numbers written without separators."""
    return _GROUPED.sub(r"\1", text)


def _page_text(text: str | None) -> str:
    return _ungrouped(_BROKEN.sub("", prepared(text)))


def _question_text(text: str | None) -> str:
    return _ungrouped(prepared(text))


def recurring(a: list[int], b: list[int], need: float = 0) -> int:
    """Words of ``a`` that recur in ``b`` in the same order (length of the longest common subsequence); -1 once ``need`` is out of reach."""
    where: dict[int, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    met = [m for m in map(where.get, b) if m]
    for lo in range(0, len(met), 24):
        if len(a) - v.bit_count() + len(met) - lo < need:
            return -1
        for m in met[lo : lo + 24]:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _slot(code: np.ndarray) -> np.ndarray:
    return (code & np.uint64(SLOTS - 1)).astype(np.int64)


class Counts:
    """Occurrences of each hashed word, words and texts of the whole table."""

    def __init__(self, slots: np.ndarray, texts: int):
        self.slots, self.texts, self.words = slots, max(1, texts), max(1, int(slots.sum()))

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Information of each word; a word that occurs once matches nothing and has none."""
        n = self.slots[_slot(code)]
        return np.where(n > 1, np.log2(self.words / np.maximum(n, 1)), 0.0)


def _text_ids(w) -> np.ndarray:
    """One code for the words of each text in order."""
    spread = mix(w.code + mix(np.arange(len(w.code), dtype=np.uint64) - w.first[w.text].astype(np.uint64)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
    return mix(total[w.first[1:]] - total[w.first[:-1]] + np.diff(w.first).astype(np.uint64))


def _chance(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


def chosen_paths(code: np.ndarray, first: np.ndarray, bits: np.ndarray, counts: Counts, start: np.ndarray | None = None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the chosen paths of each text and the texts they are of, by text and each once.

    Texts are circles: a path that reaches the end goes on at the beginning. start: a code that the paths of a text
    begin with, known: its information; a text whose start is rare enough has that code alone.
    """
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    mean = np.maximum(np.bincount(of, bits, minlength=len(n)) / np.maximum(n, 1), 1.0)
    start = np.full(len(n), 5, np.uint64) if start is None else start
    need = np.full(len(n), np.log2(counts.texts) - RARITY) - (0 if known is None else known)
    alone = np.flatnonzero(need <= 0)
    codes, texts = [start[alone]], [alone]
    # one word repeated has no order: its code is the word with the length in steps, neighbours included
    main = np.lexsort((code, of))
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[main][1:] != code[main][:-1]) | (of[main][1:] != of[main][:-1])
    at = np.flatnonzero(fresh)
    often = np.diff(np.append(at, len(code)))
    most = main[at[often >= np.maximum(2, 0.4 * n[of[main[at]]])]] if len(code) else main
    step = np.floor(np.log(np.maximum(n[of[most]], 1)) / -np.log(0.7)).astype(np.uint64)
    for k in (0, 1):
        codes.append(mix(mix(code[most] ^ start[of[most]]) + step + np.uint64(k)))
        texts.append(of[most])
    pos = np.flatnonzero((_chance(mix(code ^ mix(start)[of])) < ANCHORS * bits / (mean * np.maximum(n, 1))[of]) & (need[of] > 0))
    path, left, gone = mix(code[pos] + start[of[pos]]), need[of[pos]] + np.log2(counts.words / counts.texts) - bits[pos], np.zeros(len(pos), np.int64)
    ahead = np.arange(GAP, GAP + WINDOW)
    for depth in range(1, DEPTH + 1):
        done = (left <= 0) | (depth == DEPTH)
        codes.append(path[done])
        texts.append(of[pos[done]])
        pos, path, left, gone = pos[~done], path[~done], left[~done], gone[~done]
        if not len(pos):
            break
        size, begin = n[of[pos]], first[of[pos]]
        i, j = np.nonzero(gone[:, None] + ahead[None, :] < size[:, None])
        at = begin[i] + (pos[i] - begin[i] + ahead[j]) % size[i]
        h = (path[i] ^ code[at]) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        keep = _chance(h) < BRANCH * bits[at] / (mean[of[at]] * WINDOW) * np.maximum(1.0, (WINDOW + GAP) / size[i])
        i, j, at = i[keep], j[keep], at[keep]
        pos, path, left, gone = at, mix(h[keep]), left[i] - np.maximum(bits[at] - np.log2(WINDOW), 1.0), gone[i] + ahead[j]
    c, t = np.concatenate(codes) & CODE, np.concatenate(texts)
    order = np.lexsort((c, t))
    c, t = c[order], t[order]
    fresh = np.ones(len(c), bool)
    fresh[1:] = (c[1:] != c[:-1]) | (t[1:] != t[:-1])
    return c[fresh], t[fresh]


_SKETCH = "id bigint, same bigint, n int, nums bigint, words binary"


#: Counts that four bits can hold.
STEPS = np.array([*range(9), 10, 12, 16, 24, 32, 64, 1 << 20], np.int32)


def _bags(code: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Counts of hashed words of each text, four bits each, in half again as many places as words at least (a power of two).

    The second half of the places is in the high bits, so their sum folds a bag to half its size. Counts above eight
    are rounded up to the next of ``STEPS``.
    """
    n = np.diff(first)
    size = 1 << np.ceil(np.log2(np.maximum(1.5 * n, 16))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(len(n)), n)
    count = np.bincount(begin[of] + ((code >> np.uint64(24)).astype(np.int64) & (size[of] - 1)), minlength=begin[-1])
    count = np.searchsorted(STEPS, np.minimum(count, STEPS[-1])).astype(np.uint8)
    return [(count[b : b + s // 2] | count[b + s // 2 : b + s] << 4).tobytes() for b, s in zip(begin.tolist(), size.tolist())]


def _parities(code: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Parities of the counts of hashed words of each text, a bit each, in three times as many places as words at least (a power of two)."""
    n = np.diff(first)
    size = 1 << np.ceil(np.log2(np.maximum(3 * n, 64))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(len(n)), n)
    count = np.bincount(begin[of] + ((code & np.uint64(0xFFFFFFFF)).astype(np.int64) & (size[of] - 1)), minlength=begin[-1])
    packed = np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[b // 8 : (b + s) // 8] for b, s in zip(begin.tolist(), size.tolist())]


def alike(a: list[bytes], b: list[bytes], most: np.ndarray) -> np.ndarray:
    """Whether two texts may have ``most`` words in common; never false where they have."""
    out = np.ones(len(a), bool)
    size = np.array([[len(x) for x in a], [len(x) for x in b]])
    for s, t in set(zip(*size.tolist())):
        at = np.flatnonzero((size[0] == s) & (size[1] == t))
        x, y = (np.frombuffer(b"".join([z[k] for k in at]), np.uint8).reshape(len(at), -1) for z in (a, b))
        halves = [(STEPS[z & 15], STEPS[z >> 4]) for z in (x, y)]
        while s != t:  # fold the larger one
            k = int(t > s)
            low, high = halves[k]
            both = low + high
            halves[k] = (both[:, : both.shape[1] // 2], both[:, both.shape[1] // 2 :])
            s, t = (s, t // 2) if k else (s // 2, t)
        shared = sum(np.minimum(p, q).sum(1, dtype=np.int64) for p, q in zip(*halves))
        out[at] = shared >= most[at]
    return out


def _batch(ids, nums, n, w) -> pa.RecordBatch:
    """Sketches of the texts that have words."""
    keep = np.flatnonzero(n > 0)
    same, short, ends = _text_ids(w), (w.code >> np.uint64(32)).astype(np.uint32), w.first.tolist()
    signed = lambda x: pa.array(x[keep].view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in keep], pa.int64()), signed(same), pa.array(n[keep].astype(np.int32)), signed(nums), pa.array([short[ends[k] : ends[k + 1]].tobytes() for k in keep], pa.binary())], names=["id", "same", "n", "nums", "words"])


def page_sketches(pages: DataFrame, least: int) -> DataFrame:
    """Sketches of pages ``(id, text)`` with at least ``least`` words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for lo, hi in rounds(texts):
                w = words([_page_text(t) for t in texts[lo:hi]])
                n = np.diff(w.first)
                yield _batch(ids[lo:hi], np.zeros(hi - lo, np.uint64), np.where(n >= least, n, 0), w)

    return pages.select("id", "text").mapInArrow(sketch, _SKETCH)


def numbers(text: str) -> tuple[int, ...]:
    """The numbers of a text however grouped, in order of size."""
    return tuple(sorted(int(x) for x in _NUMBER.findall(_ungrouped(text))))


def _number_code(found: tuple[int, ...]) -> np.uint64:
    h = np.array([len(found) + 7], np.uint64)
    for x in found:
        h = mix((h ^ np.uint64(x & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15))
    return h[0]


def question_sketches(questions: DataFrame) -> DataFrame:
    """Sketches of questions ``(id, text)``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for lo, hi in rounds(texts):
                own = [_question_text(t) for t in texts[lo:hi]]
                w = words(own)
                yield _batch(ids[lo:hi], np.array([_number_code(numbers(t)) for t in own], np.uint64), np.diff(w.first), w)

    return questions.select("id", "text").mapInArrow(sketch, _SKETCH)


def _numbered(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16-bit codes of the words of each text, in any order, each with how often it was there before."""
    c = np.sort(np.repeat(np.arange(len(first) - 1, dtype=np.uint64) << np.uint64(32), np.diff(first)) | code)
    fresh = np.ones(len(c), bool)
    fresh[1:] = c[1:] != c[:-1]
    at = np.flatnonzero(fresh)
    nth = np.arange(len(c)) - np.repeat(at, np.diff(np.append(at, len(c))))
    return (mix((c & np.uint64(0xFFFFFFFF)) + (nth.astype(np.uint64) << np.uint64(32))) >> np.uint64(48)).astype(np.uint16)


def _blocks(one: DataFrame, train: bool, records: int) -> DataFrame:
    """The records of one side, each once, in blocks by numbers and length, with the ranges of these; records: how many there are."""
    kinds = {"low": pa.int64(), "high": pa.int64(), "least": pa.int32(), "most": pa.int32()} | {k: pa.binary() for k in ("ids", "ns", "nums", "words", "marks")}
    most, most_bytes = BLOCK[train], BLOCK_BYTES[train]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids, n, nums, own = zip(*held)
            flat = lambda x, t: np.array(x, t).tobytes()
            # some records at a time, as their numbering takes many times their size
            marks = [_numbered(np.frombuffer(b"".join(own[k : k + 2048]), np.uint32), np.concatenate([[0], np.cumsum(n[k : k + 2048])])).tobytes() for k in range(0, len(n), 2048)]
            row = {"low": nums[0], "high": nums[-1], "least": min(n), "most": max(n), "ids": flat(ids, np.int64), "ns": flat(n, np.int32), "nums": flat(nums, np.int64), "words": b"".join(own), "marks": b"".join(marks)}
            return pa.RecordBatch.from_pylist([row], pa.schema(list(kinds.items())))

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and r[0] == held[-1][0]:
                    continue
                if held and (len(held) == most or size > most_bytes):
                    yield block()
                    held, size = [], 0
                held.append(r)
                size += len(r[3])
        if held:
            yield block()

    order = ("nums", "n", "id")
    # maps pay in large blocks; the other side has several ranges for each task, so that tasks get blocks of many lengths
    ranges = -(-records // most) if train else max(-(-records // most), one.sparkSession.sparkContext.defaultParallelism)
    own = one.select("id", "n", "nums", "words").repartitionByRange(max(1, ranges), *order).sortWithinPartitions(*order)
    return own.mapInArrow(pack, "low bigint, high bigint, least int, most int, ids binary, ns binary, nums binary, words binary, marks binary")


class Block:
    """The arrays of a block: ids, lengths, numbers, words and numbered words with the first of each record."""

    def __init__(self, row: dict):
        self.ids, self.n, self.nums = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ns"], np.int32), np.frombuffer(row["nums"], np.int64)
        self.words, self.marks = np.frombuffer(row["words"], np.uint32), np.frombuffer(row["marks"], np.uint16)
        self.first = np.concatenate([[0], np.cumsum(self.n, dtype=np.int64)])

    @cached_property
    def maps(self) -> Maps:
        return Maps(self)


class Maps:
    """A map of bits over the records of a block for each numbered word.

    Frequent words have their own maps, others share some, so a record may seem to have a word that it has not, never
    the reverse.
    """

    def __init__(self, block: Block):
        often = np.bincount(block.marks, minlength=1 << 16)
        order = np.argsort(-often, kind="stable")
        self.row = np.empty(1 << 16, np.int32)
        own = MAPS - SHARED_MAPS
        self.row[order[:own]] = np.arange(own)
        self.row[order[own:]] = own + np.arange(len(order) - own) % SHARED_MAPS
        self.row[often == 0] = -1
        width = -(-len(block.n) // 64)
        # two more maps: no record and all records
        bits = np.zeros((MAPS + 2, width * 8), np.uint8)
        bits[-1] = 255
        at = self.row[block.marks].astype(np.int64)
        at *= width * 64
        at += np.repeat(np.arange(len(block.n), dtype=np.int32), block.n)
        at.sort()
        step = 512
        for k, (f, t) in enumerate(zip(*(at.searchsorted(np.arange(d, MAPS + d, step) * (width * 64)) for d in (0, step)))):
            part = np.zeros(step * width * 64, bool)
            part[at[f:t] - k * len(part)] = True
            bits[k * step : (k + 1) * step] = np.packbits(part, bitorder="little").reshape(step, -1)
        self.bits = bits.view(np.uint64)
        self.share = np.bitwise_count(self.bits).sum(1) / max(1, len(block.n))

    def passing(self, texts: list[np.ndarray], least: list[int], begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """``text, record``: the records from ``begin`` to ``end`` that may have ``least`` numbered words of a text."""
        chosen: list[tuple[int, np.ndarray, int]] = []
        for k, (marks, m) in enumerate(zip(texts, least)):
            rows = self.row[marks]
            rows = np.sort(rows[rows >= 0])[::-1]  # rarer words first
            spare = len(rows) - m
            if spare < 0:
                continue
            clear = np.flatnonzero(np.arange(1 - spare, m + 1) >= CLEAR * self.share[rows].cumsum() + BEYOND)
            chosen.append((k, rows[: clear[0] + 1] if len(clear) else rows, spare))
        if not chosen:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # one number of words for all: a text that needs fewer also adds the map of all records
        need = max(len(rows) - spare for _, rows, spare in chosen)
        table = np.full((need + max(spare for _, _, spare in chosen), len(chosen)), MAPS)
        for j, (_, rows, spare) in enumerate(chosen):
            table[: len(rows), j] = rows
            table[len(rows) : need + spare, j] = MAPS + 1
        word = begin // 64
        hit = at_least(sums(self.bits[table, word : -(-end // 64)]), need)
        j, at = np.nonzero(hit)
        i, bit = np.nonzero(np.unpackbits(hit[j, at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return np.array([k for k, _, _ in chosen])[j[i]], 64 * (word + at[i]) + bit


def sums(maps: np.ndarray) -> list[np.ndarray]:
    """How many of the maps have each bit, as maps of the digits of this number, the lowest first."""
    out = []
    while len(maps):
        carry = []
        while len(maps) > 2:
            k = len(maps) // 3
            x, y, z = maps[:k], maps[k : 2 * k], maps[2 * k : 3 * k]
            odd = x ^ y
            both = x & y
            digit = odd ^ z
            odd &= z
            odd |= both
            carry.append(odd)
            maps = np.concatenate([digit, maps[3 * k :]])
        if len(maps) == 2:
            carry.append(maps[:1] & maps[1:])
            maps = maps[:1] ^ maps[1:]
        out.append(maps[0])
        maps = np.concatenate(carry) if carry else maps[:0]
    return out


def at_least(digits: list[np.ndarray], m: int) -> np.ndarray:
    """The map of the bits that are in ``m`` maps at least; digits as from ``sums``."""
    if m <= 0:
        return ~np.zeros_like(digits[0])
    if (m - 1) >> len(digits):
        return np.zeros_like(digits[0])
    out = np.zeros_like(digits[0])
    for k, digit in enumerate(digits):
        if (m - 1) >> k & 1:
            out &= digit
        else:
            out |= digit
    return out


def near(a: Block, b: Block, share: float) -> Iterator[tuple[int, np.ndarray]]:
    """Places in two blocks of the pairs whose numbers, lengths and words in any order allow the share of words in order.

    Never without a pair that has it.
    """
    begin, end = np.searchsorted(b.nums, a.nums), np.searchsorted(b.nums, a.nums, "right")
    low, high = np.ceil(share * a.n - 1e-6).astype(np.int32), np.floor(a.n / share + 1e-6).astype(np.int32)
    need = np.ceil(share * b.n - 1e-6).astype(np.int32)
    known = np.zeros((TOGETHER, 1 << 16), bool)

    def found(held: list[tuple[int, int, int]]) -> Iterator[tuple[int, np.ndarray]]:
        own = [a.marks[a.first[k] : a.first[k + 1]] for k, _, _ in held]
        ks, f, t = np.array(held).T
        if (t - f).max() < SMALL:
            of = np.repeat(np.arange(len(held)), t - f)
            at = np.arange(len(of)) - np.repeat(np.cumsum(t - f) - t, t - f)
        else:
            # the shortest record in the range needs the fewest words
            of, at = b.maps.passing(own, np.maximum(low[ks], need[f]).tolist(), int(f.min()), int(t.max()))
            fits = (at >= f[of]) & (at < t[of])
            of, at = of[fits], at[fits]
        if not len(of):
            return
        for k, x in enumerate(own):
            known[k, x] = True
        good = []
        for lo in range(0, len(of), 4096):
            o, j = of[lo : lo + 4096], at[lo : lo + 4096]
            size = b.n[j]
            begins = np.cumsum(size) - size
            met = known.ravel()[b.marks[np.repeat(b.first[j] - begins, size) + np.arange(size.sum())] + np.repeat(o << 16, size)]
            good.append(np.add.reduceat(met, begins, dtype=np.int32) >= np.maximum(need[j], low[ks[o]]))
        for k, x in enumerate(own):
            known[k, x] = False
        hits = np.concatenate(good)
        of, at = of[hits], at[hits]
        for k in np.unique(of).tolist():
            yield int(ks[k]), at[of == k]

    held: list[tuple[int, int, int]] = []
    for k in np.flatnonzero(begin < end).tolist():
        f, t = begin[k], end[k]
        lengths = b.n[f:t]  # ascending
        f, t = f + lengths.searchsorted(low[k]), f + lengths.searchsorted(high[k], "right")
        if f >= t:
            continue
        if held and (len(held) == TOGETHER or a.nums[k] != a.nums[held[0][0]] or a.n[k] > 1.1 * a.n[held[0][0]] + 1):
            yield from found(held)
            held = []
        held.append((k, f, t))
    if held:
        yield from found(held)


def candidates(one: DataFrame, share: float, records: dict[bool, int]) -> DataFrame:
    """``a, b``: the training and evaluation records that match; one: records of each class and side, ``_SKETCH`` with ``train``.

    Every pair of the same numbers whose lengths allow it is compared. records: how many there are on each side.
    """
    blocks = [stored(_blocks(one.filter(F.col("train") == train), train, records.get(train, 0)), "cross-blocks") for train in (True, False)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["a"]["ids"] != last:
                    last, a = row["a"]["ids"], Block(row["a"])
                b = Block(row["b"])
                out: tuple[list, list] = ([], [])
                for k, hits in near(b, a, share):
                    x = b.words[b.first[k] : b.first[k + 1]].tolist()
                    for j in hits.tolist():
                        y = a.words[a.first[j] : a.first[j + 1]].tolist()
                        least = share * max(len(x), len(y)) - 1e-9
                        if recurring(x, y, least) >= least:
                            out[0].append(a.ids[j])
                            out[1].append(b.ids[k])
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["a", "b"])

    side = lambda k, own: own.select(F.struct("ids", "ns", "nums", "words", "marks").alias(k), *[F.col(x).alias(f"{x}_{k}") for x in ("low", "high", "least", "most")])
    fits = f"low_a <= high_b and low_b <= high_a and most_a >= {share} * least_b - 1e-6 and most_b >= {share} * least_a - 1e-6"
    both = side("a", blocks[0]).join(side("b", blocks[1]), F.expr(fits)).select("a", "b")
    spark = one.sparkSession
    before = spark.conf.get(ROWS, None)
    spark.conf.set(ROWS, str(HELD))
    try:
        out = stored(both.mapInArrow(compare, "a bigint, b bigint"), "cross-good")
    finally:
        spark.conf.unset(ROWS) if before is None else spark.conf.set(ROWS, before)
    discard(*blocks)
    return out


def matched(sides: DataFrame, sketches: DataFrame, share: float) -> DataFrame:
    """``a, b``: ids of training and evaluation records that match; sides: ``id, side``."""
    sk = stored(sketches, "cross-sketches")
    small = stored(sk.select("id", "same").distinct().join(sides, "id"), "cross-small")
    heads = stored(small.groupBy("same", "side").agg(F.min("id").alias("id")), "cross-classes")
    # one record of each class and side is compared
    records = {r.side == "T": r["count"] for r in heads.groupBy("side").count().collect()}
    good = candidates(sk.join(heads.select("id", "same", (F.col("side") == "T").alias("train")), ["id", "same"]), share, records)
    discard(sk)
    same = small.select("same", "side", "id")
    grow = lambda s, k: heads.filter(F.col("side") == s).select(F.col("id").alias(k), "same").join(same.filter(F.col("side") == s).select("same", F.col("id").alias(f"m{k}")), "same").drop("same")
    out = good.join(grow("T", "a"), "a").join(grow("E", "b"), "b")
    return out.select(F.col("ma").alias("a"), F.col("mb").alias("b")).distinct()


def _sided(split) -> F.Column:
    return F.when(split.isin(*TRAINING), "T").when(split.isin(*EVALUATION), "E")


def cross_split_pairs(questions: DataFrame, pages: DataFrame, files: DataFrame) -> DataFrame:
    """``unit, key_a, key_b``: records that recur on the other side of the split, the smaller key first."""
    ship(pages.sparkSession)
    q = questions.select(F.col("question_id").alias("key"), _sided(F.col("split")).alias("side"), F.col("question").alias("text")).filter("key is not null and side is not null and text is not null").distinct()
    q = stored(q.withColumn("id", F.xxhash64("key", "text", "side")), "cross-questions")
    key = F.concat("doc_id", F.lit("::p"), F.col("page").cast("string"))
    p = pages.filter("doc_id is not null and page is not null and text is not null").select("doc_id", key.alias("key"), F.xxhash64(key, "text").alias("id"), "text")
    own = files.filter("id is not null").select(F.col("id").alias("doc_id"), _sided(F.col("split")).alias("side")).filter("side is not null").distinct()
    pk = stored(p.select("doc_id", "key", "id").distinct().join(own, "doc_id").select("key", "id", "side"), "cross-pages")
    out = []
    for unit, keys, sk, share in (("question", q.select("key", "id", "side"), question_sketches(q), 0.75), ("page", pk, page_sketches(p, 20), 0.7)):
        got = matched(keys.select("id", "side").distinct(), sk, share)
        a, b = keys.filter("side = 'T'").select(F.col("id").alias("a"), F.col("key").alias("ka")), keys.filter("side = 'E'").select(F.col("id").alias("b"), F.col("key").alias("kb"))
        named = got.join(a, "a").join(b, "b").filter("ka != kb")
        out.append(named.select(F.lit(unit).alias("unit"), F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")))
    return out[0].unionByName(out[1]).distinct()


def overlap_report(pairs: DataFrame, questions: DataFrame, files: DataFrame) -> DataFrame:
    """``unit, split, source, records, pairs``: overlapping records of each split and source."""
    both = pairs.select("unit", F.explode(F.array("key_a", "key_b")).alias("key"), F.struct("key_a", "key_b").alias("pair"))
    q = questions.filter("question_id is not null").select(F.lit("question").alias("unit"), F.col("question_id").alias("key"), "split", "source").distinct()
    pk = both.filter("unit = 'page'").select("unit", "key").distinct().withColumn("id", F.regexp_extract("key", r"^(.*)::p-?\d+$", 1))
    p = pk.join(files.select("id", "split", "source"), "id").select("unit", "key", "split", "source").distinct()
    return both.join(q.unionByName(p), ["unit", "key"]).groupBy("unit", "split", "source").agg(F.countDistinct("key").alias("records"), F.countDistinct("pair").alias("pairs"))
