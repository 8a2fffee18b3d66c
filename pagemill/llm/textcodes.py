"""Words of many texts at once as 64-bit codes, by array operations over their characters.

Letters are folded to lower case without accents in any Unicode form (``ß`` to ``ss``), combining marks
vanish, everything that is neither letter nor digit separates. The tables are built from the Unicode
data by rule.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

IGNORED = np.uint32(0xFFFFFFFF)
#: Characters of one round of array operations; bounds a worker's memory.
ROUND_CHARS = 1_000_000
_LIGATURES = "ﬀﬁﬂﬃﬄﬅﬆ"


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Folded code of each code point below 0x10000: 0 separates, IGNORED vanishes."""
    table = np.zeros(0x10001, np.uint32)
    for cp in range(0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Mn" or cp in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):
            table[cp] = IGNORED
        elif kind[0] == "L" or kind == "Nd":
            low = unicodedata.normalize("NFKD", c.lower())
            low = [x for x in low if unicodedata.category(x)[0] != "M"]
            table[cp] = ord(low[0]) if low else cp
    table[0x10000] = 1
    return table


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    rng = np.random.default_rng(20260101)
    return rng.integers(1 << 40, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words of the texts of one round, in order."""

    code: np.ndarray  # uint64 of each word
    text: np.ndarray  # which text it is in
    first: np.ndarray  # first word of each text, with one entry more at the end
    start: np.ndarray  # offsets into chars
    end: np.ndarray
    chars: np.ndarray  # folded characters, separators 0
    origin: np.ndarray | None = None  # offset of each char in the joined text, if asked for


def codes(joined: str) -> np.ndarray:
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def prepared(text: str | None) -> str:
    """The text with the characters that fold into two letters spelled out."""
    if not text:
        return ""
    if "ß" in text or "ẞ" in text:
        text = text.replace("ß", "ss").replace("ẞ", "SS")
    if not text.isascii() and any(c in text for c in _LIGATURES):
        for c in _LIGATURES:
            text = text.replace(c, unicodedata.normalize("NFKC", c))
    return text


def words(texts: list[str], origin: bool = False) -> Words:
    """Words of ``texts``, which must be ``prepared``. No word spans two texts."""
    joined = "\n".join(texts) + "\n"
    raw = codes(joined)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    chars = fold_table()[np.minimum(raw, np.uint32(0x10000))]
    bounds = np.cumsum(lengths)
    where = None
    gone = chars == IGNORED
    if gone.any():
        kept = ~gone
        bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
        if origin:
            where = np.flatnonzero(kept)
        chars = chars[kept]
    elif origin:
        where = np.arange(len(chars))
    inside = chars != 0
    step = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(start):
        at = np.flatnonzero(inside)
        of = np.repeat(np.arange(len(start)), end - start)
        mult = _powers()[(at - start[of]) & 63]
        value = (chars[at].astype(np.uint64) + np.uint64(977)) * mult
        code = mix(np.add.reduceat(value, np.concatenate([[0], np.cumsum(end - start)[:-1]])))
    else:
        code = np.zeros(0, np.uint64)
    text = np.searchsorted(bounds, start, side="right").astype(np.int64)
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    return Words(code, text, first, start, end, chars, where)


def rounds(texts, limit: int = ROUND_CHARS):
    """Slices ``(lo, hi)`` of a list of texts with about ``limit`` characters, one text at least."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > lo and size + n > limit:
            yield lo, k
            lo, size = k, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def windows(code: np.ndarray, k: int) -> np.ndarray:
    """Codes of the runs of ``k`` words that start at each word (len - k + 1 of them), by a rolling polynomial."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, out = np.uint64(0x9E3779B97F4A7C15), np.zeros(n, np.uint64)
    for j in range(k):
        out = out * base + code[j : j + n]
    return mix(out)
