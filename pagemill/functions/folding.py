"""Case, accent and spacing folding as native column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def accent_pairs() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by the rule of canonical decomposition."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base != chr(cp) and base.isascii():
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


def fold(col: Column) -> Column:
    """Lower case without accents in either Unicode form; ``ß`` becomes ``ss``. Null stays null."""
    src, dst = accent_pairs()
    low = F.replace(F.lower(F.translate(col, src, dst)), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(low, r"\p{Mn}+", "")
