"""Statistics of a text as native column expressions.

All are single passes of built-in string functions over the column, so they run inside whole-stage code
and never leave the JVM. Lines are the pieces between newlines; empty ones do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German, Spanish, Italian, Portuguese and Dutch, accents folded.
COMMON = (
    "the of and to in a was were for with by that which at on from as is are be it this "
    "le la les des du de et en une un au aux par pour que qui sur dans est ete a "
    "der die das und den dem des im von zu mit auf bei ein eine einer nach war wird wurde "
    "el los las del y con por para se fue una al lo su "
    "il gli di e che della dei delle nel con per una sono stato al "
    "o os as do da dos das em no na nos que uma foi por ao "
    "het een van op aan voor met bij werd zijn dat der ligt"
).split()

#: A value of a table: a figure with or without sign, brackets or percent, or a mark for none.
VALUE = r"(?:\(?[-+]?\p{Sc}?\d[\d.,']*%?\)?|n/a|N/A|--?|–)"
_START = r"(?:[•·●▪◦*‣–—-]\s*|\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,5})[.)]\s*|\d{1,2}(?:\.\d{1,2})+\.?\s+|\p{Lu})"



def alternation(words: tuple[str, ...] | list[str]) -> str:
    """A pattern of the words that branches on one letter at a time, so a text is not tried against each word."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def of(node: dict) -> str:
        ways = [c + of(node[c]) for c in sorted(node) if c]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return body + ("?" if "" in node else "")

    return of(tree)


STATS = (
    "visible", "word_count", "mean_word_length", "letter_share", "symbol_ratio", "digit_ratio", "line_count", "words_per_line",
    "line_end_share", "common_share", "sentences_per_100", "value_share", "table_share", "entry_share", "bullet_share",
    "voiceless_share", "long_token_share", "upset_ratio", "repeat_share",
)
_OF_VISIBLE = {"visible", "symbol_ratio", "digit_ratio"}


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.when(b > 0, b), F.lit(0.0))


def with_stats(df: DataFrame, text: str = "text", names: tuple[str, ...] = STATS) -> DataFrame:
    """Adds the columns ``names`` of ``STATS``. A null text counts as an empty one; shares of nothing are 0.

    The statistics are one generated row of fields, so a filter on what is derived from them does not
    evaluate them again for each mention.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    bare = lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    without = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    n, words, letters = F.col("_n"), F.col("_words"), F.col("_letters")
    kept, needs = df.columns, set(names)
    df = df.withColumns({"_visible": bare(t).cast("bigint") if needs & _OF_VISIBLE else F.lit(None), "_n": F.length(t), "_words": F.regexp_count(t, F.lit(r"[\p{L}\p{M}]+")).cast("bigint")})
    df = df.withColumns({"_letters": (n - without(r"[\p{L}\p{M}]+")).cast("double"), "_lines": F.regexp_count(t, F.lit(r"(?m)^.*\S")).cast("bigint")})
    out = {
        "visible": F.col("_visible"),
        "word_count": words,
        "mean_word_length": _ratio(letters, words),
        "letter_share": _ratio(letters, n),
        "symbol_ratio": _ratio((n - without(r"[^\p{L}\p{M}\p{N}\s.,;:!?'’()%/-]+")).cast("double"), F.col("_visible")),
        "digit_ratio": _ratio((n - without(r"\p{N}+")).cast("double"), F.col("_visible")),
        "line_count": F.col("_lines"),
        "words_per_line": _ratio(words.cast("double"), F.col("_lines")),
        "line_end_share": _ratio(F.regexp_count(t, F.lit(r"(?m)[.!?][\"'»”’)\]]*[ \t]*$")).cast("double"), F.col("_lines")),
        "common_share": _ratio(F.regexp_count(t, F.lit(r"(?i)(?<![\p{L}\p{M}])" + alternation(COMMON) + r"(?![\p{L}\p{M}])")).cast("double"), words),
        "sentences_per_100": _ratio(100.0 * F.regexp_count(t, F.lit(r"[.!?](?=\s|$)(?<=\p{L}{2}[)\"'»”’]{0,3}[.!?])")), words),
        "value_share": _ratio(F.regexp_count(t, F.lit(r"(?<![^\s;|/:])" + VALUE + r"(?![^\s;|/])")).cast("double"), F.regexp_count(t, F.lit(r"[^\s;|/]+"))),
        "table_share": _ratio((n - without(r"(?m)^(?:[^\n]{0,60}?(?:[ \t;|/:=]+" + VALUE + r"){2,}|[ \t]*" + VALUE + r"|(?:[^\s;|]{0,40};|\|[^\n|]{0,40})(?:[;|][^\n;|]{0,20})+)[ \t;|/]*$\n?")).cast("double"), n),
        "entry_share": _ratio((n - without(r"(?m)^[ \t]*" + _START + r"[^\n]{0,120}[^.!?\s\n][ \t]*\n(?=\s*" + _START + r")")).cast("double"), n),
        "bullet_share": _ratio(F.regexp_count(t, F.lit(r"(?m)^[ \t]*(?:[•·●▪◦*‣–—-]\s|\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,5})[.)]\s|\d{1,2}(?:\.\d{1,2})+\.?\s)|\.{4,}\s*\d+\s*$")).cast("double"), F.col("_lines")),
        "voiceless_share": _ratio(F.regexp_count(t, F.lit(r"(?i)(?<![\p{L}\p{M}])[b-df-hj-np-tv-xz]{3,}(?![\p{L}\p{M}])")).cast("double"), words),
        "long_token_share": _ratio((n - without(r"[^\s]{28,}")).cast("double"), n),
        "upset_ratio": _ratio((n - without(r"[\u0080-\u00BF\u00D7\u00F7\u0152-\u0153\u0160-\u0161\u0178\u017D-\u017E\u0192\u02B0-\u02FF\u2020-\u2021\u20AC\u2122\uFFFD]+|\(cid:\d+\)")).cast("double"), n),
        "repeat_share": F.lit(1.0) - _ratio(F.size(F.array_distinct(F.split(F.lower(t), r"\s+"))).cast("double"), F.size(F.split(t, r"\s+"))),
    }
    fields = F.struct(*[out[k].alias(k) for k in names])
    return df.select(*kept, F.explode(F.array(fields)).alias("_s")).select(*kept, "_s.*")
