"""Noise in the text of scanned pages: running headers, page numbers, broken words, misread characters.

One reading of the pages gives the lines at their edges, the words broken at line ends and the words of the
corpus with their counts. From these tables, all of them joins and grouped counts:

- Headers and footers are edge lines that recur on the pages of their file in a form that is blind to
  figures and to misread characters, lines that differ from these in a few characters (edit distance), and lines
  that stand once in their file but are headers of other files.
- Page numbers are edge lines that are only a number and keep their distance from the page's place in the
  file; written as such (``p. 3``, ``[3]``, ``3 / 9``) they need no second witness.
- A word broken at a hyphen is joined if the corpus knows the joined word at least as well as the compound.
- A word is misread if undoing one or two confusions of characters gives a word that the corpus knows much
  better, counted over different texts, so copies of a page count once; names must be known in the same file.

A second reading finds the lines with misread words: a filter of ``SLOTS`` hashed places (fixed size) goes to
the tasks, what passes it is joined exactly with the misread words.

Defined results: null and empty pages have no damage; rows with a null key are ignored; rows delivered twice
count once, as damage is a set of lines; a file of one page has no running header of its own; further
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.storage import stored
from pagemill.session import ship

#: Character runs as misread and what they were.
MISREAD = (("0", "o"), ("1", "l"), ("5", "s"), ("6", "b"), ("9", "g"), ("!", "i"), ("vv", "w"), ("rn", "m"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("m", "in"), ("c", "e"), ("f", "t"))
#: A correct word must be this many times as frequent as its misread form.
TIMES = 10
#: Lines looked at from each end of a page (empty ones left out), hashed places of the filter of misread words.
EDGE, SLOTS = 3, 1 << 22
#: Characters of the longest running line, of the longest line that is only a page number, and of the longest word.
HEADER, FIGURE, LONGEST = 200, 40, 200
#: A running line recurs on this share of a file's pages, or on ``NEIGHBOURS`` pages that fill a quarter of their span.
RUNNING, NEIGHBOURS = 0.12, 4
#: Share of characters in which a line may differ from a running line of its file.
FUZZY = 0.15
#: Bits of the map of texts that a word is in; more than ``FULL`` texts are taken for any number.
PLACES, FULL = 63, 80
#: Entries after which a task hands its counts on; bounds its memory.
FLUSH = 300_000
HYPHENS = "-¬­‐"
_TOKEN = re.compile(r"!?[^\W_]+(?:[-!][^\W_]+)*")
_STOPPED = re.compile(r"[^\W\d_].{5,60}[^.\s]\.")
_WORDS = re.compile(r"!?\w++(?:[-!]\w++)*+")
#: A mark at a line's end with the start of the next line, and the word that ends before it.
_BREAK = re.compile(rf"[{HYPHENS}][ \t]*\r?\n[ \t]*(?=[^\W_]|!)")
_BEFORE = re.compile(r"[^\W_]+(?:[-!][^\W_]+)*$")
_PAGE = re.compile(r"^(?:(p\.|page|seite|pág\.|pag\.|blz\.)\s*)?([-–—\[(|])?\s*([0-9lIOoSsbgZB]{1,5})\s*(?:(?:/|of|von|de|di|sur|van)\s*([0-9lIOoSsbgZB]{1,5}))?\s*([-–—\])|])?$", re.IGNORECASE)
_SECTION, _GOES_ON = re.compile(r"\d+\.\d"), re.compile(r"[^\W\d_]{2}")
_ENTRY = re.compile(r"\d+\.\d+\s|\w{1,3}[.)]\s|[•·▪◦*–—-]\s")
_DIGITS = str.maketrans("lIOoSsbgZB", "1100556928")
_SHAPE = str.maketrans("0159!6cfIOS", "olsgibetlos")


def _tokens(text: str) -> list[str]:
    """All matches of ``_TOKEN``, by a pattern that is faster and takes underscores for letters."""
    return _WORDS.findall(text.replace("_", " ") if "_" in text else text)


def line_key(line: str) -> str:
    """A form of a line that is blind to figures, spacing, case and misread characters; empty for lines that cannot be running."""
    if line[-1:] == "." and line[:1].isupper() and _STOPPED.fullmatch(line):
        line = line[:-1]
    if line[-1:] in ".,;:" or line[:1].islower() or _SECTION.match(line) or "\t" in line or ";" in line or line.count("|") > 1:
        return ""
    words = line.split()
    while words and _number(words[0]) is not None and len(words) > 1:
        words.pop(0)
    while words and len(words) > 1 and _number(words[-1]) is not None and len(words[-1]) < 4:
        words.pop()
    out = [_form(w) for w in words]
    return " ".join([w for w, _ in out]) if sum([n for _, n in out]) >= 6 else ""


@lru_cache(1 << 16)
def _form(word: str) -> tuple[str, int]:
    """A word of ``line_key`` and its letters."""
    if sum(c.isdigit() for c in word) * 2 > len(word):
        return "#", 0
    word = unicodedata.normalize("NFKC", word).casefold().translate(_SHAPE)
    for a, b in (("vv", "w"), ("rn", "m"), ("d", "el"), ("ii", "u"), ("in", "m"), ("li", "h")):
        word = word.replace(a, b)
    return word, sum(c.isalpha() for c in word)


def _goes_on(line: str) -> bool:
    """Whether a line goes on with a sentence: it starts with a word in lower case."""
    return bool(_GOES_ON.match(line)) and line[:2].islower()


def _number(word: str) -> int | None:
    if not any(c.isdigit() for c in word) and word not in ("l", "I", "O", "lO", "ll", "IO", "II", "lI"):
        return None
    word = word.translate(_DIGITS)
    return int(word) if word.isascii() and word.isdigit() and len(word) <= 5 else None


def page_number(line: str) -> tuple[int, bool] | None:
    """The printed number of a line that is only a page number, and whether it is written as one."""
    m = _PAGE.match(line)
    if not m:
        return None
    word, left, figure, total, right = m.groups()
    value = _number(figure)
    if value is None or (left == "(") or bool(left) != bool(right):
        return None
    return value, bool(word or left or total)


_READ = "kind string, doc_id string, page int, line_no int, a string, b string, n bigint, texts bigint"


class _Out:
    """Rows of the first reading."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.words: Counter = Counter()
        self.texts: dict[str, int] = {}
        #: Words of the texts of each place, not yet in ``texts``; words looked at, and those of them written as names.
        self.places: list[set[str]] = [set() for _ in range(PLACES)]
        self.known: set[str] = set()
        self.titles: set[str] = set()
        self.forms: set[str] = set()
        self.names: Counter = Counter()

    def flush(self, all_: bool = False) -> Iterator[pa.RecordBatch]:
        full = all_ or len(self.words) > FLUSH
        if full or sum(map(len, self.places)) > 4 * FLUSH:
            texts = self.texts
            for k, own in enumerate(self.places):
                place = 1 << k
                for w in own:
                    texts[w] = texts.get(w, 0) | place
                own.clear()
        if full:
            texts = self.texts.get
            self.rows += [("word", None, None, None, w, None, n, texts(w, 0)) for w, n in self.words.items() if n or w in self.forms]
            self.words.clear()
            self.forms.clear()
            self.texts.clear()
            self.known.clear()
            self.titles.clear()
        if all_ or len(self.names) > FLUSH:
            self.rows += [("name", d, None, None, w, None, n, None) for (d, w), n in self.names.items()]
            self.names.clear()
        if self.rows:
            cols = list(zip(*self.rows))
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["kind", "doc_id", "page", "line_no", "a", "b", "n", "texts"])
            self.rows = []


def broken_at(text: str) -> list[tuple[int, str, str, str]]:
    """Broken words ``(line from 0, first part, mark, second part)``."""
    out, line, at = [], 0, 0
    for m in _BREAK.finditer(text):
        before = text[max(0, m.start() - LONGEST) : m.start()]
        if before and not before[-1].isspace():  # no word goes over a space
            before = before.rsplit(None, 1)[-1]
        first, second = _BEFORE.search(before), _TOKEN.match(text, m.end())
        if not first or not second:
            continue
        a, b = first.group(), second.group()
        if b[0].isupper() or (b[0].isdigit() and not b[1:2].isalpha()) or not any(c.isalpha() for c in a):
            continue
        line += text.count("\n", at, m.start())
        at = m.start()
        out.append((line, a, text[m.start()], b))
    return out


def _first_reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out()
    for batch in batches:
        docs, pages, texts = (c.to_pylist() for c in batch.columns)
        for d, p, t in zip(docs, pages, texts):
            if not t:
                continue
            lines = t.split("\n")
            full = [k for k, x in enumerate(lines) if x and not x.isspace()]
            for at, k in [*enumerate(full[:EDGE], 1), *((-j, k) for j, k in enumerate(reversed(full[-EDGE:]), 1))]:
                line = lines[k].strip()
                num = page_number(line) if len(line) <= FIGURE else None
                if num:
                    out.rows.append(("number", d, p, k + 1, "written" if num[1] else "bare", str(at), num[0], None))
                elif len(line) <= HEADER and not (at > 0 and k + 1 < len(lines) and _goes_on(lines[k + 1])) and (key := line_key(line)):
                    out.rows.append(("edge", d, p, k + 1, key, line, at, None))
            words, names, tokens = out.words, out.names, _tokens(t)
            words.update(tokens)
            place, own = out.places[crc32(t.encode("utf-8", "surrogatepass")) % PLACES], set(tokens)
            place |= own
            if new := own - out.known:
                out.known |= new
                out.titles.update([w for w in new if w[0].isupper() and len(w) >= 5 and w[1:].islower()])
            names.update([(d, w) for w in own & out.titles])
            for k, a, mark, b in broken_at(t):
                out.rows.append(("break", d, p, k + 1, a, b, 1 if mark == "-" or mark == "‐" else 0, None))
                words[a] -= 1  # parts are no words
                words[b] -= 1
                if mark in "-‐":
                    words[a + b] += 0  # not counted, but looked at
                    out.forms.add(a + b)
                else:
                    words[a + b] += 1
                    place.add(a + b)
        yield from out.flush()
    yield from out.flush(True)


def undone(word: str) -> set[str]:
    """Words that ``word`` may have been before one or two confusions."""
    one = set()
    for bad, good in MISREAD:
        k = word.find(bad)
        while k >= 0:
            one.add(word[:k] + good + word[k + len(bad) :])
            k = word.find(bad, k + 1)
    two = set()
    if len(word) >= 7 or any(c.isdigit() or c == "!" for c in word):
        for w in one:
            for bad, good in MISREAD:
                k = w.find(bad)
                while k >= 0:
                    two.add(w[:k] + good + w[k + len(bad) :])
                    k = w.find(bad, k + 1)
    out = one | two
    out.discard(word)
    return {w for w in out if len(w) >= 3 and not any(c.isdigit() for c in w)}


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = [(w, n, c) for w, n in zip(words, counts) for c in undone(w)]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["word", "n", "right"])


def misread_words(read: DataFrame) -> DataFrame:
    """``word, doc_id, right``: misread words and what they were; doc_id is null where it holds in all files."""
    words = read.filter("kind = 'word'").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n"), F.bit_or("texts").alias("texts"))
    # copies of a text count once: the number of texts, from the share of places that are free, bounds the count
    texts = F.ceil(-PLACES * F.log(1 - F.least(F.bit_count("texts"), F.lit(PLACES - 1)) / PLACES))
    words = stored(words.select("word", F.when(texts <= FULL, F.least("n", texts.cast("bigint"))).otherwise(F.col("n")).alias("n")), "scan-words")
    known = words.groupBy(F.lower("word").alias("low")).agg(F.sum(F.when(F.col("word") == F.lower("word"), F.col("n")).otherwise(0)).alias("plain"), F.sum("n").alias("all")).filter("all > 0")
    known = stored(known, "scan-known")
    letters = F.col("word").rlike(r"\p{L}.*\p{L}") & (F.length("word") >= 3) & ~F.col("word").rlike(r"\d{2}")
    cand = words.filter(letters).mapInArrow(_candidates, "word string, n bigint, right string")
    own = known.select(F.col("low").alias("word_low"), F.col("all").alias("own"))
    cand = cand.join(known.withColumnRenamed("low", "right_low"), F.lower("right") == F.col("right_low")).join(own, F.lower("word") == F.col("word_low"), "left").withColumn("own", F.coalesce("own", F.lit(1)))
    cand = stored(cand.select("word", "right", "plain", "all", "own"), "scan-candidates")
    figure = F.col("word").rlike(r"[0-9!]")
    least = F.when(F.length("right") >= 4, TIMES).otherwise(100 * TIMES)  # short words differ by one character often
    everywhere = cand.filter((F.col("plain") >= least * F.col("own")) | (figure & (F.col("all") >= 2) & (F.col("all") > F.col("own"))))
    names = read.filter("kind = 'name'").groupBy("doc_id", F.col("a").alias("word")).agg(F.sum("n").alias("n"))
    title = cand.filter(F.col("word").rlike(r"^\p{Lu}") & (F.col("plain") < TIMES * F.col("own"))).select("word", "right").distinct()
    here = names.join(title, "word")
    right = names.select("doc_id", F.col("word").alias("right"), F.col("n").alias("m"))
    local = here.join(right, ["doc_id", "right"]).filter((F.col("m") >= 2) & (F.col("m") >= 2 * F.col("n"))).select("word", "doc_id", "right", F.col("m").alias("w"))
    both = everywhere.select("word", F.lit(None).cast("string").alias("doc_id"), "right", F.col("all").alias("w")).unionByName(local)
    return both.groupBy("word", "doc_id").agg(F.max_by("right", F.struct("w", "right")).alias("right"))


def running_lines(read: DataFrame) -> DataFrame:
    """``doc_id, page, line_no``: running headers and footers."""
    edge = stored(read.filter("kind = 'edge'").select("doc_id", "page", "line_no", F.col("a").alias("key"), F.col("n").alias("at")), "scan-edges")
    pages = edge.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    often = edge.groupBy("doc_id", "key").agg(F.count_distinct("page").alias("n"), (F.max("page") - F.min("page") + 1).alias("span")).join(pages, "doc_id")
    near = (F.col("n") >= NEIGHBOURS) & (F.col("span") <= 4 * F.col("n"))
    own = stored(often.filter((F.col("n") >= 2) & ((F.col("n") >= RUNNING * F.col("pages")) | near)).select("doc_id", "key"), "scan-running")
    # lines that differ from a running line of their file in a few characters
    others = often.select("doc_id", "key").join(own, ["doc_id", "key"], "left_anti")
    most = F.floor(FUZZY * F.length("key")).cast("int")
    alike = (F.abs(F.length("key") - F.length("like")) <= most) & (F.levenshtein("key", "like") <= most)
    own = stored(own.unionByName(others.join(own.withColumnRenamed("key", "like"), "doc_id").filter(alike).select("doc_id", "key").distinct()), "scan-headers")
    wide = own.groupBy("key").agg(F.count("*").alias("files")).filter("files >= 3").select("key")
    # a line that runs through other files counts where it stands alone, at the very edge
    lone = edge.filter(F.abs("at") <= 2).join(wide, "key", "left_semi")
    return edge.join(own, ["doc_id", "key"], "left_semi").unionByName(lone).select("doc_id", "page", "line_no").distinct()


def number_lines(read: DataFrame) -> DataFrame:
    """``doc_id, page, line_no``: lines that are only the page number."""
    nums = read.filter("kind = 'number'").select("doc_id", "page", "line_no", F.col("a").alias("how"), (F.col("n") - F.col("page")).alias("off"))
    nums = stored(nums, "scan-numbers")
    votes = nums.groupBy("doc_id", "off").agg(F.count_distinct("page").alias("n"), F.max(F.when(F.col("how") == "written", 1).otherwise(0)).alias("w"))
    best = votes.groupBy("doc_id").agg(F.max_by("off", F.struct("n", "w", -F.abs("off"))).alias("best"), F.max("n").alias("n"))
    joined = nums.join(best, "doc_id")
    fits = F.col("off") == F.col("best")
    ok = (F.col("how") == "written") | (fits & ((F.col("n") >= 2) | F.col("off").between(-3, 60)))
    return joined.filter(ok).select("doc_id", "page", "line_no").distinct()


def broken_words(read: DataFrame) -> DataFrame:
    """``doc_id, page, line_no``: lines that end within a word which goes on in the next line."""
    breaks = stored(read.filter("kind = 'break'").select("doc_id", "page", "line_no", "a", "b", "n"), "scan-breaks")
    hard = breaks.filter("n = 1").select("a", "b").distinct()
    words = read.filter("kind = 'word'").groupBy(F.lower("a").alias("w")).agg(F.sum("n").alias("c"))
    look = hard.select("a", "b", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lower(w).alias("w")) for k, w in (("whole", F.concat("a", "b")), ("compound", F.concat_ws("-", "a", "b")), ("left", F.regexp_extract("a", r"([^-]+)$", 1)), ("right", F.regexp_extract("b", r"^([^-]+)", 1)))])).alias("x")).select("a", "b", "x.k", "x.w")
    seen = look.join(words, "w").groupBy("a", "b").pivot("k", ["whole", "compound", "left", "right"]).agg(F.sum("c"))
    joined = hard.join(seen, ["a", "b"], "left").na.fill(0, ["whole", "compound", "left", "right"])
    known = (F.col("whole") > 0) | (F.col("compound") > 0)
    whole = F.when(known, F.col("whole") >= F.col("compound")).otherwise((F.col("left") < 3) | (F.col("right") < 3))
    # parts that never stand alone: a word, even if the corpus does not know it whole
    plain = joined.filter(whole).select("a", "b")
    return breaks.filter("n = 0").select("doc_id", "page", "line_no").unionByName(breaks.filter("n = 1").join(plain, ["a", "b"], "left_semi").select("doc_id", "page", "line_no"))


def _misread_lines(pages: DataFrame, bad: DataFrame) -> DataFrame:
    """``doc_id, page, line_no, word``: lines with misread words, the word as it stands."""
    slots = bad.select(F.pmod(F.crc32(F.encode("word", "utf-8")), F.lit(SLOTS)).cast("int").alias("s")).distinct()
    flags = bytearray(SLOTS)
    for r in slots.toLocalIterator():
        flags[r[0]] = 1
    sent = pages.sparkSession.sparkContext.broadcast(bytes(flags))

    def second_reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = sent.value
        clean: set[str] = set()  # words that are not looked for
        for batch in batches:
            rows: list[tuple] = []
            docs, nums, texts = (c.to_pylist() for c in batch.columns)
            for d, p, t in zip(docs, nums, texts):
                if not t:
                    continue
                new = set(_tokens(t)) - clean
                hits = [w for w in new if on[crc32(w.encode("utf-8", "surrogatepass")) & (SLOTS - 1)]]
                clean |= new.difference(hits)
                if len(clean) > FLUSH:
                    clean.clear()
                parts = broken_at(t)
                inner = {(k, a) for k, a, _, _ in parts} | {(k + 1, b) for k, _, _, b in parts}
                if hits:
                    for k, line in enumerate(t.split("\n")):
                        for w in hits:
                            if w in line and (k, w) not in inner and w in _tokens(line):
                                rows.append((d, p, k + 1, w, 0))
                for k, a, _, b in parts:
                    if on[crc32((a + b).encode("utf-8", "surrogatepass")) & (SLOTS - 1)]:
                        rows.append((d, p, k + 1, a + b, len(a)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()))], names=["doc_id", "page", "line_no", "word", "cut"])

    hits = stored(pages.mapInArrow(second_reading, "doc_id string, page int, line_no int, word string, cut int"), "scan-hits")
    anywhere = hits.join(bad.filter("doc_id is null").select("word", "right"), "word")
    within = hits.join(bad.filter("doc_id is not null"), ["doc_id", "word"]).select(*anywhere.columns)
    found = anywhere.unionByName(within)
    # the damage of a broken word is in the line that holds the first differing character
    same = F.length(F.regexp_extract(F.concat_ws("\n", F.lower("word"), F.lower("right")), r"^(.*).*\n\1", 1))
    line = F.when((F.col("cut") > 0) & (same >= F.col("cut")), F.col("line_no") + 1).otherwise(F.col("line_no"))
    return found.select("doc_id", "page", line.alias("line_no"), "word", "right")


def _parts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Damaged lines at the edges of pages, each once, and the damage within the other lines."""
    ship(pages.sparkSession)
    rows = pages.filter("doc_id is not null and page is not null and text is not null").select("doc_id", "page", "text")
    read = stored(rows.mapInArrow(_first_reading, _READ), "scan-read")
    kind = lambda df, name: df.select("doc_id", "page", "line_no", F.lit(name).alias("damage"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("right"))
    run = running_lines(read)
    edges = stored(kind(run, "header").unionByName(kind(number_lines(read).join(run, ["doc_id", "page", "line_no"], "left_anti"), "page_number")), "scan-edge-damage")
    bad = stored(misread_words(read), "scan-misread")
    words = _misread_lines(rows, bad).select("doc_id", "page", "line_no", F.lit("ocr_error").alias("damage"), "word", "right")
    return edges, kind(broken_words(read), "hyphen").unionByName(words).join(edges.select("doc_id", "page", "line_no"), ["doc_id", "page", "line_no"], "left_anti")


def damages(pages: DataFrame) -> DataFrame:
    """``doc_id, page, line_no, damage, word, right``: damaged lines of each kind, with the misread words."""
    edges, inner = _parts(pages)
    return edges.unionByName(inner.distinct())


def damaged_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, page, line_no, damage``: one row for each damaged line and kind of damage."""
    edges, inner = (x.select("doc_id", "page", "line_no", "damage") for x in _parts(pages))
    return edges.unionByName(inner.distinct())


def repaired(pages: DataFrame) -> DataFrame:
    """``doc_id, page, text``: each page as continuous paragraphs.

    Headers, footers and page numbers are gone, broken words joined, misread words put right; lines of a
    paragraph are joined, blank lines part paragraphs, lines that stand alone (entries, rows of tables) stay.
    """
    found = damages(pages)
    rows = pages.filter("doc_id is not null and page is not null").groupBy("doc_id", "page").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    item = F.struct("line_no", "damage", F.coalesce("word", F.lit("")).alias("word"), F.coalesce("right", F.lit("")).alias("right"))
    own = found.groupBy("doc_id", "page").agg(F.collect_set(item).alias("marks"))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, nums, texts, marks = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(nums, pa.int32()), pa.array([repair_text(t, m or []) for t, m in zip(texts, marks)], pa.string())], names=["doc_id", "page", "text"])

    return rows.join(own, ["doc_id", "page"], "left").mapInArrow(repair, "doc_id string, page int, text string")


def repair_text(text: str, marks: list[dict]) -> str:
    """The text without the marked damage, its lines joined to paragraphs."""
    lines: list[str | None] = list(text.split("\n"))
    joined = set()
    for m in marks:
        k = m["line_no"] - 1
        if not 0 <= k < len(lines):
            continue
        if m["damage"] in ("header", "page_number"):
            lines[k] = None
        elif m["damage"] == "hyphen":
            joined.add(k)
    fixes = {m["word"]: m["right"] for m in marks if m["damage"] == "ocr_error"}
    paragraphs: list[str] = []
    open_ = False
    width = max((len(x) for x in lines if x), default=0)
    for k, line in enumerate(lines):
        if line is None:
            continue
        if not line.strip():
            open_ = False
            continue
        part = line.strip()
        if open_ == "word":
            paragraphs[-1] += part
        elif open_ and (part[:1].islower() or (lines[k - 1] is not None and len(lines[k - 1] or "") >= 0.75 * width and not _ENTRY.match(part))):
            paragraphs[-1] += " " + part
        else:
            paragraphs.append(part)
        open_ = True
        if k in joined:
            paragraphs[-1] = paragraphs[-1].rstrip(HYPHENS + " \t")
            open_ = "word"
        elif part[-1:] in "-‐":
            open_ = "word"
    out = "\n\n".join(paragraphs)
    return _TOKEN.sub(lambda m: fixes.get(m.group(0), m.group(0)), out) if fixes else out
