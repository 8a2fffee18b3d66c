"""Languages of documents and of the stretches within them.

A word is the sum of hashed embeddings of its character runs and of itself; a stretch is the average over
its words' runs, and a linear softmax over that average gives the language. Embeddings and softmax are
trained together by stochastic gradient descent on at most ``DRAWN`` sentences of each of at most ``SAMPLE`` documents
with a usable label, in order of a hash of their id; sentences whose label the first fit doubts are left out of the second, because
labels are wrong at times. A temperature fitted on held-out sentences calibrates the confidence, and
sentences under ``REJECT`` take no part in what a stretch is. Since the softmax is linear, embeddings and
weights fold into one score table of fixed size, which is all that travels to the tasks.

Defined results: null and empty texts have no language (null, confidence 0); a text without a sentence that
is sure enough takes the language of all its words, and none (null) if these are not sure enough either; rows with a null id are ignored; rows delivered twice
count once; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.text_kinds import with_kind
from pagemill.llm.textcodes import Words, mix, prepared, rounds, words
from pagemill.session import ship

LANGS = ("de", "en", "es", "fr", "it", "nl", "pt")
#: Names of the languages in labels besides their two-letter codes.
NAMES = {
    "de": ("deu", "ger", "german", "deutsch", "allemand"),
    "en": ("eng", "english", "englisch", "anglais"),
    "es": ("spa", "esp", "spanish", "espanol", "castellano"),
    "fr": ("fra", "fre", "french", "francais", "franzosisch"),
    "it": ("ita", "italian", "italiano", "italienisch"),
    "nl": ("nld", "dut", "dutch", "nederlands"),
    "pt": ("por", "portuguese", "portugues"),
}
#: Labels that name no language.
NO_LABEL = ("", "-", "?", "??", "und", "unk", "unknown", "none", "null", "n/a", "na", "xx", "zxx", "mul", "mis")
#: Documents of the sample that the model is fitted on, and sentences drawn from the whole text of each.
SAMPLE, DRAWN = 1200, 24
BUCKETS, DIM, REJECT = 1 << 15, 12, 0.6
#: Characters of the longest heading.
HEADING = 60
#: Cost of a change of language between sentences, and the most that one sentence speaks against a language (in nats).
CHANGE, DOUBT = 4.0, 6.0
_END = re.compile(r"(?<=[.!?])[\"'»”’)\]]*\s+|\n[ \t]*\n\s*")
_QUOTED = re.compile(r"[“„«][^”“»„«]{0,400}[”“»]|\"[^\"\n]{3,400}\"")


def label_key(col: Column) -> Column:
    """The two-letter code of a label however spelled; ``?`` for another language, null for none."""
    low = F.lower(F.trim(col))
    main = F.regexp_replace(F.translate(F.regexp_extract(low, r"^([\p{L}?]*)", 1), "éèçñãöü", "eecnaou"), r"^$", "-")
    out = F.when(col.isNull() | low.isin(*NO_LABEL) | main.isin(*NO_LABEL), F.lit(None).cast("string"))
    for code, names in NAMES.items():
        out = out.when(main.isin(code, *names), F.lit(code))
    return out.otherwise(F.lit("?"))


def units(text: str, is_list: bool) -> list[str]:
    """Sentences of a text, or entries of a list, without quoted phrases."""
    text = _QUOTED.sub(" ", text)
    parts = text.split("\n") if is_list else _END.split(text)
    return [p for p in parts if p and not p.isspace()]


def _is_sentence(unit: str) -> bool:
    """Whether a piece of prose is a sentence and no heading: it is closed, or too long for a heading."""
    return unit.rstrip("\"'»”’)] \n\t")[-1:] in (".", "!", "?") or len(unit) > HEADING


def _buckets(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character runs of the words ``which``: flat, with the word (index into which) of each."""
    size = np.minimum(w.end[which] - w.start[which], 24)
    wide = int(size.max()) + 2 if len(which) else 2
    grid = np.zeros((len(which), wide), np.uint64)
    col = np.arange(wide)
    inside = (col[None, :] >= 1) & (col[None, :] <= size[:, None])
    grid[inside] = w.chars[(w.start[which][:, None] + col[None, :] - 1)[inside]]
    grid[:, 0] = 2
    grid[np.arange(len(which)), size + 1] = 3
    flat, of = [mix(w.code[which]) % np.uint64(BUCKETS)], [np.arange(len(which))]
    for n in (2, 3, 4):
        if wide < n:
            continue
        h = np.zeros((len(which), wide - n + 1), np.uint64)
        for j in range(n):
            h = h * np.uint64(1000003) + grid[:, j : wide - n + 1 + j]
        ok = np.arange(wide - n + 1)[None, :] + n <= (size + 2)[:, None]
        flat.append(mix(h[ok] + np.uint64(n)) % np.uint64(BUCKETS))
        of.append(np.nonzero(ok)[0])
    return np.concatenate(flat).astype(np.int64), np.concatenate(of)


class Model:
    """The score table: for each bucket the score of each language; bias and temperature of the softmax."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, heat: float):
        self.table, self.bias, self.heat = table, bias, heat

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, Words]:
        """For each text the sum of its words' scores and the number of its runs."""
        w = words(texts)
        total, count = np.zeros((len(texts), len(LANGS))), np.zeros(len(texts))
        if len(w.code):
            _, first, back = np.unique(w.code, return_index=True, return_inverse=True)
            flat, of = _buckets(w, first)
            order = np.argsort(of, kind="stable")
            starts = np.searchsorted(of[order], np.arange(len(first)))
            each = np.add.reduceat(self.table[flat[order]], starts, axis=0)
            runs = np.bincount(of, minlength=len(first))
            full = np.flatnonzero(np.diff(w.first) > 0)
            total[full] = np.add.reduceat(each[back], w.first[full], axis=0)
            count[full] = np.add.reduceat(runs[back], w.first[full])
        return total, count, w

    def sure(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the languages."""
        z = (total / np.maximum(count, 1)[:, None] + self.bias) * self.heat
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _fit(flat: np.ndarray, first: np.ndarray, y: np.ndarray, rows: np.ndarray, rng, rounds_: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, len(LANGS))), np.zeros(len(LANGS))
    weight = len(rows) / (len(LANGS) * np.maximum(1, np.bincount(y[rows], minlength=len(LANGS))))
    weight = np.minimum(weight, 5.0)
    step, size = 8.0, 32
    batches = rounds_ * (len(rows) // size + 1)
    done = 0
    for _ in range(rounds_):
        order = rng.permutation(rows)
        for lo in range(0, len(order), size):
            b = order[lo : lo + size]
            many = first[b + 1] - first[b]
            idx = np.repeat(first[b] - np.cumsum(many) + many, many) + np.arange(many.sum())
            ids, at = flat[idx], np.repeat(np.arange(len(b)), many)
            mean = np.zeros((len(b), DIM))
            np.add.at(mean, at, emb[ids])
            mean /= many[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(b)), y[b]] -= 1
            p *= weight[y[b]][:, None] / len(b)
            rate = step * (1 - done / batches) + 0.05
            back = p @ out.T / many[:, None]
            out -= rate * (mean.T @ p)
            bias -= rate * 0.1 * p.sum(axis=0)
            np.add.at(emb, ids, -rate * len(b) * back[at])
            done += 1
    return emb, out, bias


def train(labelled: list[tuple[str, str, bool]], seed: int = 5) -> Model:
    """A model from texts with language codes, some of them wrong, and whether a text is a list.

    A part of each sentence joins the sentence itself, so short entries are known too.
    """
    rng = np.random.default_rng(seed)
    texts, y = [], []
    for text, code, is_list in labelled:
        own = [u for u in units(prepared(text), is_list) if len(u) >= 12]
        drawn = range(len(own)) if len(own) <= DRAWN else sorted(rng.choice(len(own), DRAWN, replace=False).tolist())
        for u in (own[k] for k in drawn):
            texts.append(u)
            y.append(LANGS.index(code))
            parts = u.split()
            if len(parts) > 8:
                k, n = int(rng.integers(0, len(parts) - 3)), int(rng.integers(3, 8))
                texts.append(" ".join(parts[k : k + n]))
                y.append(LANGS.index(code))
    y = np.array(y, np.int64)
    w = words(texts)
    flat, of = _buckets(w, np.arange(len(w.code)))
    order = np.argsort(w.text[of], kind="stable")
    flat, text = flat[order], w.text[of][order]
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    usable = np.flatnonzero(first[1:] > first[:-1])
    held = usable[rng.random(len(usable)) < 0.1]
    fit = np.setdiff1d(usable, held)
    for last in (False, True):
        emb, out, bias = _fit(flat, first, y, fit, rng)
        model = Model((emb @ out).astype(np.float32), bias, 1.0)
        total, count, _ = model.scores(texts)
        if not last:  # doubted labels are left out of the second fit and of the calibration
            p = model.sure(total, count)
            trusted = p[np.arange(len(y)), y] >= 0.3
            fit, held = fit[trusted[fit]], held[trusted[held]]
    best = (np.inf, 1.0)
    for heat in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
        model.heat = heat
        p = model.sure(total[held], count[held])[np.arange(len(held)), y[held]] if len(held) else np.ones(1)
        best = min(best, (float(-np.log(np.maximum(p, 1e-9)).mean()), heat))
    model.heat = best[1]
    return model


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` documents whose label names one of the languages."""
    rows = docs.select(F.col("doc_id"), label_key(F.col("lang")).alias("code"), F.col("text"), F.xxhash64("doc_id").alias("h")).filter(F.col("doc_id").isNotNull() & F.col("code").isin(*LANGS))
    limit = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).head()[0]
    if limit is None:
        return Model(np.zeros((BUCKETS, len(LANGS)), np.float32), np.zeros(len(LANGS)), 1.0)
    part = rows.filter(F.col("h") <= limit).select("h", "text", "code").orderBy("h").limit(sample)
    got = with_kind(part).filter(F.col("kind").isin("prose", "list")).orderBy("h", "text").collect()
    return train([(r["text"], r["code"], r["kind"] == "list") for r in got if r["text"]])


PARTS = "doc_id bigint, lang string, confidence double, parts array<struct<lang:string, confidence:double, first:int, last:int>>"
_PART = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("first", pa.int32()), ("last", pa.int32())])


def _path(p: np.ndarray) -> np.ndarray:
    """The likeliest sequence of languages when each change of language costs ``CHANGE``."""
    gain = np.maximum(np.log(np.maximum(p, 1e-12)), -DOUBT)
    back = np.zeros(p.shape, np.int64)
    score = gain[0]
    for k in range(1, len(p)):
        top = int(score.argmax())
        stay = score >= score[top] - CHANGE
        back[k] = np.where(stay, np.arange(p.shape[1]), top)
        score = np.where(stay, score, score[top] - CHANGE) + gain[k]
    path = np.empty(len(p), np.int64)
    path[-1] = score.argmax()
    for k in range(len(p) - 1, 0, -1):
        path[k - 1] = back[k][path[k]]
    return path


def _stretches(p: np.ndarray) -> list[dict]:
    """Runs of sentences in one language; unsure sentences end no run."""
    out: list[dict] = []
    best, sure = p.argmax(axis=1), p.max(axis=1)
    used = np.flatnonzero(sure >= REJECT)
    path = best[used] if len(set(best[used].tolist())) < 2 else _path(p[used])
    for k, b in zip(used.tolist(), path.tolist()):
        code = LANGS[b]
        if not out or out[-1]["lang"] != code:
            out.append({"lang": code, "first": k, "n": 0, "sum": 0.0})
        out[-1]["last"] = k
        out[-1]["n"] += 1
        out[-1]["sum"] += float(p[k, b])
    return [{"lang": s["lang"], "confidence": s["sum"] / s["n"], "first": s["first"], "last": s["last"], "n": s["n"]} for s in out]


def detect(docs: DataFrame, model: Model, kind: str = "kind") -> DataFrame:
    """``doc_id, lang, confidence, parts``: the language of each document and of its stretches.

    parts counts sentences (entries in lists) from 0; a stretch has two sentences in a row at least, unless
    the document has none that long.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.heat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for batch in batches:
            ids, kinds, texts = (c.to_pylist() for c in batch.columns)
            langs, sures, parts = [], [], []
            for lo, hi in rounds(texts):
                own = [units(prepared(t), kd == "list") for t, kd in zip(texts[lo:hi], kinds[lo:hi])]
                total, count, _ = m.scores([u for x in own for u in x])
                p = m.sure(total, count)
                at = 0
                for x, kd in zip(own, kinds[lo:hi]):
                    t, c, q = total[at : at + len(x)], count[at : at + len(x)], p[at : at + len(x)]
                    at += len(x)
                    if not c.sum():
                        langs.append(None)
                        sures.append(0.0)
                        parts.append([])
                        continue
                    whole = m.sure(t.sum(axis=0, keepdims=True), np.array([c.sum()]))[0]
                    q = np.where(c[:, None] > 0, q, 0)
                    if kd != "list" and len(set(q.argmax(axis=1)[q.max(axis=1) >= REJECT].tolist())) > 1:
                        q = np.where(np.array([_is_sentence(u) for u in x])[:, None], q, 0)  # headings end no language
                    runs = _stretches(q)
                    known = LANGS[int(whole.argmax())] if whole.max() >= REJECT else None
                    runs = [r for r in runs if r["n"] >= 2] or ([{"lang": known, "confidence": float(whole.max()), "first": 0, "last": len(x) - 1}] if known else [])
                    langs.append(known)
                    sures.append(float(whole.max()))
                    parts.append([{k: r[k] for k in ("lang", "confidence", "first", "last")} for r in runs])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(sures, pa.float64()), pa.array(parts, pa.list_(_PART))], names=["doc_id", "lang", "confidence", "parts"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col(kind), F.coalesce("text", F.lit(""))).mapInArrow(run, PARTS)


def mislabelled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, lang``: the languages of prose and lists whose label is missing, wrong or one of several."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), label_key(F.col("lang")).alias("label"), "text")
    kept = with_kind(rows).filter(F.col("kind").isin("prose", "list"))
    # the label rides along in the kind, so the text is not joined again
    kept = kept.withColumn("kind", F.when(F.col("kind") == "list", F.lit("list")).otherwise(F.lit("prose")))
    model = fitted(docs, sample)
    found = detect(kept, model).select("doc_id", F.array_distinct(F.col("parts.lang")).alias("langs"))
    labels = rows.select("doc_id", "label").distinct()
    both = found.join(labels, "doc_id").filter((F.size("langs") > 0) & (F.col("label").isNull() | ~F.array_contains("langs", F.col("label")) | (F.size("langs") > 1)))
    return both.select("doc_id", F.explode("langs").alias("lang")).distinct()
