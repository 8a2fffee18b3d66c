"""What a text is for the larger part: prose, list, table or junk.

An ordered rule list is induced by incremental reduced-error pruning (one rule after the other is grown on
two thirds of the labelled texts and pruned on the rest) over the statistics of ``text_stats``. The learned
thresholds become a SQL CASE expression, so applying the rules is a projection; statistics that no rule
asks for are never computed.

The labelled texts are made here, ``LABELLED`` of them from a seed, because no table carries such labels:
texts of each kind in seven languages' function words and invented content words, wrapped, in capitals,
mixed with parts of another kind; the label is the kind of the larger part.

Defined results: null and empty texts are prose without a word; texts under ``LEAST`` visible characters
are never reported; rows delivered twice count once.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.text_stats import COMMON, with_stats

LEAST = 100
#: Number of labelled texts the rules are induced from.
LABELLED = 2000
#: Held-out texts of its kind that a rule must cover to be kept.
SUPPORT = 6
KINDS = ("junk", "table", "list")
#: Statistics the rules may use.
ASKED = ("mean_word_length", "letter_share", "common_share", "sentences_per_100", "table_share", "entry_share")


class Maker:
    """Makes labelled texts from a seed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice(["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "st", "gr", "pl", "br"]) + r.choice("aeiou") for _ in range(r.randint(1, 4))) + r.choice(["", "n", "r", "l", "s", "m"])

    def number(self) -> str:
        r = self.r
        return r.choice([str(r.randint(1980, 2025)), f"{r.randint(1, 999)},{r.randint(0, 999):03}", f"{r.randint(0, 99)}.{r.randint(0, 9)}", str(r.randint(1, 99))])

    def phrase(self, n: int, common: float = 0.36) -> list[str]:
        r = self.r
        return [r.choice(COMMON) if r.random() < common else self.word() for _ in range(n)]

    def sentence(self) -> str:
        r = self.r
        w = self.phrase(r.randint(8, 24))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            w.insert(r.randrange(1, len(w)), self.number())
        for _ in range(r.choice([0, 1, 1, 2])):
            k = r.randrange(len(w) - 1)
            w[k] += r.choice([",", ",", ";"])
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randrange(len(w))
            w[k] = w[k].capitalize()
        s = " ".join(w)
        return s[0].upper() + s[1:] + r.choice([".", ".", ".", ".", "?", "!"])

    def wrap(self, s: str, width: int) -> str:
        out, line = [], ""
        for w in s.split(" "):
            if line and len(line) + len(w) + 1 > width:
                out.append(line)
                line = w
            else:
                line = f"{line} {w}".strip()
        return "\n".join([*out, line])

    def prose(self, least: int) -> str:
        r = self.r
        width, lines = r.choice([0, 0, 36, 50, 66, 75, 90]), r.random() < 0.2
        paras: list[str] = []
        while sum(map(len, paras)) < least:
            s = [self.sentence() for _ in range(r.randint(1, 6))]
            if r.random() < 0.06:  # a passage full of names and figures is prose still
                s = [" ".join(x if r.random() < 0.6 else r.choice([self.word().capitalize(), f"({self.word().capitalize()}, {r.randint(100, 9999)})", self.number()]) for x in p.split()) for p in s]
            paras.append(("\n" if lines else " ").join(self.wrap(x, width) if width else x for x in s) if lines else (self.wrap(" ".join(s), width) if width else " ".join(s)))
        text = ("\n\n" if r.random() < 0.7 else "\n").join(paras)
        return text.upper() if r.random() < 0.08 else text

    def entries(self, least: int) -> str:
        r = self.r
        style = r.choice(["• ", "- ", "– ", "* ", "n. ", "a) ", "n.m ", "n.m  ", "", "", "dots", "mixed"])
        end, often = r.choice(["", "", "", ";", ","]), r.choice([0.05, 0.12, 0.3])
        out: list[str] = []
        while sum(map(len, out)) < least or len(out) < 4:
            k = len(out)
            s = " ".join([r.choice(["the", "la", "der", "il", "o", "de", "el", "le"]), *self.phrase(r.randint(2, 8), often)])
            if r.random() < 0.25:
                s += f", {r.choice([self.number(), self.word().capitalize()])}"
            cap = s[0].upper() + s[1:]
            if style == "dots":
                out.append(f"{cap} {'.' * r.randint(5, 40)} {3 * k + 1}")
            elif style == "mixed":
                out.append(r.choice([f"– {s};", f"{self.word().capitalize()}, {s}"]))
            else:
                mark = {"n. ": f"{k + 1}. ", "a) ": f"{chr(97 + k % 26)}) ", "n.m ": f"{k // 6 + 1}.{k % 6 + 1} ", "n.m  ": f"{k // 6 + 1}.{k % 6 + 1}  "}.get(style, style)
                out.append(mark + (s if mark.strip() and r.random() < 0.4 else cap) + end)
        return "\n".join(out)

    def value(self) -> str:
        r = self.r
        return r.choice(["n/a", f"({r.randint(1, 999)})", f"{r.randint(0, 99)}.{r.randint(0, 9)}", f"{r.randint(1, 99)}%", f"{r.randint(1, 99)},{r.randint(0, 999):03}", "–", str(r.randint(1, 999))])

    def table(self, least: int) -> str:
        r = self.r
        cols, form = r.randint(2, 7), r.choice([";", "\t", " | ", "wide", " ", "/", "down", "|"])
        years = [str(r.randint(1990, 1999) + k) for k in range(cols)]
        rows = [("", years)]
        while sum(len(a) + 6 * len(b) for a, b in rows) < least or len(rows) < 4:
            rows.append((" ".join(self.word().capitalize() for _ in range(r.choice([1, 1, 1, 2]))), [self.value() for _ in years]))
        if form == "wide":
            return "\n".join(f"{a:<20}" + "".join(f"{v:>10}" for v in b) for a, b in rows)
        if form == "/":
            return "\n".join(f"{a or '-'}: {' / '.join(b)}" for a, b in rows)
        if form == "down":
            return "\n".join(x for a, b in rows for x in ([a] if a else []) + b)
        if form == "|":
            return "\n".join(f"| {' | '.join([a, *b])} |" for a, b in rows)
        return "\n".join(form.join([a, *b] if a or form != " " else b) for a, b in rows)

    def junk(self, least: int) -> str:
        r = self.r
        form = r.choice(["signs", "codes", "moji", "mute", "base", "same", "specks"])
        same, map_ = self.word().capitalize() + "n", dict(zip("bdfgklmnprstvae", r.sample([chr(c) for c in [*range(0xA1, 0xC0), *range(0xC2, 0xC6), 0x152, 0x153, 0x17E, 0x192, 0x2DC, 0x2122, 0x20AC, 0xFFFD]], r.randint(11, 15))))
        piece = {
            "signs": lambda: "".join(r.choice("+|[=&/:\"@{;>^]~#$%*<_\\. ") for _ in range(r.randint(20, 70))),
            "codes": lambda: "".join(f"(cid:{r.randint(1, 255)})" for _ in range(r.randint(4, 12))),
            "moji": lambda: " ".join("".join(map_.get(c, c) for c in self.word()) for _ in range(r.randint(4, 9))),
            "mute": lambda: " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(2, 10))) for _ in range(r.randint(3, 8))),
            "base": lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(r.randint(24, 70))),
            "same": lambda: " ".join([same] * r.randint(4, 11)),
            "specks": lambda: " ".join(r.choice([".", ",", ":", "'", "~", "_", "1", "l", "I", "ii", "rn", "o", "v", "0", "ll"]) + r.choice(["", "", ".", "0", "l"]) for _ in range(r.randint(8, 20))),
        }[form]
        out: list[str] = []
        while sum(map(len, out)) < least:
            out.append(piece())
        return "\n".join(out)

    def texts(self, n: int) -> list[tuple[str, str]]:
        r, out = self.r, []
        of = {"prose": self.prose, "list": self.entries, "table": self.table, "junk": self.junk}
        for k in range(n):
            kind = ("prose", "list", "table", "junk")[k % 4]
            size = int(120 * math.exp(r.random() * 2.6))
            parts = [(kind, of[kind](size))]
            if r.random() < 0.35:
                other = r.choice(["list", "table"]) if kind == "prose" else "prose"
                share = r.choice([0.15, 0.25, 0.4, 0.65, 0.75])
                extra = of[other](max(80, int(size * share)))
                if abs(math.log(len(extra) / len(parts[0][1]))) > 0.25:
                    parts.insert(r.randrange(2), (other, extra))
            label = max(parts, key=lambda p: len(p[1]))[0]
            lines = [p[1] for p in parts]
            if r.random() < 0.55:
                lines.insert(0, " ".join([r.choice(["the", "la", "der", "de"])] * r.randint(0, 1) + self.phrase(r.randint(2, 6), 0.4)).capitalize())
            if r.random() < 0.3:
                lines.append(r.choice([f"p. {r.randint(1, 99)}", str(r.randint(1, 99)), f"- {r.randint(1, 99)} -"]))
            out.append((r.choice(["\n", "\n\n"]).join(lines), label))
        return out


@dataclass(frozen=True)
class Rule:
    """``kind`` if all conditions (statistic, whether at least, threshold) hold."""

    kind: str
    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        keep = np.ones(len(next(iter(x.values()))), bool)
        for name, above, at in self.conditions:
            keep &= (x[name] >= at) if above else (x[name] < at)
        return keep


def _grow(x: dict[str, np.ndarray], y: np.ndarray, kind: str) -> Rule:
    """Adds the condition of highest information gain until no other kind is covered."""
    rule, inside = Rule(kind, ()), np.ones(len(y), bool)
    while (inside & ~y).any() and len(rule.conditions) < 4:
        p0, n0 = (inside & y).sum(), (inside & ~y).sum()
        base, best = math.log2(p0 / (p0 + n0)), (0.0, None)
        for name, v in x.items():
            cuts = np.unique(np.quantile(v[inside], np.linspace(0, 1, 41)))
            for at in np.unique((cuts[1:] + cuts[:-1]) / 2).round(4):
                for above in (True, False):
                    keep = inside & ((v >= at) if above else (v < at))
                    p, n = (keep & y).sum(), (keep & ~y).sum()
                    if p and (gain := p * (math.log2(p / (p + n)) - base)) > best[0] + 1e-9:
                        best = (gain, (name, above, float(at)))
        if best[1] is None:
            break
        rule = Rule(kind, (*rule.conditions, best[1]))
        inside = rule.covers(x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> float:
    c = rule.covers(x)
    p, n = (c & y).sum(), (c & ~y).sum()
    return (p - n) / (p + n) if p + n else -1.0


def induce(x: dict[str, np.ndarray], labels: np.ndarray, kinds: tuple[str, ...] = KINDS, seed: int = 7) -> list[Rule]:
    """An ordered rule list by incremental reduced-error pruning; what no rule covers is prose."""
    rng, rules = np.random.default_rng(seed), []
    left = np.ones(len(labels), bool)
    for kind in kinds:
        for _ in range(12):
            pos = left & (labels == kind)
            if pos.sum() < 8:
                break
            grow = rng.random(len(labels)) < 2 / 3
            g, t = left & grow, left & ~grow
            if not (g & pos).any():
                break
            rule = _grow({k: v[g] for k, v in x.items()}, (labels == kind)[g], kind)
            xt, yt = {k: v[t] for k, v in x.items()}, (labels == kind)[t]
            ways = [Rule(kind, rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
            if not ways:
                break
            rule = max(ways, key=lambda w: (_worth(w, xt, yt), -len(w.conditions)))
            if _worth(rule, xt, yt) <= 0.5 or (rule.covers(xt) & yt).sum() < SUPPORT:
                break
            rules.append(rule)
            left &= ~rule.covers(x)
    return rules


def as_case(rules: list[Rule]) -> str:
    """The rule list as a SQL CASE expression over the statistics."""
    when = "".join(" WHEN " + " AND ".join(f"{n} {'>=' if above else '<'} {at!r}D" for n, above, at in r.conditions) + f" THEN '{r.kind}'" for r in rules)
    return f"CASE{when} ELSE 'prose' END" if when else "'prose'"


_learned: dict[tuple[int, int], str] = {}


def kind_rules(spark: SparkSession, labelled: int = LABELLED, seed: int = 11) -> str:
    """The CASE expression learned from ``labelled`` made texts."""
    if (labelled, seed) not in _learned:
        made = Maker(seed).texts(labelled)
        rows = with_stats(spark.createDataFrame(made, "text string, label string").coalesce(4), names=ASKED).select("label", *ASKED).collect()
        x = {k: np.array([r[k] for r in rows]) for k in ASKED}
        _learned[labelled, seed] = as_case(induce(x, np.array([r["label"] for r in rows])))
    return _learned[labelled, seed]


def with_kind(df: DataFrame, text: str = "text", labelled: int = LABELLED, also: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``kind`` (prose, list, table or junk) and the statistics ``also``."""
    rules = kind_rules(df.sparkSession, labelled)
    kept = df.columns
    asked = tuple(k for k in ASKED if re.search(rf"\b{k}\b", rules))
    return with_stats(df, text, (*also, *(k for k in asked if k not in also))).select(*kept, *also, F.expr(rules).alias("kind"))


def not_prose(df: DataFrame, keys: list[Column], text: str = "text") -> DataFrame:
    """Keys and kind of the texts whose larger part is no prose."""
    found = with_kind(df.select(*keys, F.col(text).alias("text")), also=("visible",))
    return found.filter((F.col("visible") >= LEAST) & (F.col("kind") != "prose")).drop("text", "visible").distinct()
