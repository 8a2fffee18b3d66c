import random

import numpy as np
from conftest import rows

from pagemill.llm import languages
from pagemill.llm.text_kinds import Maker, Rule, as_case, induce, kind_rules, not_prose, with_kind
from pagemill.llm.text_stats import STATS, alternation, with_stats


def test_alternation_matches_exactly_the_words():
    import re

    words = ["de", "des", "der", "d", "la", "las"]
    p = re.compile(alternation(words))
    assert all(p.fullmatch(w) for w in words) and not any(p.fullmatch(w) for w in ("", "l", "dess", "da"))


def test_statistics_of_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "The cat of the house. It ran!"), (5, "x" * 200_000)], "id int, text string").selectExpr("*", "1 as visible_x")
    got = {r.id: r for r in with_stats(df).collect()}
    assert all(getattr(got[1], s) in (0, 0.0) for s in STATS if s not in ("repeat_share",))
    assert got[4].word_count == 7 and got[4].visible == 23 and got[4].common_share == 4 / 7
    assert got[5].long_token_share == 1


def test_rule_list_separates_and_becomes_sql(spark):
    r = np.random.default_rng(0)
    a = r.random(600)
    labels = np.where(a > 0.7, "table", "prose")
    rules = induce({"a": a, "b": r.random(600)}, labels)
    covered = np.any([k.covers({"a": a, "b": a}) for k in rules], axis=0)
    assert ((labels == "table") == covered).mean() > 0.97
    assert as_case([Rule("list", (("a", True, 0.5), ("b", False, 1.0)))]) == "CASE WHEN a >= 0.5D AND b < 1.0D THEN 'list' ELSE 'prose' END"
    assert as_case([]) == "'prose'"


def test_held_out_accuracy(spark):
    made = spark.createDataFrame(Maker(123).texts(400), "text string, label string")
    got = with_kind(made).select("label", "kind").collect()
    assert sum(r.label == r.kind for r in got) / len(got) > 0.93
    assert kind_rules(spark) == kind_rules(spark)


def test_not_prose_needs_length_and_counts_once(spark):
    table = "\n".join(f"Name{k};12,5;n/a;7%" for k in range(20))
    df = spark.createDataFrame([("a", table), ("a", table), ("b", "1;2;3"), ("c", None)], "k string, text string")
    assert rows(not_prose(df, [df.k])) == [("a", "table")]


SENTENCES = {
    "en": "the council of the town was asked for a report that nobody had read before",
    "fr": "le conseil de la ville a demandé un rapport que personne ne voulait lire pour les autres",
    "de": "der Rat der Stadt wurde um einen Bericht gebeten den niemand vorher gelesen hatte und wollte",
    "es": "el consejo de la ciudad pidió un informe que nadie había leído con los otros por favor",
    "it": "il consiglio della città ha chiesto un rapporto che nessuno aveva letto con gli altri nel mese",
    "pt": "o conselho da cidade pediu um relatório que ninguém tinha lido com os outros na semana não",
    "nl": "het bestuur van de stad werd gevraagd om een verslag dat niemand van tevoren gelezen had voor ons",
}


def said(r, code, n):
    w = SENTENCES[code].split()
    return " ".join(" ".join(r.sample(w, 10)).capitalize() + "." for _ in range(n))


def test_languages_with_wrong_labels_and_mixtures(spark):
    r = random.Random(4)
    data = []
    for k in range(280):
        code = list(SENTENCES)[k % 7]
        data.append((k, said(r, code, 4), code if r.random() > 0.1 else "en"))
    clean = {k: list(SENTENCES)[k % 7] for k in range(280)}
    mixed = [(1000, said(r, "en", 3) + " " + said(r, "de", 3), "en"), (1001, said(r, "fr", 4).upper(), None), (1002, said(r, "es", 4), "spa"), (1003, None, "en"), (1004, "", None), (None, said(r, "en", 3), "fr")]
    df = spark.createDataFrame(data + mixed + data[:3], "doc_id bigint, text string, lang string")
    got = {}
    for d, l in languages.mislabelled(df).collect():
        got.setdefault(d, set()).add(l)
    assert got[1000] == {"en", "de"} and got[1001] == {"fr"} and 1002 not in got and 1003 not in got and 1004 not in got
    wrong = {d for d, _, l in data if l != clean[d]}
    assert len(wrong ^ {d for d in got if d < 1000}) <= 3


def test_label_spellings(spark):
    df = spark.createDataFrame([(x,) for x in ("EN", "en-GB", "eng", " Deutsch ", "Français", "??", "und", "", None, "sv", "pt_BR")], "x string")
    got = [r[0] for r in df.select(languages.label_key(df.x)).collect()]
    assert got == ["en", "en", "en", "de", "fr", None, None, None, None, "?", "pt"]


def test_quotes_and_entries():
    assert languages.units("He said “das ist gut. Sehr gut.” twice. Then left.", False) == ["He said   twice.", "Then left."]
    assert languages.units("a b\n\nc d", True) == ["a b", "c d"]
