import random
from collections import Counter

import numpy as np
from conftest import rows

from pagemill.llm import cross_split
from pagemill.llm.cross_split import SHARED, SLOTS, Block, Counts, _bags, _numbered, _parities, alike, chosen_paths, cross_split_pairs, near, numbers, overlap_report, recurring
from pagemill.llm.textcodes import mix

T, E = "development_tune", "locked_test"


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_recurring_words_are_the_common_subsequence():
    r = random.Random(1)
    for _ in range(50):
        a, b = ([r.randrange(6) for _ in range(r.randrange(0, 30))] for _ in range(2))
        assert recurring(a, b) == lcs(a, b)


def test_numbers_however_grouped():
    assert numbers("57 973 777 and 1,234.5") == numbers("1234.5, 57,973,777") == (5, 1234, 57973777)
    assert numbers("in 2019 345 cases") == (345, 2019)


def test_bags_lose_no_pair():
    r = random.Random(3)
    texts = [[r.randrange(1, 200) if r.random() < 0.9 else 7 for _ in range(r.choice([3, 20, 60, 90, 130, 400]))] for _ in range(60)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    bags = _bags(mix(np.array(sum(texts, []), np.uint64)), first)
    pairs = [(i, j) for i in range(60) for j in range(60)]
    common = np.array([sum((Counter(texts[i]) & Counter(texts[j])).values()) for i, j in pairs])
    assert alike([bags[i] for i, _ in pairs], [bags[j] for _, j in pairs], common).all()
    assert not alike([bags[i] for i, _ in pairs], [bags[j] for _, j in pairs], common + 60).all()


def test_questions_and_pages_against_brute_force(spark):
    r = random.Random(9)
    vocab = [f"w{k}" for k in range(400)]
    common = [f"c{k}" for k in range(12)]

    def text(n):
        return [r.choice(common) if r.random() < 0.5 else r.choice(vocab) for _ in range(n)]

    def damaged(w, share):
        out = []
        for x in w:
            u = r.random()
            out += [] if u < share / 3 else [x, r.choice(vocab)] if u < 2 * share / 3 else [r.choice(vocab)] if u < share else [x]
        return out

    pages, files = [], []
    for d in range(30):
        files.append((f"d{d}", T if d % 2 else E, f"s{d % 3}"))
        for p in range(1, 5):
            w = text(r.randrange(10, 90))
            if pages and r.random() < 0.5:
                w = damaged(r.choice(pages)[2].lower().split(), r.choice([0, 0.05, 0.15, 0.6]))
            pages.append((f"d{d}", p, " ".join(w).upper()))
    pages += pages[:5] + [("d0", 9, None), ("d1", 9, ""), (None, 1, "x"), ("nowhere", 1, pages[0][2])]
    questions = [(f"q{k}::1", T if k % 2 else E, f"what of the {r.choice([1000, 25])} things " + " ".join(text(12)), "s") for k in range(40)]
    questions += [(f"z{k}::1", E, questions[2 * k + 1][2].replace("1000", "1,000").upper() + "?", "s") for k in range(8)]
    questions += [("n1::1", T, "no figure here at all my dear friend", "s"), ("n2::1", E, "No figure here at all, my dear friend!", "s"), ("n3::1", E, None, "s"), (None, T, "x", "s")]
    q = spark.createDataFrame(questions, "question_id string, split string, question string, source string")
    p = spark.createDataFrame(pages, "doc_id string, page int, text string").selectExpr("*", "1 as id", "2 as side")
    f = spark.createDataFrame(files, "id string, split string, source string")
    got = {tuple(x) for x in cross_split_pairs(q, p, f).collect()}
    side = {d: s for d, s, _ in files}
    want = set()
    own = {(d, n): (t or "").split() for d, n, t in pages if d in side}
    for (d1, n1), a in own.items():
        for (d2, n2), b in own.items():
            if side[d1] == T and side[d2] == E and min(len(a), len(b)) >= 20 and lcs(a, b) >= 0.7 * max(len(a), len(b)):
                want.add(("page", *sorted((f"{d1}::p{n1}", f"{d2}::p{n2}"))))
    import re

    split = [(k, s, re.findall(r"\w+", t.lower().replace(",000", "000"))) for k, s, t, _ in questions if k and t]
    for k1, s1, a in split:
        for k2, s2, b in split:
            if s1 == T and s2 == E and sorted(x for x in a if x.isdigit()) == sorted(x for x in b if x.isdigit()) and lcs(a, b) >= 0.75 * max(len(a), len(b)):
                want.add(("question", *sorted((k1, k2))))
    assert got == want and any(u == "page" for u, _, _ in want) and ("question", "n1::1", "n2::1") in want
    report = overlap_report(spark.createDataFrame(sorted(got), "unit string, key_a string, key_b string"), q, f)
    assert sum(r.records for r in report.collect()) == len({(u, k) for u, a, b in got for k in (a, b)})


def test_copies_of_one_page_on_both_sides(spark):
    t = " ".join(f"word{k}" for k in range(40))
    p = spark.createDataFrame([(d, n, t) for d in ("a", "b") for n in range(1, 30)], "doc_id string, page int, text string")
    f = spark.createDataFrame([("a", T), ("b", E)], "id string, split string")
    q = spark.createDataFrame([], "question_id string, split string, question string")
    assert cross_split_pairs(q, p, f).count() == 29 * 29
    assert cross_split_pairs(q, p.limit(0), f).count() == 0


def _page_pairs(spark, pages):
    """The pairs of pages (file, side, number, words) as found and as by brute force."""
    p = spark.createDataFrame([(d, k, " ".join(w)) for d, _, k, w in pages], "doc_id string, page int, text string")
    f = spark.createDataFrame(sorted({(d, s) for d, s, _, _ in pages}), "id string, split string")
    q = spark.createDataFrame([], "question_id string, split string, question string")
    code = {}
    own = [(f"{d}::p{k}", s, [code.setdefault(x, len(code)) for x in w]) for d, s, k, w in pages]
    want = {tuple(sorted((a, b))) for a, s, x in own for b, t, y in own if s == T and t == E and recurring(x, y) >= 0.7 * max(len(x), len(y)) - 1e-9}
    return {(r.key_a, r.key_b) for r in cross_split_pairs(q, p, f).collect()}, want


def _worn(r, words, share, mark):
    """The words with this share of them replaced by words that are nowhere else."""
    at = set(r.sample(range(len(words)), round(share * len(words))))
    return [f"{mark}x{k}" if k in at else w for k, w in enumerate(words)]


def test_pairs_with_70_to_85_percent_of_the_words(spark):
    r = random.Random(4)
    common, rare = [f"c{k}" for k in range(300)], [f"r{k}" for k in range(5000)]
    pages = []
    for k in range(240):
        w = [r.choice(rare) if r.random() < 0.03 else r.choice(common) for _ in range(250)]
        pages += [("a", T, k, w), ("b", E, k, _worn(r, w, (0.3, 0.25, 0.2, 0.15)[k % 4], f"e{k}"))]
    got, want = _page_pairs(spark, pages)
    assert got == want and len(want) >= 240


def test_no_pair_at_the_threshold_is_lost(spark):
    """Short pages with evenly spread damage share few runs of words, pages of one template little else than frequent ones."""
    r = random.Random(12)
    template = [f"t{k}" for k in range(42)]
    pages = []
    for k in range(500):
        w = [f"w{r.randrange(300)}" for _ in range(r.randrange(20, 60))]
        m = int(0.3 * len(w) + 1e-9)
        at = {j * len(w) // m for j in range(m)}
        pages += [("a", T, k, w), ("b", E, k, [f"e{k}x{j}" if j in at else x for j, x in enumerate(w)])]
    for k in range(500, 540):
        pages += [(s[0], s, k, [f"{s[0]}{k}x{j // 10}" if j % 10 in (2, 5, 8) else template[j % 42] for j in range(60)]) for s in (T, E)]
    got, want = _page_pairs(spark, [(d[0], s, k, w) for d, s, k, w in pages])
    assert got == want and len(want) >= 500 + 40 * 40


def test_parities_lose_no_pair():
    r = random.Random(13)
    texts = [[r.randrange(1, 400) for _ in range(r.choice([1, 20, 22, 40, 44, 90, 130]))] for _ in range(60)]
    for k in range(60):
        w = list(texts[k])
        for j in r.sample(range(len(w)), int(0.3 * len(w))):
            w[j] = r.randrange(1000, 9999)
        texts.append(w)
    texts.sort(key=len)

    def block(own):
        first = np.concatenate([[0], np.cumsum([len(t) for t in own])])
        code = mix(np.array(sum(own, []), np.uint64))
        short = (code >> np.uint64(32)).astype(np.uint32)
        n = np.diff(first)
        row = {"ids": np.arange(len(own)), "ns": n.astype(np.int32), "nums": 0 * n, "words": short, "marks": _numbered(short, first)}
        return Block({k: x.tobytes() for k, x in row.items()} | {"bits": b"".join(_parities(code, first))})

    widths = {}
    for t in texts:
        widths.setdefault(max(64, 1 << (3 * len(t) - 1).bit_length()), []).append(t)
    lost = kept = every = 0
    for a in widths.values():
        for b in widths.values():
            found = {(k, j) for k, hits in near(block(a), block(b), 0.7) for j in hits.tolist()}
            want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if sum((Counter(x) & Counter(y)).values()) >= 0.7 * max(len(x), len(y)) - 1e-9}
            lost, kept, every = lost + len(want - found), kept + len(found), every + len(a) * len(b)
    assert not lost and kept < every / 4


def test_maps_lose_no_pair_and_leave_few_to_compare(monkeypatch):
    """Pages of the phrases of one language, some with the threshold's damage: other pages are told apart by the maps alone."""
    r = random.Random(14)
    phrases = [[r.randrange(1, 300) if r.random() < 0.5 else r.randrange(300, 2000) for _ in range(r.randrange(3, 8))] for _ in range(400)]
    sides = [[sum((r.choice(phrases) for _ in range(r.randrange(8, 40))), []) for _ in range(n)] for n in (700, 60)]
    for k in range(60):
        w = list(sides[0][10 * k])
        for j in r.sample(range(len(w)), int(0.3 * len(w))):
            w[j] = r.randrange(10000, 99999)
        sides[1].append(w)
    blocks = []
    for own in sides:
        own.sort(key=len)
        first = np.concatenate([[0], np.cumsum([len(t) for t in own])])
        short = (mix(np.array(sum(own, []), np.uint64)) >> np.uint64(32)).astype(np.uint32)
        n = np.diff(first)
        blocks.append(Block({k: x.tobytes() for k, x in {"ids": np.arange(len(own)), "ns": n.astype(np.int32), "nums": 0 * n, "words": short, "marks": _numbered(short, first)}.items()}))
    passed = []
    own = cross_split.Maps.passing
    monkeypatch.setattr(cross_split.Maps, "passing", lambda *x: passed.append(own(*x)) or passed[-1])
    monkeypatch.setattr(cross_split, "SMALL", 0)
    found = {(k, j) for k, hits in near(blocks[1], blocks[0], 0.7) for j in hits.tolist()}
    want = {(i, j) for i, x in enumerate(sides[1]) for j, y in enumerate(sides[0]) if sum((Counter(x) & Counter(y)).values()) >= 0.7 * max(len(x), len(y)) - 1e-9}
    assert want <= found and len(want) >= 60 and sum(len(k) for k, _ in passed) < 0.01 * len(sides[0]) * len(sides[1])


def test_several_hundred_near_copies_on_both_sides(spark):
    r = random.Random(5)
    w = [f"w{r.randrange(2000)}" for _ in range(250)]
    pages = [(s[0], s, k, _worn(r, w, 0.1, f"{s[0]}{k}")) for s in (T, E) for k in range(150)]
    got, want = _page_pairs(spark, pages)
    assert got == want and len(want) == 150 * 150


def _recall(pages, damaged):
    """Share of damaged pages that stay candidates of their originals, with counts of all pages."""
    flat = lambda x: (np.concatenate([np.array(p, np.uint64) for p in x]), np.concatenate([[0], np.cumsum([len(p) for p in x])]))
    code, _ = flat(pages + [d for d in damaged if d is not None])
    counts = Counts(np.bincount((code & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS), len(pages))
    at = [k for k, d in enumerate(damaged) if d is not None]
    sets = []
    for part in ([pages[k] for k in at], [damaged[k] for k in at]):
        c, f = flat(part)
        codes, of = chosen_paths(c, f, counts.bits(c), counts)
        sets.append([set(codes[of == k].tolist()) for k in range(len(at))])
    return sum(len(a & b) >= max(1, int(SHARED * min(len(a), len(b)))) for a, b in zip(*sets)) / len(at)


def test_recall_by_damage_and_size_of_the_corpus():
    for size in (1000, 8000):
        r = np.random.default_rng(size)
        vocabulary = mix(np.arange(1, 20001, dtype=np.uint64))
        weight = 1 / np.arange(3, 20003)
        pages = [vocabulary[r.choice(20000, n, p=weight / weight.sum())] for n in r.integers(60, 400, size)]
        for share in (0.1, 0.15, 0.2, 0.25, 0.28):
            for spread in (False, True):
                damaged = [None] * size
                for k in range(300):
                    p = pages[k].copy()
                    m = int(share * len(p))
                    at = (np.arange(m) * len(p) / m).astype(int) if spread else r.choice(len(p), m, replace=False)
                    p[at] = vocabulary[r.choice(20000, m, p=weight / weight.sum())]
                    damaged[k] = p
                assert _recall(pages, damaged) >= 0.95, (size, share, spread)
