import random

from conftest import rows

from pagemill.llm.natural_cuts import cut_pages, cuts, ends_sentence, wrong_pieces

SIZES = [("dense_chunk", 40, 5)]


def greedy(words, size, overlap, closing):
    out, s = [], 0
    while True:
        if len(words) - s <= size:
            return [*out, (s, len(words))]
        e = s + size
        for k in range(e, e - closing, -1):
            if ends_sentence(words[k - 1]):
                e = k
                break
        out.append((s, e))
        s = e - overlap


def text(r, n):
    return [f"w{k}" + (r.choice([".", "?”", "!)"]) if r.random() < 0.15 else "") for k in range(n)]


def test_doubling_equals_the_greedy_walk():
    r = random.Random(2)
    texts = [text(r, n) for n in (0, 1, 80, 81, 500, 3000, 79, 200)]
    got = cuts(texts, 80, 15)
    assert got[0] == [(0, 0)]
    for t, g in zip(texts[1:], got[1:]):
        assert g == greedy(t, 80, 15, 25)


def test_sentence_ends():
    assert [ends_sentence(w) for w in ("a.", "a.”", "(a!)", ".", "a,", "1.5", "”")] == [True, True, True, True, False, False, False]


def limits(spark):
    return spark.createDataFrame(SIZES, "limit_name string, max_size int, overlap int")


def pages(spark, data):
    return spark.createDataFrame(data, "doc_id string, page int, text string")


def test_cut_pages_keep_every_word(spark):
    words = [f"w{k}" for k in range(100)]
    got = cut_pages(pages(spark, [("d", 1, "\n ".join(words)), ("d", 2, " "), ("d", 3, None), (None, 1, "x")]), limits(spark))
    parts = {(r.page, r.chunk_index): r.text for r in got.collect()}
    assert parts[2, 0] == "" and parts[3, 0] == ""
    own = [parts[1, k].split() for k in range(sum(p == 1 for p, _ in parts))]
    assert own[0] == words[:40] and all(b[:5] == a[-5:] for a, b in zip(own, own[1:])) and own[-1][-1] == "w99"


def test_each_kind_of_wrong_piece(spark):
    w = [f"w{k}" for k in range(30)] + ["end."] + [f"v{k}" for k in range(69)]
    good = [" ".join(w[s:e]) for s, e in cuts([w], 40, 5)[0]]
    base = [("d", 1, k, t) for k, t in enumerate(good)]

    def judged(chunks, page=" ".join(w)):
        c = spark.createDataFrame(chunks, "doc_id string, page int, chunk_index int, text string")
        return [r[2] for r in rows(wrong_pieces(pages(spark, [("d", 1, page), ("d", 1, page)]), c, limits(spark)))]

    assert judged(base + base[:1]) == []
    assert judged([("d", 1, 0, " ".join(w))]) == [0]  # too long
    assert judged([("d", 1, 0, "x" + good[0]), *base[1:]]) == [0]  # not at a word of the page
    assert judged([("d", 1, 0, good[0][1:]), *base[1:]]) == [0]
    assert judged(base[1:]) == [1]  # the first does not start the page
    assert judged(base[:-1]) == [len(base) - 2]  # the last does not end it
    assert judged([base[0], ("d", 1, 1, " ".join(good[1].split()[1:])), *base[2:]]) == [1]  # overlap
    early = [("d", 1, 0, " ".join(w[:40])), ("d", 1, 1, " ".join(w[35:70])), ("d", 1, 2, " ".join(w[65:]))]
    assert judged(early) == [0]  # passes a sentence end
    assert judged([("d", 1, 0, "anything")], " ") == []  # an empty page is not judged
    assert judged([]) == []


def test_against_brute_force_on_damaged_pieces(spark):
    r = random.Random(5)
    data, chunks, want = [], [], set()
    for d in range(60):
        w = text(r, r.randrange(1, 240))
        data.append((f"d{d}", 1, " ".join(w)))
        own = [" ".join(w[s:e]) for s, e in cuts([w], 40, 5)[0]]
        if r.random() < 0.5:
            k = r.randrange(len(own))
            own[k] = r.choice([own[k][2:], own[k][:-2], own[k] + " more", " ".join(own[k].split()[:-1])])
        chunks += [(f"d{d}", 1, k, t) for k, t in enumerate(own)]
        for k, t in enumerate(own):
            own_w, flat = t.split(), f" {' '.join(w)} "
            prev = own[k - 1].split() if k else None
            bad = not own_w or len(own_w) > 40 or f" {' '.join(own_w)} " not in flat
            bad |= k == 0 and not flat.startswith(f" {' '.join(own_w)} ") or k == len(own) - 1 and not flat.endswith(f" {' '.join(own_w)} ")
            bad |= prev is not None and own_w[:5] != prev[-5:]
            bad |= k < len(own) - 1 and bool(own_w) and not ends_sentence(own_w[-1]) and any(map(ends_sentence, own_w[-25:]))
            if bad:
                want.add((f"d{d}", 1, k))
    c = spark.createDataFrame(chunks, "doc_id string, page int, chunk_index int, text string")
    assert set(rows(wrong_pieces(pages(spark, data), c, limits(spark)))) == want
