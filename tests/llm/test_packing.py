import random

from pagemill.llm.packing import default_tokenizer, fill, pack, packed, token_counts


def test_containers_hold_every_item_once_and_never_too_much():
    r = random.Random(1)
    sizes = [r.randrange(1, 100) for _ in range(500)]
    got = pack(sizes, 100)
    assert sorted(i for c in got for i in c) == list(range(500))
    assert all(sum(sizes[i] for i in c) <= 100 for c in got)
    assert len(got) <= sum(sizes) / 100 * 1.02 + 1


def test_fill_finds_the_exact_sum():
    assert next(fill({60: 1, 39: 1, 25: 1, 15: 1}, 100)) == ([(15, 1), (25, 1), (60, 1)], 1)
    assert list(fill({}, 10)) == []
    assert list(fill({5: 4}, 10)) == [([(5, 2)], 2)]


def test_round_trip(spark):
    text = "word and more " * 60
    data = [(k, text[: 7 * k]) for k in range(120)] + [(500, text * 4), (1, text[:7]), (None, text), (600, None), (601, "")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "1 as piece", "2 as container")
    got = packed(df, 64).collect()
    want = {r.doc_id: r.tokens for r in token_counts(df, default_tokenizer()).collect() if r.tokens}
    have, room = {}, {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
        room[r.container] = room.get(r.container, 0) + r.tokens
    assert {d: sum(n for _, n in p) for d, p in have.items()} == want
    for d, p in have.items():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:]))
        assert len(p) == -(-want[d] // 64)
    assert max(room.values()) <= 64 and len(room) <= sum(want.values()) / 64 + 2
    assert packed(df.limit(0), 64).count() == 0
