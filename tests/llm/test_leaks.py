import random

import numpy as np
from conftest import rows

from pagemill.llm.leaks import leaked, stretch, tiles


def words(r, n):
    return [r.choice("abcdefghij") + str(r.randrange(10_000)) for _ in range(n)]


def test_tiles_cover_reordered_parts_without_overlap():
    a = np.arange(20, dtype=np.uint64)
    b = np.concatenate([a[10:], np.array([99], np.uint64), a[:10]])
    assert tiles(a, b) == [(0, 11, 10), (10, 0, 10)]
    assert tiles(a, np.array([5, 5, 5], np.uint64)) == []


def test_repeated_words_are_used_once():
    a = np.array([1, 1, 1, 1], np.uint64)
    assert sum(t[2] for t in tiles(a, np.array([1, 1, 1, 1, 1, 1], np.uint64))) <= 4


def brute(item, doc):
    """Whether some stretch of the item is in the document with few enough errors, by trying all of them."""
    n = len(item)
    need = min(24, n)
    for s in range(n - need + 1):
        prev = [0] * (len(doc) + 1)
        for k, x in enumerate(item[s:], 1):
            cur = [k]
            for j, y in enumerate(doc, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
            if k >= need and min(cur) * 12 <= k:
                return True
    return False


def test_against_brute_force(spark):
    r = random.Random(7)
    items = {k: words(r, n) for k, n in enumerate([40, 24, 26, 13, 9, 4, 60])}
    docs = {}
    for d in range(80):
        k = r.randrange(7)
        it = list(items[k])
        take = it[: r.randrange(10, 41)] if len(it) > 24 and r.random() < 0.6 else it
        for _ in range(r.randrange(0, 5)):
            p = r.randrange(len(take))
            take = r.choice([take[:p] + take[p + 1 :] or take, take[:p] + words(r, 1) + take[p + 1 :], take[:p] + words(r, 1) + take[p:]])
        docs[d] = words(r, r.randrange(0, 30)) + take + words(r, r.randrange(0, 30))
    di = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id bigint, text string")
    dd = spark.createDataFrame([(k, ", ".join(w).upper()) for k, w in docs.items()], "doc_id bigint, text string")
    want = sorted((k, d) for k, i in items.items() for d, t in docs.items() if brute(i, t))
    assert rows(leaked(dd, di), "item_id", "doc_id") == want


def test_form_does_not_matter_and_edges(spark):
    item = "Straße und Café " + " ".join(f"w{k}" for k in range(10))
    di = spark.createDataFrame([(1, item), (2, ""), (3, None), (None, item)], "item_id bigint, text string")
    dd = spark.createDataFrame([(1, "x STRASSE; und\nCafé " + " - ".join(f"W{k}" for k in range(10))), (2, None), (3, ""), (None, item), (4, item[:-3])], "doc_id bigint, text string")
    assert rows(leaked(dd, di), "item_id", "doc_id") == [(1, 1), (1, 4)]
    assert leaked(dd, di.limit(0)).count() == 0 and leaked(dd.limit(0), di).count() == 0


def test_near_misses():
    a = np.arange(100, 160, dtype=np.uint64)
    b = a.copy()
    b[::4] = 0  # every fourth word differs
    assert not stretch(a, b, tiles(a, b))
    c = a[:26].copy()
    c[[5, 15]] = 0
    assert stretch(a, c, tiles(a, c))
