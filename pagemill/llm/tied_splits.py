"""Splits that keep related records together.

Records and the keys they share (document, author) form a bipartite graph. Its components come from
alternating large-star and small-star steps (each a grouped minimum and a join, a number of rounds that
grows with the logarithm of the graph). Components are then bundled by size and by the split most of
their records have now; a min-cost flow from the bundles to the splits meets the quotas with as few moved
records as possible, is rounded to whole components, and a hash order says which components of a bundle
go where. The bundles on the driver are few: component sizes that differ are at most the square root of
twice the number of records.

Defined results: rows with a null record id are ignored; null, blank and placeholder keys tie nothing;
repeated rows change nothing; a record without keys is a component by itself; empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.folding import fold
from pagemill.operators.storage import stored

#: Spellings that stand for no author.
NO_AUTHOR = ("", "-", "--", "?", "??", "n/a", "na", "none", "null", "unknown", "anonymous", "anon", "tbd", "unbekannt", "inconnu")
#: Parts of each bundle in which components are ranked, so no bundle is ranked in one task.
RANK_PARTS = 1024


def document_key(col: Column) -> Column:
    """A document id however spelled: letters and digits only, without prefix or file ending; null if nothing is left."""
    low = F.regexp_replace(F.lower(F.trim(col)), r"\.[a-z]{2,4}$", "")
    bare = F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}]+", ""), r"^(urn)?(uuid)?", "")
    return F.when(bare != "", bare)


def author_key(col: Column) -> Column:
    """A name but for case, spacing, accents and closing punctuation; null for placeholders."""
    name = F.regexp_replace(fold(col), r"[\s  -​ 　]+", " ")
    name = F.trim(name)
    bare = F.regexp_replace(F.regexp_replace(name, r"[\s.,;:!?]+$", ""), r" ", "")
    return F.when(~name.isin(*NO_AUTHOR) & ~bare.isin(*NO_AUTHOR), bare)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of the undirected graph with string columns ``a`` and ``b``; root is the smallest node."""
    cur = stored(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "cc-edges")
    last = None
    while True:
        sym = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = sym.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = stored(large, "cc-large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        cur = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc-small")
        mark = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if mark == last:
            break
        last = mark
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))


def record_groups(rows: DataFrame) -> DataFrame:
    """``question_id, group_id, size``: the component of each question; group_id is its smallest question_id."""
    q = rows.filter(F.col("question_id").isNotNull()).select("question_id", "doc_id", "author")
    keys = q.select(
        "question_id",
        F.explode(
            F.array(
                F.concat(F.lit("d:"), document_key(F.col("doc_id"))),
                F.concat(F.lit("d:"), document_key(F.regexp_extract("question_id", r"^(.*?)::", 1))),
                F.concat(F.lit("a:"), author_key(F.col("author"))),
            )
        ).alias("key"),
    ).filter(F.col("key").isNotNull()).distinct()
    linked = components(keys.select(F.concat(F.lit("q:"), "question_id").alias("a"), F.col("key").alias("b")))
    roots = linked.filter(F.col("node").startswith("q:")).select(F.expr("substring(node, 3)").alias("question_id"), "root")
    ids = q.select("question_id").distinct().join(roots, "question_id", "left").withColumn("root", F.coalesce("root", F.concat(F.lit("q:"), "question_id")))
    ids = stored(ids, "cc-members")
    names = ids.groupBy("root").agg(F.min("question_id").alias("group_id"), F.count("*").alias("size"))
    return ids.join(names, "root").select("question_id", "group_id", "size")


class _Movers:
    """Bundles with units in each split, by the split they are in now, smallest name first; a move's price follows from these two."""

    def __init__(self, splits: list[str], keep: dict, sent: dict):
        self.splits, self.keep, self.sent = splits, keep, sent
        self.heaps: dict = {}

    def put(self, bundle, split: str) -> None:
        own = self.keep.get(bundle)
        heapq.heappush(self.heaps.setdefault((split, own if own in self.splits else None), []), (str(bundle), bundle))

    def _head(self, split: str, own):
        heap = self.heaps.get((split, own), [])
        while heap and self.sent[heap[0][1]][split] <= 0:
            heapq.heappop(heap)
        return heap[0] if heap else None

    def cheapest(self, s: str, t: str):
        """``(price, name, bundle)`` of the cheapest unit that goes from ``s`` to ``t``; none if there is no unit."""
        rest = [h for own in (*self.splits, None) if own not in (s, t) and (h := self._head(s, own))]
        for price, head in ((-1, self._head(s, t)), (0, min(rest, default=None)), (1, self._head(s, s))):
            if head:
                return (price, *head)
        return None


def flow(supply: dict, quota: dict[str, float], keep: dict) -> dict:
    """Units of each bundle for each split by successive shortest paths.

    supply: units of each bundle; quota: units wanted of each split; keep: the split a bundle is in now.
    Moving a unit costs 1, a unit beyond a quota 3. Time grows with the number of bundles times its logarithm.
    """
    splits = sorted(quota)
    total = sum(supply.values())
    room, base = {}, 0
    for s in splits:
        room[s] = int(quota[s])
        base += room[s]
    for s in sorted(splits, key=lambda s: (room[s] - quota[s], s))[: max(0, total - base)]:
        room[s] += 1
    sent = {b: dict.fromkeys(splits, 0) for b in supply}
    movers = _Movers(splits, keep, sent)
    cost = lambda b, s: 0 if keep.get(b) == s else 1

    def add(b, s: str, n: int) -> None:
        if sent[b][s] == 0 and n > 0:
            sent[b][s] = n
            movers.put(b, s)
        else:
            sent[b][s] += n

    for b in sorted(supply, key=lambda b: (-supply[b], str(b))):
        left = supply[b]
        while left > 0:
            # cheapest way from b to a split with room: directly, or by moving units of other bundles on
            dist = {s: (cost(b, s), None, None) for s in splits}
            moves = {(s, t): movers.cheapest(s, t) for s in splits for t in splits if s != t}
            for _ in splits:
                for (s, t), d in moves.items():
                    if d and dist[s][0] + d[0] < dist[t][0]:
                        dist[t] = (dist[s][0] + d[0], s, d[2])
            ends = [(dist[s][0] + (0 if room[s] > 0 else 3), s) for s in splits]
            _, end = min(ends)
            path, s = [], end
            while dist[s][1] is not None:
                path.append((dist[s][2], dist[s][1], s))
                s = dist[s][1]
            amount = min([left, *([room[end]] if room[end] > 0 else []), *(sent[x][f] for x, f, _ in path)])
            add(b, s, amount)
            for x, f, t in path:
                add(x, f, -amount)
                add(x, t, amount)
            if room[end] > 0:
                room[end] -= amount
            left -= amount
    return sent


def whole(bundles: list[tuple[tuple, int, int]], sent: dict, quota: dict[str, float]) -> dict:
    """Components of each bundle for each split: the flow rounded down, the rest to the split that lacks most."""
    given, have = {}, dict.fromkeys(sorted(quota), 0)
    rest = []
    for b, size, count in bundles:
        given[b] = {s: sent[b][s] // size for s in have}
        for s in have:
            have[s] += given[b][s] * size
        rest += [(size, b)] * (count - sum(given[b].values()))
    for size, b in sorted(rest, key=lambda x: (-x[0], str(x[1]))):
        s = max(have, key=lambda s: (quota[s] - have[s], s))
        given[b][s] += 1
        have[s] += size
    return given


def assign_splits(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``question_id, group_id, split``: one split for each question, the same for its whole component."""
    spark = rows.sparkSession
    groups = stored(record_groups(rows), "tied-groups")
    now = rows.filter(F.col("question_id").isNotNull()).groupBy("question_id").agg(F.min("split").alias("now"))
    votes = groups.join(now, "question_id").groupBy("group_id", "size", "now").agg(F.count("*").alias("n"))
    profile = votes.groupBy("group_id", "size").agg(F.max_by("now", F.struct("n", "now")).alias("now"))
    parts = profile.withColumn("h", F.xxhash64("group_id")).withColumn("part", F.pmod("h", F.lit(RANK_PARTS)))
    parts = stored(parts, "tied-profiles")
    shares = {r["split"]: float(r["share"]) for r in targets.filter("split is not null and share > 0").select("split", "share").collect()}
    counts = parts.groupBy("size", "now").agg(F.count("*").alias("n")).collect()
    if not shares:
        raise ValueError("no split has a positive share")
    total = sum(r["size"] * r["n"] for r in counts)
    quota = {s: total * v / sum(shares.values()) for s, v in shares.items()}
    bundles = [((r["size"], r["now"]), r["size"], r["n"]) for r in counts]
    sent = flow({b: size * n for b, size, n in bundles}, quota, {b: b[1] for b, _, _ in bundles})
    given = whole(bundles, sent, quota)
    spans = []
    for b, _, _ in bundles:
        at = 0
        for s in sorted(given[b]):
            if given[b][s]:
                spans.append((b[0], b[1], s, at, at + given[b][s]))
                at += given[b][s]
    plan = spark.createDataFrame(spans, "size bigint, now string, split string, lo bigint, hi bigint")
    sizes = parts.groupBy("size", "now", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("size", "now").orderBy("part")) - F.col("n")).drop("n")
    eq = lambda a, b: [a["size"] == b["size"], a["now"].eqNullSafe(b["now"])]
    ranked = parts.join(before, [*eq(parts, before), parts["part"] == before["part"]]).select(parts["*"], before["before"])
    ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy("size", "now", "part").orderBy("h", "group_id")) - 1 + F.col("before"))
    placed = ranked.join(plan, [*eq(ranked, plan), ranked["at"] >= plan["lo"], ranked["at"] < plan["hi"]]).select("group_id", "split")
    return groups.join(placed, "group_id").select("question_id", "group_id", "split")
