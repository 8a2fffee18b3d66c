"""Containers of fixed capacity filled with items of varying length.

Minimum bin slack: each container starts with the longest item left; a subset-sum over the multiset of the
lengths left, held as the bits of one integer, gives the sum closest to the room left, and walking back
through the bits gives how many of each length. The same filling is taken as often as the counts allow.

Items are dealt into groups of about ``GROUP`` by a hash of their key, so no group grows with the input.
Containers of a group that are filled less than ``FULL`` are taken apart and packed again with those of the
other groups, in ever fewer groups, until one is left or a turn fills no further container.

Defined results: rows with a null key are ignored; rows delivered twice count once; null and empty texts
have no tokens and are packed nowhere; an item longer than a container is cut into full containers and a
rest; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.storage import stored
from pagemill.session import ship

GROUP, FULL = 4000, 0.995


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> str:
    """Path of the vocabulary that counts tokens if no other is given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, tokens`` of each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            ids, sizes = batch.column(0), []
            for lo in range(0, batch.num_rows, 256):
                sizes += [len(tok.encode_ordinary(t)) for t in batch.column(1).slice(lo, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tokens bigint").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def fill(counts: dict[int, int], capacity: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Fillings ``[(length, how many)]`` and how often each is taken, until nothing is left."""
    left = {s: n for s, n in counts.items() if n > 0}
    while left:
        first = max(left)
        room = capacity - first
        mask = (1 << (room + 1)) - 1
        reach, steps, used = 1, [], {first: 1}
        for size in sorted(left, reverse=True):
            many = min(left[size] - (size == first), room // size)
            k = 1
            while many > 0 and not reach >> room & 1:
                take = min(k, many)
                many -= take
                k *= 2
                more = (reach | reach << (size * take)) & mask
                if more != reach:
                    steps.append((size, take, reach))
                    reach = more
            if reach >> room & 1:
                break
        at = reach.bit_length() - 1
        for size, take, before in reversed(steps):
            if not before >> at & 1:
                at -= size * take
                used[size] = used.get(size, 0) + take
        times = min(left[s] // n for s, n in used.items())
        yield sorted(used.items()), times
        for s, n in used.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers."""
    of: dict[int, list[int]] = {}
    for k, s in enumerate(sizes):
        of.setdefault(s, []).append(k)
    out = []
    for filling, times in fill({s: len(v) for s, v in of.items()}, capacity):
        for _ in range(times):
            out.append([of[s].pop() for s, n in filling for _ in range(n)])
    return out


def packed(docs: DataFrame, capacity: int, path: str | None = None) -> DataFrame:
    """``doc_id, piece, first_token, tokens, container``: where each item, or piece of an oversized one, goes."""
    spark = docs.sparkSession
    ship(spark)
    counts = stored(token_counts(docs, path or default_tokenizer()).filter("tokens > 0"), "pack-tokens")
    cap = F.lit(capacity).cast("bigint")
    piece = counts.select("doc_id", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("tokens") - 1, cap)).alias("piece", "first_token"), "tokens")
    piece = piece.select("doc_id", "piece", "first_token", F.least(cap, F.col("tokens") - F.col("first_token")).alias("tokens"))
    whole = piece.filter(F.col("tokens") == cap).withColumn("container", F.concat_ws("-", F.lit("w"), F.col("doc_id").cast("string"), F.col("piece").cast("string")))
    done, left = [whole], stored(piece.filter(F.col("tokens") < cap), "pack-left")
    before, turn = None, 0
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, first_token bigint, tokens bigint, container string, full boolean"
    while True:
        n = left.count()
        last = n <= GROUP or n == before
        groups = 1 if n <= GROUP else -(-n // GROUP)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            turn = int(pdf["turn"].iloc[0])
            pdf = pdf.drop(columns="turn").sort_values(["tokens", "doc_id", "piece"]).reset_index(drop=True)
            name, full = [""] * len(pdf), [False] * len(pdf)
            sizes = pdf["tokens"].tolist()
            for k, items in enumerate(pack(sizes, capacity)):
                ok = sum(sizes[i] for i in items) >= FULL * capacity
                for i in items:
                    name[i], full[i] = f"{turn}-{pdf['g'][0]}-{k}", ok
            return pdf.drop(columns="g").assign(container=name, full=full)

        dealt = left.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(groups))).withColumn("turn", F.lit(turn))
        # groups are small in bytes; their number is given so that they are not merged into few tasks
        out = stored(dealt.repartition(int(min(groups, 4096)), "g").groupBy("g").applyInPandas(run, schema), "pack-turn")
        if last:
            done.append(out.drop("full"))
            break
        done.append(out.filter("full").drop("full"))
        before, left, turn = n, out.filter("not full").drop("full", "container"), turn + 1
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result
