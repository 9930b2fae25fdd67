"""Filling containers of fixed capacity with texts.

Shortest-pack-first over the histogram of lengths: lengths are placed from the longest to the shortest, each into the packs with
the most space left, and packs with the same contents are counted together as one pattern. The histogram has a bounded number of entries, so
the placing is a small computation on the driver whose cost doesn't follow the number of texts. Texts and patterns are then joined by
rank: the texts of a length are numbered in two levels, a pattern's places of a length are a range of those numbers, and both are
brought together in blocks of numbers, in which a text belongs to the last range that began.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.blocked import running_sum
from tapewright.session import cut_lineage

#: The histograms of all containers together may have so many entries at the driver. Where capacities add up to more, the lengths of
#: the large containers are counted in units of several tokens, rounded up: every text still has its place, and a pack of n
#: texts leaves at most n units more empty.
MAX_ENTRIES = 4_000_000
MAX_CONTAINERS = 10_000
#: Texts per block of the numbering and of the rank join, and the most blocks of a length.
TEXTS_PER_BLOCK = 50_000
MAX_BLOCKS = 1_000_000

Pattern = tuple[tuple[int, int], ...]


def shortest_pack_first(histogram: Iterable[tuple[int, int]], capacity: int) -> list[tuple[Pattern, int]]:
    """(pattern, count) pairs; a pattern lists (length, how often) from the longest. Lengths are 1..capacity."""
    spaces: list[int] = []  # negated: the most space first
    by_space: dict[int, dict[Pattern, int]] = {}

    def add(space: int, pattern: Pattern, count: int) -> None:
        if space not in by_space:
            by_space[space] = {}
            heapq.heappush(spaces, -space)
        packs = by_space[space]
        packs[pattern] = packs.get(pattern, 0) + count

    for length, count in sorted(histogram, reverse=True):
        while count:
            if not spaces or -spaces[0] < length:
                # a new pack is the one with the most space until it is full
                times = capacity // length
                full, rest = divmod(count, times)
                if full:
                    add(capacity - times * length, ((length, times),), full)
                if rest:
                    add(capacity - rest * length, ((length, rest),), 1)
                break
            space = -spaces[0]
            packs = by_space[space]
            pattern, have = next(iter(packs.items()))
            used = min(have, count)
            if used == have:
                del packs[pattern]
                if not packs:
                    del by_space[space]
                    heapq.heappop(spaces)
            else:
                packs[pattern] = have - used
            last, times = pattern[-1]
            grown = (*pattern[:-1], (last, times + 1)) if last == length else (*pattern, (length, 1))
            add(space - length, grown, used)
            count -= used
    return [(p, n) for packs in by_space.values() for p, n in packs.items()]


def _places(container: str, patterns: list[tuple[Pattern, int]]) -> list[tuple]:
    """(container, length, first rank, places, per pack, first pack, fill): which ranks of a length go into which packs."""
    at: dict[int, int] = {}
    rows, base = [], 0
    for pattern, count in sorted(patterns, reverse=True):
        fill = sum(n * k for n, k in pattern)
        for length, times in pattern:
            r = at.get(length, 0)
            rows.append((container, length, r, times * count, times, base, fill))
            at[length] = r + times * count
        base += count
    return rows


def block_width(most: int) -> int:
    """Numbers per block where a length has at most ``most`` texts."""
    return max(TEXTS_PER_BLOCK, -(-most // MAX_BLOCKS))


def pack(sized: DataFrame, containers: DataFrame, key: str = "doc_id", name: str = "container", capacity: str = "capacity_tokens") -> DataFrame:
    """One row per container kind and piece of a text: which pack it is in.

    ``sized`` has the key and ``tokens``. A text is divided only if it is larger than the capacity: into pieces of the capacity and a
    rest. Texts of no tokens or a NULL size or key take no space and are left out; rows that repeat a key are texts of
    their own. Containers with a NULL name or a capacity below 1 are left out, repeats of a container count once; at most
    MAX_CONTAINERS may be listed. Returns container, pack_no (from 0), the key, piece_no, token_start, tokens, fill_tokens (of the
    pack) and capacity.
    """
    kinds = [(r[0], int(r[1])) for r in containers.where(F.col(name).isNotNull() & (F.col(capacity) >= 1)).groupBy(name).agg(F.max(capacity)).orderBy(name).limit(MAX_CONTAINERS + 1).collect()]
    if len(kinds) > MAX_CONTAINERS:
        raise ValueError(f"more than {MAX_CONTAINERS} containers are listed")
    entries = MAX_ENTRIES // max(len(kinds), 1)
    units = {n: 1 if sum(c for _, c in kinds) <= MAX_ENTRIES else -(-c // entries) for n, c in kinds}
    spark = sized.sparkSession
    texts = cut_lineage(sized.where(f"tokens > 0 AND `{key}` IS NOT NULL").select(F.col(key).alias("key"), F.col("tokens").cast("bigint").alias("size")))
    of_kinds = [F.struct(F.lit(n).alias("container"), F.lit(c).cast("bigint").alias("capacity"), F.lit(units[n]).cast("bigint").alias("unit")) for n, c in kinds]
    kind = F.explode(F.array(*of_kinds) if kinds else F.expr("cast(array() as array<struct<container:string,capacity:bigint,unit:bigint>>)"))
    div = lambda a, b: F.call_function("div", a, b)
    pieces = (
        texts.withColumn("kind", kind)
        .select("key", "size", "kind.*")
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), div(F.col("size") - 1, F.col("capacity")))))
        .withColumn("token_start", F.col("piece_no") * F.col("capacity"))
        .withColumn("tokens", F.least(F.col("capacity"), F.col("size") - F.col("token_start")))
        # a piece of more than the whole units of a container has it alone
        .withColumn("length", F.least(div(F.col("tokens") + F.col("unit") - 1, F.col("unit")), div(F.col("capacity"), F.col("unit"))))
    )
    counted: dict[str, list[tuple[int, int]]] = {}
    for r in pieces.groupBy("container", "length").agg(F.count(F.lit(1)).alias("n")).collect():
        counted.setdefault(r["container"], []).append((r["length"], r["n"]))
    rows = [row for n, c in kinds for row in _places(n, shortest_pack_first(counted.get(n, []), c // units[n]))]
    total = max((sum(k for _, k in h) for h in counted.values()), default=0)
    width = F.lit(block_width(total)).cast("bigint")

    places = spark.createDataFrame(rows, "container string, length bigint, first_rank bigint, places bigint, per_pack bigint, first_pack bigint, fill_tokens bigint")
    # a range is seen by every block it reaches into
    places = places.withColumn("block", F.explode(F.sequence(div(F.col("first_rank"), width), div(F.col("first_rank") + F.col("places") - 1, width))))
    places = places.select("container", "length", "block", F.greatest(F.col("first_rank"), F.col("block") * width).alias("rank"), F.struct("first_rank", "per_pack", "first_pack", "fill_tokens").alias("place"))
    parts = max(1, total // TEXTS_PER_BLOCK)
    ranked = pieces.drop("size").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).withColumn("one", F.lit(1).cast("bigint"))
    ranked = running_sum(ranked, ["container", "length"], "part", ["key", "piece_no"], "one", "rank").withColumn("rank", F.col("rank") - 1).drop("part", "one")
    both = ranked.withColumn("block", div(F.col("rank"), width)).unionByName(places, allowMissingColumns=True)
    w = Window.partitionBy("container", "length", "block").orderBy("rank", F.col("place").isNull())
    hit = both.withColumn("at", F.last("place", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("key IS NOT NULL")
    out = hit.select(
        F.col("container").alias(name),
        (F.col("at.first_pack") + div(F.col("rank") - F.col("at.first_rank"), F.col("at.per_pack"))).alias("pack_no"),
        F.col("key").alias(key),
        "piece_no",
        "token_start",
        "tokens",
        F.col("at.fill_tokens").alias("fill_tokens"),
        "capacity",
    )
    if any(u > 1 for u in units.values()):
        out = out.withColumn("fill_tokens", F.sum("tokens").over(Window.partitionBy(name, "pack_no")))
    return out
