"""Continuous periods and gaps of overlapping ranges, by compressed run bitmaps.

Time is discretised into exact units of 10^-16 s (see ``exact_time``) and cut into shards. The
ranges of an entity in a shard are one bitmap over the shard's units, kept compressed as the
lengths of its alternating clear and set runs. Bitmaps are first united where the ranges are read,
so what is shuffled is at most one bitmap per entity, shard and task, however many ranges an
entity has; they are united again per entity and shard, and their set runs and clear runs are the
periods and gaps. Runs that meet at a shard's edge are joined over one summary row per shard.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from tapewright.functions import exact_time as X

#: Shards of 512 s: 512 * 10^16 units fit a BIGINT.
SHARD_SECONDS = 512
_WIDTH = SHARD_SECONDS * X.FINE


def encode(starts: np.ndarray, ends: np.ndarray, group_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint sorted runs -> lengths of alternating clear and set runs, and the offsets of the groups.

    ``group_of``: the group of each run, ascending from 0 without holes.
    """
    first = np.r_[True, group_of[1:] != group_of[:-1]] if len(group_of) else np.zeros(0, bool)
    before = np.where(first, 0, np.r_[0, ends[:-1]]) if len(ends) else ends
    lengths = np.empty(2 * len(starts), np.int64)
    lengths[0::2] = starts - before
    lengths[1::2] = ends - starts
    counts = np.bincount(group_of) if len(group_of) else np.zeros(0, np.int64)
    return lengths, np.r_[0, np.cumsum(2 * counts)].astype(np.int32)


def decode(lengths: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inverse of ``encode``: starts, ends and group of each run."""
    sizes = np.diff(offsets) // 2
    # the edges restart at 0 in each group; running sums over groups may pass 2^63 but wrap consistently
    with np.errstate(over="ignore"):
        edges = np.cumsum(lengths)
        base = np.where(offsets[:-1] > 0, edges[np.maximum(offsets[:-1] - 1, 0)], 0) if len(edges) else np.zeros(len(sizes), np.int64)
        edges = edges - np.repeat(base, sizes * 2)
    return edges[0::2], edges[1::2], np.repeat(np.arange(len(sizes)), sizes)


def unite(group: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of runs per group; runs that touch become one. Empty runs count for nothing."""
    keep = ends > starts
    group, starts, ends = group[keep], starts[keep], ends[keep]
    if not len(group):
        return group, starts, ends
    order = np.lexsort((starts, group))
    group, starts, ends = group[order], starts[order], ends[order]
    # a running maximum of the ends that restarts with each group: ranks of the ends, lifted by group
    rank = np.argsort(np.argsort(ends, kind="stable"), kind="stable") + group.astype(np.int64) * len(ends)
    top = np.argsort(ends, kind="stable")
    reach = ends[top[np.maximum.accumulate(rank) - group * len(ends)]]
    fresh = np.r_[True, (group[1:] != group[:-1]) | (starts[1:] > reach[:-1])]
    at = np.flatnonzero(fresh)
    return group[at], starts[at], reach[np.r_[at[1:] - 1, len(reach) - 1]]


def _codes(table: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, pa.Table]:
    """A group number for each row and the table of the groups' keys, in order of first appearance."""
    codes, distinct = None, []
    for k in keys:
        enc = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        enc = enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc
        own = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = own if codes is None else np.unique(codes * (len(enc.dictionary) + 1) + own, return_inverse=True)[1]
        distinct.append(k)
    uniq, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
    return inverse, table.select(list(keys)).take(pa.array(first))


def _bitmaps(keys: Sequence[str], schema: pa.Schema):
    """Pieces of ranges -> one bitmap per entity and shard of the batches read so far."""

    def flush(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        code, groups = _codes(table, keys)
        g, s, e = unite(code, table.column("piece_start").to_numpy(), table.column("piece_end").to_numpy())
        present, g = np.unique(g, return_inverse=True)
        lengths, offsets = encode(s, e, g)
        groups = groups.take(pa.array(present))
        columns = [groups.column(k).combine_chunks() for k in keys]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(lengths))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 200_000:
                yield from flush(held)
                held, rows = [], 0
        if held:
            yield from flush(held)

    return run


def _extract(keys: Sequence[str], schema: pa.Schema):
    """Bitmaps sorted by entity and shard -> the set runs of their union, marked by place in the shard."""

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        code, groups = _codes(table, keys)
        lists = table.column("bitmap").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        offsets = lists.offsets.to_numpy()
        s, e, row = decode(lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0])
        g, s, e = unite(code[row], s, e)
        if not len(g):
            return
        first = np.r_[True, g[1:] != g[:-1]]
        last = np.r_[g[1:] != g[:-1], True]
        after = pa.array(np.r_[s[1:], 0], mask=last)
        out = groups.take(pa.array(g))
        columns = [out.column(k).combine_chunks() for k in keys]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(s), pa.array(e), after, pa.array(first), pa.array(last)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 20_000:
                continue
            # the last group may go on in the next batch
            tail = held.slice(held.num_rows - 1)
            same = np.ones(held.num_rows, bool)
            for k in keys:
                same &= np.array([v == tail.column(k)[0].as_py() for v in held.column(k).to_pylist()])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
            if cut:
                yield from flush(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from flush(held)

    return run


def range_pieces(ranges: DataFrame, entity: Sequence[str], start: tuple[str, str], end: tuple[str, str]) -> DataFrame:
    """One row per shard that a range touches, with its part in it. Invalid and empty ranges give none."""
    sn, sd, en, ed = *start, *end
    cols = [F.col(c).alias(f"k{i}") for i, c in enumerate(entity)]
    s = ranges.select(
        *cols,
        X.whole_seconds(sn, sd).alias("s_sec"),
        X.fine_rest(sn, sd).alias("s_fine"),
        X.whole_seconds(en, ed).alias("e_sec"),
        X.fine_rest(en, ed).alias("e_fine"),
    )
    width = F.lit(SHARD_SECONDS).cast("bigint")
    s = s.where((F.col("e_sec") > F.col("s_sec")) | ((F.col("e_sec") == F.col("s_sec")) & (F.col("e_fine") > F.col("s_fine"))))
    s = s.withColumn("s_shard", X.floor_div(F.col("s_sec"), width)).withColumn("e_shard", X.floor_div(F.col("e_sec"), width))
    s = s.withColumn("shard", F.explode(F.sequence("s_shard", "e_shard")))
    inside = lambda sec, fine: F.pmod(F.col(sec), width) * F.lit(X.FINE) + F.col(fine)
    return s.select(
        *[f"k{i}" for i in range(len(entity))],
        "shard",
        F.when(F.col("shard") == F.col("s_shard"), inside("s_sec", "s_fine")).otherwise(F.lit(0)).alias("piece_start"),
        F.when(F.col("shard") == F.col("e_shard"), inside("e_sec", "e_fine")).otherwise(F.lit(_WIDTH)).alias("piece_end"),
    ).where("piece_end > piece_start")


def us_pieces(ranges: DataFrame, entity: Sequence[str], start: str, end: str) -> DataFrame:
    """``range_pieces`` of edges in whole microseconds. Their expressions stay short however the edges are made, which the plans held by the driver
    and the size of the generated code depend on."""
    width = F.lit(SHARD_SECONDS * 10**6).cast("bigint")
    s = ranges.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(entity)], F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).where("e > s")
    s = s.withColumn("s_shard", X.floor_div(F.col("s"), width)).withColumn("e_shard", X.floor_div(F.col("e"), width))
    s = s.withColumn("shard", F.explode(F.sequence("s_shard", "e_shard")))
    inside = lambda c: F.pmod(F.col(c), width) * F.lit(10**10)
    return s.select(
        *[f"k{i}" for i in range(len(entity))],
        "shard",
        F.when(F.col("shard") == F.col("s_shard"), inside("s")).otherwise(F.lit(0)).alias("piece_start"),
        F.when(F.col("shard") == F.col("e_shard"), inside("e")).otherwise(F.lit(_WIDTH)).alias("piece_end"),
    ).where("piece_end > piece_start")


def periods_and_gaps(
    ranges: DataFrame,
    entity: Sequence[str],
    start: tuple[str, str] = ("start_num", "start_den"),
    end: tuple[str, str] = ("end_num", "end_den"),
    max_gap_seconds: int | None = None,
) -> DataFrame:
    """Per entity the longest stretches covered by its ranges and the gaps between them.

    Ranges are half open; ranges that touch exactly belong together. Left out are ranges with a NULL
    entity column, a NULL edge or a zero denominator, with the end before the start, and empty ones.
    Repeated rows change nothing. An entity without a valid range gives no row, an empty table none.
    Other columns of ``ranges`` are ignored, whatever their names.

    Returns the entity columns, ``what`` ('period' or 'gap'), ``start_us`` and ``end_us``: the exact
    seconds times 10^6, rounded down. Gaps longer than ``max_gap_seconds`` are left out.
    Exact for denominators up to 10^8.
    """
    return _united(range_pieces(_known(ranges, entity), entity, start, end), entity, max_gap_seconds)


def us_periods_and_gaps(ranges: DataFrame, entity: Sequence[str], start: str, end: str) -> DataFrame:
    """``periods_and_gaps`` of edges in whole microseconds."""
    return _united(us_pieces(_known(ranges, entity), entity, start, end), entity, None)


def _known(ranges: DataFrame, entity: Sequence[str]) -> DataFrame:
    return ranges.where(" AND ".join(f"`{c}` IS NOT NULL" for c in entity)) if entity else ranges


def _united(pieces: DataFrame, entity: Sequence[str], max_gap_seconds: int | None) -> DataFrame:
    ks = [f"k{i}" for i in range(len(entity))]
    keys = [*ks, "shard"]
    types = {f.name: f.dataType.simpleString() for f in pieces.schema}
    key_ddl = ", ".join(f"{k} {types[k]}" for k in keys)
    key_fields = [f for f in pieces.schema if f.name in keys]
    key_fields = [StructField(f.name, f.dataType) for f in key_fields]
    map_schema = to_arrow_schema(StructType([*key_fields, StructField("bitmap", ArrayType(LongType()))]))
    run_schema = to_arrow_schema(StructType([*key_fields, StructField("s", LongType()), StructField("e", LongType()), StructField("next_s", LongType()), StructField("first", BooleanType()), StructField("last", BooleanType())]))
    local = pieces.mapInArrow(_bitmaps(keys, map_schema), f"{key_ddl}, bitmap array<bigint>")
    runs = (
        local.repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_extract(keys, run_schema), f"{key_ddl}, s bigint, e bigint, next_s bigint, first boolean, last boolean")
    )
    return _stitched(runs, ks, entity, max_gap_seconds)


def _stitched(runs: DataFrame, ks: list[str], entity: Sequence[str], max_gap_seconds: int | None) -> DataFrame:
    """Set and clear runs of the shards -> periods and gaps of the entities.

    Inner runs, and the clear runs between two runs of a shard, are final. The first and last run of a shard
    go through one summary row per shard and a window over the summaries of the entity. Both branches
    read the same shuffle of bitmaps.
    """
    to_us = lambda c: X.int_div(c, F.lit(10**10))
    us = lambda shard, c: shard * F.lit(SHARD_SECONDS * 10**6) + to_us(c)
    shard = F.col("shard")
    row = lambda cond, what, a, b: F.when(cond, F.struct(F.lit(what).alias("what"), a.alias("start_us"), b.alias("end_us")))
    short = F.lit(True) if max_gap_seconds is None or max_gap_seconds >= SHARD_SECONDS else F.col("next_s") - F.col("e") <= max_gap_seconds * X.FINE
    inner = runs.select(
        *ks,
        F.explode(
            F.array_compact(
                F.array(
                    row(~F.col("first") & ~F.col("last"), "period", us(shard, F.col("s")), us(shard, F.col("e"))),
                    row(F.col("next_s").isNotNull() & short, "gap", us(shard, F.col("e")), us(shard, F.col("next_s"))),
                )
            )
        ).alias("x"),
    ).select(*ks, "x.*")

    heads = (
        runs.where("first OR last")
        .groupBy(*ks, "shard")
        .agg(F.max(F.when(F.col("first"), F.struct("s", "e"))).alias("head"), F.max(F.when(F.col("last"), F.struct("s", "e"))).alias("tail"))
    )
    w = Window.partitionBy(*ks).orderBy("shard")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    head, tail = F.col("head"), F.col("tail")
    heads = (
        heads.withColumn("one", head == tail)
        .withColumn("goes_on", F.coalesce((head["s"] == 0) & (F.lag("shard").over(w) == shard - 1) & (F.lag("tail").over(w)["e"] == _WIDTH), F.lit(False)))
        .withColumn("next_goes_on", F.coalesce(F.lead("goes_on").over(w), F.lit(False)))
        .withColumn("opened", F.when(~(F.col("goes_on") & F.col("one")), us(shard, tail["s"])))
        .withColumn("carried", F.last("opened", ignorenulls=True).over(so_far))
        .withColumn("next_shard", F.lead("shard").over(w))
        .withColumn("next_s", F.lead("head").over(w)["s"])
    )
    head_start = F.when(F.col("goes_on"), F.col("carried")).otherwise(us(shard, head["s"]))
    wide = "decimal(38,0)"
    if max_gap_seconds is None:
        short = F.lit(True)
    else:
        width = F.lit(_WIDTH).cast("decimal(19,0)")
        short = (F.col("next_shard") - shard).cast("decimal(19,0)") * width + F.col("next_s").cast(wide) - tail["e"].cast(wide) <= F.lit(max_gap_seconds).cast(wide) * F.lit(X.FINE).cast("decimal(18,0)")
    edges = heads.select(
        *ks,
        F.explode(
            F.array_compact(
                F.array(
                    row(~F.col("one") | ~F.col("next_goes_on"), "period", head_start, us(shard, head["e"])),
                    row(~F.col("one") & ~F.col("next_goes_on"), "period", us(shard, tail["s"]), us(shard, tail["e"])),
                    row(~F.col("next_goes_on") & F.col("next_shard").isNotNull() & short, "gap", us(shard, tail["e"]), us(F.col("next_shard"), F.col("next_s"))),
                )
            )
        ).alias("x"),
    ).select(*ks, "x.*")
    out = inner.unionByName(edges)
    return out.select(*[F.col(k).alias(c) for k, c in zip(ks, entity)], "what", "start_us", "end_us")
