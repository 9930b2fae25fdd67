"""Operations along long ordered groups, in two levels.

A window over a whole entity puts that entity into one task. These helpers cut the entity into blocks
(a time shard, a range of line numbers): the window runs inside a block, and what a block must know of the blocks before or behind it
comes as one row more, made from one summary row per block. So the rows are shuffled once, by entity and block, and the task
that sees a whole entity sees one row per block only.

Blocks must be ordered as their rows are. The input is read twice, once for the summaries: cut its lineage first if it is costly to make.
A NULL entity or block is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.exact_time import floor_div



def _order(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _with_guests(df: DataFrame, guests: DataFrame, entity: Sequence[str], block: str, order: Sequence[Column | str], last: bool = False):
    """``df`` and one guest row at the head (or the end) of every block, the windows over both, and which rows are ``df``'s own."""
    rows = df.withColumn("__own", F.lit(True)).unionByName(guests.withColumn("__own", F.lit(False)), allowMissingColumns=True)
    side = F.col("__own").desc() if last else F.col("__own").asc()
    return rows, Window.partitionBy(*entity, block).orderBy(side, *_order(order))


def running_sum(df: DataFrame, entity: Sequence[str], block: str, order: Sequence[Column | str], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the entity up to and with this one."""
    outer = Window.partitionBy(*entity).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*entity, block).agg(F.sum(value).alias("__sum"))
    guests = sums.select(*entity, block, F.coalesce(F.sum("__sum").over(outer), F.lit(0)).alias("__add"))
    rows, w = _with_guests(df.withColumn("__add", F.col(value)), guests, entity, block, order)
    rows = rows.withColumn(out, F.sum("__add").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("__own").drop("__own", "__add")


def carry_forward(df: DataFrame, entity: Sequence[str], block: str, order: Sequence[Column | str], value: str, out: str) -> DataFrame:
    """``out``: the last ``value`` that is not NULL among the rows of the entity up to and with this one."""
    outer = Window.partitionBy(*entity).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_order(order))])
    known = df.groupBy(*entity, block).agg(F.max(F.when(F.col(value).isNotNull(), F.struct(inside.alias("at"), F.col(value).alias("value"))))["value"].alias("__value"))
    guests = known.select(*entity, block, F.last("__value", ignorenulls=True).over(outer).alias("__seen"))
    rows, w = _with_guests(df.withColumn("__seen", F.col(value)), guests, entity, block, order)
    rows = rows.withColumn(out, F.last("__seen", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("__own").drop("__own", "__seen")


def _neighbour(df: DataFrame, entity: Sequence[str], block: str, order: Sequence[Column | str], value: str, out: str, before: bool) -> DataFrame:
    outer = Window.partitionBy(*entity).orderBy(block)
    inside = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_order(order))])
    edge = (F.max if before else F.min)(F.struct(inside.alias("at"), F.struct(F.col(value).alias("value")).alias("box")))
    edges = df.groupBy(*entity, block).agg(edge["box"].alias("__edge"))
    guests = edges.select(*entity, block, (F.lag if before else F.lead)("__edge").over(outer).alias("__box"))
    rows, w = _with_guests(df.withColumn("__box", F.struct(F.col(value).alias("value"))), guests, entity, block, order, last=not before)
    rows = rows.withColumn(out, (F.lag if before else F.lead)("__box").over(w))
    return rows.where("__own").drop("__own", "__box")


def previous(df: DataFrame, entity: Sequence[str], block: str, order: Sequence[Column | str], value: str, out: str) -> DataFrame:
    """``out``: ``value`` of the row before this one in the entity, as a one-field struct; NULL at the first row.

    Rows with equal ``order`` follow each other in no defined order."""
    return _neighbour(df, entity, block, order, value, out, True)


def following(df: DataFrame, entity: Sequence[str], block: str, order: Sequence[Column | str], value: str, out: str) -> DataFrame:
    """As ``previous``, of the row behind this one."""
    return _neighbour(df, entity, block, order, value, out, False)


def running_max(df: DataFrame, entity: Sequence[str], block: str, order: Sequence[Column | str], value: str, out: str) -> DataFrame:
    """``out``: the largest ``value`` of the rows of the entity before this one; NULL if there is none."""
    outer = Window.partitionBy(*entity).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*entity, block).agg(F.max(value).alias("__top"))
    guests = tops.select(*entity, block, F.max("__top").over(outer).alias("__most"))
    rows, w = _with_guests(df.withColumn("__most", F.col(value)), guests, entity, block, order)
    rows = rows.withColumn(out, F.max("__most").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.where("__own").drop("__own", "__most")


def blocks(df: DataFrame, at: str, width: int, out: str = "__block") -> DataFrame:
    """Adds the block a row belongs to: ``width`` units of its place in the order. A NULL place has a block of its own."""
    return df.withColumn(out, floor_div(F.col(at).cast("bigint"), F.lit(width).cast("bigint")))


def value_runs(df: DataFrame, keys: Sequence[str], at: str, value: str, width: int | None, tie: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """Longest stretches of rows, in the order of ``at``, with one value (NULL is one): keys, value, start, end (first and last place), n, next (the place
    of the first row behind, NULL at the end of the entity) and, of a column ``total``, its sum.

    A block of ``width`` units sums up its runs, and only its first and last run are joined with those of other blocks. Rows at one
    place are ordered by ``tie``. Without a width ``df`` has its blocks already, as ``__block``, and keeps its partitioning.
    """
    d = df if width is None else blocks(df, at, width)
    d = d.select(*dict.fromkeys((*keys, "__block", at, value, *tie, *([total] if total else []))))
    w = Window.partitionBy(*keys, "__block").orderBy(at, *tie)
    d = d.withColumn("__was", F.lag(F.struct(F.col(value).alias("v"))).over(w)).withColumn("__next", F.lead(at).over(w))
    d = d.withColumn("__fresh", (F.col("__was").isNull() | ~F.col("__was.v").eqNullSafe(F.col(value))).cast("int"))
    d = d.withColumn("__run", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    more = [F.sum(total).alias("total")] if total else []
    # the place behind a run: of the last row, which is the only one with a larger or no next place
    behind = F.max_by("__next", F.struct(at, *tie)).alias("next")
    local = d.groupBy(*keys, "__block", "__run", value).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n"), behind, *more)
    local = local.withColumn("__last", F.col("__run") == F.max("__run").over(Window.partitionBy(*keys, "__block")))
    cols = [*keys, value, "start", "end", "n", "next", *(["total"] if total else [])]
    # one or two rows per block
    e = Window.partitionBy(*keys).orderBy("__block", "__run")
    edges = local.where("__run = 1 OR __last").withColumn("__was", F.lag(F.struct(F.col(value).alias("v"))).over(e))
    edges = edges.withColumn("next", F.coalesce("next", F.lead("start").over(e)))
    fresh = (F.col("__run") > 1) | F.col("__was").isNull() | ~F.col("__was.v").eqNullSafe(F.col(value))
    edges = edges.withColumn("__whole", F.sum(fresh.cast("int")).over(e.rowsBetween(Window.unboundedPreceding, 0)))
    more = [F.sum("total").alias("total")] if total else []
    what = [F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.max_by("next", F.struct("__block", "__run")).alias("next")]
    merged = edges.groupBy(*keys, "__whole", value).agg(*what, *more).select(*cols)
    return local.where("__run > 1 AND NOT __last").select(*cols).unionByName(merged)


def running_sums(df: DataFrame, entity: Sequence[str], block: str, order: Sequence[Column | str], values: dict[str, str]) -> DataFrame:
    """``running_sum`` of several columns at once: value -> name of its sum."""
    outer = Window.partitionBy(*entity).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*entity, block).agg(*[F.sum(v).alias(f"__s_{v}") for v in values])
    guests = sums.select(*entity, block, *[F.coalesce(F.sum(f"__s_{v}").over(outer), F.lit(0)).alias(f"__a_{v}") for v in values])
    rows, w = _with_guests(df.select("*", *[F.col(v).alias(f"__a_{v}") for v in values]), guests, entity, block, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(f"__a_{v}").over(upto).alias(o) for v, o in values.items()])
    return rows.where("__own").drop("__own", *[f"__a_{v}" for v in values])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, width: int) -> DataFrame:
    """``out``: the place of a row in its entity, from 0, by ``order``; blocks are cut by the first of it, ``width`` units each."""
    d = blocks(df.withColumn("__one", F.lit(1).cast("bigint")), order[0], width)
    d = running_sum(d, keys, "__block", order, "__one", "__nth").drop("__one", "__block")
    return d.withColumn(out, F.col("__nth") - 1).drop("__nth")


def with_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, width: int, places: int = 50_000) -> DataFrame:
    """Rows in blocks (``__block``) that also hold the ``size`` - 1 rows before them (``__halo``), so that a window of ``size`` rows up to a row is whole inside its
    block. ``width``: units of the first of ``order`` per block of the numbering; ``places``: rows per block of the result."""
    d = numbered(df, keys, order, "__place", width)
    own = floor_div(F.col("__place"), F.lit(places))
    d = d.withColumn("__own", own).withColumn("__block", F.explode(F.sequence("__own", floor_div(F.col("__place") + size - 1, F.lit(places)))))
    return d.withColumn("__halo", F.col("__own") < F.col("__block")).drop("__own", "__place")
