"""Interval sets and temporal joins over integer times.

Ranges are half open. ``keys`` name the entity, usually a recording, which may hold any share of the rows: what depends on neighbours is worked
out in blocks of ``block`` units of time (or places) by the operations of ``blocked``, so no task sorts a whole entity. Joins by time
are equi-joins on (entity, time bucket) with the exact condition behind it, never nested loops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.exact_time import floor_div, int_div
from tapewright.operators.blocked import blocks, following, previous, running_max, running_sum, running_sums, value_runs
from tapewright.operators.run_bitmap import us_periods_and_gaps
from tapewright.session import cut_lineage

#: An hour of microseconds.
HOUR = 3600 * 10**6
#: Places (words, samples) per block where the order is a count.
PLACES = 50_000
#: A range is listed in so many buckets at most; longer ones go to wider buckets.
SPREAD = 64


def merge(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Union of the ranges of each entity, touching ones joined: keys, start, end. By run bitmaps, so no entity is too large.

    The edges are microseconds.
    """
    out = us_periods_and_gaps(df, keys, start, end).where("what = 'period'")
    return out.select(*keys, F.col("start_us").alias(start), F.col("end_us").alias(end))


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str, block: int = HOUR) -> DataFrame:
    """What is covered by ``a`` and not by ``b``, as disjoint ranges, the longest: a sweep over the edges of both. Empty and reversed ranges
    and NULL edges cover nothing."""
    edges = lambda df, da, db: df.select(*keys, F.col(start).alias("at"), F.lit(da).alias("da"), F.lit(db).alias("db")).unionByName(
        df.select(*keys, F.col(end).alias("at"), F.lit(-da).alias("da"), F.lit(-db).alias("db"))
    )
    e = edges(a.where(F.col(end) > F.col(start)), 1, 0).unionByName(edges(b.where(F.col(end) > F.col(start)), 0, 1))
    e = blocks(e.groupBy(*keys, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db")), "at", block)
    e = running_sums(e, keys, "__block", ["at"], {"da": "na", "db": "nb"})
    # a stretch ends where the next begins; the last edge covers nothing
    r = value_runs(e.withColumn("kept", (F.col("na") > 0) & (F.col("nb") <= 0)), keys, "at", "kept", None)
    return r.where("kept AND next IS NOT NULL").select(*keys, F.col("start").alias(start), F.col("next").alias(end))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], fresh: Column, out: str, block: int = HOUR) -> DataFrame:
    """``out``: number of the island a row belongs to; ``fresh`` says where one begins (NULL: here). Blocks are cut by the first of ``order``."""
    d = blocks(df.withColumn("__fresh", F.coalesce(fresh, F.lit(True)).cast("int")), order[0], block)
    return running_sum(d, keys, "__block", order, "__fresh", out).drop("__fresh", "__block")


def coalesce_within(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int, reason: str, block: int = HOUR) -> DataFrame:
    """Ranges of one class at most ``gap`` apart become one; reasons are chained by "; " unless equal to what the chain holds so far.

    A block sums up its ranges, of which the first may go on from the block before. The chain is one text per range of the result, so it is as
    long as that range has different reasons in turn."""
    order = [start, end, reason]
    g = running_max(blocks(df.select(*keys, *order), start, block), keys, "__block", order, end, "__reach")
    w = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("__run", F.sum(F.coalesce(F.col(start) - F.col("__reach") > gap, F.lit(True)).cast("int")).over(w))
    local = g.groupBy(*keys, "__block", "__run").agg(F.min(start).alias("s"), F.max(end).alias("e"), F.array_sort(F.collect_list(F.struct(*order))).alias("said"), F.count(F.lit(1)).alias("n_items"))
    local = local.withColumn("__last", F.col("__run") == F.max("__run").over(Window.partitionBy(*keys, "__block")))
    # run 0 goes on; one or two rows per block can be joined
    e = Window.partitionBy(*keys).orderBy("__block", "__run").rowsBetween(Window.unboundedPreceding, 0)
    edges = local.where("__run = 0 OR __last").withColumn("__whole", F.sum((F.col("__run") > 0).cast("int")).over(e))
    merged = edges.groupBy(*keys, "__whole").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.array_sort(F.flatten(F.collect_list("said"))).alias("said"), F.sum("n_items").alias("n_items"))
    cols = [*keys, "s", "e", "said", "n_items"]
    out = local.where("__run > 0 AND NOT __last").select(*cols).unionByName(merged.select(*cols))
    reasons = F.transform("said", lambda x: x[reason])
    chain = F.reduce(F.slice(reasons, F.lit(2), F.size(reasons)), F.element_at(reasons, 1), lambda a, b: F.when(a == b, a).otherwise(F.concat(a, F.lit("; "), b)))
    return out.select(*keys, F.col("s").alias(start), F.col("e").alias(end), chain.alias(reason), "n_items")


def threshold_runs(df: DataFrame, keys: Sequence[str], order: str, level: str, below: float, longer_than: int, padding: int, block: int = HOUR) -> DataFrame:
    """Runs of consecutive samples under a level, longer than a minimum and padded inwards; the mean is over the unpadded run. A NULL level ends a run."""
    runs = value_runs(df.withColumn("__low", F.col(level) < below), keys, order, "__low", block, total=level).where("__low")
    runs = runs.where(F.col("end") - F.col("start") > longer_than)
    return runs.select(*keys, (F.col("start") + padding).alias("start"), (F.col("end") - padding).alias("end"), (F.col("total") / F.col("n")).alias("mean_level"), "n").where("end > start")


def state_runs(df: DataFrame, keys: Sequence[str], order: str, holds: Column, tolerance: int, block: int = HOUR) -> DataFrame:
    """Stretches over which a state holds: matching samples extend a run, any other closes it; a run ends one tolerance after its last match."""
    runs = value_runs(df.withColumn("__holds", F.coalesce(holds, F.lit(False))), keys, order, "__holds", block).where("__holds")
    return runs.select(*keys, "start", (F.col("end") + tolerance).alias("end"), "n")


def sample_ranges(df: DataFrame, keys: Sequence[str], at: str, holds: Column, tolerance: int) -> DataFrame:
    """Each positive sample covers [t, t + tolerance); ranges that touch are joined."""
    return merge(df.where(holds).select(*keys, F.col(at).alias("start"), (F.col(at) + tolerance).alias("end")), keys, "start", "end")


def visits(df: DataFrame, keys: Sequence[str], order: str, holder: str, at_least: int, rejoin: int, block: int = HOUR) -> DataFrame:
    """Runs with one exclusive holder (NULL: none or several), of a minimum length; then runs of one holder close together are joined again."""
    r = cut_lineage(value_runs(df, keys, order, holder, block).where(F.col(holder).isNotNull() & (F.col("end") - F.col("start") >= at_least)).select(*keys, holder, "start", "end"))
    r = previous(blocks(r.withColumn("__run", F.struct(F.col(holder).alias("holder"), "end")), "start", block), keys, "__block", ["start"], "__run", "__was").drop("__block", "__run")
    was = F.col("__was.value")
    r = islands(r, keys, ["start"], ~((was["holder"] == F.col(holder)) & (F.col("start") - was["end"] < rejoin)), "__m", block)
    return r.groupBy(*keys, "__m", holder).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_runs")).drop("__m")


def opening_run(df: DataFrame, keys: Sequence[str], order: str, active: Column, most_misses: int, at_least: int, block: int = HOUR) -> DataFrame:
    """The run from the beginning in which all are active, over at most ``most_misses`` misses in a row; NULL end if it ends before ``at_least``."""
    r = cut_lineage(value_runs(df.withColumn("__on", F.coalesce(active, F.lit(False))), keys, order, "__on", block))
    broken = r.groupBy(*keys).agg(F.min(F.when(~F.col("__on") & (F.col("n") > most_misses), F.col("start"))).alias("__stop"))
    r = r.join(broken, list(keys)).where("__stop IS NULL OR start < __stop")
    last = r.where("__on").groupBy(*keys).agg(F.max("end").alias("__end"))
    open_ = r.join(last, list(keys)).where("end <= __end").groupBy(*keys).agg((F.sum("n") - 1).cast("int").alias("last_sample"), F.max("__end").alias("end"))
    return open_.select(*keys, "last_sample", F.when(F.col("last_sample") >= at_least, F.col("end")).alias("end"))


def longest_absence(df: DataFrame, keys: Sequence[str], order: str, present: Column, tail: int, block: int = HOUR) -> DataFrame:
    """The longest run without presence, from its first sample to the next presence; an open run ends one ``tail`` after its last sample."""
    r = value_runs(df.withColumn("__on", F.coalesce(present, F.lit(False))), keys, order, "__on", block).where("NOT __on")
    length = F.coalesce(F.col("next"), F.col("end") + tail) - F.col("start")
    best = F.max(F.struct(length.alias("length"), (-F.col("start")).alias("first")))
    return r.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.first")).alias("start"), F.col("b.length").alias("length"))


def _levels(width: int, longest: int | None, *ranges: tuple[DataFrame, str, str]) -> list[int]:
    """Bucket widths: the given one, and as many larger ones, each SPREAD times the last, as the longest range asks for, which is looked up if it isn't known."""
    out = [width]
    longest = longest if longest is not None else max((df.agg(F.max(F.col(e) - F.col(s))).first()[0] or 0) for df, s, e in ranges)
    while longest > out[-1] * SPREAD:
        out.append(out[-1] * SPREAD)
    return out


def _level_of(start: str, end: str, levels: Sequence[int]) -> Column:
    """Which width a range belongs to: the first of which it needs few."""
    size = F.col(end) - F.col(start)
    out = F.lit(len(levels) - 1)
    for n in range(len(levels) - 2, -1, -1):
        out = F.when(size <= levels[n] * SPREAD, F.lit(n)).otherwise(out)
    return out


def _listed(df: DataFrame, start: str, end: str, levels: Sequence[int], out: str, upwards: bool) -> DataFrame:
    """Ranges in all buckets they reach into, as a struct of the bucket's level and number: at their own level or, ``upwards``, at that and all wider ones."""
    own = _level_of(start, end, levels)

    def buckets(n: int) -> Column:
        first, last = (floor_div(c, F.lit(levels[n])) for c in (F.col(start), F.col(end) - 1))
        return F.transform(F.sequence(first, last), lambda b: F.struct(F.lit(n).alias("level"), b.alias("bucket")))

    none = F.array().cast("array<struct<level:int,bucket:bigint>>")
    at = [F.when((own <= n) if upwards else (own == n), buckets(n)).otherwise(none) for n in range(len(levels))]
    return df.withColumn(out, F.explode(F.concat(*at) if len(at) > 1 else at[0]))


def point_in_range(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, end: str, order: Sequence[str], width: int, longest: int | None = None) -> DataFrame:
    """Each point with the first range, by ``order``, that contains it; points in no range keep NULLs, repeated points stay. Ranges have distinct column
    names; repeated, empty and reversed ones and NULL edges don't matter. ``width``: about the length of a range; ``longest``: of the longest, if it is
    known."""
    cols = [c for c in ranges.columns if c not in keys]
    r = ranges.where(F.col(end) > F.col(start)).dropDuplicates()
    levels = _levels(width, longest, (r, start, end))
    rk = [f"__r_{k}" for k in keys]
    r = _listed(r, start, end, levels, "__rb", False).select(*[F.col(k).alias(n) for k, n in zip(keys, rk)], *cols, "__rb")
    p = points.withColumn("__pb", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), floor_div(F.col(at), F.lit(x)).alias("bucket")) for n, x in enumerate(levels)])))
    cond = (F.col("__pb.level") == F.col("__rb.level")) & (F.col("__pb.bucket") == F.col("__rb.bucket")) & (F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))
    for k, n in zip(keys, rk):
        cond = cond & (F.col(k) == F.col(n))
    found = F.when(F.col(start).isNotNull(), F.struct(*order, *[c for c in cols if c not in order]))
    hit = p.join(r, cond, "left").select(*points.columns, "__pb", found.alias("__f"))
    # how often a point is repeated shows in each range that contains it, and in each level where none does
    hit = hit.repartition(*points.columns).groupBy(*points.columns, "__f", F.when(F.col("__f").isNull(), F.col("__pb.level")).alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min(F.struct(F.col("__f").isNull().alias("none"), F.col("__f").alias("f"), F.col("__n").alias("n")))
    out = hit.groupBy(*points.columns).agg(best.alias("__b")).withColumn("__k", F.explode(F.array_repeat(F.lit(1), F.col("__b.n").cast("int"))))
    return out.select(*points.columns, *[F.col(f"__b.f.{c}").alias(c) for c in cols])


def overlap_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], a_range: tuple[str, str], b_range: tuple[str, str], width: int, longest: int | None = None) -> DataFrame:
    """All pairs of overlapping ranges of one entity, once: a pair is reported in the bucket where the later of the two begins, at the level of the longer."""
    (s, e), (t, u) = a_range, b_range
    bk = [f"__b_{k}" for k in keys]
    a, b = a.where(F.col(e) > F.col(s)), b.where(F.col(u) > F.col(t))
    levels = _levels(width, longest, (a, s, e), (b, t, u))
    left = _listed(a.withColumn("__al", _level_of(s, e, levels)), s, e, levels, "__ab", True)
    right = _listed(b.withColumn("__bl", _level_of(t, u, levels)), t, u, levels, "__bb", True).select(*[F.col(k).alias(n) for k, n in zip(keys, bk)], *[c for c in b.columns if c not in keys], "__bl", "__bb")
    home = F.lit(None).cast("bigint")
    for n, x in enumerate(levels):
        home = F.when(F.col("__ab.level") == n, floor_div(F.greatest(s, t), F.lit(x))).otherwise(home)
    cond = (F.col("__ab.level") == F.col("__bb.level")) & (F.col("__ab.bucket") == F.col("__bb.bucket")) & (F.col(s) < F.col(u)) & (F.col(t) < F.col(e))
    cond = cond & (F.col("__ab.level") == F.greatest("__al", "__bl")) & (home == F.col("__ab.bucket"))
    for k, n in zip(keys, bk):
        cond = cond & (F.col(k) == F.col(n))
    return left.join(right, cond).drop("__ab", "__bb", "__al", "__bl", *bk)


def nearest_samples(points: DataFrame, samples: DataFrame, keys: Sequence[str], at: str, sample_at: str, value: Sequence[str], block: int = HOUR) -> DataFrame:
    """Each point with the last sample at or before it and the first at or after it, as structs ``before`` and ``after`` (two-sided as-of).

    Of samples at one time the one with the least value counts. A block of time also gets the last sample before it and the first behind it."""
    v = F.struct(F.col(sample_at).alias("at"), *value)
    own = samples.where(F.col(sample_at).isNotNull()).select(*keys, F.col(sample_at).alias("__t"), v.alias("__v"))
    kind = own.schema["__v"].dataType
    p = blocks(points.withColumn("__t", F.col(at)), "__t", block).withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(kind))
    s = blocks(own, "__t", block)
    backwards = F.struct((-F.col("__v.at")).alias("t"), *[F.col(f"__v.{c}").alias(c) for c in value], F.col("__v").alias("v"))
    edges = s.groupBy(*keys, "__block").agg(F.min("__v").alias("__first"), F.min(backwards)["v"].alias("__last")).unionByName(p.select(*keys, "__block").distinct(), allowMissingColumns=True)
    edges = edges.groupBy(*keys, "__block").agg(F.first("__first", ignorenulls=True).alias("__first"), F.first("__last", ignorenulls=True).alias("__last"))
    o = Window.partitionBy(*keys).orderBy("__block")
    edges = edges.select(*keys, "__block", F.last("__last", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1)).alias("b"), F.first("__first", ignorenulls=True).over(o.rowsBetween(1, Window.unboundedFollowing)).alias("a"))
    guests = edges.select(*keys, "__block", F.explode(F.array_compact(F.array("b", "a"))).alias("__v")).withColumn("__t", F.col("__v.at"))
    u = p.unionByName(s.unionByName(guests).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "__block")
    # the least value comes last
    falling = [F.col(f"__v.{c}").desc_nulls_last() for c in value]
    back = w.orderBy("__t", "__side", *falling).rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.orderBy(F.col("__t").desc(), "__side", *falling).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("before", F.last("__v", ignorenulls=True).over(back)).withColumn("after", F.last("__v", ignorenulls=True).over(ahead))
    return u.where("__side = 1").select(*points.columns, "before", "after")


def nearest(points: DataFrame, samples: DataFrame, keys: Sequence[str], at: str, sample_at: str, sample_id: str, most: int | None = None, block: int = HOUR) -> DataFrame:
    """Nearest sample of each point, the earlier of two equally near, optionally at most ``most`` away: adds sample_id and ``distance``."""
    n = nearest_samples(points, samples, keys, at, sample_at, [sample_id], block)
    option = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.at") - F.col(at)).alias("distance"), F.col(f"{c}.at").alias("at"), F.col(f"{c}.{sample_id}").alias("id")))
    best = F.array_min(F.array_compact(F.array(option("before"), option("after"))))
    n = n.withColumn("__b", best)
    ok = F.lit(True) if most is None else F.col("__b.distance") <= most
    return n.select(*points.columns, F.when(ok, F.col("__b.id")).alias(sample_id), F.when(ok, F.col("__b.distance")).alias("distance"))


def gaps_between(df: DataFrame, keys: Sequence[str], order: str, start: str, end: str, longer_than: int, block: int = PLACES) -> DataFrame:
    """Pauses between neighbours: after each row but the last, from its end to the next start, longer than a minimum. ``block``: units of ``order``."""
    g = following(blocks(df, order, block), keys, "__block", [order], start, "__next").drop("__block")
    g = g.withColumn("gap_start", F.col(end)).withColumn("gap_end", F.col("__next.value")).drop("__next")
    return g.where((F.col("gap_end") > F.col("gap_start")) & (F.col("gap_end") - F.col("gap_start") > longer_than))


def capped_gaps(gaps: DataFrame, maximum: int) -> DataFrame:
    """What to remove so that no gap is longer than a maximum."""
    return gaps.where(F.col("gap_end") - F.col("gap_start") > maximum).withColumn("gap_start", F.col("gap_start") + maximum)


def change_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, block: int = HOUR) -> DataFrame:
    """Rows whose value differs from the row before; the first row of an entity is none."""
    d = previous(blocks(df, order[0], block), keys, "__block", order, value, "__was").drop("__block")
    return d.where(F.col("__was").isNotNull() & ~F.col(value).eqNullSafe(F.col("__was.value"))).drop("__was")


def adjacent_overlaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str, block: int = HOUR) -> DataFrame:
    """Rows that reach past the start of the next in order, with ``by``, how far."""
    d = following(blocks(df, order[0], block), keys, "__block", order, start, "__next").drop("__block")
    return d.where(F.col("__next.value") < F.col(end)).withColumn("by", F.col(end) - F.col("__next.value")).drop("__next")


def turns_of(segments: DataFrame, start: str, end: str, least: int = 3 * 10**5) -> DataFrame:
    """Segments of speakers as turns: those of at least 0.3 s (of microseconds). Shorter, reversed and open ones are none."""
    return segments.where(F.col(end) - F.col(start) >= least)


def padded_span(start: Column, end: Column, pad: int) -> tuple[Column, Column]:
    return F.greatest(start - pad, F.lit(0)), end + pad


def milli(c: Column) -> Column:
    """Microseconds cut to milliseconds."""
    return int_div(c, F.lit(1000)) * 1000
