"""Robust aggregates, trends and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.exact_time import int_div
from tapewright.operators.blocked import running_sum
from tapewright.session import cut_lineage


#: Values of one block of ranks: so many to a doubling of size.
PER_OCTAVE = 16


def upper_median(n: Column) -> Column:
    """The rank (from 0) of the middle value of n, of two the upper."""
    return F.floor(n / 2)


def nearest_rank(share: float, rounded: bool = False):
    """The rank (from 0) at (n - 1) * share, rounded down or to the nearest."""
    return lambda n: F.round((n - 1) * share) if rounded else F.floor((n - 1) * share)


def _size_block(value: Column) -> Column:
    """Blocks in the order of the values: by sign and logarithm."""
    steps = F.floor(F.log2(F.abs(value)) * PER_OCTAVE).cast("bigint") + 20_000
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, steps).otherwise(-steps)


def at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, object], count: str = "n") -> DataFrame:
    """One row per group with the values at ranks (name -> function of the number of values), from the counts of the distinct values.

    Values are counted before they are shuffled, and summed up in blocks by size, so a group of any size is spread; nothing gathers its values. NULLs
    don't count and a group without values gives no row. Also ``count``, the number of values.
    """
    c = df.select(*keys, F.col(value).alias("__v")).where("__v IS NOT NULL").groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    c = c.withColumn("__block", _size_block(F.col("__v").cast("double")))
    inner = c.groupBy(*keys, "__block").agg(F.sum("__c").alias("__s"))
    w = Window.partitionBy(*keys)
    blocks = inner.select(*keys, "__block", (F.sum("__s").over(w.orderBy("__block")) - F.col("__s")).alias("__before"), F.sum("__s").over(w).alias(count), F.col("__s"))
    # only the blocks that hold a rank
    wanted = [r(F.col(count)) for r in ranks.values()]
    holds = F.lit(False)
    for r in wanted:
        holds = holds | ((r >= F.col("__before")) & (r < F.col("__before") + F.col("__s")))
    blocks = blocks.where(holds).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), "__before", count)
    cond = F.col("__block") == F.col("__b")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    j = c.join(blocks, cond).withColumn("__upto", F.col("__before") + F.sum("__c").over(Window.partitionBy(*keys, "__block").orderBy("__v")))
    pick = [F.max(F.when((F.col("__upto") > r) & (F.col("__upto") - F.col("__c") <= r), F.col("__v"))).alias(name) for name, r in zip(ranks, wanted)]
    return j.groupBy(*keys).agg(*pick, F.max(count).alias(count))


def ranked_value(df: DataFrame, keys: Sequence[str], value: str, rank, count: str = "n") -> DataFrame:
    """The value at a rank (a function of their number) in each group, and how many there are."""
    return at_ranks(df, keys, value, {"__r": rank}, count).select(*keys, F.col("__r").alias(value), count)


def medians(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The median of each group (the mean of the two middle values), from ranks: keys and ``out``."""
    r = at_ranks(df, keys, value, {"__low": lambda n: F.floor((n - 1) / 2), "__high": upper_median}, "__n")
    return r.select(*keys, ((F.col("__low") + F.col("__high")) / 2).alias(out))


def robust_z(df: DataFrame, keys: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """(v - median) / (1.4826 MAD) within groups; where the MAD is 0 it is 0 at the median and an infinity beside it. The input is read several times."""
    w = df.where(F.col(value).isNotNull())
    j = w.join(cut_lineage(medians(w, keys, value, "med")), list(keys))
    mad = medians(j.select(*keys, F.abs(F.col(value) - F.col("med")).alias("__off")), keys, "__off", "mad")
    j = j.join(mad, list(keys))
    off = F.col(value) - F.col("med")
    z = F.when(F.col("mad") > 0, off / (1.4826 * F.col("mad"))).when(off == 0, 0.0).when(off > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return j.withColumn(out, z)


def _without_one(df: DataFrame, group: Sequence[str], value: str, tie: str, out: str) -> DataFrame:
    """``out``: the averaged median of the other rows' values in the group, from the ranks alone: no row meets another. Ranks come from blocks of size."""
    r = df.withColumn("__block", _size_block(F.col(value).cast("double"))).withColumn("__one", F.lit(1).cast("bigint"))
    r = running_sum(r, group, "__block", [value, tie], "__one", "__r").withColumn("__r", F.col("__r") - 1).drop("__block", "__one")
    names = {g: f"__{g}" for g in group}
    n = df.groupBy(*[F.col(g).alias(names[g]) for g in group]).agg(F.count(F.lit(1)).alias("__n"))
    same = [F.col(g).eqNullSafe(F.col(names[g])) for g in group]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    r = r.join(n, cond).drop(*names.values())
    low, high = int_div(F.col("__n") - 2, F.lit(2)), int_div(F.col("__n") - 1, F.lit(2))
    at = lambda j, name: F.max(F.when(F.col("__r") == j, F.col(value))).alias(name)
    stats = r.groupBy(*[F.col(g).alias(names[g]) for g in group]).agg(at(low, "__l0"), at(low + 1, "__l1"), at(high, "__h0"), at(high + 1, "__h1"))
    j = r.join(stats, cond)
    rest = lambda k, a, b: F.when(k < F.col("__r"), F.col(a)).otherwise(F.col(b))
    med = F.when(F.col("__n") > 1, (rest(low, "__l0", "__l1") + rest(high, "__h0", "__h1")) / 2)
    return j.withColumn(out, med).withColumn("n_others", F.col("__n") - 1).drop("__r", "__n", "__l0", "__l1", "__h0", "__h1", *names.values())


def history_deviations(history: DataFrame, metric: str, value: str, video: str, least: int = 5, threshold: float = 3.0) -> DataFrame:
    """Metrics of a recording that stand out against all other recordings': at least ``least`` others with the metric, |z| over the threshold.

    ``history``: one value per video and metric; NULL values don't count, too little history gives no row. The median without a
    recording follows from its rank, and takes at most four values in a metric; for each of those the deviations are ranked once. So
    the work is that of a few sorts, not of all pairs. Returns video, metric, value, n_others, z.
    """
    h = history.select(F.col(video).alias("video"), F.col(metric).alias("metric"), F.col(value).cast("double").alias("x")).where("video IS NOT NULL AND metric IS NOT NULL AND x IS NOT NULL")
    own = _without_one(h, ["metric"], "x", "video", "med").where(F.col("n_others") >= least)
    meds = own.select(F.col("metric").alias("m_metric"), F.col("med").alias("m_med")).distinct()
    dev = h.join(meds, F.col("metric") == F.col("m_metric")).select("video", "metric", F.col("m_med").alias("med"), F.abs(F.col("x") - F.col("m_med")).alias("dev"))
    mad = _without_one(dev, ["metric", "med"], "dev", "video", "mad").select(F.col("video").alias("v2"), F.col("metric").alias("m2"), F.col("med").alias("d2"), "mad")
    j = own.join(mad, (F.col("video") == F.col("v2")) & (F.col("metric") == F.col("m2")) & (F.col("med") == F.col("d2")))
    off = F.col("x") - F.col("med")
    z = F.when(F.col("mad") > 0, off / (1.4826 * F.col("mad"))).when(off == 0, 0.0).when(off > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return j.withColumn("z", z).where(F.abs("z") > threshold).select(F.col("video").alias(video), F.col("metric").alias(metric), F.col("x").alias(value), "n_others", "z")


def trend(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, last: int = 10, hours: str | None = None) -> DataFrame:
    """The trend of the last rows of each group: slope per step (least squares against their index, 0 for fewer than two), n, first and last value, and why it
    doesn't show that the value falls (NULL if it does): too few rows, a slope that isn't negative, or a row without ``hours`` to be a rate of."""
    w = Window.partitionBy(*keys)
    r = df.withColumn("__back", F.row_number().over(w.orderBy(*[F.col(c).desc() for c in order]))).where(F.col("__back") <= last)
    empty = F.max(F.coalesce(F.col(hours) <= 0, F.lit(True))) if hours else F.lit(False)
    slope = F.coalesce(F.round(F.regr_slope(value, -F.col("__back")), 9), F.lit(0.0))
    g = r.groupBy(*keys).agg(slope.alias("slope"), F.count(F.lit(1)).alias("n"), F.max_by(value, "__back").alias("first"), F.min_by(value, "__back").alias("last"), empty.alias("__empty"))
    why = F.when(F.col("n") < last, "too few").when(F.col("slope") >= 0, "not falling").when(F.col("__empty"), "no footage")
    return g.withColumn("shortfall", why).drop("__empty")


def per_hour(count: Column, hours: Column) -> Column:
    """A rate, 0 where there are no hours."""
    return F.when(hours > 0, count / hours).otherwise(0.0)


def share(condition: Column) -> Column:
    """Share of the rows for which a condition holds: an aggregate, 0 of nothing."""
    return F.coalesce(F.avg(condition.cast("int")), F.lit(0.0))


def first_seen(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Distinct values in the order in which they first appear."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("first_at"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("first_at", value)))


def screen_time(df: DataFrame, keys: Sequence[str], text: str, at: str) -> DataFrame:
    """How long each line is on screen: sightings times the interval of the first two frames of the recording."""
    head = df.groupBy(*keys).agg(F.min(at).alias("__head"))
    # a recording with one frame has a step of 0
    step = F.coalesce(F.min(F.when(F.col(at) > F.col("__head"), F.col(at) - F.col("__head"))), F.lit(0))
    first = df.select(*keys, at).join(head, list(keys)).groupBy(*keys).agg(step.alias("step"))
    return df.groupBy(*keys, text).agg(F.count(F.lit(1)).alias("n")).join(first, list(keys)).select(*keys, text, "n", (F.col("n") * F.col("step")).alias("on_screen"))


def preferences(notes: DataFrame, offer_at: int = 3) -> DataFrame:
    """Notes of one wording and project as one preference: how often, when first and last, confidence, and whether to offer it for promotion.

    ``notes``: note, project (may be NULL), at. Confidence is min(50 + 5 min(n, 10), 90) / 100.
    """
    from tapewright.functions.normalise import key

    g = notes.groupBy(key(F.col("note")).alias("note"), "project").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return g.withColumn("confidence", F.least(50 + 5 * F.least("n", F.lit(10)), F.lit(90)) / 100).withColumn("offer", F.col("n") >= offer_at)


def budget(items: DataFrame, keys: Sequence[str], start: str, end: str, total: Column, most: float = 0.2) -> DataFrame:
    """Time to review, its share of the piece, and whether the review is selective."""
    return items.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("review"), F.max(total).alias("total")).withColumn("share", F.when(F.col("total") > 0, F.col("review") / F.col("total")).otherwise(0.0)).withColumn("selective", F.col("share") <= most)


def grid_cell(x: Column, y: Column, width: int, height: int, cells: int = 10) -> Column:
    """Cell of a position on a square grid over the picture."""
    at = lambda c, size: F.least(F.greatest(F.floor(c * cells / size), F.lit(0)), F.lit(cells - 1)).cast("int")
    return at(y, height) * cells + at(x, width)
