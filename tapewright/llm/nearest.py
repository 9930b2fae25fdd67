"""Pairing records of two tables by nearest time.

Each right-hand record owns the interval of times to which it is the nearest: from the midpoint with
the record before to the midpoint with the record after, cut at the tolerance. The intervals are indexed
by entity and time bucket, and each left-hand time is looked up in its own bucket: an equi-join with a
range condition. Both sides are shuffled once, by entity and bucket, so an entity with any share of the
rows is spread over all its buckets. Interval ends are whole ticks, widened by one; the few records that
then claim the same left-hand time are told apart by their exact rational distances.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import exact_time as X


#: Two times with larger denominators may share a tick and its rest.
MAX_DENOMINATOR = 8 * 10**8


def _checked(den: Column) -> Column:
    return F.when(den > MAX_DENOMINATOR, F.raise_error(F.lit(f"a time has a denominator over {MAX_DENOMINATOR}")).cast("bigint")).otherwise(den)


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_id: str,
    entity: str = "asset",
    left_time: tuple[str, str] = ("start_num", "start_den"),
    right_time: tuple[str, str] = ("time_num", "time_den"),
    tolerance: tuple[int, int] = (2, 5),
    bucket_seconds: int = 8,
) -> DataFrame:
    """``left_keys`` and ``right_id`` of each left record and the right record nearest in time.

    Only pairs of one entity at most ``tolerance`` (a fraction of seconds, inclusive) apart count; of two
    equally near records the earlier wins, of several at the same time the one with the least id. Left out
    are rows with a NULL entity or time on either side, or a zero denominator. Repeated rows with the same
    keys give one row; a left record without a partner gives none; an empty side gives an empty result.
    Other columns are ignored, whatever their names. Exact for denominators up to MAX_DENOMINATOR; a larger one is an error.
    """
    tol_num, tol_den = tolerance
    reach = -(-tol_num * X.TICKS // tol_den) + 2
    width = max(bucket_seconds * X.TICKS, 2 * reach)
    bucket = lambda c: X.floor_div(c, F.lit(width))

    rn, rd = X.signed(*right_time)
    r = right.select(F.col(entity).alias("e"), F.col(right_id).alias("rid"), rn.alias("rn"), _checked(rd).alias("rd"), X.tick(*right_time).alias("rt"), X.sub_tick(*right_time).alias("rs"))
    r = r.where("e IS NOT NULL AND rid IS NOT NULL AND rt IS NOT NULL")
    r = r.withColumn("b", F.explode(F.sequence(bucket(F.col("rt") - reach), bucket(F.col("rt") + reach))))
    r = r.repartition("e", "b").groupBy("e", "b", "rt", "rs").agg(F.min(F.struct("rid", "rn", "rd")).alias("r"))
    in_time = Window.partitionBy("e", "b").orderBy("rt", "rs")
    before, after = F.lag("rt").over(in_time), F.lead("rt").over(in_time)
    r = r.select(
        "e",
        "b",
        "rt",
        "rs",
        "r.*",
        F.greatest(F.col("rt") - reach, X.floor_div(before + F.col("rt"), F.lit(2)) - 1).alias("lo"),
        F.least(F.col("rt") + reach, X.floor_div(after + F.col("rt"), F.lit(2)) + 2).alias("hi"),
    )

    ln, ld = X.signed(*left_time)
    l = left.select(F.col(entity).alias("le"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(left_keys)], ln.alias("ln"), _checked(ld).alias("ld"), X.tick(*left_time).alias("lt"))
    l = l.where("le IS NOT NULL AND lt IS NOT NULL").withColumn("lb", bucket(F.col("lt")))
    keys = [f"k{i}" for i in range(len(left_keys))]

    hit = l.join(r, (F.col("le") == F.col("e")) & (F.col("lb") == F.col("b")) & F.col("lt").between(F.col("lo"), F.col("hi")))
    hit = hit.where(X.within(F.col("rn"), F.col("rd"), F.col("ln"), F.col("ld"), tol_num, tol_den))
    best = F.min(F.struct(X.distance_key(F.col("rn"), F.col("rd"), F.col("ln"), F.col("ld")).alias("d"), "rt", "rs", "rid"))
    # grouped by the join's own keys first: no further shuffle
    return hit.groupBy("e", "b", *keys).agg(best.alias("best")).select(*[F.col(k).alias(c) for k, c in zip(keys, left_keys)], F.col("best.rid").alias(right_id))
