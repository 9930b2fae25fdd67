"""Features of sampled series: levels, loudness, silence, histogram distances, shots, thresholds and lags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.measures import decibels
from tapewright.operators.blocked import blocks, previous, with_halo

#: Rows, or units of an order that counts, per block.
PLACES = 50_000

# Gates and weights of programme loudness.
ABSOLUTE_GATE = -70.0
RELATIVE_GATE = -10.0
RANGE_GATE = -20.0
LOUDNESS_OFFSET = -0.691
#: Of left, right, centre, low effects, left and right surround.
CHANNEL_WEIGHTS = (1.0, 1.0, 1.0, 0.0, 1.41, 1.41)


def l1_distance(a: Column, b: Column) -> Column:
    """Sum of absolute differences over 3 channels; 0 for vectors of different sizes."""
    diff = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), diff / 3).otherwise(0.0)


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference in shares of 255; 1 for vectors of different sizes or none."""
    diff = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), diff / F.size(a) / 255).otherwise(1.0)


def consecutive_distance(df: DataFrame, keys: Sequence[str], order: str, vector: str, block: int = PLACES) -> DataFrame:
    """Adds the distance of each row's vector from that of the row before; NULL at the first row. ``block``: units of ``order``."""
    d = previous(blocks(df, order, block), keys, "__block", [order], vector, "__was").drop("__block")
    return d.withColumn("distance", F.when(F.col("__was.value").isNotNull(), l1_distance(F.col("__was.value"), F.col(vector)))).drop("__was")


def block_power(hops: DataFrame, keys: Sequence[str], hop: str, energy: str, samples: str, hops_per_block: int = 4, places: int = PLACES) -> DataFrame:
    """Mean square of overlapping blocks of whole hops (a block ends at its hop; the first, incomplete ones are dropped)."""
    h = with_halo(hops.select(*keys, hop, energy, samples), keys, [hop], hops_per_block, PLACES, places)
    w = Window.partitionBy(*keys, "__block").orderBy(hop).rowsBetween(1 - hops_per_block, 0)
    b = h.select(*keys, hop, "__halo", (F.sum(energy).over(w) / F.sum(samples).over(w)).alias("power"), F.count(F.lit(1)).over(w).alias("__n"))
    return b.where((F.col("__n") == hops_per_block) & ~F.col("__halo")).drop("__n", "__halo")


def _windowed(powers: DataFrame, keys: Sequence[str], order: str, power: str, size: int, places: int = PLACES) -> DataFrame:
    """keys, p (the block's power) and long (the mean of the last ``size`` blocks, NULL before there are so many)."""
    h = with_halo(powers.select(*keys, order, F.col(power).alias("p")), keys, [order], size, PLACES, places)
    w = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(1 - size, 0)
    h = h.select(*keys, "p", "__halo", F.avg("p").over(w).alias("long"), F.count(F.lit(1)).over(w).alias("__n"))
    return h.where("NOT __halo").select(*keys, "p", F.when(F.col("__n") == size, F.col("long")).alias("long"))


def channel_power(powers: DataFrame, keys: Sequence[str], hop: str, channel: str, power: str = "power", weights: Sequence[float] = CHANNEL_WEIGHTS) -> DataFrame:
    """The weighted sum of the channels' powers in each block: keys, hop, power. Channels are numbered in the order of the weights; others count nothing."""
    weight = F.coalesce(F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col(channel)), F.lit(0.0))
    return powers.groupBy(*keys, hop).agg(F.sum(F.col(power) * weight).alias("power"))


def loudness_maxima(powers: DataFrame, keys: Sequence[str], order: str, power: str = "power", blocks_per_window: int = 30) -> DataFrame:
    """The largest momentary loudness (of a block) and short-term loudness (of a window of blocks), NULL where there is none but silence."""
    s = _windowed(powers, keys, order, power, blocks_per_window)
    return s.groupBy(*keys).agg(loudness(F.max("p")).alias("momentary"), loudness(F.max("long")).alias("short_term"))


def loudness(power: Column) -> Column:
    """LUFS of a mean square, NULL for silence."""
    return F.when(power > 0, F.lit(LOUDNESS_OFFSET) + 10 * F.log10(power))


def integrated_loudness(powers: DataFrame, keys: Sequence[str], power: str = "power") -> DataFrame:
    """Two-stage gated loudness: blocks over the absolute gate, then those over 10 below their mean. NULL if no block passes."""
    b = powers.where(loudness(F.col(power)) > ABSOLUTE_GATE)
    gate = b.groupBy(*keys).agg((loudness(F.avg(power)) + RELATIVE_GATE).alias("__gate"))
    passed = b.join(gate, list(keys)).where(loudness(F.col(power)) > F.col("__gate"))
    out = passed.groupBy(*keys).agg(loudness(F.avg(power)).alias("integrated"), F.count(F.lit(1)).alias("n_blocks"))
    return powers.select(*keys).distinct().join(out, list(keys), "left")


def loudness_range(powers: DataFrame, keys: Sequence[str], order: str, power: str = "power", blocks_per_window: int = 30) -> DataFrame:
    """Spread between the 10th and 95th percentile (nearest rank, rounded) of the short-term loudness, gated at -70 and 20 below the mean."""
    from tapewright.operators.statistics import at_ranks, nearest_rank

    s = _windowed(powers, keys, order, power, blocks_per_window).where("long IS NOT NULL").select(*keys, F.col("long").alias("p"))
    s = s.where(loudness(F.col("p")) > ABSOLUTE_GATE)
    gate = s.groupBy(*keys).agg((loudness(F.avg("p")) + RANGE_GATE).alias("__gate"))
    s = s.join(gate, list(keys)).where(loudness(F.col("p")) > F.col("__gate")).withColumn("l", loudness(F.col("p")))
    r = at_ranks(s, keys, "l", {"high": nearest_rank(0.95, True), "low": nearest_rank(0.10, True)})
    return r.select(*keys, (F.col("high") - F.col("low")).alias("loudness_range"))


def gain_to(target: Column, integrated: Column) -> Column:
    """What to add to reach a loudness, NULL where it isn't known."""
    return target - integrated


def rms_frames(samples: DataFrame, keys: Sequence[str], n: str, value: str, size: int) -> DataFrame:
    """Level in dBFS of consecutive frames of samples; a last, incomplete frame is dropped."""
    g = samples.groupBy(*keys, F.call_function("div", F.col(n), F.lit(size)).alias("frame")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count(F.lit(1)).alias("__n"))
    return g.where(F.col("__n") == size).select(*keys, "frame", decibels(F.col("rms")).alias("db"))


def silence_profile(frames: DataFrame, keys: Sequence[str], db: str = "db", below_speech: float = 25.0) -> DataFrame:
    """Speech level (55th percentile of the frames over -45 dB), noise floor (10th of all) and the threshold under which it is silent."""
    from tapewright.operators.statistics import at_ranks, nearest_rank

    floor = at_ranks(frames, keys, db, {"noise_floor": nearest_rank(0.10)}).select(*keys, "noise_floor")
    speech = at_ranks(frames.where(F.col(db) > -45), keys, db, {"speech_level": nearest_rank(0.55)}).select(*keys, "speech_level")
    g = floor.join(speech, list(keys), "left").select(*keys, F.coalesce("speech_level", F.lit(-120.0)).alias("speech_level"), "noise_floor")
    return g.withColumn("threshold", F.col("speech_level") - below_speech)


def cut_scores(df: DataFrame, keys: Sequence[str], distance: str = "distance", factor: float = 6.0, least: float = 0.08) -> DataFrame:
    """Threshold of shot cuts: a multiple of the upper median distance, at least a fixed value; ``is_cut`` is strict. Without a distance nothing is a cut."""
    from tapewright.operators.statistics import ranked_value, upper_median

    t = ranked_value(df, keys, distance, upper_median).select(*keys, F.greatest(factor * F.col(distance), F.lit(least)).alias("threshold"))
    return df.join(t, list(keys), "left").withColumn("is_cut", F.coalesce(F.col(distance) > F.col("threshold"), F.lit(False)))


def shots_of_cuts(scores: DataFrame, keys: Sequence[str], at: str, distance: str, end: DataFrame, shortest: int) -> DataFrame:
    """Shots from frames with ``is_cut``: keys, shot, start, end, boundary_score.

    ``end``: keys and ``end`` of each recording. A cut counts if more than ``shortest`` lies between it and the last one that did (or 0), which is decided in
    order, over the cuts of one recording alone; the shot behind it carries its distance. What is left is a shot of any length; without cuts the whole recording is one.
    """
    import pandas as pd

    cuts = scores.where("is_cut").select(*keys, F.col(at).cast("bigint").alias("at"), F.col(distance).cast("double").alias("score"))
    j = end.select(*keys, "end").join(cuts, list(keys), "left")
    kinds = ", ".join(f"{k} {end.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        stop, start, score, out = int(pdf["end"].iloc[0]), 0, 0.0, []
        for t, s in sorted((int(t), s) for t, s in zip(pdf["at"], pdf["score"]) if t == t and t is not pd.NA and t is not None):
            if t - start > shortest:
                out.append((*key, len(out), start, t, score))
                start, score = t, s
        if start < stop or not out:
            out.append((*key, len(out), start, max(stop, start), score))
        return pd.DataFrame(out, columns=[*keys, "shot", "start", "end", "boundary_score"])

    return j.groupBy(*keys).applyInPandas(run, f"{kinds}, shot int, start bigint, end bigint, boundary_score double")


def otsu_threshold(df: DataFrame, keys: Sequence[str], value: str, bins: int = 128, fallback: float = 0.005) -> DataFrame:
    """Otsu's threshold over logarithmic bins: the edge with the largest between-class variance, the first of equals.

    Eight values or fewer, or all alike, give the fallback. Values below 1e-6 count as 1e-6.
    """
    v = df.where(F.col(value).isNotNull()).select(*keys, F.log10(F.greatest(F.col(value).cast("double"), F.lit(1e-6))).alias("x"))
    s = v.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    j = v.join(s, list(keys)).where("hi > lo AND n > 8")
    j = j.withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int"))
    h = j.groupBy(*keys, "lo", "hi", "n", "bin").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    h = h.withColumn("w0", F.sum("c").over(w)).withColumn("s0", F.sum(F.col("c") * F.col("bin")).over(w)).withColumn("st", F.sum(F.col("c") * F.col("bin")).over(whole))
    h = h.where("w0 < n")
    between = F.col("w0") * (F.col("n") - F.col("w0")) * F.pow(F.col("s0") / F.col("w0") - (F.col("st") - F.col("s0")) / (F.col("n") - F.col("w0")), F.lit(2))
    best = h.withColumn("v", F.round(between, 6)).groupBy(*keys, "lo", "hi").agg(F.max(F.struct("v", (-F.col("bin")).alias("b"))).alias("m"))
    t = best.select(*keys, F.pow(F.lit(10.0), F.col("lo") + (-F.col("m.b") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("t"))
    return s.select(*keys).join(t, list(keys), "left").select(*keys, F.coalesce("t", F.lit(fallback)).alias("threshold"))


def best_lag(a: DataFrame, b: DataFrame, keys: Sequence[str], at: str, value: str, maximum: int) -> DataFrame:
    """The shift of b against a with the least mean absolute difference, if it is under 0.8 of that without shift and not at the limit.

    ``at`` is a sample index. Returns keys, lag (NULL if none qualifies), difference, baseline.
    """
    x = a.select(*keys, F.col(at).alias("i"), F.col(value).alias("x"))
    y = b.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(at).alias("j"), F.col(value).alias("y"))
    shifted = x.withColumn("lag", F.explode(F.sequence(F.lit(-maximum), F.lit(maximum))))
    cond = F.col("i") + F.col("lag") == F.col("j")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    d = shifted.join(y, cond).groupBy(*keys, "lag").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("d"))
    d = d.withColumn("d", F.round("d", 9))
    base = F.max(F.when(F.col("lag") == 0, F.col("d")))
    g = d.groupBy(*keys).agg(F.min(F.struct("d", F.abs("lag").alias("size"), "lag")).alias("m"), base.alias("baseline"))
    ok = (F.col("m.d") < 0.8 * F.col("baseline")) & (F.col("m.size") < maximum)
    return g.select(*keys, F.when(ok, F.col("m.lag")).alias("lag"), F.col("m.d").alias("difference"), "baseline")


def classify_frames(stats: DataFrame, low: Column, high: Column, tagged: Column) -> DataFrame:
    """Flags of frame statistics (min, max, mean, diff): illegal levels (undecidable, NULL, without a range tag), black, repeated."""
    return stats.withColumn("illegal", F.when(tagged, (F.col("min") < low) | (F.col("max") > high))).withColumn("black", F.col("mean") < 17).withColumn("repeated", F.coalesce(F.col("diff") < 0.05, F.lit(False)))


def cadence(df: DataFrame, keys: Sequence[str], at: str, first: int = 12) -> DataFrame:
    """Frames per second from the first timestamps (microseconds): 1 over the upper median of the positive gaps; NULL with fewer than three timestamps."""
    from tapewright.operators.statistics import ranked_value, upper_median

    w = Window.partitionBy(*keys).orderBy(at)
    # only the first rows of each partition are shuffled
    g = df.select(*keys, at).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= first).withColumn("gap", F.col(at) - F.lag(at).over(w))
    n = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    m = n.join(ranked_value(g.where("gap > 0"), keys, "gap", upper_median, "n_gaps"), list(keys), "left")
    return m.select(*keys, F.when((F.col("n") >= 3) & (F.col("gap") > 0), F.lit(1e6) / F.col("gap")).alias("fps"))


def mask_coverage(cells: DataFrame, keys: Sequence[str], present: str, layer: int, region: tuple[int, int, int, int]) -> DataFrame:
    """Share of a region's pixels that a layer covers: ``cells`` has x, y and a bit mask of the layers present; an edge crosses it between 2 and 98 %."""
    x0, y0, x1, y1 = region
    c = cells.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1))
    bit = F.col(present).bitwiseAND(1 << layer) != 0
    g = c.groupBy(*keys).agg(F.avg(bit.cast("int")).alias("coverage"), F.count_if(F.col(present) == 0).alias("uncovered"), F.min(F.when(bit, F.col("x"))).alias("min_x"), F.max(F.when(bit, F.col("x"))).alias("max_x"))
    return g.withColumn("edge_crosses", (F.col("coverage") > 0.02) & (F.col("coverage") < 0.98))


def k_weighting(rate: int) -> list[tuple[float, float, float, float, float]]:
    """The two filters of programme loudness at a sample rate, as (b0, b1, b2, a1, a2): a high shelf and a high pass."""
    import math

    def shelf(f: float, gain: float, q: float) -> tuple[float, float, float, float, float]:
        k = math.tan(math.pi * f / rate)
        vh = 10 ** (gain / 20)
        vb = vh**0.4996667741545416
        a0 = 1 + k / q + k * k
        return ((vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)

    def high_pass(f: float, q: float) -> tuple[float, float, float, float, float]:
        k = math.tan(math.pi * f / rate)
        a0 = 1 + k / q + k * k
        return (1.0, -2.0, 1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)

    # fixed values: corner frequencies, gain and quality of the two stages
    return [shelf(1681.974450955533, 3.999843853973347, 0.7071752369554196), high_pass(38.13547087602444, 0.5003270373238773)]


def weighted(samples: DataFrame, keys: Sequence[str], n: str, value: str, rate: int) -> DataFrame:
    """K-weighted samples of each channel, in order: a recursive filter, so it runs per channel of a recording."""
    import pandas as pd

    filters = k_weighting(rate)
    s = samples.select(*keys, n, F.col(value).cast("double").alias("v"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(n)
        x = pdf["v"].tolist()
        for b0, b1, b2, a1, a2 in filters:
            z1 = z2 = 0.0
            out = []
            for v in x:
                y = b0 * v + z1
                z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
                out.append(y)
            x = out
        return pdf.assign(v=x)

    return s.groupBy(*keys).applyInPandas(run, schema).withColumnRenamed("v", value)


def true_peak(value: Column) -> Column:
    """The largest magnitude in dBFS: linear interpolation between samples can't exceed it. An aggregate; -120 for silence."""
    return decibels(F.max(F.abs(value)))


def echo_step(offsets: DataFrame, keys: Sequence[str], panel: str, offset: str) -> DataFrame:
    """Mean of the positive steps between the offsets of neighbouring panels; NULL if there is none."""
    w = Window.partitionBy(*keys).orderBy(panel)
    o = offsets.withColumn("step", F.col(offset) - F.lag(offset).over(w))
    return o.groupBy(*keys).agg(F.avg(F.when(F.col("step") > 0, F.col("step"))).alias("echo_step"))


def blank_bands(cells: DataFrame, keys: Sequence[str], frame: str, band: str, value: str, least: float = 2.0) -> DataFrame:
    """Bands whose mean spread over the sampled frames is under a minimum: they carry no picture."""
    s = cells.groupBy(*keys, frame, band).agg(F.stddev_pop(value).alias("s"))
    return s.groupBy(*keys, band).agg(F.avg("s").alias("spread")).withColumn("blank", F.col("spread") < least)


def inspect_cuts(cuts: DataFrame) -> DataFrame:
    """``cuts``: luma_before, luma_after, sound_before, sound_after, shot_seconds, text_before, text_after (arrays): what a cut looks and sounds like."""
    before, after = F.col("text_before"), F.col("text_after")
    common = F.size(F.array_intersect(before, after))
    return (
        cuts.withColumn("jump_cut", F.abs(F.col("luma_after") - F.col("luma_before")) < 12)
        .withColumn("flash", F.col("shot_seconds") < 0.2)
        .withColumn("click", F.abs(F.col("sound_after") - F.col("sound_before")) > 0.15)
        .withColumn("text_interrupted", (F.size(before) > 0) & (F.size(F.array_except(before, after)) > 0) & (common > 0))
        .withColumn("text_replaced", (F.size(before) > 0) & (F.size(after) > 0) & (common == 0))
    )


def spatial_guard(coverage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``coverage``: keys, layers (in the frame), coverage (of a protected region by a layer; NULL without a region): frames that can be checked,
    those that can't, and those in which an edge crosses the region."""
    ok = (F.col("layers") > 1) & F.col("coverage").isNotNull()
    hit = ok & (F.col("coverage") > 0.02) & (F.col("coverage") < 0.98)
    return coverage.groupBy(*keys).agg(F.count_if(ok).alias("checkable"), F.count_if(~ok).alias("not_checkable"), F.count_if(hit).alias("crossed"))
