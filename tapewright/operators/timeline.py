"""The timeline as a table of clips, edited set at a time.

``clips``: doc, track, clip, asset, source_start, source_end, start (timeline), all times BIGINT of one unit, half open. A clip plays its
source at its own speed unless it has a ``duration`` on the timeline. The fold over a log of commands in ``command_log`` is the
reference these set forms are tested against.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.exact_time import floor_div
from tapewright.operators.blocked import blocks, numbered, running_sum
from tapewright.operators.intervals import HOUR, PLACES, merge, nearest_samples, overlap_pairs, subtract
from tapewright.session import cut_lineage

TRACK = ["doc", "track"]


def with_end(clips: DataFrame) -> DataFrame:
    return clips.withColumn("end", F.col("start") + F.col("source_end") - F.col("source_start"))


def source_time(clips_at: DataFrame, at: str, out: str) -> DataFrame:
    """The source instant that plays at a timeline instant; linear in retimed clips (``duration`` on the timeline, NULL for none)."""
    span = F.coalesce(F.col("duration"), F.col("source_end") - F.col("source_start"))
    off = (F.col(at) - F.col("start")) * (F.col("source_end") - F.col("source_start"))
    return clips_at.withColumn(out, F.when(span > 0, F.col("source_start") + F.call_function("div", off, span)).otherwise(F.col("source_start")))


def ripple_delete(clips: DataFrame, removals: DataFrame, width: int, block: int = HOUR) -> DataFrame:
    """Cuts ranges (doc, track, start, end on the timeline) out of their tracks and closes the holes; all at once.

    Overlapping removals count once. A clip that is cut inside becomes two. ``width``: bucket of the join, about the length of a clip.
    Pieces are renumbered in order of time.
    """
    # the removals are read three times
    r = cut_lineage(merge(removals.select(*TRACK, F.col("start").alias("r_start"), F.col("end").alias("r_end")), TRACK, "r_start", "r_end"))
    c = with_end(clips)
    hit = overlap_pairs(c.select(*TRACK, "clip", "start", "end"), r, TRACK, ("start", "end"), ("r_start", "r_end"), width).select(*TRACK, "clip", F.col("r_start").alias("start"), F.col("r_end").alias("end"))
    kept = subtract(c.select(*TRACK, "clip", "start", "end"), hit, [*TRACK, "clip"], "start", "end").select(*TRACK, "clip", F.col("start").alias("k_start"), F.col("end").alias("k_end"))
    p = kept.join(c, [*TRACK, "clip"])
    # what was removed before a piece: a running sum over the removals' ends and the pieces' starts
    ends = r.select(*TRACK, F.col("r_end").alias("t"), F.lit(0).alias("kind"), (F.col("r_end") - F.col("r_start")).alias("gone"))
    pieces = p.select(*TRACK, F.col("k_start").alias("t"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("gone"), F.struct("clip", "asset", "source_start", "start", "k_start", "k_end").alias("p"))
    u = cut_lineage(blocks(ends.unionByName(pieces, allowMissingColumns=True), "t", block))
    u = running_sum(u, TRACK, "__block", ["t", "kind"], "gone", "before").where("kind = 1")
    out = u.select(
        *TRACK,
        F.col("p.asset").alias("asset"),
        (F.col("p.source_start") + F.col("p.k_start") - F.col("p.start")).alias("source_start"),
        (F.col("p.source_start") + F.col("p.k_end") - F.col("p.start")).alias("source_end"),
        (F.col("p.k_start") - F.col("before")).alias("start"),
    )
    return numbered(out, TRACK, ["start", "source_start"], "clip", block).select(*TRACK, F.col("clip").cast("int").alias("clip"), "asset", "source_start", "source_end", "start")


def move_range(clips: DataFrame, moves: DataFrame, block: int = HOUR) -> DataFrame:
    """Moves one range per document (doc, a, b, to) on every track: it is lifted, the hole closes, and it lands before ``to``.

    A destination inside or at the end of the range, or an empty range, leaves the document as it is. Clips are cut at the range's edges and
    at the destination.
    """
    m = moves.where("b > a AND (to < a OR to > b)")
    c = with_end(clips).join(m, "doc", "left")
    cuts = F.array_sort(F.array_distinct(F.array_compact(F.array("start", "end", *[F.when((F.col(x) > F.col("start")) & (F.col(x) < F.col("end")), F.col(x)) for x in ("a", "b", "to")]))))
    c = c.withColumn("cuts", cuts)
    parts = F.zip_with(F.slice("cuts", F.lit(1), F.size("cuts") - 1), F.slice("cuts", F.lit(2), F.size("cuts") - 1), lambda x, y: F.struct(x.alias("s"), y.alias("e")))
    c = c.select(*TRACK, "asset", "source_start", "start", "a", "b", "to", F.explode(parts).alias("p"))
    s, a, b, to = F.col("p.s"), F.col("a"), F.col("b"), F.col("to")
    size = b - a
    offset = (
        F.when(a.isNull(), 0)
        .when((s >= a) & (s < b), F.when(to < a, to - a).otherwise(to - size - a))
        .when((to < a) & (s >= to) & (s < a), size)
        .when((to > b) & (s >= b) & (s < to), -size)
        .otherwise(0)
    )
    out = c.select(*TRACK, "asset", (F.col("source_start") + s - F.col("start")).alias("source_start"), (F.col("source_start") + F.col("p.e") - F.col("start")).alias("source_end"), (s + offset).alias("start"))
    return numbered(out, TRACK, ["start", "source_start"], "clip", block).select(*TRACK, F.col("clip").cast("int").alias("clip"), "asset", "source_start", "source_end", "start")


def diff(before: DataFrame, after: DataFrame, block: int = HOUR) -> DataFrame:
    """What changed between two versions, per document the largest first (``ord``): change, source_start, source_end, and where it is in the new
    version (``start``, NULL for what was removed).

    'removed' and 'added' compare the source time that each track uses of an asset, not its clips. 'reframed', where both versions have a ``placement``, is a clip of
    the new version whose source range is in the old one (its first clip counts) at another place in the frame."""
    keys = [*TRACK, "asset"]
    placed = "placement" in before.columns and "placement" in after.columns
    more = ["placement"] if placed else []
    old, new = (cut_lineage(x.select(*keys, "clip", "source_start", "source_end", "start", *more)) for x in (before, after))
    span = ("source_start", "source_end")
    removed = subtract(old.select(*keys, *span), new.select(*keys, *span), keys, *span, block).withColumn("change", F.lit("removed")).withColumn("start", F.lit(None).cast("bigint"))
    added = subtract(new.select(*keys, *span), old.select(*keys, *span), keys, *span, block)
    # the first clip of the new version that plays some of it
    n = new.select(*keys, F.col("clip").alias("n_clip"), F.col("source_start").alias("n_s"), F.col("source_end").alias("n_e"), F.col("start").alias("n_start"))
    landed = overlap_pairs(added, n, keys, span, ("n_s", "n_e"), block // 60).groupBy(*keys, *span).agg(F.min(F.struct("n_clip", "n_start"))["n_start"].alias("start"))
    out = removed.unionByName(landed.withColumn("change", F.lit("added")))
    if placed:
        first = old.groupBy(*keys, *span).agg(F.min(F.struct("clip", "placement"))["placement"].alias("was"))
        moved = new.join(first, [*keys, *span]).where(~F.col("was").eqNullSafe(F.col("placement")))
        out = out.unionByName(moved.select(*keys, *span, F.lit("reframed").alias("change"), "start"))
    out = cut_lineage(out.withColumn("__size", F.col("source_start") - F.col("source_end")))
    return numbered(out, ["doc"], ["__size", "track", "asset", "change", "source_start", "start"], "ord", block // 360).drop("__size").withColumn("ord", F.col("ord").cast("int"))


def lower_plan(clips: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """Ranges of source time (doc, asset, start, end) as ranges of the timeline, through every clip that plays them."""
    c = with_end(clips).select("doc", "track", "clip", "asset", "source_start", "source_end", F.col("start").alias("at"))
    r = ranges.select("doc", "asset", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    j = overlap_pairs(c, r, ["doc", "asset"], ("source_start", "source_end"), ("r_start", "r_end"), width)
    return j.select("doc", "track", (F.greatest("r_start", "source_start") - F.col("source_start") + F.col("at")).alias("start"), (F.least("r_end", "source_end") - F.col("source_start") + F.col("at")).alias("end"))


def topmost(layers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of several clips at an instant the one on the highest track."""
    return layers.groupBy(*keys).agg(F.max(F.struct("track", "clip")).alias("m"), F.count(F.lit(1)).alias("n_layers")).select(*keys, "m.track", "m.clip", "n_layers")


def unique_decisions(applied: DataFrame, keys: Sequence[str], decision: str, order: str) -> DataFrame:
    """Decisions in the order in which they were first applied, with the number of their applications."""
    g = applied.groupBy(*keys, decision).agg(F.min(order).alias("first_at"), F.count(F.lit(1)).alias("applications"))
    return g.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("first_at")))


def content_hash(*fields: Column) -> Column:
    """SHA-256 of the canonical JSON of the fields, which must be named in alphabetical order."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def placement_problem(confidence: Column, floor: Column, known_track: Column, known_asset: Column, source_end: Column, duration: Column, aligned: Column, free: Column) -> Column:
    """The first reason against placing a clip, in the order in which they are checked; NULL if there is none."""
    return (
        F.when(confidence < floor, "confidence below floor")
        .when(~known_track, "no such track")
        .when(~known_asset, "no such asset")
        .when(source_end > duration, "past the end of the source")
        .when(~aligned, "off the grid")
        .when(~free, "overlaps a clip")
    )


def broken_links(beats: DataFrame, links: DataFrame, surviving: DataFrame) -> DataFrame:
    """Links of which exactly one side survives: ``beats`` doc, beat, first, last (words, inclusive); ``links`` doc, link, setup, payoff;
    ``surviving`` doc, idx. A beat survives if any of its words does; a link to a beat that isn't there is reported as missing."""
    # a beat survives if the first word that does, at or behind its own first, isn't past its end
    b = nearest_samples(beats, surviving.select("doc", "idx"), ["doc"], "first", "idx", [], block=PLACES)
    b = b.select("doc", "beat", F.coalesce(F.col("after.at") <= F.col("last"), F.lit(False)).alias("lives"))
    side = lambda name: b.select(F.col("doc").alias(f"{name}_doc"), F.col("beat").alias(f"{name}_beat"), F.col("lives").alias(f"{name}_lives"))
    j = links.join(side("s"), (F.col("doc") == F.col("s_doc")) & (F.col("setup") == F.col("s_beat")), "left").join(side("p"), (F.col("doc") == F.col("p_doc")) & (F.col("payoff") == F.col("p_beat")), "left")
    why = F.when(F.col("s_lives").isNull() | F.col("p_lives").isNull(), "missing beat").when(F.col("s_lives") & ~F.col("p_lives"), "payoff lost").when(~F.col("s_lives") & F.col("p_lives"), "setup lost")
    return j.withColumn("why", why).where("why IS NOT NULL").select("doc", "link", "setup", "payoff", "why")


def inverted_links(beats: DataFrame, links: DataFrame, order: DataFrame) -> DataFrame:
    """Links whose payoff comes before its setup: ``order`` doc, idx, position (the last of repeated positions counts). Missing positions are skipped."""
    pos = order.groupBy(F.col("doc").alias("o_doc"), F.col("idx").alias("o_idx")).agg(F.max("position").alias("position"))
    # positions of words are many more than their texts' size lets Spark believe: never broadcast
    at = beats.join(pos.hint("merge"), (F.col("doc") == F.col("o_doc")) & (F.col("first") == F.col("o_idx"))).select(F.col("doc").alias("b_doc"), "beat", "position")
    side = lambda name: at.select(F.col("b_doc").alias(f"{name}_doc"), F.col("beat").alias(f"{name}_beat"), F.col("position").alias(f"{name}_at"))
    j = links.join(side("s").hint("merge"), (F.col("doc") == F.col("s_doc")) & (F.col("setup") == F.col("s_beat"))).join(side("p").hint("merge"), (F.col("doc") == F.col("p_doc")) & (F.col("payoff") == F.col("p_beat")))
    return j.where("p_at < s_at").select("doc", "link", "setup", "payoff")


def mix(clips: DataFrame, samples: DataFrame, width: int) -> DataFrame:
    """Sum of the overlapping clips' samples times their gain (NULL: 1): ``samples`` asset, n, v at the unit of the clips; doc, n, v.

    Clips meet samples in buckets of ``width`` units of source time, so a long recording is spread like many short ones."""
    s = samples.withColumn("bucket", floor_div(F.col("n").cast("bigint"), F.lit(width).cast("bigint")))
    return mix_buckets(clips, s.groupBy("asset", "bucket").agg(F.collect_list(F.struct("n", "v")).alias("samples")), width)


def mix_buckets(clips: DataFrame, samples: DataFrame, width: int) -> DataFrame:
    """``mix`` of samples that are in buckets already: asset, bucket (n divided by ``width``, rounded down), samples (array of n, v).

    What is moved are arrays: a clip is cut at the buckets of source time and of the timeline, a piece takes its samples from one array and
    goes to its bucket of the timeline as one row. Samples are single rows only where they are summed up."""
    w = F.lit(width).cast("bigint")
    c = clips.where("source_end > source_start").withColumn("gain", F.coalesce("gain", F.lit(1.0)))
    c = c.select("doc", F.col("asset").alias("c_asset"), F.col("source_start").cast("bigint").alias("a"), F.col("source_end").cast("bigint").alias("b"), (F.col("start") - F.col("source_start")).cast("bigint").alias("shift"), "gain")
    c = c.withColumn("c_bucket", F.explode(F.sequence(floor_div(F.col("a"), w), floor_div(F.col("b") - 1, w)))).repartition("c_asset", "c_bucket")
    c = c.withColumn("a", F.greatest("a", F.col("c_bucket") * w)).withColumn("b", F.least("b", (F.col("c_bucket") + 1) * w))
    # a clip without a place keeps its samples, at no place; greatest and least pass over its NULLs
    c = c.withColumn("at_bucket", F.explode_outer(F.sequence(floor_div(F.col("a") + F.col("shift"), w), floor_div(F.col("b") - 1 + F.col("shift"), w))))
    c = c.withColumn("zero", F.col("at_bucket") * w - F.col("shift"))
    c = c.withColumn("a", F.greatest("a", "zero")).withColumn("b", F.least("b", F.col("zero") + w))
    # samples are many more than the rows they are made from let Spark believe: never broadcast
    j = c.join(samples.hint("merge"), (F.col("asset") == F.col("c_asset")) & (F.col("bucket") == F.col("c_bucket")))
    j = j.select("doc", "at_bucket", "zero", "gain", F.filter("samples", lambda x: (x["n"] >= F.col("a")) & (x["n"] < F.col("b"))).alias("part"))
    j = j.select("doc", "at_bucket", F.transform("part", lambda x: (x["n"] - F.col("zero")).cast("int")).alias("at"), F.transform("part", lambda x: x["v"] * F.col("gain")).alias("v"))
    r = j.repartition("doc", "at_bucket").select("doc", "at_bucket", F.inline(F.arrays_zip("at", "v")))
    return r.groupBy("doc", "at_bucket", "at").agg(F.sum("v").alias("v")).select("doc", (F.col("at_bucket") * w + F.col("at")).alias("n"), "v")
