"""Queries on interval sets and temporal joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions import ranges as R
from tapewright.operators import intervals as I
from tapewright.operators.blocked import blocks, following
from tapewright.plans.catalog import Catalog
from tapewright.sources.standins import CUTS, EVENTS, FRAMES, SHOTS, TURNS, WORDS, cut_ranges, events, frames, shots, turns, words

CATALOG = Catalog()
SECOND = 10**6

_MERGED = """m AS (
  SELECT asset, min(start_us) AS start_us, max(end_us) AS end_us FROM (
    SELECT *, sum(CASE WHEN reach IS NULL OR start_us > reach THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS n
    FROM (SELECT *, max(end_us) OVER (PARTITION BY asset ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src} WHERE end_us > start_us))
  GROUP BY asset, n
)"""


@CATALOG.add("interval_merge", f"WITH {TURNS}, {_MERGED.format(src='t')} SELECT * FROM m")
def interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    return I.merge(turns(spark, sf), ["asset"], "start_us", "end_us")


_SUBTRACT = f"""WITH {TURNS}, {CUTS}, e AS (
  SELECT asset, pt, sum(da) AS da, sum(db) AS db FROM (
    SELECT asset, start_us AS pt, 1 AS da, 0 AS db FROM t WHERE end_us > start_us UNION ALL SELECT asset, end_us, -1, 0 FROM t WHERE end_us > start_us
    UNION ALL SELECT asset, start_us, 0, 1 FROM c UNION ALL SELECT asset, end_us, 0, -1 FROM c) GROUP BY asset, pt
), r AS (
  SELECT asset, pt, lead(pt) OVER w AS nxt, sum(da) OVER w AS a, sum(db) OVER w AS b FROM e WINDOW w AS (PARTITION BY asset ORDER BY pt)
), k AS (SELECT * FROM r WHERE a > 0 AND b = 0 AND nxt IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN was = pt THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY pt) AS n FROM (SELECT *, lag(nxt) OVER (PARTITION BY asset ORDER BY pt) AS was FROM k))
SELECT asset, min(pt) AS start_us, max(nxt) AS end_us FROM g GROUP BY asset, n"""


@CATALOG.add("interval_subtract", _SUBTRACT)
def interval_subtract(spark: SparkSession, sf: str) -> DataFrame:
    """Speech that no cut plan removes."""
    return I.subtract(turns(spark, sf), cut_ranges(spark, sf), ["asset"], "start_us", "end_us")


_COALESCE = f"""WITH {SHOTS}, i AS (
  SELECT asset, CASE WHEN boundary_score IS NULL OR boundary_score > 0.6 THEN 3 WHEN boundary_score > 0.3 THEN 2 ELSE 1 END AS severity,
    start_us, start_us + 1000000 AS end_us, CASE WHEN boundary_score IS NULL THEN 'no score' WHEN boundary_score > 0.5 THEN 'hard cut' ELSE 'soft cut' END AS reason FROM s
), r AS (SELECT *, max(end_us) OVER (PARTITION BY asset, severity ORDER BY start_us, end_us, reason ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_us - reach > 2000000 THEN 1 ELSE 0 END) OVER (PARTITION BY asset, severity ORDER BY start_us, end_us, reason ROWS UNBOUNDED PRECEDING) AS n FROM r)
SELECT asset, severity, min(start_us) AS start_us, max(end_us) // 1000 * 1000 AS end_us,
  list_reduce(list(reason ORDER BY start_us, end_us, reason), lambda a, b: CASE WHEN a = b THEN a ELSE a || '; ' || b END) AS reason, count(*) AS n_items
FROM g GROUP BY asset, severity, n"""


@CATALOG.add("interval_coalesce", _COALESCE)
def interval_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    """Review items around shot starts, joined within their severity over gaps of up to 2 s."""
    b = F.col("boundary_score")
    i = shots(spark, sf).select(
        "asset",
        F.when(b.isNull() | (b > 0.6), 3).when(b > 0.3, 2).otherwise(1).alias("severity"),
        "start_us",
        (F.col("start_us") + SECOND).alias("end_us"),
        F.when(b.isNull(), "no score").when(b > 0.5, "hard cut").otherwise("soft cut").alias("reason"),
    )
    return I.coalesce_within(i, ["asset", "severity"], "start_us", "end_us", 2 * SECOND, "reason").withColumn("end_us", I.milli(F.col("end_us")))


_QUIET = f"""WITH {EVENTS}, m AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us) - row_number() OVER (PARTITION BY user_id, value < 40 ORDER BY ts_us) AS n FROM e
) SELECT user_id, min(ts_us) + 100000 AS "start", max(ts_us) - 100000 AS "end", round(avg(value), 6) AS mean_level, count(*) AS n
FROM m WHERE value < 40 GROUP BY user_id, m.n HAVING max(ts_us) - min(ts_us) > 400000 AND max(ts_us) - 100000 > min(ts_us) + 100000"""


@CATALOG.add("interval_quiet_runs", _QUIET)
def interval_quiet_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = I.threshold_runs(events(spark, sf), ["user_id"], "ts_us", "value", 40, 400_000, 100_000)
    return r.withColumn("mean_level", F.round("mean_level", 6))


_STATE = f"""WITH {FRAMES}, m AS (SELECT *, n_faces > 0 AS h, coalesce(lag(n_faces > 0) OVER w, false) AS was FROM f WINDOW w AS (PARTITION BY asset ORDER BY time_us)),
g AS (SELECT *, sum(CASE WHEN h AND was THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY time_us ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT asset, min(time_us) AS "start", max(time_us) + 1000000 AS "end", count(*) AS n FROM g WHERE h GROUP BY asset, k"""


@CATALOG.add("interval_state_runs", _STATE)
def interval_state_runs(spark: SparkSession, sf: str) -> DataFrame:
    return I.state_runs(frames(spark, sf), ["asset"], "time_us", F.col("n_faces") > 0, SECOND)


@CATALOG.add("interval_person_visible", f"WITH {FRAMES}, v AS (SELECT asset, time_us AS start_us, time_us + 1500000 AS end_us FROM f WHERE n_faces > 0), {_MERGED.format(src='v')} SELECT asset, start_us AS \"start\", end_us AS \"end\" FROM m")
def interval_person_visible(spark: SparkSession, sf: str) -> DataFrame:
    return I.sample_ranges(frames(spark, sf), ["asset"], "time_us", F.col("n_faces") > 0, 1_500_000)


_VISITS = f"""WITH {FRAMES}, h AS (SELECT asset, time_us, CASE WHEN n_faces BETWEEN 1 AND 2 THEN n_faces END AS holder FROM f),
a AS (SELECT *, sum(CASE WHEN holder IS NOT DISTINCT FROM was AND rn > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY time_us ROWS UNBOUNDED PRECEDING) AS n
  FROM (SELECT *, lag(holder) OVER w AS was, row_number() OVER w AS rn FROM h WINDOW w AS (PARTITION BY asset ORDER BY time_us))),
r AS (SELECT asset, n, holder, min(time_us) AS s, max(time_us) AS e FROM a WHERE holder IS NOT NULL GROUP BY ALL HAVING max(time_us) - min(time_us) >= 400000),
b AS (SELECT *, sum(CASE WHEN wh = holder AND s - we < 1200000 THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY s) AS m
  FROM (SELECT *, lag(holder) OVER w AS wh, lag(e) OVER w AS we FROM r WINDOW w AS (PARTITION BY asset ORDER BY s)))
SELECT asset, holder, min(s) AS "start", max(e) AS "end", count(*) AS n_runs FROM b GROUP BY asset, m, holder"""


@CATALOG.add("interval_visits", _VISITS)
def interval_visits(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).withColumn("holder", F.when(F.col("n_faces").between(1, 2), F.col("n_faces")))
    return I.visits(f, ["asset"], "time_us", "holder", 400_000, 1_200_000)


_OPENING = f"""WITH {FRAMES}, i AS (SELECT *, n_lines > 0 AS active, row_number() OVER (PARTITION BY asset ORDER BY time_us) - 1 AS i FROM f),
l AS (SELECT *, coalesce(max(CASE WHEN active THEN i END) OVER (PARTITION BY asset ORDER BY i), -1) AS hit FROM i),
b AS (SELECT *, max(CASE WHEN i - hit > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY i) AS broken FROM l)
SELECT asset, max(i)::INT AS last_sample, CASE WHEN max(i) >= 2 THEN max(time_us) END AS "end" FROM b WHERE broken = 0 AND active GROUP BY asset"""


@CATALOG.add("interval_opening", _OPENING)
def interval_opening(spark: SparkSession, sf: str) -> DataFrame:
    return I.opening_run(frames(spark, sf), ["asset"], "time_us", F.col("n_lines") > 0, 3, 2)


_ABSENCE = f"""WITH {FRAMES}, m AS (SELECT *, n_faces > 0 AS p, lead(time_us) OVER w AS nxt, coalesce(lag(n_faces > 0) OVER w, true) AS was FROM f WINDOW w AS (PARTITION BY asset ORDER BY time_us)),
g AS (SELECT *, sum(CASE WHEN p OR was THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY time_us ROWS UNBOUNDED PRECEDING) AS n FROM m),
r AS (SELECT asset, min(time_us) AS s, max(coalesce(nxt, time_us + 500000)) - min(time_us) AS len FROM g WHERE NOT p GROUP BY asset, n)
SELECT asset, s AS "start", len AS length FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY len DESC, s) AS k FROM r) WHERE k = 1"""


@CATALOG.add("interval_longest_absence", _ABSENCE)
def interval_longest_absence(spark: SparkSession, sf: str) -> DataFrame:
    return I.longest_absence(frames(spark, sf), ["asset"], "time_us", F.col("n_faces") > 0, 500_000)


_POINT = f"""WITH {FRAMES}, {SHOTS}, sv AS (SELECT *, start_us // 10000000 AS b0, (end_us - 1) // 10000000 AS b1 FROM s WHERE end_us > start_us),
sb AS (SELECT *, unnest(generate_series(b0, b1)) AS b FROM sv),
j AS (SELECT f.frame_id, f.asset, f.time_us, sb.shot_id, sb.start_us, row_number() OVER (PARTITION BY f.frame_id ORDER BY sb.start_us, sb.shot_id) AS k
  FROM f LEFT JOIN sb ON f.asset = sb.asset AND f.time_us // 10000000 = sb.b AND sb.start_us <= f.time_us AND f.time_us < sb.end_us)
SELECT frame_id, asset, time_us, shot_id, start_us FROM j WHERE k = 1"""


@CATALOG.add("interval_shot_of_frame", _POINT)
def interval_shot_of_frame(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).select("frame_id", "asset", "time_us")
    s = shots(spark, sf).select("asset", "shot_id", "start_us", "end_us")
    return I.point_in_range(f, s, ["asset"], "time_us", "start_us", "end_us", ["start_us", "shot_id"], 10 * SECOND).select("frame_id", "asset", "time_us", "shot_id", "start_us")


_LABELLED = f"""WITH {FRAMES}, {TURNS}, tb AS (SELECT *, unnest(generate_series(start_us // 10000000, (end_us - 1) // 10000000)) AS b FROM t WHERE end_us > start_us),
j AS (SELECT f.frame_id, tb.speaker, row_number() OVER (PARTITION BY f.frame_id ORDER BY tb.start_us, tb.turn_id) AS k
  FROM f LEFT JOIN tb ON f.asset = tb.asset AND f.time_us // 10000000 = tb.b AND tb.start_us <= f.time_us AND f.time_us < tb.end_us)
SELECT frame_id, speaker FROM j WHERE k = 1"""


@CATALOG.add("interval_speaker_of_frame", _LABELLED)
def interval_speaker_of_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Who speaks at each frame: the turn at its instant, NULL outside of turns."""
    f = frames(spark, sf).select("frame_id", "asset", "time_us")
    t = turns(spark, sf).select("asset", "turn_id", "speaker", "start_us", "end_us")
    return I.point_in_range(f, t, ["asset"], "time_us", "start_us", "end_us", ["start_us", "turn_id"], 10 * SECOND).select("frame_id", "speaker")


_OVERLAP = f"""WITH {TURNS}, {SHOTS}, tb AS (SELECT *, unnest(generate_series(start_us // 10000000, (end_us - 1) // 10000000)) AS b FROM t WHERE end_us > start_us),
sb AS (SELECT *, unnest(generate_series(start_us // 10000000, (end_us - 1) // 10000000)) AS b FROM s WHERE end_us > start_us)
SELECT tb.turn_id, count(*) AS n_shots, sum(least(tb.end_us, sb.end_us) - greatest(tb.start_us, sb.start_us))::BIGINT AS shared_us
FROM tb JOIN sb ON tb.asset = sb.asset AND tb.b = sb.b AND tb.start_us < sb.end_us AND sb.start_us < tb.end_us AND greatest(tb.start_us, sb.start_us) // 10000000 = tb.b GROUP BY tb.turn_id"""


@CATALOG.add("interval_overlap_join", _OVERLAP)
def interval_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf).select("asset", "turn_id", "start_us", "end_us")
    s = shots(spark, sf).select("asset", "shot_id", F.col("start_us").alias("s_start"), F.col("end_us").alias("s_end"))
    p = I.overlap_pairs(t, s, ["asset"], ("start_us", "end_us"), ("s_start", "s_end"), 10 * SECOND)
    return p.groupBy("turn_id").agg(F.count(F.lit(1)).alias("n_shots"), F.sum(F.least("end_us", "s_end") - F.greatest("start_us", "s_start")).alias("shared_us"))


_COLLIDE = f"""WITH {TURNS}, tb AS (SELECT *, unnest(generate_series(start_us // 10000000, (end_us - 1) // 10000000)) AS b FROM t WHERE end_us > start_us)
SELECT p.turn_id AS first_id, q.turn_id AS second_id FROM tb p JOIN tb q ON p.asset = q.asset AND p.b = q.b AND p.turn_id < q.turn_id AND p.start_us < q.end_us AND q.start_us < p.end_us
  AND greatest(p.start_us, q.start_us) // 10000000 = p.b"""


@CATALOG.add("interval_collisions", _COLLIDE)
def interval_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of turns of a recording that overlap; each turn overlaps its neighbours in time only."""
    t = turns(spark, sf).select("asset", F.col("turn_id").alias("first_id"), "start_us", "end_us")
    u = t.select("asset", F.col("first_id").alias("second_id"), F.col("start_us").alias("s2"), F.col("end_us").alias("e2"))
    return I.overlap_pairs(t, u, ["asset"], ("start_us", "end_us"), ("s2", "e2"), 10 * SECOND).where("first_id < second_id").select("first_id", "second_id")


_NEAREST = f"""WITH {FRAMES}, {SHOTS}, j AS (
  SELECT s.shot_id, f.frame_id, abs(f.time_us - s.start_us) AS distance, row_number() OVER (PARTITION BY s.shot_id ORDER BY abs(f.time_us - s.start_us), f.time_us, f.frame_id) AS k
  FROM s JOIN f ON s.asset = f.asset AND f.time_us BETWEEN s.start_us - 500000 AND s.start_us + 500000)
SELECT s.shot_id, j.frame_id, j.distance FROM s LEFT JOIN j ON s.shot_id = j.shot_id AND j.k = 1"""


@CATALOG.add("interval_nearest_frame", _NEAREST)
def interval_nearest_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The frame nearest to the start of each shot, at most 0.5 s away."""
    s = shots(spark, sf).select("asset", "shot_id", "start_us")
    return I.nearest(s, frames(spark, sf).select("asset", "frame_id", "time_us"), ["asset"], "start_us", "time_us", "frame_id", 500_000).select("shot_id", "frame_id", "distance")


_BACKWARD = f"""WITH {FRAMES}, {TURNS}, a AS (
  SELECT t.turn_id, t.asset, t.start_us, f.time_us, f.n_faces FROM t ASOF LEFT JOIN f ON t.asset = f.asset AND t.start_us >= f.time_us
), g AS (SELECT asset, time_us FROM f WHERE n_faces > 0),
b AS (SELECT a.*, g.time_us AS face_us FROM a ASOF LEFT JOIN g ON a.asset = g.asset AND a.start_us >= g.time_us)
SELECT turn_id, CASE WHEN n_faces > 0 THEN time_us WHEN face_us >= start_us - 2500000 THEN face_us ELSE start_us END AS at_us FROM b"""


@CATALOG.add("interval_last_face", _BACKWARD)
def interval_last_face(spark: SparkSession, sf: str) -> DataFrame:
    """Backward as-of with lookback: the last frame before a turn; if it has no face, the last one with a face within 2.5 s, else the turn's start."""
    t = turns(spark, sf).select("asset", "turn_id", "start_us")
    f = frames(spark, sf)
    n = I.nearest_samples(t, f.select("asset", "time_us", "n_faces"), ["asset"], "start_us", "time_us", ["n_faces"]).drop("after").withColumnRenamed("before", "last")
    n = I.nearest_samples(n, f.where("n_faces > 0").select("asset", "time_us", "n_faces"), ["asset"], "start_us", "time_us", ["n_faces"])
    return n.select("turn_id", F.when(F.col("last.n_faces") > 0, F.col("last.at")).when(F.col("before.at") >= F.col("start_us") - 2_500_000, F.col("before.at")).otherwise(F.col("start_us")).alias("at_us"))


@CATALOG.add("interval_next_frame", f"WITH {FRAMES}, {TURNS} SELECT t.turn_id, f.frame_id, f.time_us FROM t ASOF LEFT JOIN f ON t.asset = f.asset AND t.end_us <= f.time_us")
def interval_next_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The first frame at or after the end of each turn."""
    t = turns(spark, sf).select("asset", "turn_id", "end_us")
    n = I.nearest_samples(t, frames(spark, sf).select("asset", "frame_id", "time_us"), ["asset"], "end_us", "time_us", ["frame_id"])
    return n.select("turn_id", F.col("after.frame_id").alias("frame_id"), F.col("after.at").alias("time_us"))


_ADJACENT = f"WITH {TURNS} SELECT turn_id, asset, end_us - nxt AS by_us FROM (SELECT *, lead(start_us) OVER (PARTITION BY asset ORDER BY start_us, end_us, turn_id) AS nxt FROM t) WHERE nxt < end_us"


@CATALOG.add("interval_adjacent_overlaps", _ADJACENT)
def interval_adjacent_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return I.adjacent_overlaps(turns(spark, sf), ["asset"], ["start_us", "end_us", "turn_id"], "start_us", "end_us").select("turn_id", "asset", F.col("by").alias("by_us"))


@CATALOG.add("interval_pauses", f"WITH {WORDS} SELECT doc_id, idx, end_ms AS gap_start, nxt AS gap_end FROM (SELECT *, lead(start_ms) OVER (PARTITION BY doc_id ORDER BY idx) AS nxt FROM w) WHERE nxt - end_ms > 600")
def interval_pauses(spark: SparkSession, sf: str) -> DataFrame:
    return I.gaps_between(words(spark, sf), ["doc_id"], "idx", "start_ms", "end_ms", 600).select("doc_id", "idx", "gap_start", "gap_end")


@CATALOG.add(
    "interval_tighten_pauses",
    f"WITH {WORDS} SELECT doc_id, idx, end_ms + 700 AS gap_start, nxt AS gap_end FROM (SELECT *, lead(start_ms) OVER (PARTITION BY doc_id ORDER BY idx) AS nxt FROM w) WHERE nxt - end_ms > 700",
)
def interval_tighten_pauses(spark: SparkSession, sf: str) -> DataFrame:
    """What to remove so that no pause is longer than 0.7 s."""
    return I.capped_gaps(I.gaps_between(words(spark, sf), ["doc_id"], "idx", "start_ms", "end_ms", 0), 700).select("doc_id", "idx", "gap_start", "gap_end")


@CATALOG.add("interval_speaker_changes", f"WITH {TURNS} SELECT turn_id, asset, start_us FROM (SELECT *, row_number() OVER w AS rn, lag(speaker) OVER w AS was FROM t WINDOW w AS (PARTITION BY asset ORDER BY start_us, end_us, turn_id)) WHERE rn > 1 AND speaker IS DISTINCT FROM was")
def interval_speaker_changes(spark: SparkSession, sf: str) -> DataFrame:
    return I.change_points(turns(spark, sf), ["asset"], ["start_us", "end_us", "turn_id"], "speaker").select("turn_id", "asset", "start_us")


@CATALOG.add(
    "interval_padded_spans",
    f"WITH {WORDS} SELECT doc_id, (idx // 12)::BIGINT AS span, greatest(min(start_ms) - 250, 0) AS start_ms, max(end_ms) + 250 AS end_ms FROM w GROUP BY doc_id, idx // 12",
)
def interval_padded_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of twelve words with a pad of 0.25 s, clamped at 0."""
    g = words(spark, sf).groupBy("doc_id", F.call_function("div", F.col("idx"), F.lit(12)).alias("span")).agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    s, e = I.padded_span(F.col("s"), F.col("e"), 250)
    return g.select("doc_id", "span", s.alias("start_ms"), e.alias("end_ms"))


_RELATIONS = f"""WITH {TURNS}, n AS (SELECT *, lead(start_us) OVER w AS s2, lead(end_us) OVER w AS e2 FROM t WINDOW w AS (PARTITION BY asset ORDER BY start_us, end_us, turn_id))
SELECT turn_id, start_us <= s2 AND s2 < end_us AS contains, start_us < e2 AND s2 < end_us AS overlaps, CASE WHEN start_us < e2 AND s2 < end_us THEN least(end_us, e2) - greatest(start_us, s2) END AS shared_us FROM n WHERE s2 IS NOT NULL"""


@CATALOG.add("interval_relations", _RELATIONS)
def interval_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn and the one behind it: whether it holds that one's start, whether they overlap, and how much they share."""
    t = turns(spark, sf).withColumn("range", F.struct("start_us", "end_us"))
    n = following(blocks(t, "start_us", I.HOUR), ["asset"], "__block", ["start_us", "end_us", "turn_id"], "range", "next").where("next IS NOT NULL")
    own, other = (F.col("start_us"), F.col("end_us")), (F.col("next.value.start_us"), F.col("next.value.end_us"))
    both = R.intersection(*own, *other)
    return n.select("turn_id", R.contains(*own, other[0]).alias("contains"), R.overlaps(*own, *other).alias("overlaps"), (both["end"] - both["start"]).alias("shared_us"))


@CATALOG.add("interval_turns_of", f"WITH {TURNS} SELECT turn_id, asset, speaker, start_us, end_us FROM t WHERE end_us - start_us >= 300000")
def interval_turns_of(spark: SparkSession, sf: str) -> DataFrame:
    """Segments long enough to be turns."""
    return I.turns_of(turns(spark, sf), "start_us", "end_us")
