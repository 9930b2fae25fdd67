"""Queries on robust statistics and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.operators import signals as G
from tapewright.operators import statistics as S
from tapewright.operators.blocked import blocks, previous
from tapewright.operators.intervals import HOUR
from tapewright.plans.catalog import Catalog
from tapewright.session import cut_lineage
from tapewright.sources.standins import EVENTS, FRAMES, SHOTS, TURNS, events, frames, shots, turns
from tapewright.sources.tables import table

CATALOG = Catalog()
r6 = lambda c: F.round(c, 6)

_MEDIANS = f"""WITH {EVENTS} SELECT user_id, list_sort(list(value))[len(list(value)) // 2 + 1] AS upper, median(value) AS middle,
  list_sort(list(value))[floor((len(list(value)) - 1) * 0.9::DOUBLE)::INT + 1] AS p90, list_sort(list(value))[round((len(list(value)) - 1) * 0.95::DOUBLE)::INT + 1] AS p95r FROM e GROUP BY user_id"""


@CATALOG.add("stat_ranks", _MEDIANS)
def stat_ranks(spark: SparkSession, sf: str) -> DataFrame:
    lower_median = lambda n: F.floor((n - 1) / 2)
    r = S.at_ranks(events(spark, sf), ["user_id"], "value", {"upper": S.upper_median, "low": lower_median, "p90": S.nearest_rank(0.9), "p95r": S.nearest_rank(0.95, True)})
    return r.select("user_id", "upper", ((F.col("low") + F.col("upper")) / 2).alias("middle"), "p90", "p95r")


@CATALOG.add("stat_rank_by_counts", "SELECT l_returnflag, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS l_quantity, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_returnflag")
def stat_rank_by_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The upper median of very large groups, from the counts of their distinct values."""
    return S.ranked_value(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", S.upper_median)


_Z = f"""WITH {EVENTS}, m AS (SELECT user_id, median(value) AS med FROM e WHERE value IS NOT NULL GROUP BY user_id), d AS (SELECT e.event_id, e.user_id, e.value, m.med FROM e JOIN m USING (user_id) WHERE value IS NOT NULL),
a AS (SELECT user_id, median(abs(value - med)) AS mad FROM d GROUP BY user_id)
SELECT event_id, round(med, 6) AS med, round(mad, 6) AS mad, round(CASE WHEN mad > 0 THEN (value - med) / (1.4826::DOUBLE * mad) WHEN value = med THEN 0.0 WHEN value > med THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END, 6) AS z FROM d JOIN a USING (user_id)"""


@CATALOG.add("stat_robust_z", _Z)
def stat_robust_z(spark: SparkSession, sf: str) -> DataFrame:
    z = S.robust_z(events(spark, sf).select("event_id", "user_id", "value"), ["user_id"], "value")
    return z.select("event_id", r6("med").alias("med"), r6("mad").alias("mad"), r6("z").alias("z"))


_CATALOGUE = """metric AS (SELECT l_returnflag || l_linestatus AS kind, l_suppkey AS video, avg(l_extendedprice) AS v, count(*) AS n FROM lineitem GROUP BY ALL),
l AS (SELECT video, kind || '_mean' AS metric, round(v, 4) AS value FROM metric UNION ALL SELECT video, kind || '_count', n::DOUBLE FROM metric),
p AS (SELECT c.video, c.metric, c.value, h.value AS hx FROM l c JOIN l h ON c.metric = h.metric AND c.video <> h.video),
m AS (SELECT video, metric, value, median(hx) AS med, count(*) AS n_history FROM p GROUP BY ALL),
a AS (SELECT m.video, m.metric, m.value, m.med, m.n_history, median(abs(hx - med)) AS mad FROM m JOIN p ON m.video = p.video AND m.metric = p.metric GROUP BY ALL)"""


@CATALOG.add(
    "stat_catalogue_compare",
    f"WITH {_CATALOGUE}, z AS (SELECT *, CASE WHEN mad > 0 THEN (value - med) / (1.4826::DOUBLE * mad) WHEN value = med THEN 0.0 WHEN value > med THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END AS z FROM a WHERE n_history >= 5) SELECT video, metric, value, n_history AS n_others, round(z, 5) AS z FROM z WHERE abs(z) > 3",
)
def stat_catalogue_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as recordings: which of their metrics stand out against all other suppliers'."""
    m = table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("kind"), F.col("l_suppkey").alias("video")).agg(F.avg("l_extendedprice").alias("v"), F.count(F.lit(1)).alias("n"))
    long = m.select("video", F.explode(F.create_map(F.concat("kind", F.lit("_mean")), F.round("v", 4), F.concat("kind", F.lit("_count")), F.col("n").cast("double"))).alias("metric", "value"))
    return S.history_deviations(long, "metric", "value", "video").withColumn("z", F.round("z", 5))


_TREND = f"""WITH {EVENTS}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, event_id DESC) AS back FROM e),
g AS (SELECT user_id, coalesce(round(regr_slope(value, -back), 9), 0.0) AS slope, count(*) AS n, arg_max(value, back) AS first, arg_min(value, back) AS last, bool_or(value <= 1) AS empty FROM b WHERE back <= 10 GROUP BY user_id)
SELECT user_id, round(slope, 6) AS slope, n, first, last, CASE WHEN n < 10 THEN 'too few' WHEN slope >= 0 THEN 'not falling' WHEN empty THEN 'no footage' END AS shortfall FROM g"""


@CATALOG.add("stat_trend", _TREND)
def stat_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the values of a user's last ten events fall; those of at most 1 count as rates without footage."""
    e = events(spark, sf).withColumn("hours", F.col("value") - 1)
    return S.trend(e, ["user_id"], ["ts_us", "event_id"], "value", 10, "hours").withColumn("slope", r6("slope"))


_RATES = f"""WITH {EVENTS} SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS questions, round(CASE WHEN max(ts_us) > min(ts_us) THEN count(*) FILTER (WHERE event_type = 'error') / ((max(ts_us) - min(ts_us)) / 3600000000.0::DOUBLE) ELSE 0.0 END, 6) AS per_hour,
  round(coalesce(avg((value > 50)::INT), 0.0), 6) AS share_over, count(DISTINCT event_type) AS kinds FROM e GROUP BY user_id"""


@CATALOG.add("stat_rates", _RATES)
def stat_rates(spark: SparkSession, sf: str) -> DataFrame:
    q = F.count_if(F.col("event_type") == "error")
    return events(spark, sf).groupBy("user_id").agg(
        q.alias("questions"), r6(S.per_hour(q, (F.max("ts_us") - F.min("ts_us")) / 3.6e9)).alias("per_hour"), r6(S.share(F.col("value") > 50)).alias("share_over"), F.count_distinct("event_type").alias("kinds")
    )


@CATALOG.add(
    "stat_residue",
    f"WITH {EVENTS}, k AS (SELECT event_type AS category, value > 20 AS answered, value > 80 AS compiled FROM e) SELECT category, count(*) AS asked, count(*) FILTER (WHERE answered) AS answered, count(*) FILTER (WHERE answered AND NOT compiled) AS residue, count(*) FILTER (WHERE answered AND NOT compiled) > 0 AS needs_human FROM k GROUP BY category",
)
def stat_residue(spark: SparkSession, sf: str) -> DataFrame:
    """Questions by category: answered, and of those not yet compiled into a rule."""
    residue = F.count_if(F.col("answered") & ~F.col("compiled"))
    k = events(spark, sf).select(F.col("event_type").alias("category"), (F.col("value") > 20).alias("answered"), (F.col("value") > 80).alias("compiled"))
    return k.groupBy("category").agg(F.count(F.lit(1)).alias("asked"), F.count_if("answered").alias("answered"), residue.alias("residue"), (residue > 0).alias("needs_human"))


@CATALOG.add("stat_share_of_voice", f"WITH {TURNS} SELECT asset, speaker, sum(end_us - start_us)::BIGINT AS voice_us, count(*) AS n_turns FROM t GROUP BY asset, speaker")
def stat_share_of_voice(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).groupBy("asset", "speaker").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("voice_us"), F.count(F.lit(1)).alias("n_turns"))


_STYLE = f"""WITH {SHOTS}, {TURNS}, {FRAMES},
a AS (SELECT DISTINCT asset, duration_num::DOUBLE / duration_den AS secs FROM assets WHERE duration_num IS NOT NULL AND duration_den IS NOT NULL),
sh AS (SELECT asset, count(*) AS shots, list_sort(list(end_us - start_us))[len(list(end_us)) // 2 + 1] AS median_shot_us FROM s GROUP BY asset),
tu AS (SELECT asset, count(DISTINCT speaker) AS speakers, sum(end_us - start_us) / 1e6::DOUBLE AS voice FROM t GROUP BY asset),
fr AS (SELECT asset, avg((n_faces > 0)::INT) AS faces, avg((n_lines > 0)::INT) AS lines FROM f GROUP BY asset)
SELECT a.asset, round((coalesce(shots, 0) - 1) / greatest(secs / 60, 0.001), 5) AS cuts_per_minute, median_shot_us::BIGINT AS median_shot_us, coalesce(speakers, 0) AS speakers, round(coalesce(voice, 0) / greatest(secs / 60, 0.001), 5) AS voice_per_minute,
  round(coalesce(faces, 0), 6) AS face_share, round(coalesce(lines, 0), 6) AS text_share FROM a LEFT JOIN sh USING (asset) LEFT JOIN tu USING (asset) LEFT JOIN fr USING (asset)"""


@CATALOG.add("stat_style_vector", _STYLE)
def stat_style_vector(spark: SparkSession, sf: str) -> DataFrame:
    """The style of each recording: cuts, shots, voices, faces and text in proportion to its length."""
    a = table(spark, sf, "assets").where("duration_num IS NOT NULL AND duration_den IS NOT NULL").select("asset", (F.col("duration_num").cast("double") / F.col("duration_den")).alias("secs")).distinct()
    sh = S.ranked_value(shots(spark, sf).withColumn("median_shot_us", F.col("end_us") - F.col("start_us")), ["asset"], "median_shot_us", S.upper_median, "shots")
    tu = turns(spark, sf).groupBy("asset").agg(F.count_distinct("speaker").alias("speakers"), (F.sum(F.col("end_us") - F.col("start_us")) / 1e6).alias("voice"))
    fr = frames(spark, sf).groupBy("asset").agg(S.share(F.col("n_faces") > 0).alias("faces"), S.share(F.col("n_lines") > 0).alias("lines"))
    j = a.join(sh, "asset", "left").join(tu, "asset", "left").join(fr, "asset", "left")
    minutes = F.greatest(F.col("secs") / 60, F.lit(0.001))
    return j.select(
        "asset",
        F.round((F.coalesce("shots", F.lit(0)) - 1) / minutes, 5).alias("cuts_per_minute"),
        "median_shot_us",
        F.coalesce("speakers", F.lit(0)).alias("speakers"),
        F.round(F.coalesce("voice", F.lit(0.0)) / minutes, 5).alias("voice_per_minute"),
        r6(F.coalesce("faces", F.lit(0.0))).alias("face_share"),
        r6(F.coalesce("lines", F.lit(0.0))).alias("text_share"),
    )


_LINES = """x AS (SELECT DISTINCT frame_id, asset, (time_num::HUGEINT * 1000000 // time_den)::BIGINT AS time_us, text FROM frames WHERE asset IS NOT NULL AND time_num IS NOT NULL AND text IS NOT NULL),
l AS (SELECT frame_id, asset, time_us, upper(trim(u.text)) AS line, u.box AS box FROM (SELECT frame_id, asset, time_us, unnest(text) AS u FROM x) WHERE u.text IS NOT NULL)"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    from tapewright.sources.standins import us

    f = table(spark, sf, "frames").where("asset IS NOT NULL AND time_num IS NOT NULL AND text IS NOT NULL").dropDuplicates(["frame_id"])
    return f.select("frame_id", "asset", us("time_num", "time_den").alias("time_us"), F.explode("text").alias("t")).where("t.text IS NOT NULL").select("frame_id", "asset", "time_us", F.upper(F.trim("t.text")).alias("line"), F.col("t.box").alias("box"))


@CATALOG.add("stat_first_seen_text", f"WITH {_LINES}, g AS (SELECT asset, line, min(time_us) AS first_at, count(*) AS n FROM l GROUP BY asset, line) SELECT *, row_number() OVER (PARTITION BY asset ORDER BY first_at, line)::INT AS ord FROM g")
def stat_first_seen_text(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_seen(_lines(spark, sf), ["asset"], "line", "time_us")


_SCREEN = f"""WITH {_LINES}, k AS (SELECT asset, time_us, row_number() OVER (PARTITION BY asset ORDER BY time_us) AS k FROM (SELECT DISTINCT asset, time_us FROM l)), f AS (SELECT asset, max(time_us) - min(time_us) AS step FROM k WHERE k <= 2 GROUP BY asset)
SELECT l.asset, line, count(*) AS n, count(*) * max(step) AS on_screen FROM l JOIN f USING (asset) GROUP BY l.asset, line"""


@CATALOG.add("stat_screen_time", _SCREEN)
def stat_screen_time(spark: SparkSession, sf: str) -> DataFrame:
    return S.screen_time(_lines(spark, sf), ["asset"], "line", "time_us")


_PERSISTENT = f"""WITH {_LINES}, t AS (SELECT asset, count(DISTINCT frame_id) AS frames FROM l GROUP BY asset),
c AS (SELECT asset, line, (least(greatest(floor(box.y * 10 / 1920), 0), 9) * 10 + least(greatest(floor(box.x * 10 / 1080), 0), 9))::INT AS cell, count(DISTINCT frame_id) AS n FROM l GROUP BY ALL)
SELECT asset, line, cell, n, round(n / frames::DOUBLE, 6) AS persistence, n / frames::DOUBLE >= 0.6 AS persistent FROM c JOIN t USING (asset)"""


@CATALOG.add("stat_persistent_text", _PERSISTENT)
def stat_persistent_text(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by place: the share of frames in which they are seen there."""
    l = _lines(spark, sf)
    t = l.groupBy("asset").agg(F.count_distinct("frame_id").alias("frames"))
    c = l.groupBy("asset", "line", S.grid_cell(F.col("box.x"), F.col("box.y"), 1080, 1920).alias("cell")).agg(F.count_distinct("frame_id").alias("n"))
    p = F.col("n") / F.col("frames")
    return c.join(t, "asset").select("asset", "line", "cell", "n", r6(p).alias("persistence"), (p >= 0.6).alias("persistent"))


_FACE = """WITH x AS (SELECT DISTINCT frame_id, asset, faces FROM frames WHERE asset IS NOT NULL AND faces IS NOT NULL AND len(faces) > 0), u AS (SELECT frame_id, asset, unnest(faces) AS b FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY b.width * b.height DESC, b.x, b.y) AS k FROM u)
SELECT asset, count(*) AS n, list_sort(list(b.x + b.width / 2))[len(list(b.x)) // 2 + 1] AS mid_x, list_sort(list(b.y + b.height / 2))[len(list(b.x)) // 2 + 1] AS mid_y FROM k WHERE k = 1 GROUP BY asset HAVING count(*) >= 3"""


@CATALOG.add("stat_largest_face", _FACE)
def stat_largest_face(spark: SparkSession, sf: str) -> DataFrame:
    """Where the largest face of each frame is as a rule; needs three frames with a face."""
    f = table(spark, sf, "frames").where("asset IS NOT NULL AND size(faces) > 0").dropDuplicates(["frame_id"])
    big = F.array_max(F.transform("faces", lambda b: F.struct((b["width"] * b["height"]).alias("a"), (-b["x"]).alias("nx"), (-b["y"]).alias("ny"), b["width"].alias("w"), b["height"].alias("h"))))
    g = f.select("asset", big.alias("b")).select("asset", (-F.col("b.nx") + F.col("b.w") / 2).alias("mid_x"), (-F.col("b.ny") + F.col("b.h") / 2).alias("mid_y"))
    y = S.ranked_value(g, ["asset"], "mid_y", S.upper_median, "n_y").select("asset", "mid_y")
    return S.ranked_value(g, ["asset"], "mid_x", S.upper_median).where("n >= 3").join(y, "asset")


_PREFS = r"""WITH n AS (SELECT CASE WHEN event_id % 3 = 0 THEN upper(event_type) || '!' ELSE event_type END AS note, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'p' || (user_id % 5) END AS project, epoch_us(ts)::BIGINT AS at_us FROM events),
g AS (SELECT trim(regexp_replace(regexp_replace(lower(note), '[^\p{L}\p{N} ]', '', 'g'), ' +', ' ', 'g')) AS note, project, count(*) AS n, min(at_us) AS first_at, max(at_us) AS last_at FROM n GROUP BY ALL)
SELECT *, least(50 + 5 * least(n, 10), 90) / 100.0::DOUBLE AS confidence, n >= 3 AS offer FROM g"""


@CATALOG.add("stat_preferences", _PREFS)
def stat_preferences(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    n = e.select(
        F.when(F.col("event_id") % 3 == 0, F.concat(F.upper("event_type"), F.lit("!"))).otherwise(F.col("event_type")).alias("note"), F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string"))).alias("project"), F.col("ts_us").alias("at")
    )
    return S.preferences(n)


# ---- signals ---------------------------------------------------------------------------------------------------------

_DIST = """WITH d AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS was FROM embeddings)
SELECT vec_id, round(CASE WHEN was IS NOT NULL THEN list_sum(list_transform(list_zip(embedding, was), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) / 3 END, 5) AS distance FROM d"""


@CATALOG.add("signal_distances", _DIST)
def signal_distances(spark: SparkSession, sf: str) -> DataFrame:
    d = G.consecutive_distance(table(spark, sf, "embeddings"), ["label"], "vec_id", "embedding")
    return d.select("vec_id", F.round("distance", 5).alias("distance"))


_CUTS = f"""WITH {EVENTS}, d AS (SELECT event_id, user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts_us, event_id)) AS distance FROM e),
t AS (SELECT user_id, greatest(6 * list_sort(list(distance) FILTER (WHERE distance IS NOT NULL))[count(distance) // 2 + 1], 0.08) AS threshold FROM d GROUP BY user_id)
SELECT event_id, round(threshold, 5) AS threshold, coalesce(distance > threshold, false) AS is_cut FROM d JOIN t USING (user_id)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frames, the step of the level from one to the next as their distance, and the cuts that stand out."""
    e = previous(blocks(events(spark, sf), "ts_us", 24 * HOUR), ["user_id"], "__block", ["ts_us", "event_id"], "value", "was")
    d = cut_lineage(e.select("event_id", "user_id", "ts_us", F.abs(F.col("value") - F.col("was.value")).alias("distance")))
    return G.cut_scores(d, ["user_id"])


@CATALOG.add("signal_cuts", _CUTS)
def signal_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("event_id", F.round("threshold", 5).alias("threshold"), "is_cut")


@CATALOG.add("signal_shots")
def signal_shots(spark: SparkSession, sf: str) -> DataFrame:
    """The shots between those cuts."""
    first = F.lit(1_704_067_200_000_000)
    d = _scored(spark, sf).withColumn("at", F.col("ts_us") - first)
    end = events(spark, sf).groupBy("user_id").agg((F.max("ts_us") - first).alias("end"))
    return G.shots_of_cuts(d, ["user_id"], "at", "distance", end, 200_000)


_HOPS = f"""{EVENTS}, h AS (SELECT user_id, ts_us // 21600000000 AS hop, sum(value * value / 10000) AS energy, count(*)::DOUBLE AS samples FROM e GROUP BY ALL),
b AS (SELECT * FROM (SELECT user_id, hop, sum(energy) OVER w / sum(samples) OVER w AS power, count(*) OVER w AS n FROM h WINDOW w AS (PARTITION BY user_id ORDER BY hop ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE n = 4)"""


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    h = e.groupBy("user_id", F.call_function("div", F.col("ts_us"), F.lit(21_600_000_000)).alias("hop")).agg(F.sum(F.col("value") * F.col("value") / 10000).alias("energy"), F.count(F.lit(1)).cast("double").alias("samples"))
    return G.block_power(h, ["user_id"], "hop", "energy", "samples")


_LOUD = f"""WITH {_HOPS}, q AS (SELECT *, -0.691::DOUBLE + 10 * log10(power) AS l FROM b WHERE power > 0), g AS (SELECT user_id, -0.691::DOUBLE + 10 * log10(avg(power)) - 10 AS gate FROM q WHERE l > -70 GROUP BY user_id)
SELECT b.user_id, round(any_value(i.integrated), 5) AS integrated, coalesce(any_value(i.n_blocks), NULL) AS n_blocks, round(-23 - any_value(i.integrated), 5) AS gain FROM (SELECT DISTINCT user_id FROM b) b LEFT JOIN
(SELECT q.user_id, -0.691::DOUBLE + 10 * log10(avg(power)) AS integrated, count(*) AS n_blocks FROM q JOIN g USING (user_id) WHERE l > -70 AND l > gate GROUP BY q.user_id) i USING (user_id) GROUP BY b.user_id"""


@CATALOG.add("signal_loudness", _LOUD)
def signal_loudness(spark: SparkSession, sf: str) -> DataFrame:
    i = G.integrated_loudness(_blocks(spark, sf), ["user_id"])
    return i.select("user_id", F.round("integrated", 5).alias("integrated"), "n_blocks", F.round(G.gain_to(F.lit(-23.0), F.col("integrated")), 5).alias("gain"))


_SURROUND = f"""WITH {EVENTS}, h AS (SELECT user_id, event_type, ts_us // 86400000000 AS hop, avg(value * value / 10000) AS power FROM e GROUP BY ALL),
b AS (SELECT user_id, hop, sum(power * CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN 0 ELSE 1.41::DOUBLE END) AS power FROM h GROUP BY ALL),
m AS (SELECT user_id, max(power) AS p, max(CASE WHEN n = 30 THEN long END) AS s FROM (SELECT user_id, power, avg(power) OVER w AS long, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY user_id ORDER BY hop ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) GROUP BY user_id)
SELECT user_id, round(CASE WHEN p > 0 THEN -0.691::DOUBLE + 10 * log10(p) END, 5) AS momentary, round(CASE WHEN s > 0 THEN -0.691::DOUBLE + 10 * log10(s) END, 5) AS short_term FROM m"""


@CATALOG.add("signal_loudness_maxima", _SURROUND)
def signal_loudness_maxima(spark: SparkSession, sf: str) -> DataFrame:
    """Types of events as the channels of a sound, a day as a block: the loudest block and the loudest thirty."""
    t = F.col("event_type")
    channel = F.when(t == "view", 0).when(t == "click", 1).when(t == "signup", 2).when(t == "error", 3).otherwise(4)
    h = events(spark, sf).groupBy("user_id", channel.alias("channel"), F.call_function("div", F.col("ts_us"), F.lit(86_400_000_000)).alias("hop")).agg(F.avg(F.col("value") * F.col("value") / 10000).alias("power"))
    m = G.loudness_maxima(G.channel_power(h, ["user_id"], "hop", "channel"), ["user_id"], "hop")
    return m.select("user_id", F.round("momentary", 5).alias("momentary"), F.round("short_term", 5).alias("short_term"))


_RANGE = f"""WITH {_HOPS}, s AS (SELECT user_id, p, -0.691::DOUBLE + 10 * log10(p) AS l FROM (SELECT user_id, avg(power) OVER w AS p, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY user_id ORDER BY hop ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE n = 30 AND p > 0),
g AS (SELECT user_id, -0.691::DOUBLE + 10 * log10(avg(p)) - 20 AS gate FROM s WHERE l > -70 GROUP BY user_id), k AS (SELECT s.user_id, list_sort(list(l)) AS x FROM s JOIN g USING (user_id) WHERE l > -70 AND l > gate GROUP BY s.user_id)
SELECT user_id, round(x[round((len(x) - 1) * 0.95::DOUBLE)::INT + 1] - x[round((len(x) - 1) * 0.1::DOUBLE)::INT + 1], 5) AS loudness_range FROM k"""


@CATALOG.add("signal_loudness_range", _RANGE)
def signal_loudness_range(spark: SparkSession, sf: str) -> DataFrame:
    return G.loudness_range(_blocks(spark, sf), ["user_id"], "hop").withColumn("loudness_range", F.round("loudness_range", 5))


_SILENCE = f"""WITH {EVENTS}, n AS (SELECT user_id, value / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) - 1 AS n FROM e),
f AS (SELECT user_id, n // 4 AS frame, CASE WHEN avg(v * v) > 0 THEN 20 * log10(sqrt(avg(v * v))) ELSE -120.0 END AS db FROM n GROUP BY ALL HAVING count(*) = 4),
g AS (SELECT user_id, coalesce(list_sort(list(db) FILTER (WHERE db > -45))[floor((count(*) FILTER (WHERE db > -45) - 1) * 0.55::DOUBLE)::INT + 1], -120.0) AS speech, list_sort(list(db))[floor((count(*) - 1) * 0.1::DOUBLE)::INT + 1] AS noise FROM f GROUP BY user_id)
SELECT user_id, round(speech, 5) AS speech_level, round(noise, 5) AS noise_floor, round(speech - 25, 5) AS threshold FROM g"""


@CATALOG.add("signal_silence_profile", _SILENCE)
def signal_silence_profile(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts_us", "event_id")
    n = events(spark, sf).select("user_id", (F.col("value") / 100).alias("v"), (F.row_number().over(w) - 1).alias("n"))
    p = G.silence_profile(G.rms_frames(n, ["user_id"], "n", "v", 4), ["user_id"])
    return p.select("user_id", *[F.round(c, 5).alias(c) for c in ("speech_level", "noise_floor", "threshold")])


_OTSU = f"""WITH {EVENTS}, v AS (SELECT event_type, log10(greatest(value, 1e-6::DOUBLE)) AS x FROM e WHERE value IS NOT NULL), s AS (SELECT event_type, min(x) AS lo, max(x) AS hi, count(*) AS n FROM v GROUP BY event_type),
h AS (SELECT event_type, lo, hi, n, least(floor((x - lo) / (hi - lo) * 128), 127)::INT AS bin, count(*) AS c FROM v JOIN s USING (event_type) WHERE hi > lo AND n > 8 GROUP BY ALL),
k AS (SELECT *, sum(c) OVER w AS w0, sum(c * bin) OVER w AS s0, sum(c * bin) OVER (PARTITION BY event_type) AS st FROM h WINDOW w AS (PARTITION BY event_type ORDER BY bin)),
b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(w0::DOUBLE * (n - w0) * pow(s0 / w0::DOUBLE - (st - s0) / (n - w0)::DOUBLE, 2), 6) DESC, bin) AS r FROM k WHERE w0 < n)
SELECT event_type, round(coalesce(pow(10.0::DOUBLE, lo + (bin + 1) * (hi - lo) / 128), 0.005), 5) AS threshold FROM (SELECT event_type FROM s) LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (event_type)"""


@CATALOG.add("signal_otsu", _OTSU)
def signal_otsu(spark: SparkSession, sf: str) -> DataFrame:
    return G.otsu_threshold(events(spark, sf), ["event_type"], "value").withColumn("threshold", F.round("threshold", 5))


_LAG = f"""WITH {EVENTS}, x AS (SELECT event_type, ts_us // 86400000000 AS day, round(avg(value), 9) AS v FROM e GROUP BY ALL), y AS (SELECT event_type, day + 2 AS day, v + 1 AS v FROM x),
g AS (SELECT unnest(range(-5, 6)) AS lag), d AS (SELECT x.event_type, g.lag, round(avg(abs(x.v - y.v)), 9) AS d FROM x JOIN y USING (event_type) JOIN g ON x.day + g.lag = y.day GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d, abs(lag), lag) AS k, max(CASE WHEN lag = 0 THEN d END) OVER (PARTITION BY event_type) AS base FROM d)
SELECT event_type, CASE WHEN d < 0.8 * base AND abs(lag) < 5 THEN lag::INT END AS lag, round(d, 7) AS difference, round(base, 7) AS baseline FROM m WHERE k = 1"""


@CATALOG.add("signal_lag", _LAG)
def signal_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Daily levels against the same shifted by two days: the shift is found."""
    x = events(spark, sf).groupBy("event_type", F.call_function("div", F.col("ts_us"), F.lit(86_400_000_000)).alias("day")).agg(F.round(F.avg("value"), 9).alias("v"))
    y = x.select("event_type", (F.col("day") + 2).alias("day"), (F.col("v") + 1).alias("v"))
    l = G.best_lag(x, y, ["event_type"], "day", "v", 5)
    return l.select("event_type", "lag", F.round("difference", 7).alias("difference"), F.round("baseline", 7).alias("baseline"))


_CADENCE = f"""WITH {FRAMES}, g AS (SELECT asset, row_number() OVER w AS k, time_us - lag(time_us) OVER w AS gap FROM f WINDOW w AS (PARTITION BY asset ORDER BY time_us)), m AS (SELECT asset, count(*) AS n, list_sort(list(gap) FILTER (WHERE gap > 0)) AS x FROM g WHERE k <= 12 GROUP BY asset)
SELECT asset, round(CASE WHEN n >= 3 THEN 1e6::DOUBLE / x[len(x) // 2 + 1] END, 6) AS fps FROM m"""


@CATALOG.add("signal_cadence", _CADENCE)
def signal_cadence(spark: SparkSession, sf: str) -> DataFrame:
    return G.cadence(frames(spark, sf), ["asset"], "time_us").withColumn("fps", r6("fps"))


_QC = """WITH f AS (SELECT vec_id, list_min(embedding)::DOUBLE * 400 + 128 AS lo, list_max(embedding)::DOUBLE * 400 + 128 AS hi, list_avg(embedding)::DOUBLE * 400 + 20 AS mean,
  list_avg(list_transform(list_zip(embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) AS diff, vec_id % 5 <> 0 AS tagged FROM embeddings)
SELECT vec_id, CASE WHEN tagged THEN lo < 5 OR hi > 246 END AS illegal, mean < 17 AS black, coalesce(diff < 0.05, false) AS repeated FROM f"""


@CATALOG.add("signal_frame_qc", _QC)
def signal_frame_qc(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(c)
    was = F.lag("embedding").over(w)
    e = e.withColumn("was", was)
    s = e.select(
        "vec_id",
        (F.array_min("embedding").cast("double") * 400 + 128).alias("min"),
        (F.array_max("embedding").cast("double") * 400 + 128).alias("max"),
        (mean(F.col("embedding")) * 400 + 20).alias("mean"),
        F.when(F.col("was").isNotNull(), mean(F.zip_with("embedding", "was", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))).alias("diff"),
    )
    return G.classify_frames(s, F.lit(5), F.lit(246), F.col("vec_id") % 5 != 0).select("vec_id", "illegal", "black", "repeated")


_MASK = """WITH c AS (SELECT l_suppkey % 7 AS frame, l_partkey % 64 AS x, l_orderkey % 64 AS y, (l_linenumber * 5 + l_suppkey) % 8 AS present FROM lineitem),
r AS (SELECT * FROM c WHERE x BETWEEN 8 AND 39 AND y BETWEEN 8 AND 39)
SELECT frame, round(avg((present & 2 <> 0)::INT), 6) AS coverage, count(*) FILTER (WHERE present = 0) AS uncovered, min(x) FILTER (WHERE present & 2 <> 0) AS min_x, max(x) FILTER (WHERE present & 2 <> 0) AS max_x,
  avg((present & 2 <> 0)::INT) > 0.02 AND avg((present & 2 <> 0)::INT) < 0.98 AS edge_crosses FROM r GROUP BY frame"""


@CATALOG.add("signal_mask_coverage", _MASK)
def signal_mask_coverage(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    c = l.select((F.col("l_suppkey") % 7).alias("frame"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_orderkey") % 64).alias("y"), ((F.col("l_linenumber") * 5 + F.col("l_suppkey")) % 8).cast("bigint").alias("present"))
    return G.mask_coverage(c, ["frame"], "present", 1, (8, 8, 40, 40)).withColumn("coverage", r6("coverage"))
