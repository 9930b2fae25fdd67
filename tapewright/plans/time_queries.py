"""Queries on grids, timecode and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.functions import exact_time as X
from tapewright.functions import grid as G
from tapewright.functions import measures as M
from tapewright.plans.catalog import Catalog
from tapewright.sources.standins import EVENTS, events
from tapewright.sources.tables import table

CATALOG = Catalog()


@CATALOG.add(
    "time_rounding",
    """SELECT DISTINCT frame_id, time_num // time_den AS floor_s, (time_num + time_den - 1) // time_den AS ceil_s,
      (2 * time_num + time_den) // (2 * time_den) AS rounded_s, (time_num::HUGEINT * 705600000 // time_den)::BIGINT AS tick,
      time_num::HUGEINT * 705600000 % time_den = 0 AS exact
    FROM frames WHERE time_num IS NOT NULL AND time_den IS NOT NULL""",
)
def time_rounding(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "frames").where("time_num IS NOT NULL AND time_den IS NOT NULL")
    n, d = F.col("time_num"), F.col("time_den")
    return f.select(
        "frame_id", G.floor_seconds(n, d).alias("floor_s"), G.ceil_seconds(n, d).alias("ceil_s"), G.rounded_seconds(n, d).alias("rounded_s"), X.tick("time_num", "time_den").alias("tick"), X.is_exact_tick("time_num", "time_den").alias("exact")
    ).distinct()


_FRAME_GRID = """
SELECT DISTINCT frame_id, (time_num::HUGEINT * fps_num // (time_den::HUGEINT * fps_den))::BIGINT AS frame,
  ((2 * time_num::HUGEINT * fps_num + time_den::HUGEINT * fps_den) // (2 * time_den::HUGEINT * fps_den))::BIGINT AS nearest,
  time_num::HUGEINT * fps_num % (time_den::HUGEINT * fps_den) = 0 AS aligned,
  (time_num::HUGEINT * 48000 // time_den)::BIGINT AS sample, ((2 * time_num::HUGEINT * 48000 + time_den) // (2 * time_den::HUGEINT))::BIGINT AS nearest_sample
FROM frames JOIN (SELECT DISTINCT asset, fps_num, fps_den FROM assets WHERE fps_num IS NOT NULL AND fps_den IS NOT NULL) USING (asset)
WHERE time_num IS NOT NULL AND time_den IS NOT NULL
"""


@CATALOG.add("time_grid", _FRAME_GRID)
def time_grid(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "assets").where("fps_num IS NOT NULL AND fps_den IS NOT NULL").select("asset", "fps_num", "fps_den").distinct()
    f = table(spark, sf, "frames").where("time_num IS NOT NULL AND time_den IS NOT NULL").select("frame_id", "asset", "time_num", "time_den").join(a, "asset")
    args = [F.col(c) for c in ("time_num", "time_den", "fps_num", "fps_den")]
    return f.select(
        "frame_id",
        G.frame_at(*args).alias("frame"),
        G.nearest_frame(*args).alias("nearest"),
        G.is_frame_aligned(*args).alias("aligned"),
        G.sample_index(args[0], args[1], 48000).alias("sample"),
        G.nearest_sample(args[0], args[1], 48000).alias("nearest_sample"),
    ).distinct()


_TIMECODE = """
WITH x AS (SELECT DISTINCT event_id * 37 AS frame FROM events), y AS (
  SELECT frame, frame // 17982 AS d, frame % 17982 AS m FROM x), z AS (
  SELECT frame, frame + 18 * d + CASE WHEN m >= 2 THEN 2 * ((m - 2) // 1798) ELSE 0 END AS n FROM y)
SELECT frame, printf('%02d:%02d:%02d;%02d', n // 108000, n // 1800 % 60, n // 30 % 60, n % 30) AS tc_drop,
  printf('%02d:%02d:%02d:%02d', frame // 90000, frame // 1500 % 60, frame // 25 % 60, frame % 25) AS tc_25,
  frame AS back_drop, frame AS back_25 FROM z
"""


@CATALOG.add("time_timecode", _TIMECODE)
def time_timecode(spark: SparkSession, sf: str) -> DataFrame:
    """Frame to timecode and back, with and without dropped numbers."""
    x = table(spark, sf, "events").select((F.col("event_id") * 37).alias("frame")).distinct()
    x = x.withColumn("tc_drop", G.timecode(F.col("frame"), 30, True)).withColumn("tc_25", G.timecode(F.col("frame"), 25, False))
    return x.withColumn("back_drop", G.frame_of_timecode(F.col("tc_drop"), 30, True)).withColumn("back_25", G.frame_of_timecode(F.col("tc_25"), 25, False))


_RATE = """
WITH m AS (SELECT DISTINCT asset, fps_num::DOUBLE / fps_den * (1 + (ascii(asset) % 9 - 4) * 0.008) AS measured FROM assets WHERE fps_num IS NOT NULL AND fps_den IS NOT NULL),
r AS (SELECT * FROM (VALUES (0, 24000, 1001), (1, 24, 1), (2, 25, 1), (3, 30000, 1001), (4, 30, 1), (5, 50, 1), (6, 60000, 1001), (7, 60, 1)) AS v(ord, num, den)),
j AS (SELECT asset, measured, num, den, abs(measured - num::DOUBLE / den) / (num::DOUBLE / den) AS error, ord FROM m CROSS JOIN r),
b AS (SELECT *, row_number() OVER (PARTITION BY asset, measured ORDER BY error, ord) AS k FROM j)
SELECT asset, round(measured, 6) AS measured, CASE WHEN error <= 0.02 THEN num END AS rate_num, CASE WHEN error <= 0.02 THEN den END AS rate_den FROM b WHERE k = 1
"""


@CATALOG.add("time_standard_rate", _RATE)
def time_standard_rate(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "assets").where("fps_num IS NOT NULL AND fps_den IS NOT NULL")
    a = a.select("asset", (F.col("fps_num").cast("double") / F.col("fps_den") * (1 + (F.ascii("asset") % 9 - 4) * 0.008)).alias("measured")).distinct()
    r = G.nearest_standard_rate(F.col("measured"))
    return a.select("asset", F.round("measured", 6).alias("measured"), r["num"].alias("rate_num"), r["den"].alias("rate_den"))


_MEASURES = (
    f"WITH {EVENTS}, p AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS was FROM e)"
    + """
SELECT event_id, round(CASE WHEN value > 0 THEN 20 * log10(value) ELSE -120.0 END, 6) AS db,
  round(CASE WHEN was > 0 AND value > 0 THEN abs(12 * log2(value / was)) END, 6) AS step,
  round((greatest(l1, l2) + 0.05) / (least(l1, l2) + 0.05), 6) AS contrast
FROM (SELECT *, (0.2126 + 0.7152 + 0.0722) * CASE WHEN a <= 0.04045 THEN a / 12.92 ELSE pow((a + 0.055) / 1.055, 2.4) END AS l1,
  (0.2126 + 0.7152 + 0.0722) * CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS l2
  FROM (SELECT *, event_id % 256 / 255.0::DOUBLE AS a, event_id * 7 % 256 / 255.0::DOUBLE AS b FROM p))
"""
)


@CATALOG.add("measure_levels", _MEASURES)
def measure_levels(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts_us", "event_id")
    e = events(spark, sf).withColumn("was", F.lag("value").over(w))
    a, b = (F.col("event_id") % 256 / 255.0), (F.col("event_id") * 7 % 256 / 255.0)
    return e.select(
        "event_id",
        F.round(M.decibels(F.col("value")), 6).alias("db"),
        F.round(M.semitones(F.col("was"), F.col("value")), 6).alias("step"),
        F.round(M.contrast_ratio(M.relative_luminance(a, a, a), M.relative_luminance(b, b, b)), 6).alias("contrast"),
    )


_BOXES = """
WITH b AS (SELECT DISTINCT frame_id, faces FROM frames WHERE faces IS NOT NULL AND len(faces) > 0),
x AS (SELECT frame_id, unnest(faces) AS b, unnest(range(len(faces))) AS i FROM b)
SELECT frame_id, round(sum(b.width * b.height), 3) AS area, round(max(b.x + b.width), 3) AS max_x, round(max(b.y + b.height), 3) AS max_y,
  (SELECT count(*) FROM x p JOIN x q ON p.frame_id = q.frame_id AND p.i < q.i
    AND p.b.x < q.b.x + q.b.width AND q.b.x < p.b.x + p.b.width AND p.b.y < q.b.y + q.b.height AND q.b.y < p.b.y + p.b.height WHERE p.frame_id = x.frame_id) AS crossing
FROM x GROUP BY frame_id
"""


@CATALOG.add("measure_boxes", _BOXES)
def measure_boxes(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "frames").where("faces IS NOT NULL AND size(faces) > 0").select("frame_id", "faces").dropDuplicates(["frame_id"])
    after = lambda i: F.slice(F.col("faces"), i + 2, F.size("faces"))
    crossing = F.aggregate(F.transform("faces", lambda b, i: F.size(F.filter(after(i), lambda c: M.boxes_intersect(b, c)))), F.lit(0), lambda a, n: a + n)
    return f.select(
        "frame_id",
        F.round(F.aggregate("faces", F.lit(0.0), lambda a, b: a + M.box_area(b)), 3).alias("area"),
        F.round(F.array_max(F.transform("faces", lambda b: b["x"] + b["width"])), 3).alias("max_x"),
        F.round(F.array_max(F.transform("faces", lambda b: b["y"] + b["height"])), 3).alias("max_y"),
        crossing.cast("bigint").alias("crossing"),
    )


_REFRAME = """
WITH a AS (SELECT DISTINCT vec_id, 640 + vec_id % 97 * 20 AS w, 360 + vec_id % 89 * 20 AS h, [ '16:9', '9:16', '1:1', '4:5', 'original', '16x9' ][vec_id % 6 + 1] AS aspect,
  CASE WHEN vec_id % 5 = 0 THEN NULL ELSE vec_id % 11 / 10.0::DOUBLE END AS sx, vec_id % 7 / 6.0::DOUBLE AS sy FROM embeddings),
r AS (SELECT *, CASE aspect WHEN '16:9' THEN 16 / 9.0::DOUBLE WHEN '9:16' THEN 9 / 16.0::DOUBLE WHEN '1:1' THEN 1.0::DOUBLE WHEN '4:5' THEN 4 / 5.0::DOUBLE END AS ratio FROM a),
c AS (SELECT *, (floor(CASE WHEN w::DOUBLE / h > ratio THEN h * ratio ELSE w::DOUBLE END / 2) * 2)::BIGINT AS cw,
  (floor(CASE WHEN w::DOUBLE / h > ratio THEN h::DOUBLE ELSE w / ratio END / 2) * 2)::BIGINT AS ch FROM r WHERE ratio IS NOT NULL)
SELECT vec_id, round(ratio, 6) AS ratio, cw, ch, floor(least(greatest(coalesce(sx, 0.5) * w - cw / 2.0::DOUBLE, 0.0), (w - cw)::DOUBLE))::BIGINT AS x,
  floor(least(greatest(sy * h - ch / 2.0::DOUBLE, 0.0), (h - ch)::DOUBLE))::BIGINT AS y FROM c
"""


@CATALOG.add("measure_reframe", _REFRAME)
def measure_reframe(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    a = table(spark, sf, "embeddings").select(
        "vec_id",
        (640 + v % 97 * 20).alias("w"),
        (360 + v % 89 * 20).alias("h"),
        F.element_at(F.array(*[F.lit(x) for x in ("16:9", "9:16", "1:1", "4:5", "original", "16x9")]), (v % 6 + 1).cast("int")).alias("aspect"),
        F.when(v % 5 != 0, v % 11 / 10.0).alias("sx"),
        (v % 7 / 6.0).alias("sy"),
    ).distinct()
    a = a.withColumn("ratio", M.parse_aspect(F.col("aspect"))).where("ratio IS NOT NULL")
    c = a.withColumn("c", M.crop_plan(F.col("w"), F.col("h"), F.col("ratio"), F.col("sx"), F.col("sy")))
    return c.select("vec_id", F.round("ratio", 6).alias("ratio"), F.col("c.width").alias("cw"), F.col("c.height").alias("ch"), F.col("c.x").alias("x"), F.col("c.y").alias("y"))


_BANDS = """
WITH a AS (SELECT DISTINCT vec_id, 2 + vec_id % 3 AS panels, vec_id % 2 AS panel, 640 + vec_id % 97 * 20 AS w, 360 + vec_id % 89 * 20 AS h, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE vec_id % 9 / 8.0::DOUBLE END AS sy FROM embeddings),
b AS (SELECT *, 1920::DOUBLE / panels AS band, greatest(1080::DOUBLE / w, 1920::DOUBLE / panels / h) AS scale FROM a)
SELECT vec_id, round(scale * 100000) / 100000 AS scale, round(least(greatest(coalesce(sy, 0.5) * h * scale - band / 2, 0.0), h * scale - band) * 100000) / 100000 AS offset_y, round(panel * band * 100000) / 100000 AS band_top FROM b
"""


@CATALOG.add("measure_bands", _BANDS)
def measure_bands(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    a = table(spark, sf, "embeddings").select("vec_id").distinct()
    p = M.band_placement(v % 2, 2 + v % 3, 640 + v % 97 * 20, 360 + v % 89 * 20, F.lit(1080.0), F.lit(1920.0), F.when(v % 4 != 0, v % 9 / 8.0))
    return a.select("vec_id", p.alias("p")).select("vec_id", "p.scale", "p.offset_y", "p.band_top")
