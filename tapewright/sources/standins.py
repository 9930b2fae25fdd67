"""Tables of the data model derived from the test tables, each with the same derivation in SQL.

``*_us`` columns are exact times in microseconds, rounded down. Rows delivered again under one id are one record.
Words carry times derived from their place, so that every operator on words can run on ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions import exact_time as X
from tapewright.sources.tables import table


def us(num: str, den: str) -> Column:
    return X.whole_seconds(num, den) * F.lit(10**6) + X.micro_rest(num, den)


def turns(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "turns").where("asset IS NOT NULL AND end_num IS NOT NULL")
    return t.select("turn_id", "asset", "speaker", us("start_num", "start_den").alias("start_us"), us("end_num", "end_den").alias("end_us")).where("end_us >= start_us").dropDuplicates(["turn_id"])


TURNS = """t AS (
  SELECT DISTINCT turn_id, asset, speaker, (start_num::HUGEINT * 1000000 // start_den)::BIGINT AS start_us, (end_num::HUGEINT * 1000000 // end_den)::BIGINT AS end_us
  FROM turns WHERE asset IS NOT NULL AND end_num IS NOT NULL AND end_num::HUGEINT * 1000000 // end_den >= start_num::HUGEINT * 1000000 // start_den
)"""


def shots(spark: SparkSession, sf: str, repeated: bool = False) -> DataFrame:
    """``repeated``: with the rows that were delivered again, for what they don't change, as a union of ranges."""
    t = table(spark, sf, "shots").where("asset IS NOT NULL AND end_num IS NOT NULL")
    s = t.select("shot_id", "asset", "boundary_score", us("start_num", "start_den").alias("start_us"), us("end_num", "end_den").alias("end_us")).where("end_us >= start_us")
    return s if repeated else s.dropDuplicates(["shot_id"])


SHOTS = """s AS (
  SELECT DISTINCT shot_id, asset, boundary_score, (start_num::HUGEINT * 1000000 // start_den)::BIGINT AS start_us, (end_num::HUGEINT * 1000000 // end_den)::BIGINT AS end_us
  FROM shots WHERE asset IS NOT NULL AND end_num IS NOT NULL AND end_num::HUGEINT * 1000000 // end_den >= start_num::HUGEINT * 1000000 // start_den
)"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with their number of faces (confidence of 0.3 or more) and lines; -1 where the detector didn't run."""
    f = table(spark, sf, "frames").where("asset IS NOT NULL AND time_num IS NOT NULL")
    sure = lambda x: x["confidence"] >= 0.3
    return f.select("frame_id", "asset", us("time_num", "time_den").alias("time_us"), F.coalesce(F.size(F.filter("faces", sure)), F.lit(-1)).alias("n_faces"), F.coalesce(F.size("text"), F.lit(-1)).alias("n_lines")).dropDuplicates(["frame_id"])


FRAMES = """f AS (
  SELECT DISTINCT frame_id, asset, (time_num::HUGEINT * 1000000 // time_den)::BIGINT AS time_us,
    coalesce(len(list_filter(faces, lambda x: x.confidence >= 0.3)), -1)::INT AS n_faces, coalesce(len(text), -1)::INT AS n_lines
  FROM frames WHERE asset IS NOT NULL AND time_num IS NOT NULL
)"""


def cut_ranges(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "cut_plans").where("asset IS NOT NULL").select("plan_id", "asset", F.inline("ranges"))
    c = c.where("start_num IS NOT NULL AND end_num IS NOT NULL AND start_den IS NOT NULL AND end_den IS NOT NULL")
    return c.select("plan_id", "asset", us("start_num", "start_den").alias("start_us"), us("end_num", "end_den").alias("end_us")).where("end_us > start_us").distinct()


CUTS = """c AS (
  SELECT DISTINCT plan_id, asset, (x.start_num::HUGEINT * 1000000 // x.start_den)::BIGINT AS start_us, (x.end_num::HUGEINT * 1000000 // x.end_den)::BIGINT AS end_us
  FROM (SELECT plan_id, asset, unnest(ranges) AS x FROM cut_plans WHERE asset IS NOT NULL)
  WHERE x.start_num IS NOT NULL AND x.end_num IS NOT NULL AND x.start_den IS NOT NULL AND x.end_den IS NOT NULL
    AND x.end_num::HUGEINT * 1000000 // x.end_den > x.start_num::HUGEINT * 1000000 // x.start_den
)"""


def words(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """doc_id, idx, word, start_ms, end_ms, conf (hundredths), speaker. A pause of 0.9 s after every eleventh word.

    ``whole``: the words of a document are in one partition, by doc_id, so that work by document moves the texts and not every word. Spark takes the words
    for as small as the compressed texts, so a join with them has to say that they aren't to be broadcast."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    if whole:
        d = d.select("doc_id", "text").repartition("doc_id")
    w = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))).alias("idx", "word"))
    start = F.col("idx") * 400 + F.call_function("div", F.col("idx"), F.lit(11)).cast("int") * 900 + (F.col("doc_id") * 31 + F.col("idx") * 17) % 90
    return w.select(
        "doc_id",
        "idx",
        "word",
        start.cast("bigint").alias("start_ms"),
        (start + 120 + (F.length("word") * 37 + F.col("idx") * 11) % 180).cast("bigint").alias("end_ms"),
        ((F.col("doc_id") * 13 + F.col("idx") * 7 + F.length("word") * 5) % 60 + 40).cast("int").alias("conf"),
        (F.call_function("div", F.col("idx"), F.lit(25)) % 3).cast("int").alias("speaker"),
    )


WORDS = r"""w AS (
  SELECT doc_id, idx, word, (idx * 400 + idx // 11 * 900 + (doc_id * 31 + idx * 17) % 90)::BIGINT AS start_ms,
    (idx * 400 + idx // 11 * 900 + (doc_id * 31 + idx * 17) % 90 + 120 + (length(word) * 37 + idx * 11) % 180)::BIGINT AS end_ms,
    ((doc_id * 13 + idx * 7 + length(word) * 5) % 60 + 40)::INT AS conf, (idx // 25 % 3)::INT AS speaker
  FROM (SELECT doc_id, unnest(l) AS word, (unnest(range(len(l))))::INT AS idx
        FROM (SELECT doc_id, regexp_extract_all(text, '(\S+)', 1) AS l FROM documents WHERE text IS NOT NULL))
)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a series of levels: ts_us from the naive timestamp."""
    e = table(spark, sf, "events")
    return e.withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))


EVENTS = "e AS (SELECT *, epoch_us(ts)::BIGINT AS ts_us FROM events)"
