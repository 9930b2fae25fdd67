"""Queries on takes, scripts, panels and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.functions import normalise as N
from tapewright.operators import intervals as I
from tapewright.operators import report as P
from tapewright.operators import scripts as X
from tapewright.operators import selection as H
from tapewright.operators import statistics as S
from tapewright.plans.catalog import Catalog
from tapewright.plans.interval_queries import _MERGED
from tapewright.plans.stat_queries import _lines
from tapewright.session import cut_lineage
from tapewright.sources.standins import FRAMES, SHOTS, TURNS, frames, shots, turns, words
from tapewright.sources.tables import table

CATALOG = Catalog()
ENGINES = ["apple", "whisper_turbo", "distil_whisper", "parakeet"]


@CATALOG.add("choice_takes")
def choice_takes(spark: SparkSession, sf: str) -> DataFrame:
    """The readings of an utterance as takes: which to use for each line."""
    r = table(spark, sf, "asr_real_transcripts").dropDuplicates(["utterance_id"])
    r = r.select("utterance_id", F.posexplode(F.array(*ENGINES)).alias("take", "text")).where("trim(text) <> ''")
    w = r.select("utterance_id", "take", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("idx", "word"))
    w = w.withColumn("start_ms", (F.col("idx") * 400 + F.when(F.col("idx") % 7 == 3, 300).otherwise(0)).cast("bigint")).withColumn("end_ms", F.col("start_ms") + 250)
    return H.choose_takes(w.withColumn("conf", (F.length("word") * 13 + F.col("take") * 7) % 40 + 60), "utterance_id").withColumn("score", F.round("score", 6))


def _transcript_words(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "raw_transcripts").dropDuplicates(["line_id"]).select("transcript_id", "line_no", "line_id", F.posexplode(F.regexp_extract_all("raw_line", F.lit(r"(\S+)"), F.lit(1))).alias("pos", "word"))
    w = Window.partitionBy("transcript_id").orderBy("line_no", "line_id", "pos")
    l = l.withColumn("idx", F.row_number().over(w) - 1)
    return l.select("transcript_id", "idx", "word", (F.col("idx") * 400).cast("bigint").alias("start_ms"), (F.col("idx") * 400 + 300).cast("bigint").alias("end_ms"))


def _paused_words(spark: SparkSession, sf: str) -> DataFrame:
    """The same words with 400 ms of silence where the typed line has an ellipsis, a dash or a bracket."""
    pause = F.col("word").rlike(r"(\.\.\.|…|—|-|\])$")
    return _transcript_words(spark, sf).withColumn("end_ms", F.when(pause, F.col("start_ms")).otherwise(F.col("end_ms")))


def _located(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "corrections").dropDuplicates(["correction_id"]).select("transcript_id", F.col("correction_id").cast("int").alias("ord"), F.col("text").alias("line"))
    return X.locate_lines(lines, _transcript_words(spark, sf), "transcript_id")


@CATALOG.add("choice_located_lines")
def choice_located_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Where the abandoned speech of the corrections is in its transcript."""
    return _located(spark, sf).withColumn("similarity", F.round("similarity", 6))


def _beats(spark: SparkSession, sf: str) -> DataFrame:
    """The located lines one after another, as the plan of an output."""
    w = Window.partitionBy("transcript_id").orderBy("ord")
    l = _located(spark, sf).where("start_ms IS NOT NULL").withColumn("length", F.col("end_ms") - F.col("start_ms"))
    start = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return l.select("transcript_id", "ord", "line", F.col("start_ms").alias("source_start"), F.col("end_ms").alias("source_end"), start.alias("start"), (start + F.col("length")).alias("end"))


@CATALOG.add("choice_read_back")
def choice_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """An output that plays the located lines, less the last 400 ms of each, read back against its plan."""
    from tapewright.operators.intervals import overlap_pairs

    words_, beats = _transcript_words(spark, sf), cut_lineage(_beats(spark, sf))
    played = beats.select("transcript_id", "source_start", (F.col("source_end") - 400).alias("stop"), "start")
    o = overlap_pairs(played, words_, ["transcript_id"], ("source_start", "stop"), ("start_ms", "end_ms"), 10_000).where("start_ms >= source_start AND end_ms <= stop")
    o = o.select("transcript_id", F.row_number().over(Window.partitionBy("transcript_id").orderBy("start", "idx")).alias("idx"), "word", (F.col("start_ms") - F.col("source_start") + F.col("start")).alias("start_ms"), (F.col("end_ms") - F.col("source_start") + F.col("start")).alias("end_ms"))
    return X.read_back(beats, o, words_, "transcript_id").withColumn("similarity", F.round("similarity", 6))


@CATALOG.add("choice_times_heard")
def choice_times_heard(spark: SparkSession, sf: str) -> DataFrame:
    """How often the abandoned speech of a transcript's first correction is said in it."""
    c = table(spark, sf, "corrections").where("text IS NOT NULL").groupBy("transcript_id").agg(F.min_by("text", "correction_id").alias("phrase"))
    return X.times_heard(c, _transcript_words(spark, sf), "transcript_id")


@CATALOG.add("choice_stumbles")
def choice_stumbles(spark: SparkSession, sf: str) -> DataFrame:
    return X.stumbles(_located(spark, sf), _paused_words(spark, sf), "transcript_id")


@CATALOG.add("choice_script_problems")
def choice_script_problems(spark: SparkSession, sf: str) -> DataFrame:
    return X.script_problems(_located(spark, sf), _paused_words(spark, sf), "transcript_id").withColumn("similarity", F.round("similarity", 6))


@CATALOG.add("choice_join_costs")
def choice_join_costs(spark: SparkSession, sf: str) -> DataFrame:
    """The joins that would leave out the pause between two turns, over a sound of two tones whose pitch and level follow the time."""
    from tapewright.operators.blocked import blocks, following
    from tapewright.operators.intervals import HOUR

    rate = 1000
    t = following(blocks(turns(spark, sf), "start_us", HOUR), ["asset"], "__block", ["start_us", "turn_id"], "start_us", "next")
    ms = lambda c: F.call_function("div", c, F.lit(10**6 // rate))
    j = t.where("next.value > end_us").select(F.col("turn_id").alias("join_id"), "asset", ms(F.col("end_us")).alias("out_at"), ms(F.col("next.value")).alias("in_at"))
    near = j.select("asset", F.explode(F.array_union(F.sequence(F.greatest(F.col("out_at") - 360, F.lit(0)), F.col("out_at")), F.sequence("in_at", F.col("in_at") + 120))).alias("n")).distinct()
    hz = F.lit(90.0) + F.pmod(F.call_function("div", F.col("n"), F.lit(2000)), F.lit(5)) * 25
    sound = (F.lit(0.1) + F.pmod(F.call_function("div", F.col("n"), F.lit(700)), F.lit(7)) * 0.1) * F.sin(F.col("n") * hz * 6.283185307179586 / rate)
    return H.join_costs(j, near.withColumn("v", sound), rate).select("join_id", *[F.round(c, 4).alias(c) for c in ("level_step", "room_step", "pitch_step", "cost")], "settled")


@CATALOG.add("choice_captions_not_heard")
def choice_captions_not_heard(spark: SparkSession, sf: str) -> DataFrame:
    """Titles as captions over the first seconds of their text."""
    c = table(spark, sf, "documents").where("title IS NOT NULL").select("doc_id", F.lit(0).alias("caption"), F.col("title").alias("text"), F.lit(0).cast("bigint").alias("start_ms"), F.lit(5000).cast("bigint").alias("end_ms"))
    return X.captions_not_heard(c, words(spark, sf), "doc_id").withColumn("contained", F.round("contained", 6))


@CATALOG.add("choice_sections")
def choice_sections(spark: SparkSession, sf: str) -> DataFrame:
    return X.sections(words(spark, sf), "doc_id", 3)


_LABELS = r"""WITH r AS (SELECT DISTINCT utterance_id, apple, parakeet FROM asr_real_transcripts WHERE apple IS NOT NULL AND parakeet IS NOT NULL),
n AS (SELECT utterance_id, list_filter(list_transform(regexp_extract_all(parakeet, '(\S+)', 1), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS t,
  list_filter(list_transform(regexp_extract_all(apple, '(\S+)', 1), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS p FROM r),
c AS (SELECT utterance_id, len(t) AS n_truth, len(list_filter(t, lambda x: len(list_filter(p, lambda y: contains(x, y) OR contains(y, x))) > 0)) AS found, len(p) AS n_predicted,
  len(list_filter(p, lambda x: len(list_filter(t, lambda y: contains(x, y) OR contains(y, x))) = 0)) AS invented FROM n)
SELECT utterance_id, n_truth::INT AS n_truth, found::INT AS found, n_predicted::INT AS n_predicted, invented::INT AS invented, round(CASE WHEN n_truth > 0 THEN found / n_truth::DOUBLE END, 6) AS recall FROM c"""


@CATALOG.add("choice_label_scores", _LABELS)
def choice_label_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Words of one engine as labels, of another as predictions."""
    r = table(spark, sf, "asr_real_transcripts").where("apple IS NOT NULL AND parakeet IS NOT NULL").select("utterance_id", "apple", "parakeet").distinct()
    split = lambda c: F.regexp_extract_all(c, F.lit(r"(\S+)"), F.lit(1))
    return X.label_scores(r.select("utterance_id", split("parakeet").alias("truth"), split("apple").alias("predicted")), "utterance_id").withColumn("recall", F.round("recall", 6))


_PANELS = f"""WITH {SHOTS}, c AS (SELECT asset, shot_id, CASE WHEN boundary_score IS NULL THEN 0 WHEN boundary_score > 0.5 THEN 1 ELSE 2 END AS panel, shot_id = min(shot_id) OVER (PARTITION BY asset) AS opens,
  floor(start_us / 40000::DOUBLE + 0.5)::BIGINT * 40000 AS source_start, greatest(floor((end_us - start_us) / 40000::DOUBLE + 0.5)::BIGINT * 40000, 40000) AS len FROM s),
d AS (SELECT asset, shot_id, panel, opens, source_start, source_start + len AS source_end, len + CASE WHEN opens THEN 160000 ELSE 0 END AS span FROM c)
SELECT asset, shot_id, panel, source_start, source_end, span, coalesce(sum(span) OVER w, 0)::BIGINT AS "at", last_value(CASE WHEN opens OR panel = 0 THEN source_end END IGNORE NULLS) OVER w AS frozen_0,
  last_value(CASE WHEN opens THEN greatest(source_end - 80000, 0) WHEN panel = 1 THEN source_end END IGNORE NULLS) OVER w AS frozen_1, last_value(CASE WHEN opens THEN greatest(source_end - 160000, 0) WHEN panel = 2 THEN source_end END IGNORE NULLS) OVER w AS frozen_2
FROM d WINDOW w AS (PARTITION BY asset ORDER BY shot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@CATALOG.add("choice_panel_plan", _PANELS)
def choice_panel_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Shots as the cuts of a script, panels by their score; the first of a recording opens on all panels, which follow each other by 70 ms (two frames on the grid)."""
    b = F.col("boundary_score")
    c = shots(spark, sf).withColumn("panel", F.when(b.isNull(), 0).when(b > 0.5, 1).otherwise(2)).withColumn("first_id", F.min("shot_id").over(Window.partitionBy("asset")))
    p = H.panel_plan(c, ["asset"], "shot_id", "start_us", "end_us", "panel", 40_000, 3, F.col("shot_id") == F.col("first_id"), 70_000)
    return p.select("asset", "shot_id", "panel", "source_start", "source_end", "span", "at", "frozen_0", "frozen_1", "frozen_2")


_ASSEMBLE = f"""WITH {TURNS}, c AS (SELECT asset, turn_id, greatest(start_us - 80000, 0) AS source_start, end_us + 80000 AS source_end, turn_id % 101 / 100.0::DOUBLE AS q FROM t)
SELECT asset, turn_id, source_start, source_end, coalesce(sum(source_end - source_start) OVER (PARTITION BY asset ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "at", floor((0.7::DOUBLE + 0.25::DOUBLE * q) * 100) / 100 AS confidence FROM c"""


@CATALOG.add("choice_assemble", _ASSEMBLE)
def choice_assemble(spark: SparkSession, sf: str) -> DataFrame:
    a = H.assemble(turns(spark, sf), ["asset"], "turn_id", "start_us", "end_us", 80_000, F.col("turn_id") % 101 / 100.0)
    return a.select("asset", "turn_id", "source_start", "source_end", "at", "confidence")


_BRIEF = f"""WITH {FRAMES}, s AS (SELECT asset, time_us, CASE WHEN n_faces = 1 THEN 'closeUp' WHEN n_faces > 1 THEN 'wide' ELSE 'card' END AS shot FROM f), n AS (SELECT asset, shot, count(*) AS n FROM s GROUP BY ALL),
d AS (SELECT asset, shot AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY n DESC, shot) AS k FROM n) WHERE k = 1), w AS (SELECT s.*, dominant, lag(shot) OVER (PARTITION BY s.asset ORDER BY time_us) AS was FROM s JOIN d USING (asset))
SELECT asset, max(dominant) AS dominant, count(*) FILTER (WHERE was <> shot) AS changes, count(*) FILTER (WHERE shot <> dominant AND (was IS NULL OR was = dominant)) AS cutaways, count(*) AS n FROM w GROUP BY asset"""


@CATALOG.add("choice_recording_brief", _BRIEF)
def choice_recording_brief(spark: SparkSession, sf: str) -> DataFrame:
    s = frames(spark, sf).withColumn("shot", F.when(F.col("n_faces") == 1, "closeUp").when(F.col("n_faces") > 1, "wide").otherwise("card"))
    return H.brief_of(s, "asset", "time_us", "shot")


_LAYOUT = """WITH e AS (SELECT label AS piece, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, len(embedding) AS len FROM embeddings), n AS (SELECT e.*, p.n, len // p.n AS size FROM e, (SELECT unnest([2, 3, 4]) AS n) p),
o AS (SELECT *, 'stacked' AS arrangement, 1 AS across FROM n UNION ALL SELECT *, 'side', n FROM n), ij AS (SELECT o.*, i.i, j.j FROM o JOIN (SELECT unnest(range(4)) AS i) i ON i.i < o.n JOIN (SELECT unnest(range(4)) AS j) j ON j.j < o.n AND j.j > i.i),
d AS (SELECT piece, n AS panels, arrangement, 1 - list_sum(list_transform(range(size), lambda k: CASE WHEN across = 1 THEN abs(v[i * size + k + 1] - v[j * size + k + 1]) ELSE abs(v[k * n + i + 1] - v[k * n + j + 1]) END)) / size AS s FROM ij),
m AS (SELECT piece, panels, arrangement, round(avg(s), 9) AS s FROM d GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY s DESC, panels, arrangement DESC) AS k FROM m)
SELECT piece, panels, arrangement, round(s, 6) AS similarity, s > 0.55 AS is_split FROM k WHERE k = 1"""


@CATALOG.add("choice_panel_layout", _LAYOUT)
def choice_panel_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a label as pictures: the split whose parts are most alike."""
    p = H.panel_similarities(table(spark, sf, "embeddings").withColumnRenamed("label", "piece"), ["piece"], "embedding")
    return H.panel_layout(p, ["piece"]).withColumn("similarity", F.round("similarity", 6))


@CATALOG.add("choice_freeze_resume")
def choice_freeze_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a label as a picture that is held for some samples."""
    e = table(spark, sf, "embeddings").select("label", "vec_id", "embedding", (F.when(F.col("vec_id") % 10 < 6, 0.0).otherwise(1.0)).alias("distance"))
    return H.freeze_and_resume(e, ["label"], "vec_id", "distance", "embedding").withColumn("difference", F.round("difference", 9))


_SPEECH = r"""sp AS (SELECT asset, count(*) AS words, count(*) FILTER (WHERE regexp_replace(lower(x), '^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$', '', 'g') IN ('um', 'uh', 'erm', 'hmm', 'mm', 'eh', 'ah')) AS fillers
  FROM (SELECT asset, unnest(regexp_extract_all(raw_line, '(\S+)', 1)) AS x FROM (SELECT DISTINCT line_id, asset, raw_line FROM raw_transcripts WHERE asset IS NOT NULL)) GROUP BY asset),
sg AS (SELECT asset, count(*) AS segments, max(end_us - start_us) / 1e6::DOUBLE AS longest_segment, max(end_us) AS last_us FROM t GROUP BY asset)"""
_REPORT = f"""WITH {SHOTS}, {TURNS}, {FRAMES}, {_SPEECH}, v AS (SELECT asset, time_us AS start_us, time_us + 4000000 AS end_us FROM f WHERE n_faces > 0), {_MERGED.format(src='v')},
a AS (SELECT asset, max(CASE WHEN duration_num IS NOT NULL AND duration_den IS NOT NULL THEN duration_num::DOUBLE / duration_den END) AS seconds, bool_or(has_video) AS v, coalesce(bool_or(has_audio), false) AS au FROM assets GROUP BY asset),
sh AS (SELECT asset, count(*) AS shots, list_sort(list(end_us - start_us))[count(*) // 2 + 1] / 1e6::DOUBLE AS median_shot, max(end_us - start_us) / 1e6::DOUBLE AS longest_shot FROM s GROUP BY asset),
h AS (SELECT DISTINCT frame_id, coalesce(len(hands), 0) > 0 AS hands FROM frames), l AS (SELECT asset, count(DISTINCT upper(trim(u.text))) AS distinct_lines FROM (SELECT asset, unnest(text) AS u FROM frames WHERE asset IS NOT NULL AND time_num IS NOT NULL AND text IS NOT NULL) WHERE u.text IS NOT NULL GROUP BY asset),
fr AS (SELECT asset, count(*) AS samples, count(*) FILTER (WHERE n_faces > 0) AS with_face, count(*) FILTER (WHERE n_lines > 0) AS with_text, count(*) FILTER (WHERE hands) AS with_hands FROM f JOIN h USING (frame_id) GROUP BY asset),
pr AS (SELECT asset, count(*) AS person_runs FROM m GROUP BY asset),
x AS (SELECT a.*, words, fillers, segments, longest_segment, shots, median_shot, longest_shot, samples, with_face, with_text, with_hands, distinct_lines, person_runs FROM a LEFT JOIN sp USING (asset) LEFT JOIN sg USING (asset) LEFT JOIN sh USING (asset) LEFT JOIN fr USING (asset) LEFT JOIN l USING (asset) LEFT JOIN pr USING (asset))
SELECT asset, u.o::INT AS ord, u.k AS kind, u.l AS layer, u.t AS text FROM (SELECT asset, unnest([
  CASE WHEN v AND seconds IS NOT NULL THEN {{'o': 0, 'k': 'fact', 'l': 'L0', 't': 'picture, ' || floor(seconds)::BIGINT || '.' || floor(seconds * 10)::BIGINT % 10 || ' s'}} END, CASE WHEN NOT au THEN {{'o': 2, 'k': 'problem', 'l': 'L0', 't': 'no sound track'}} END,
  CASE WHEN au AND words IS NOT NULL THEN {{'o': 12, 'k': 'fact', 'l': 'L2', 't': words || ' words, ' || floor(words / greatest(seconds, 0.001) * 60)::BIGINT || ' a minute'}} END, CASE WHEN au AND segments IS NOT NULL THEN {{'o': 13, 'k': 'fact', 'l': 'L2', 't': segments || ' segments'}} END,
  CASE WHEN au AND fillers > 0 THEN {{'o': 14, 'k': 'opportunity', 'l': 'L2', 't': fillers || ' fillers'}} END, CASE WHEN au AND longest_segment > 12 THEN {{'o': 16, 'k': 'opportunity', 'l': 'L2', 't': 'unbroken for ' || floor(longest_segment)::BIGINT || ' s'}} END,
  CASE WHEN shots = 1 THEN {{'o': 17, 'k': 'fact', 'l': 'L2', 't': 'one continuous shot'}} END, CASE WHEN shots > 1 THEN {{'o': 18, 'k': 'fact', 'l': 'L2', 't': shots || ' shots, median ' || floor(median_shot)::BIGINT || '.' || floor(median_shot * 10)::BIGINT % 10 || ' s'}} END,
  CASE WHEN shots > 1 AND median_shot < 1.5 THEN {{'o': 19, 'k': 'fact', 'l': 'L2', 't': 'fast cutting'}} END, CASE WHEN shots > 1 AND median_shot > 8 THEN {{'o': 20, 'k': 'opportunity', 'l': 'L2', 't': 'long takes'}} END,
  CASE WHEN shots > 1 AND longest_shot > greatest(median_shot * 4, 10) THEN {{'o': 21, 'k': 'opportunity', 'l': 'L2', 't': 'one shot runs ' || floor(longest_shot)::BIGINT || ' s'}} END, CASE WHEN samples > 0 THEN {{'o': 22, 'k': 'fact', 'l': 'L2', 't': 'a person in ' || (100 * with_face // samples) || ' %'}} END,
  CASE WHEN samples > 0 AND with_hands > 0 THEN {{'o': 23, 'k': 'fact', 'l': 'L2', 't': 'hands in ' || (100 * with_hands // samples) || ' %'}} END, CASE WHEN samples > 0 AND with_text > 0 THEN {{'o': 24, 'k': 'fact', 'l': 'L2', 't': 'text in ' || (100 * with_text // samples) || ' %, ' || distinct_lines || ' lines'}} END,
  CASE WHEN samples > 0 AND person_runs > 1 THEN {{'o': 25, 'k': 'fact', 'l': 'L2', 't': 'a person in ' || person_runs || ' runs'}} END, CASE WHEN samples > 0 AND with_face = 0 AND with_text = 0 THEN {{'o': 26, 'k': 'problem', 'l': 'L2', 't': 'neither face nor text'}} END]) AS u FROM x) WHERE u IS NOT NULL"""


def _speech(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Words and fillers of each recording's typed lines; number and longest of its turns."""
    l = table(spark, sf, "raw_transcripts").where("asset IS NOT NULL").select("line_id", "asset", "raw_line").distinct()
    w = l.select("asset", F.explode(F.regexp_extract_all("raw_line", F.lit(r"(\S+)"), F.lit(1))).alias("word"))
    said = w.groupBy("asset").agg(F.count(F.lit(1)).alias("words"), F.count_if(N.is_filler(F.col("word"))).alias("fillers"))
    t = turns(spark, sf).groupBy("asset").agg(F.count(F.lit(1)).alias("segments"), (F.max(F.col("end_us") - F.col("start_us")) / 1e6).alias("longest_segment"), F.max("end_us").alias("last_us"))
    return said, t


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "assets").groupBy("asset").agg(F.max(F.col("duration_num").cast("double") / F.col("duration_den")).alias("seconds"), F.bool_or("has_video").alias("has_video"), F.bool_or("has_audio").alias("has_audio"))
    lengths = shots(spark, sf).withColumn("length", F.col("end_us") - F.col("start_us"))
    longest = lengths.groupBy("asset").agg((F.max("length") / 1e6).alias("longest_shot"))
    median = S.ranked_value(lengths, ["asset"], "length", S.upper_median, "shots").select("asset", "shots", (F.col("length") / 1e6).alias("median_shot"))
    hands = table(spark, sf, "frames").select(F.col("frame_id").alias("h_frame"), (F.coalesce(F.size("hands"), F.lit(0)) > 0).alias("hands")).distinct()
    f = frames(spark, sf)
    seen = f.join(hands, F.col("frame_id") == F.col("h_frame")).groupBy("asset").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("n_faces") > 0).alias("with_face"), F.count_if(F.col("n_lines") > 0).alias("with_text"), F.count_if("hands").alias("with_hands"))
    lines = _lines(spark, sf).groupBy("asset").agg(F.count_distinct("line").alias("distinct_lines"))
    person = I.sample_ranges(f, ["asset"], "time_us", F.col("n_faces") > 0, 4_000_000).groupBy("asset").agg(F.count(F.lit(1)).alias("person_runs"))
    said, spoken = _speech(spark, sf)
    for more in (said, spoken.drop("last_us"), median, longest, seen, lines, person):
        a = a.join(more, "asset", "left")
    unknown = ("width", "height", "integrated", "loudness_range", "true_peak", "speech_level", "noise_floor", "silences", "silent_seconds", "longest_silence", "unsure_words", "filler_seconds")
    return a.select("*", *[F.lit(None).cast("double").alias(c) for c in unknown], F.lit(False).alias("sound_measured"))


@CATALOG.add("choice_editors_report", _REPORT)
def choice_editors_report(spark: SparkSession, sf: str) -> DataFrame:
    """What the tables tell of each recording; sound and picture size aren't in them."""
    return P.editors_report(_facts(spark, sf), "asset")


_FORMAT = f"""WITH {TURNS}, {_SPEECH}, n AS (SELECT asset, count(DISTINCT speaker) AS panels FROM t GROUP BY asset), c AS (SELECT asset, count(*) FILTER (WHERE similarity IS NOT NULL) AS retaken, count(*) FILTER (WHERE similarity IS NULL) AS again FROM (SELECT DISTINCT correction_id, asset, similarity FROM corrections WHERE asset IS NOT NULL) GROUP BY asset),
w AS (SELECT sp.asset, words, words / greatest(last_us / 6e7::DOUBLE, 0.01) AS wpm FROM sp JOIN sg USING (asset)), z AS (SELECT * FROM w ORDER BY words DESC, asset LIMIT 1),
p AS (SELECT w.asset, w.wpm, z.wpm AS ref_wpm, coalesce(retaken, 0) AS retaken, coalesce(again, 0) AS again, (SELECT panels FROM n WHERE n.asset = z.asset) AS panels FROM w LEFT JOIN c USING (asset), z)
SELECT asset, u.o::INT AS ord, u.k AS kind, u.l AS layer, u.t AS text FROM (SELECT asset, unnest([
  CASE WHEN panels > 1 THEN {{'o': 0, 'k': 'step', 'l': 'layout', 't': 'split into ' || panels || ' panels'}} END, CASE WHEN NOT panels > 1 THEN {{'o': 1, 'k': 'step', 'l': 'layout', 't': 'single frame'}} END, CASE WHEN panels > 1 THEN {{'o': 4, 'k': 'step', 'l': 'content', 't': 'label the panels by section'}} END,
  CASE WHEN again > 0 THEN {{'o': 5, 'k': 'question', 'l': 'takes', 't': again || ' lines are said again: on purpose?'}} END, CASE WHEN retaken > 0 THEN {{'o': 6, 'k': 'step', 'l': 'takes', 't': 'use the best of ' || retaken || ' retaken lines'}} END,
  CASE WHEN wpm < ref_wpm * 0.85 THEN {{'o': 7, 'k': 'step', 'l': 'pace', 't': 'tighten pauses: ' || floor(wpm)::BIGINT || ' to ' || floor(ref_wpm)::BIGINT || ' words a minute'}} END, CASE WHEN wpm >= ref_wpm * 0.85 THEN {{'o': 8, 'k': 'step', 'l': 'pace', 't': 'keep the pace'}} END,
  {{'o': 10, 'k': 'step', 'l': 'captions', 't': 'burn in captions'}}, {{'o': 11, 'k': 'unknown', 'l': 'look', 't': 'fonts and colours'}}, {{'o': 12, 'k': 'unknown', 'l': 'layout', 't': 'delay between panels'}}, {{'o': 13, 'k': 'unknown', 'l': 'look', 't': 'graphics that aren''t text'}},
  CASE WHEN panels > 1 THEN {{'o': 14, 'k': 'question', 'l': 'layout', 't': 'how long should the echo be?'}} END]) AS u FROM p) WHERE u IS NOT NULL"""


@CATALOG.add("choice_format_plan", _FORMAT)
def choice_format_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Every recording in the format of the one with the most words, a panel for each of whose speakers."""
    said, spoken = _speech(spark, sf)
    w = said.join(spoken, "asset").select("asset", "words", (F.col("words") / F.greatest(F.col("last_us") / 6e7, F.lit(0.01))).alias("wpm"))
    n = turns(spark, sf).groupBy("asset").agg(F.count_distinct("speaker").alias("panels"))
    # one row: the format to follow
    ref = w.join(n, "asset").orderBy(F.col("words").desc(), "asset").first()
    c = table(spark, sf, "corrections").where("asset IS NOT NULL").select("correction_id", "asset", "similarity").distinct()
    c = c.groupBy("asset").agg(F.count("similarity").alias("retaken"), F.count_if(F.col("similarity").isNull()).alias("repeated"))
    p = w.join(c, "asset", "left").select("asset", "wpm", F.coalesce("retaken", F.lit(0)).alias("retaken"), F.coalesce("repeated", F.lit(0)).alias("repeated"))
    given = {"ref_wpm": (ref and ref["wpm"], "double"), "panels": (ref and ref["panels"], "int"), "opening_seconds": (None, "double"), "weakest_break": (None, "double"), "ref_loudness": (None, "double"), "echo_known": (False, "boolean")}
    return P.format_plan(p.select("*", *[F.lit(v).cast(t).alias(k) for k, (v, t) in given.items()]), "asset")
