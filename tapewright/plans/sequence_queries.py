"""Queries of the sequence kernels. Where SQL can't express one on whole tables, tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions import normalise as N
from tapewright.operators import sequences as Q
from tapewright.operators import wording as W
from tapewright.plans.catalog import Catalog
from tapewright.sources.standins import WORDS, turns, words
from tapewright.sources.tables import table

CATALOG = Catalog()


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "asr_real_transcripts").dropDuplicates(["utterance_id"])
    tokens = lambda c: F.split(N.key(F.col(c)), " ")
    return r.select("utterance_id", *[F.when(F.trim(c) != "", tokens(c)).alias(c) for c in ("apple", "whisper_turbo", "distil_whisper", "parakeet")])


def _reading_words(spark: SparkSession, sf: str, engine: str, shift: int) -> DataFrame:
    r = table(spark, sf, "asr_real_transcripts").dropDuplicates(["utterance_id"]).where(f"{engine} IS NOT NULL AND trim({engine}) <> ''")
    w = r.select("utterance_id", F.posexplode(F.split(F.trim(engine), r"\s+")).alias("idx", "word"))
    return w.withColumn("start_ms", (F.col("idx") * 300 + shift).cast("bigint")).withColumn("end_ms", F.col("start_ms") + 250)


# a row of the table per word of one side: prefix maxima (minima) take the place of the cell to the left
_TOKENS = r"""rd AS (SELECT DISTINCT utterance_id, apple, whisper_turbo, distil_whisper, parakeet FROM asr_real_transcripts),
tk AS (SELECT utterance_id, k.e AS engine, CASE WHEN trim(k.t) <> '' THEN string_split(trim(regexp_replace(regexp_replace(lower(k.t), '[^\p{L}\p{N} ]', '', 'g'), ' +', ' ', 'g')), ' ') END AS x
  FROM (SELECT utterance_id, unnest([{'e': 'apple', 't': apple}, {'e': 'whisper_turbo', 't': whisper_turbo}, {'e': 'distil_whisper', 't': distil_whisper}, {'e': 'parakeet', 't': parakeet}]) AS k FROM rd))"""
_LCS = rf"""WITH RECURSIVE {_TOKENS}, pr AS (SELECT a.utterance_id, a.x AS a, b.x AS b FROM tk a JOIN tk b ON a.utterance_id = b.utterance_id AND a.engine = 'apple' AND b.engine = 'parakeet'),
st AS (SELECT utterance_id, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda z: 0) AS row FROM pr WHERE a IS NOT NULL AND b IS NOT NULL
  UNION ALL SELECT utterance_id, a, b, i + 1, [0] || list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN a[i + 1] = b[k] THEN greatest(row[k] + 1, row[k + 1]) ELSE row[k + 1] END))) FROM st WHERE i < len(a))
SELECT pr.utterance_id, round(CASE WHEN pr.a IS NOT NULL AND pr.b IS NOT NULL THEN st.row[len(st.b) + 1] / greatest(len(st.a), len(st.b))::DOUBLE END, 6) AS similarity FROM pr LEFT JOIN st ON pr.utterance_id = st.utterance_id AND st.i = len(st.a)"""


@CATALOG.add("sequence_similarity", _LCS)
def sequence_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _readings(spark, sf).select("utterance_id", F.round(Q.similarity_of("apple", "parakeet"), 6).alias("similarity"))


_WER = rf"""WITH RECURSIVE {_TOKENS}, pr AS (SELECT a.utterance_id, b.engine, a.x AS a, b.x AS b FROM tk a JOIN tk b ON a.utterance_id = b.utterance_id AND a.engine = 'parakeet' AND b.engine <> 'parakeet' WHERE a.x IS NOT NULL),
st AS (SELECT utterance_id, engine, a, b, 0 AS i, range(len(b) + 1) AS row FROM pr WHERE b IS NOT NULL
  UNION ALL SELECT utterance_id, engine, a, b, i + 1, list_transform(range(len(b) + 1), lambda j: list_min(list_transform(range(j + 1), lambda k: (CASE WHEN k = 0 THEN i + 1 WHEN a[i + 1] = b[k] THEN row[k] ELSE least(row[k], row[k + 1]) + 1 END) + j - k))) FROM st WHERE i < len(a)),
er AS (SELECT pr.engine, len(pr.a) AS n, CASE WHEN pr.b IS NULL THEN len(pr.a) ELSE st.row[len(st.b) + 1] END AS e FROM pr LEFT JOIN st ON pr.utterance_id = st.utterance_id AND pr.engine = st.engine AND st.i = len(st.a))
SELECT engine, sum(e)::BIGINT AS errors, sum(n)::BIGINT AS n_words, round(sum(e) / sum(n)::DOUBLE, 6) AS wer FROM er GROUP BY engine"""


@CATALOG.add("sequence_word_error_rate", _WER)
def sequence_word_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Each engine against parakeet as the reference."""
    r = _readings(spark, sf).where("parakeet IS NOT NULL")
    long = r.select("parakeet", F.explode(F.create_map(*[x for c in ("apple", "whisper_turbo", "distil_whisper") for x in (F.lit(c), F.col(c))])).alias("engine", "heard"))
    return Q.word_error_rate(long, ["engine"], "parakeet", "heard").withColumn("wer", F.round("wer", 6))


@CATALOG.add("sequence_vote")
def sequence_vote(spark: SparkSession, sf: str) -> DataFrame:
    return Q.vote(_reading_words(spark, sf, "apple", 0), _reading_words(spark, sf, "parakeet", 90), "utterance_id")


@CATALOG.add("sequence_self_corrections")
def sequence_self_corrections(spark: SparkSession, sf: str) -> DataFrame:
    return Q.find_self_corrections(words(spark, sf), "doc_id").withColumn("similarity", F.round("similarity", 6))


@CATALOG.add("sequence_repeated_lines")
def sequence_repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    return Q.repeated_lines(W.segments(words(spark, sf), "doc_id"), "doc_id", "first_idx", "text", "start_ms")


_CAPTIONS = rf"""WITH {WORDS}, f AS (SELECT *, CASE WHEN coalesce(regexp_matches(lag(word) OVER o, '[.?!]$') OR start_ms - lag(end_ms) OVER o >= 350, true) THEN idx END AS head FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY idx)),
p AS (SELECT *, idx - max(head) OVER (PARTITION BY doc_id ORDER BY idx) AS pos FROM f), c AS (SELECT *, sum((pos % 4 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS caption FROM p)
SELECT doc_id, caption::INT AS caption, string_agg(word, ' ' ORDER BY idx) AS text, min(start_ms) AS start_ms, arg_max(end_ms, idx) AS end_ms FROM c GROUP BY doc_id, caption"""


@CATALOG.add("sequence_captions", _CAPTIONS)
def sequence_captions(spark: SparkSession, sf: str) -> DataFrame:
    return Q.caption(words(spark, sf), "doc_id")


@CATALOG.add("sequence_diarization_error")
def sequence_diarization_error(spark: SparkSession, sf: str) -> DataFrame:
    """Turns against the same turns with some speakers swapped and edges moved."""
    t = turns(spark, sf)
    ref = t.select("asset", "speaker", F.col("start_us").alias("start"), F.col("end_us").alias("end"))
    hyp = t.select("asset", F.when(F.col("turn_id") % 9 == 0, 7).otherwise(10 - F.col("speaker")).alias("speaker"), (F.col("start_us") + 50_000).alias("start"), F.col("end_us").alias("end"))
    return Q.diarization_errors(ref, hyp, "asset").withColumn("der", F.round("der", 6))
