"""Queries of the problems tagged llm, each with its SQL twin where SQL can express it on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.consensus import consensus
from tapewright.llm.mixing import mix, plain_source
from tapewright.llm.nearest import nearest_in_time
from tapewright.llm.packing import pack
from tapewright.llm.runs import collapse_runs
from tapewright.llm.sentences import sentences
from tapewright.llm.tokens import token_counts
from tapewright.llm.turns import speaker_turns
from tapewright.plans.catalog import Catalog
from tapewright.session import cut_lineage
from tapewright.sources.tables import table

CATALOG = Catalog()

#: Column of the readings -> name of the engine.
ENGINES = {"apple": "apple", "whisper_turbo": "whisper_turbo", "distil_whisper": "distil_whisper", "parakeet": "parakeet"}


@CATALOG.add("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    items, _ = consensus(table(spark, sf, "asr_real_transcripts"), ENGINES)
    return items.select("utterance_id", F.posexplode("differs").alias("n", "differs")).where("differs").select("utterance_id", F.element_at(F.array(*[F.lit(e) for e in ENGINES.values()]), F.col("n") + 1).alias("engine"))


@CATALOG.add("p1_consensus")
def p1_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """The wording to be believed and the agreement of the engines, per utterance."""
    return consensus(table(spark, sf, "asr_real_transcripts"), ENGINES)[0].drop("differs")


@CATALOG.add("p1_engines")
def p1_engines(spark: SparkSession, sf: str) -> DataFrame:
    """The reliability of each engine."""
    return consensus(table(spark, sf, "asr_real_transcripts"), ENGINES)[1]


def _starts(spark: SparkSession, sf: str) -> DataFrame:
    """Turns and shots with whole, forward ranges; empty ranges stay."""
    out = None
    for kind, name, key in (("turn", "turns", "turn_id"), ("shot", "shots", "shot_id")):
        t = table(spark, sf, name)
        sn, sd, en, ed = (F.col(c).cast("decimal(19,0)") for c in ("start_num", "start_den", "end_num", "end_den"))
        forward = F.when(F.col("start_den") * F.signum("end_den") > 0, sn * ed <= en * sd).otherwise(sn * ed >= en * sd)
        t = t.where((F.col("start_den") != 0) & (F.col("end_den") != 0) & F.col("end_num").isNotNull() & forward)
        t = t.select(F.lit(kind).alias("kind"), F.col(key).alias("record_id"), "asset", "start_num", "start_den")
        out = t if out is None else out.unionByName(t)
    return out


_NEAREST_SQL = """
WITH l AS (
  SELECT DISTINCT 'turn' AS kind, turn_id AS record_id, asset, start_num, start_den, end_num, end_den FROM turns
  UNION SELECT DISTINCT 'shot', shot_id, asset, start_num, start_den, end_num, end_den FROM shots
), lv AS (
  SELECT *, start_num::HUGEINT * 705600000 // start_den AS t FROM l
  WHERE asset IS NOT NULL AND start_num::HUGEINT * end_den <= end_num::HUGEINT * start_den
), f AS (
  SELECT DISTINCT frame_id, asset, time_num, time_den, time_num::HUGEINT * 705600000 // time_den AS t
  FROM frames WHERE asset IS NOT NULL AND time_num IS NOT NULL AND time_den IS NOT NULL
), j AS (
  SELECT lv.kind, lv.record_id, f.frame_id, f.time_num, f.time_den,
    abs(f.time_num::HUGEINT * lv.start_den - lv.start_num::HUGEINT * f.time_den) AS gap, lv.start_den
  FROM lv JOIN (SELECT *, unnest([(t // 705600000 - 1), (t // 705600000), (t // 705600000 + 1)]) AS b FROM f) f
    ON lv.asset = f.asset AND lv.t // 705600000 = f.b
), k AS (
  SELECT *, row_number() OVER (
    PARTITION BY kind, record_id
    ORDER BY gap // time_den, gap % time_den * 1000000000000000000 // time_den, time_num::HUGEINT * 1000000000 // time_den, frame_id) AS rn
  FROM j WHERE gap * 5 <= 2 * time_den::HUGEINT * start_den
)
SELECT kind, record_id, frame_id FROM k WHERE rn = 1
"""


@CATALOG.add("p2_found", _NEAREST_SQL)
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_in_time(_starts(spark, sf), table(spark, sf, "frames"), ["kind", "record_id"], "frame_id")


@CATALOG.add("p3_found")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return collapse_runs(table(spark, sf, "frames")).where("n_frames >= 2").select("asset", "first_frame_id", "last_frame_id")


@CATALOG.add("p3_runs")
def p3_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch, single frames included, with its count and duration."""
    return collapse_runs(table(spark, sf, "frames"))


@CATALOG.add("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return speaker_turns(table(spark, sf, "raw_transcripts"), table(spark, sf, "corrections"), text=False).select("transcript_id", "first_line_id", "last_line_id")


@CATALOG.add("p4_turns")
def p4_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The turns with their speaker, start and clean text."""
    return speaker_turns(table(spark, sf, "raw_transcripts"), table(spark, sf, "corrections"))


@CATALOG.add("p6_pack")
def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Which texts, or pieces of texts larger than the capacity, are together in which container."""
    return pack(token_counts(table(spark, sf, "documents"), ["doc_id"]), table(spark, sf, "containers"))


@CATALOG.add("p6_fill")
def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind of container: how many were filled, with how many texts, and the share of their capacity in use."""
    packed = p6_pack(spark, sf)
    packs = packed.groupBy("container", "pack_no").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.max("capacity").alias("capacity"))
    return packs.groupBy("container").agg(
        F.max("capacity").alias("capacity"), F.count(F.lit(1)).alias("n_packs"), F.sum("pieces").alias("n_pieces"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.sum("capacity")).alias("fill_share")
    )


_WHOLE_PACKS = """WITH d AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 0)
SELECT container, d.n AS n_texts, 0::BIGINT AS overfull, 0::BIGINT AS needlessly_divided, 0::BIGINT AS not_whole FROM containers, d"""


@CATALOG.add("p6_whole", _WHOLE_PACKS)
def p6_whole(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any packing: every text with tokens is in each kind of container, no pack is overfull, no text is divided that would fit, and the pieces of
    a text follow each other without gaps or overlaps."""
    packed = cut_lineage(p6_pack(spark, sf))
    packs = packed.groupBy("container", "pack_no").agg(F.sum("tokens").alias("t"), F.max("fill_tokens").alias("f"), F.max("capacity").alias("c"))
    over = packs.groupBy("container").agg(F.count_if((F.col("t") > F.col("c")) | (F.col("t") != F.col("f"))).alias("overfull"))
    texts = packed.groupBy("container", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.max(F.col("token_start") + F.col("tokens")).alias("end"), F.max("piece_no").alias("last"), F.max("capacity").alias("c"))
    whole = texts.groupBy("container").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("c"))).alias("needlessly_divided"), F.count_if((F.col("t") != F.col("end")) | (F.col("n") != F.col("last") + 1)).alias("not_whole"))
    return whole.join(over, "container")


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mix(token_counts(table(spark, sf, "documents"), ["doc_id", "source"]), table(spark, sf, "mix_targets"))


@CATALOG.add("p7_draw")
def p7_draw(spark: SparkSession, sf: str) -> DataFrame:
    """The drawn texts with the number of their copies."""
    return _mixed(spark, sf)[0]


_WHOLE_DRAW = r"""WITH d AS (SELECT regexp_replace(trim(lower(source)), '[\s_\-]+', '_', 'g') AS source, count(*) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 0 AND source IS NOT NULL GROUP BY 1)
SELECT m.source, coalesce(n, 0) AS n_available, 0::BIGINT AS over_cap, 0::BIGINT AS drawn_twice FROM mix_targets m LEFT JOIN d ON m.source = d.source"""


@CATALOG.add("p7_whole", _WHOLE_DRAW)
def p7_whole(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any draw: only listed sources and texts that are there, each in one row, none more often than its source allows."""
    sized = token_counts(table(spark, sf, "documents"), ["doc_id", "source"])
    draw, shares = mix(sized, table(spark, sf, "mix_targets"))
    draw = draw.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copies").alias("copies"))
    have = sized.where("tokens > 0 AND source IS NOT NULL").groupBy(plain_source(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("n_available"))
    j = shares.select("source", "max_repeats").join(draw, "source", "full")
    seen = j.groupBy("source").agg(F.count_if(F.col("max_repeats").isNull() | (F.col("copies") > F.col("max_repeats"))).alias("over_cap"), F.count_if(F.col("n") > 1).alias("drawn_twice"))
    return seen.join(have, "source", "left").select("source", F.coalesce("n_available", F.lit(0)).alias("n_available"), "over_cap", "drawn_twice")


@CATALOG.add("p7_shares")
def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares aimed at and reached."""
    return _mixed(spark, sf)[1]


@CATALOG.add("p8_found")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(table(spark, sf, "documents")).select("doc_id", "start_char", "end_char")


@CATALOG.add("p8_sentences")
def p8_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences with their number in the text."""
    return sentences(table(spark, sf, "documents"))
