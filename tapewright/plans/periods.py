"""Problem 5: continuous periods and gaps of turns, shots and cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators.run_bitmap import periods_and_gaps
from tapewright.plans.catalog import Catalog
from tapewright.sources.tables import table

CATALOG = Catalog()

_EDGES = ["start_num", "start_den", "end_num", "end_den"]


def all_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """kind, asset and the exact edges of the ranges of turns, shots and cut plans."""
    turns = table(spark, sf, "turns").select(F.lit("turn").alias("kind"), "asset", *_EDGES)
    shots = table(spark, sf, "shots").select(F.lit("shot").alias("kind"), "asset", *_EDGES)
    cuts = table(spark, sf, "cut_plans").select(F.lit("cut").alias("kind"), "asset", F.inline("ranges")).select("kind", "asset", *_EDGES)
    return turns.unionByName(shots).unionByName(cuts)


_TURNS_SQL = """
WITH r AS (
  SELECT 'turn' AS kind, asset, start_num, start_den, end_num, end_den FROM turns
  UNION ALL SELECT 'shot', asset, start_num, start_den, end_num, end_den FROM shots
  UNION ALL SELECT 'cut', asset, x.start_num, x.start_den, x.end_num, x.end_den FROM (SELECT asset, unnest(ranges) AS x FROM cut_plans)
), k AS (
  SELECT kind, asset,
    start_num::HUGEINT // start_den * 10000000000000000 + (start_num::HUGEINT % start_den) * 10000000000000000 // start_den AS s,
    end_num::HUGEINT // end_den * 10000000000000000 + (end_num::HUGEINT % end_den) * 10000000000000000 // end_den AS e
  FROM r WHERE asset IS NOT NULL AND start_num IS NOT NULL AND start_den IS NOT NULL AND end_num IS NOT NULL AND end_den IS NOT NULL
), m AS (
  SELECT *, max(e) OVER (PARTITION BY kind, asset ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k WHERE e > s
), g AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY kind, asset ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM m
), p AS (
  SELECT kind, asset, n, min(s) AS s, max(e) AS e FROM g GROUP BY ALL
), q AS (
  SELECT *, lead(s) OVER (PARTITION BY kind, asset ORDER BY s) AS nxt FROM p
)
SELECT kind, asset, 'period' AS what, (s // 10000000000)::BIGINT AS start_us, (e // 10000000000)::BIGINT AS end_us FROM q
UNION ALL
SELECT kind, asset, 'gap', (e // 10000000000)::BIGINT, (nxt // 10000000000)::BIGINT FROM q WHERE nxt - e <= 600 * 10000000000000000
"""


@CATALOG.add("p5_found", _TURNS_SQL)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return periods_and_gaps(all_ranges(spark, sf), ["kind", "asset"], max_gap_seconds=600)
