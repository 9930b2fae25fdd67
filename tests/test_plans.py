"""Shapes of the physical plans: no nested loops, no cross products, no row-at-a-time Python, filters at the scan."""

import pytest

from tapewright.plans import all_catalogs

ENTRIES = {n: e for c in all_catalogs() for n, e in c.entries.items()}
# plans that are built without running anything
LAZY = [n for n in ENTRIES if n.startswith(("interval_", "time_", "text_", "stat_", "signal_", "rule_", "p5_"))]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops(spark, data, name):
    text = plan(ENTRIES[name].run(spark, data))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "BatchEvalPython"):
        assert bad not in text


def test_scans_are_narrow(spark, data):
    text = plan(ENTRIES["p5_found"].run(spark, data))
    assert "ingested_at" not in text and "PushedFilters" in text
    text = plan(ENTRIES["interval_speaker_changes"].run(spark, data))
    assert "IsNotNull(asset)" in text and "ReadSchema: struct<turn_id" in text


def test_bitmaps_are_shuffled_once(spark, data):
    df = ENTRIES["p5_found"].run(spark, data)
    df.collect()
    assert "ReusedExchange" in plan(df)
