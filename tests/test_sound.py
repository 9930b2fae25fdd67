"""Filters, pitch, joins and echoes on signals known by construction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.functions import rational as R
from tapewright.operators import selection as H
from tapewright.operators import signals as G

RATE = 8000


def _tone(hertz, seconds, amplitude=0.5, rate=RATE):
    return amplitude * np.sin(2 * np.pi * hertz * np.arange(int(seconds * rate)) / rate)


def test_pitch():
    assert H.pitch(_tone(220, 0.12), RATE) == pytest.approx(220, rel=0.02)
    assert H.pitch(np.zeros(960), RATE) is None and H.pitch(np.zeros(0), RATE) is None
    assert H.pitch(np.random.default_rng(1).normal(size=960), RATE) is None


def test_join_cost_has_caps():
    assert H.join_cost(0, 0, 0, True) == 0 and H.join_cost(100, -100, 99, False) == 1.5 + 1.5 + 3 + 1 and H.join_cost(0, 0, None, True) == 0
    same = H.measure_join(_tone(200, 0.12), _tone(200, 0.12), RATE)
    louder = H.measure_join(_tone(200, 0.12), _tone(300, 0.12, 1.0), RATE)
    assert louder["cost"] > same["cost"] and louder["level_step"] == pytest.approx(6.02, abs=0.1) and louder["pitch_step"] == pytest.approx(7.02, abs=0.6)


def test_echo():
    rng = np.random.default_rng(2)
    burst = np.zeros(RATE * 6)
    for at in rng.choice(RATE * 5, 25, replace=False):
        burst[at : at + 160] += rng.normal(size=len(burst[at : at + 160]))
    delayed = np.concatenate([np.zeros(int(0.3 * RATE)), burst])[: len(burst)]
    assert H.echo_lag(burst + 0.9 * delayed, RATE) == pytest.approx(0.3, abs=0.011)
    assert H.echo_lag(np.zeros(RATE), RATE) is None and H.echo_lag(np.zeros(3), RATE) is None


def test_k_weighting_at_48k():
    (b0, b1, b2, a1, a2), (_, _, _, c1, c2) = G.k_weighting(48_000)
    assert (b0, b1, b2) == pytest.approx((1.53512485958697, -2.69169618940638, 1.19839281085285), abs=1e-6)
    assert (a1, a2, c1, c2) == pytest.approx((-1.69065929318241, 0.73248077421585, -1.99004745483398, 0.99007225036621), abs=1e-6)


def test_loudness_doubles_by_six(spark):
    def level(amplitude):
        x = _tone(997, 2, amplitude)
        s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, n bigint, v double")
        w = G.weighted(s, ["k"], "n", "v", RATE)
        h = w.groupBy("k", F.expr("n div 800").alias("hop")).agg(F.sum(F.col("v") * F.col("v")).alias("e"), F.count("*").cast("double").alias("m"))
        return G.integrated_loudness(G.block_power(h, ["k"], "hop", "e", "m"), ["k"]).collect()[0].integrated

    assert level(0.5) - level(0.25) == pytest.approx(6.02, abs=0.05)


def test_silence_is_null(spark):
    b = spark.createDataFrame([("a", i, 0.0) for i in range(5)], "k string, n int, power double")
    assert G.integrated_loudness(b, ["k"]).collect()[0].integrated is None


def test_fractions(spark):
    df = spark.createDataFrame([(7007, 24000, 1, 3), (6, -4, 2, 8), (0, 5, 1, 1), (1, 0, 1, 1), (None, 1, 1, 1), (2**62, 2**61, -3, 9)], "a bigint, b bigint, c bigint, d bigint")
    x, y = R.rational("a", "b"), R.rational("c", "d")
    got = df.select(x.alias("x"), R.add(x, y).alias("s"), R.multiply(x, y).alias("p"), R.divide(x, y).alias("q"), R.less(x, y).alias("l"), R.canonical_json(x).alias("j")).collect()
    assert tuple(got[0].x) == (7007, 24000) and got[0].j == '{"seconds":{"den":24000,"num":7007}}' and got[0].l
    assert tuple(got[1].x) == (-3, 2) and tuple(got[1].s) == (-5, 4) and tuple(got[1].p) == (-3, 8) and tuple(got[1].q) == (-6, 1)
    assert tuple(got[2].x) == (0, 1) and got[3].x is None and got[4].x is None
    assert tuple(got[5].x) == (2, 1) and tuple(got[5].q) == (-6, 1)
