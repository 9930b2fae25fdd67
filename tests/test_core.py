"""Exact time, prefix operations, run bitmaps and intervals against brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewright.functions import exact_time as X
from tapewright.functions import grid as G
from tapewright.operators import blocked as B
from tapewright.operators import intervals as I
from tapewright.operators import run_bitmap as R


def test_exact_time(spark):
    rng = random.Random(1)
    rows = [(rng.randint(-(10**12), 10**12), rng.choice([1, -7, 1001, 30000, 15360, 705600000, 10**8 - 1, 2 * 10**10, 999999937])) for _ in range(300)] + [(None, 1), (1, None), (5, 0), (0, 3)]
    df = spark.createDataFrame(rows, "n bigint, d bigint")
    got = df.select("n", "d", X.tick("n", "d").alias("t"), X.sub_tick("n", "d").alias("s"), X.whole_seconds("n", "d").alias("w"), X.fine_rest("n", "d").alias("f"), X.is_exact_tick("n", "d").alias("e")).collect()
    for r in got:
        if r.n is None or not r.d:
            assert r.t is None and r.s is None and r.w is None
            continue
        x = Fraction(r.n, r.d)
        ticks = x * X.TICKS
        assert r.t == (ticks.__floor__() if abs(ticks) < 2**63 - X.TICKS else None)
        assert r.s == ((ticks - ticks.__floor__()) * X.SUBS).__floor__()
        assert r.w == x.__floor__()
        assert r.f == ((x - x.__floor__()) * X.FINE).__floor__()
        assert r.e == (ticks.denominator == 1)


def test_distance_orders_exactly(spark):
    rows = [(n, d, m, e) for n, d in [(1, 3), (333333333, 10**9), (1, 2), (10**8 + 1, 3 * 10**8)] for m, e in [(2, 5), (1, 7), (1, 3)]]
    df = spark.createDataFrame(rows, "n bigint, d bigint, m bigint, e bigint")
    got = df.withColumn("k", X.distance_key(F.col("n"), F.col("d"), F.col("m"), F.col("e"))).withColumn("w", X.within(F.col("n"), F.col("d"), F.col("m"), F.col("e"), 1, 10)).collect()
    for target in {(r.m, r.e) for r in got}:
        own = [r for r in got if (r.m, r.e) == target]
        by_key = sorted(own, key=lambda r: tuple(r.k))
        exact = sorted(own, key=lambda r: abs(Fraction(r.n, r.d) - Fraction(*target)))
        assert [abs(Fraction(r.n, r.d) - Fraction(*target)) for r in by_key] == [abs(Fraction(r.n, r.d) - Fraction(*target)) for r in exact]
        for r in own:
            assert r.w == (abs(Fraction(r.n, r.d) - Fraction(*target)) <= Fraction(1, 10))


def test_timecode(spark):
    df = spark.createDataFrame([(1800, "00:01:00;02"), (17982, "00:10:00;00"), (107892, "01:00:00;00")], "f bigint, tc string")
    for r in df.select("tc", G.timecode(F.col("f"), 30, True).alias("got"), G.frame_of_timecode(F.col("tc"), 30, True).alias("back"), "f").collect():
        assert r.got == r.tc and r.back == r.f
    bad = spark.createDataFrame([("00:01:00;00",), ("00:61:00;00",), ("junk",), (None,)], "tc string")
    assert [r[0] for r in bad.select(G.frame_of_timecode(F.col("tc"), 30, True)).collect()] == [None] * 4


def test_rounding_is_away_from_zero(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (1, 3), (-1, 3)], "n bigint, d bigint")
    n, d = F.col("n"), F.col("d")
    got = [tuple(r) for r in df.select(G.floor_seconds(n, d), G.ceil_seconds(n, d), G.rounded_seconds(n, d)).collect()]
    assert got == [(3, 4, 4), (-4, -3, -4), (0, 1, 0), (-1, 0, 0)]


def test_blocked_prefixes(spark):
    rng = random.Random(3)
    rows = [(e, i // 7, i, rng.randint(0, 3), rng.choice([None, "a", "b"])) for e in ("x", "y", None) for i in range(60) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "e string, b bigint, i int, v int, s string")
    summed = {(r.e, r.i): r.o for r in B.running_sum(df, ["e"], "b", ["i"], "v", "o").collect()}
    carried = {(r.e, r.i): r.o for r in B.carry_forward(df, ["e"], "b", ["i"], "s", "o").collect()}
    before = {(r.e, r.i): r.o for r in B.previous(df, ["e"], "b", ["i"], "s", "o").collect()}
    behind = {(r.e, r.i): r.o for r in B.following(df, ["e"], "b", ["i"], "s", "o").collect()}
    tops = {(r.e, r.i): r.o for r in B.running_max(df, ["e"], "b", ["i"], "v", "o").collect()}
    for e in ("x", "y", None):
        total, last, prev, top = 0, None, "first", None
        own = sorted((r for r in rows if r[0] == e), key=lambda r: r[2])
        for (_, _, i, v, s), after in zip(own, [*own[1:], None]):
            assert tops[e, i] == top and (behind[e, i] is None if after is None else behind[e, i].value == after[4])
            total, last, top = total + v, s or last, v if top is None else max(v, top)
            assert summed[e, i] == total and carried[e, i] == last
            assert (before[e, i] is None) if prev == "first" else before[e, i].value == prev
            prev = s


RUNS = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 40), st.integers(0, 8)), max_size=40)


def _brute_union(rows):
    out = {}
    for g, s, n in rows:
        out.setdefault(g, set()).update(range(s, s + n))
    runs = []
    for g, points in sorted(out.items()):
        for p in sorted(points):
            if runs and runs[-1][0] == g and runs[-1][2] == p:
                runs[-1][2] = p + 1
            else:
                runs.append([g, p, p + 1])
    return [tuple(r) for r in runs]


@given(RUNS)
@settings(max_examples=200, deadline=None)
def test_unite_and_codec(rows):
    g, s, n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    got = R.unite(g, s, s + n)
    assert list(zip(*(x.tolist() for x in got))) == _brute_union(rows)
    present, code = np.unique(got[0], return_inverse=True)
    lengths, offsets = R.encode(got[1], got[2], code)
    back = R.decode(lengths, offsets)
    assert [x.tolist() for x in back] == [got[1].tolist(), got[2].tolist(), code.tolist()]
    assert len(offsets) == len(present) + 1


def brute_periods(ranges, most):
    """(what, entity, start_us, end_us) with exact fractions."""
    by = {}
    for e, sn, sd, en, ed in ranges:
        if e is None or None in (sn, sd, en, ed) or 0 in (sd, ed):
            continue
        s, t = Fraction(sn, sd), Fraction(en, ed)
        if t > s:
            by.setdefault(e, []).append((s, t))
    us = lambda x: (x * 10**6).__floor__()
    out = []
    for e, rs in by.items():
        merged = []
        for s, t in sorted(rs):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        out += [("period", e, us(s), us(t)) for s, t in merged]
        out += [("gap", e, us(a[1]), us(b[0])) for a, b in zip(merged, merged[1:]) if b[0] - a[1] <= most]
    return sorted(out)


@pytest.mark.parametrize("seed,most", [(1, 600), (2, 600), (3, 5), (4, 10**6)])
def test_periods_and_gaps(spark, seed, most):
    rng = random.Random(seed)
    dens = [1, 3, 1000, 15360, 30000, 2688000, -7]
    rows = []
    for _ in range(400):
        d, f = rng.choice(dens), rng.choice(dens)
        s = Fraction(rng.randint(-2000 * 16, 6000 * 16), 16)
        n = Fraction(rng.choice([0, 1, 5, 30, 300, 1500]) * rng.randint(0, 12), rng.choice([1, 3, 8])) / 4
        rows.append((rng.choice("ab"), (s * d).__floor__(), d, ((s + n) * f).__floor__(), f))
    rows += [("a", 512, 1, 1024, 1), ("a", 1024, 1, 1536, 1), ("c", 0, 1, 5120, 1), ("c", 5120, 1, 5121, 1), ("c", 5721, 1, 5722, 1), ("c", 6323, 1, 6324, 1)]
    rows += [(None, 1, 1, 2, 1), ("a", None, 1, 2, 1), ("a", 1, 0, 2, 1), ("d", 2, 1, 1, 1), ("d", 3, 1, 3, 1)] + rows[:20]
    df = spark.createDataFrame(rows, "asset string, start_num bigint, start_den bigint, end_num bigint, end_den bigint").withColumn("shard", F.lit(1)).withColumn("what", F.lit("x")).withColumn("k0", F.lit(2))
    got = sorted((r.what, r.asset, r.start_us, r.end_us) for r in R.periods_and_gaps(df.repartition(3), ["asset"], max_gap_seconds=most).collect())
    assert got == brute_periods(rows, most)


def test_periods_of_nothing(spark):
    df = spark.createDataFrame([], "asset string, start_num bigint, start_den bigint, end_num bigint, end_den bigint")
    out = R.periods_and_gaps(df, ["asset"], max_gap_seconds=600)
    assert out.columns == ["asset", "what", "start_us", "end_us"] and out.count() == 0


def _ranges(rng, n):
    return [(rng.choice("ab"), s, s + rng.randint(0, 30)) for s in (rng.randint(0, 300) for _ in range(n))]


def test_subtract_and_overlap_pairs(spark):
    rng = random.Random(5)
    a, b = _ranges(rng, 60), _ranges(rng, 40)
    da, db = (spark.createDataFrame(x, "k string, s bigint, e bigint") for x in (a, b))
    cover = lambda rows, k: {t for key, s, e in rows if key == k for t in range(s, e)}
    got = [tuple(r) for r in I.subtract(da, db, ["k"], "s", "e").collect()]
    for k in "ab":
        assert cover(got, k) == cover(a, k) - cover(b, k)
    assert all(e > s for _, s, e in got) and len({(k, s) for k, s, _ in got} & {(k, e) for k, _, e in got}) == 0
    pairs = I.overlap_pairs(da.withColumnsRenamed({"s": "s1", "e": "e1"}), db, ["k"], ("s1", "e1"), ("s", "e"), 10)
    want = sorted((k, s, e, t, u) for k, s, e in a for l, t, u in b if k == l and s < u and t < e and e > s and u > t)
    assert sorted((r.k, r.s1, r.e1, r.s, r.e) for r in pairs.collect()) == want


def test_point_lookup_and_nearest(spark):
    rng = random.Random(6)
    ranges = [(k, i, s, e) for i, (k, s, e) in enumerate(_ranges(rng, 40))]
    points = [(rng.choice("abc"), i, rng.randint(0, 330)) for i in range(80)]
    dr, dp = spark.createDataFrame(ranges, "k string, id int, s bigint, e bigint"), spark.createDataFrame(points, "k string, p int, t bigint")
    got = {r.p: r.id for r in I.point_in_range(dp, dr, ["k"], "t", "s", "e", ["s", "id"], 7).collect()}
    for k, p, t in points:
        inside = sorted((s, i) for l, i, s, e in ranges if l == k and s <= t < e)
        assert got[p] == (inside[0][1] if inside else None)
    samples = [(k, i, s) for k, i, s, _ in ranges]
    ds = spark.createDataFrame(samples, "k string, id int, at bigint")
    near = {r.p: (r.id, r.distance) for r in I.nearest(dp, ds, ["k"], "t", "at", "id", 12).collect()}
    for k, p, t in points:
        best = min(((abs(at - t), at, i) for l, i, at in samples if l == k), default=None)
        if best is None or best[0] > 12:
            assert near[p] == (None, None)
        else:
            assert near[p][1] == best[0]
            assert any(abs(at - t) == best[0] and at == best[1] and i == near[p][0] for l, i, at in samples if l == k)


def test_coalesce_stays_within_its_class(spark):
    df = spark.createDataFrame([("x", 2, 10_000, 11_000, "a"), ("x", 2, 11_500, 12_500, "b"), ("x", 3, 11_200, 12_000, "c"), ("x", 2, 30_000, 31_000, "a")], "k string, sev int, s bigint, e bigint, why string")
    got = sorted(tuple(r) for r in I.coalesce_within(df, ["k", "sev"], "s", "e", 2000, "why").collect())
    assert got == [("x", 2, 10_000, 12_500, "a; b", 2), ("x", 2, 30_000, 31_000, "a", 1), ("x", 3, 11_200, 12_000, "c", 1)]


def test_merge_is_idempotent(spark):
    df = spark.createDataFrame(_ranges(random.Random(9), 50), "k string, s bigint, e bigint")
    once = I.merge(df, ["k"], "s", "e")
    assert sorted(map(tuple, I.merge(once, ["k"], "s", "e").collect())) == sorted(map(tuple, once.collect()))


def test_history_deviations_leave_the_own_value_out(spark):
    from statistics import median

    from tapewright.operators.statistics import history_deviations

    rng = random.Random(11)
    rows = [(v, m, float(rng.choice([1, 2, 3, 5, 8, 40]))) for v in range(23) for m in ("a", "b", "c") if m != "c" or v < 4]
    rows += [(50, "d", 3.0)] + [(v, "d", 1.0) for v in range(6)] + [(60, "a", None), (None, "a", 1.0)]
    want = set()
    for v, m, x in rows:
        if None in (v, x):
            continue
        rest = [y for u, n, y in rows if n == m and u not in (v, None) and y is not None]
        if len(rest) >= 5:
            med = median(rest)
            mad = median(abs(y - med) for y in rest)
            z = (x - med) / (1.4826 * mad) if mad else 0.0 if x == med else float("inf") if x > med else float("-inf")
            if abs(z) > 1.5:
                want.add((v, m, x, len(rest), round(z, 9)))
    got = {(r.video, r.metric, r.x, r.n_others, round(r.z, 9)) for r in history_deviations(spark.createDataFrame(rows, "video int, metric string, x double"), "metric", "x", "video", 5, 1.5).collect()}
    assert got == want
    ten = spark.createDataFrame([(i, "cuts", x) for i, x in enumerate([10.0, 11.0, 12.0, 40.0])], "video int, metric string, x double")
    assert history_deviations(ten, "metric", "x", "video").count() == 0


def test_blocks_make_no_difference(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "a", "b", None]), t, rng.choice([None, 1, 1, 2]), rng.random() * 10, t + rng.randint(0, 9)) for t in rng.sample(range(400), 160)]
    df = spark.createDataFrame(rows, "k string, t bigint, who int, level double, e bigint")
    other = spark.createDataFrame([(rng.choice("ab"), s, s + rng.randint(0, 40)) for s in rng.sample(range(400), 20)], "k string, t bigint, e bigint")
    points = spark.createDataFrame([("a", 5), ("a", 5), ("a", 399), ("b", 77), ("c", 1)], "k string, at bigint")
    cases = {
        "subtract": lambda n: I.subtract(df.where("k IS NOT NULL").select("k", "t", "e"), other, ["k"], "t", "e", block=n),
        "quiet": lambda n: I.threshold_runs(df, ["k"], "t", "level", 6, 2, 0, block=n).selectExpr("k", "start", "end", "n", "round(mean_level, 9) m"),
        "state": lambda n: I.state_runs(df, ["k"], "t", F.col("who") == 1, 3, block=n),
        "visits": lambda n: I.visits(df, ["k"], "t", "who", 2, 8, block=n),
        "opening": lambda n: I.opening_run(df, ["k"], "t", F.col("who").isNotNull(), 3, 2, block=n),
        "absence": lambda n: I.longest_absence(df, ["k"], "t", F.col("who") == 2, 5, block=n),
        "pauses": lambda n: I.gaps_between(df, ["k"], "t", "t", "e", 1, block=n),
        "changes": lambda n: I.change_points(df, ["k"], ["t"], "who", block=n),
        "adjacent": lambda n: I.adjacent_overlaps(df, ["k"], ["t"], "t", "e", block=n),
        "coalesce": lambda n: I.coalesce_within(df.withColumn("why", F.col("who").cast("string")).na.fill("none", ["why"]), ["k"], "t", "e", 2, "why", block=n),
        "samples": lambda n: I.nearest_samples(points, df, ["k"], "at", "t", ["who"], block=n),
    }
    for name, run in cases.items():
        whole = sorted(map(str, run(10**6).collect()))
        assert whole and whole == sorted(map(str, run(7).collect())), name
        assert run(7).columns == run(10**6).columns
    empty = df.where("false")
    assert I.subtract(empty, empty, ["k"], "t", "e").count() == I.state_runs(empty, ["k"], "t", F.lit(True), 1).count() == I.opening_run(empty, ["k"], "t", F.lit(True), 1, 1).count() == 0


def test_a_range_without_end_and_repeated_points(spark):
    far = 10**15
    ranges = spark.createDataFrame([("a", 1, 0, far), ("a", 2, 50, 60), ("a", 2, 50, 60), ("a", 3, 5, 5), ("a", 4, 9, None), ("b", 5, far - 10, far)], "k string, id int, s bigint, e bigint")
    points = spark.createDataFrame([("a", 55), ("a", 55), ("a", -1), ("b", far - 1), ("c", 5), ("a", far - 1), (None, 55), ("c", 5)], "k string, t bigint")
    got = sorted((r.k or "", r.t, r.id or 0) for r in I.point_in_range(points, ranges, ["k"], "t", "s", "e", ["s", "id"], 10).collect())
    assert got == [("", 55, 0), ("a", -1, 0), ("a", 55, 1), ("a", 55, 1), ("a", far - 1, 1), ("b", far - 1, 5), ("c", 5, 0), ("c", 5, 0)]
    pairs = I.overlap_pairs(ranges, ranges.selectExpr("k", "id AS id2", "s AS s2", "e AS e2"), ["k"], ("s", "e"), ("s2", "e2"), 10).where("id < id2")
    assert sorted((r.id, r.id2) for r in pairs.collect()) == [(1, 2), (1, 2)]


def test_ranks_from_counts(spark):
    from tapewright.operators import statistics as S

    rng = random.Random(12)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, 0.0, -3.5, 7.25, rng.gauss(0, 50), float(rng.randint(-4, 4)), 1e-9])) for _ in range(600)] + [("lone", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("n", F.lit("x"))
    got = {r.k: r for r in S.at_ranks(df.repartition(5), ["k"], "v", {"upper": S.upper_median, "p90": S.nearest_rank(0.9), "p95": S.nearest_rank(0.95, True), "first": lambda n: n * 0}, "count").collect()}
    assert set(got) == {"a", "b", None, "lone"}
    for k, r in got.items():
        v = sorted(x for y, x in rows if y == k and x is not None)
        n = len(v)
        assert (r["count"], r.upper, r.p90, r.first) == (n, v[n // 2], v[int((n - 1) * 0.9)], v[0]) and r.p95 == v[int((n - 1) * 0.95 + 0.5)]
    assert S.at_ranks(df.where("false"), ["k"], "v", {"m": S.upper_median}).count() == 0


def test_shots_of_cuts(spark):
    from tapewright.operators import signals as G

    rows = [("a", t, t in (100, 250, 400, 900), t / 1000) for t in range(0, 1000, 50)] + [("b", 10, False, 0.1)]
    df = spark.createDataFrame(rows, "k string, t bigint, is_cut boolean, d double")
    end = spark.createDataFrame([("a", 1000), ("b", 80), ("c", 0)], "k string, `end` bigint")
    got = sorted(tuple(r) for r in G.shots_of_cuts(df, ["k"], "t", "d", end, 200).collect())
    # the cut at 100 comes too soon; that at 400 lies 150 behind the one at 250; the tail is a shot of any length
    assert got == [("a", 0, 0, 250, 0.0), ("a", 1, 250, 900, 0.25), ("a", 2, 900, 1000, 0.9), ("b", 0, 0, 80, 0.0), ("c", 0, 0, 0, 0.0)]


def test_windows_of_rows_reach_over_blocks(spark):
    from tapewright.operators import signals as G

    rng = random.Random(16)
    rows = [(k, h, rng.random(), 10.0) for k in ("a", "b") for h in sorted(rng.sample(range(300), 70))]
    df = spark.createDataFrame(rows, "k string, h bigint, e double, s double")
    whole = G.block_power(df, ["k"], "h", "e", "s")
    got = sorted((r.k, r.h, round(r.power, 12)) for r in G.block_power(df, ["k"], "h", "e", "s", places=6).collect())
    want = []
    for k in ("a", "b"):
        own = [r for r in rows if r[0] == k]
        want += [(k, own[i][1], round(sum(r[2] for r in own[i - 3 : i + 1]) / 40, 12)) for i in range(3, len(own))]
    assert got == sorted(want) == sorted((r.k, r.h, round(r.power, 12)) for r in whole.collect())
    m = {r.k: r for r in G.loudness_maxima(whole, ["k"], "h", blocks_per_window=5).collect()}
    for k in ("a", "b"):
        p = [x for y, _, x in want if y == k]
        loud = lambda x: -0.691 + 10 * np.log10(x)
        assert m[k].momentary == pytest.approx(loud(max(p))) and m[k].short_term == pytest.approx(loud(max(sum(p[i - 4 : i + 1]) / 5 for i in range(4, len(p)))))
    v = spark.createDataFrame([("a", i, [float(i * i), 1.0]) for i in range(9)], "k string, i bigint, v array<double>")
    one, many = (sorted(map(str, G.consecutive_distance(v, ["k"], "i", "v", n).collect())) for n in (10**6, 2))
    assert one == many and "distance=None" in one[0]


def test_robust_z_and_medians(spark):
    from tapewright.operators import statistics as S

    rng = random.Random(17)
    rows = [(k, i, rng.choice([1.0, 2.5, -4.0, rng.gauss(0, 9)])) for k in ("a", "b") for i in range(60 + (k == "b"))] + [("flat", i, 3.0) for i in range(5)] + [("flat", 9, 4.0)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    for r in S.robust_z(df, ["k"], "v").collect():
        own = [v for k, _, v in rows if k == r.k]
        med = float(np.median(own))
        mad = float(np.median([abs(v - med) for v in own]))
        z = (r.v - med) / (1.4826 * mad) if mad else (0.0 if r.v == med else float("inf"))
        assert (r.med, r.mad) == (pytest.approx(med), pytest.approx(mad)) and r.z == pytest.approx(z)


def test_microseconds_without_decimals(spark):
    from tapewright.sources.standins import us

    rng = random.Random(5)
    rows = [(rng.randint(-(10**12), 10**12), rng.choice([1, 25, 922, 923, 30000, 10**8, 9223372036854, 9223372036855, 2**61]) * rng.choice([1, -1])) for _ in range(300)]
    rows += [(None, 1), (1, None), (1, 0)]
    got = spark.createDataFrame(rows, "n bigint, d bigint").select("n", "d", us("n", "d").alias("u")).collect()
    assert [r.u for r in got] == [None if r.n is None or not r.d else r.n * 10**6 // r.d for r in got]


def test_ranges_in_microseconds_are_those_of_fractions(spark):
    # the edges of shards count

    rng = random.Random(6)
    edge = 512 * 10**6
    rows = [(rng.choice(["a", "b", None]), s := rng.choice([rng.randint(-3 * edge, 3 * edge), edge * rng.randint(-2, 2)]), s + rng.choice([-1, 0, 1, rng.randint(0, 10**8), edge, 2 * edge])) for _ in range(60)]
    rows += [("a", None, 5), ("a", 5, None)]
    df = spark.createDataFrame(rows, "asset string, s bigint, e bigint").withColumn("m", F.lit(10**6).cast("bigint"))
    want = {(r.asset, r.start_us, r.end_us) for r in R.periods_and_gaps(df, ["asset"], ("s", "m"), ("e", "m")).where("what = 'period'").collect()}
    got = [(r.asset, r.s, r.e) for r in I.merge(df, ["asset"], "s", "e").collect()]
    assert len(got) == len(want) and set(got) == want
