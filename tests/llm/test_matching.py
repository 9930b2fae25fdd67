"""Consensus, nearest times and runs of frames against brute force, and their edge cases."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tapewright.llm import consensus as C
from tapewright.llm import runs as R
from tapewright.llm.nearest import nearest_in_time

ENGINES = {"a": "a", "b": "b", "c": "c", "d": "d"}
READINGS = "utterance_id bigint, a string, b string, c string, d string"


def test_what_makes_no_difference():
    w = C.spoken_words
    assert w("Seven uh percent, of the Level.") == w(" 7% of the level") == ["seven", "percent", "of", "the", "level"]
    assert w("it’s 12 o'clock") == w("IT'S twelve o’clock!")
    assert w("1,204 frames") == ["one", "thousand", "two", "hundred", "four", "frames"]
    assert w("twenty-one") == w("21") and w("2.5") == ["two", "point", "five"] and w("the 3rd") == w("the third")
    assert w(None) == w("  ") == w("um, eh...") == []
    assert w("hum umbrella") == ["hum", "umbrella"]


def test_alignment_keeps_every_reading():
    rng = random.Random(1)
    for _ in range(60):
        readings = [[rng.choice("the a cut shot we".split()) for _ in range(rng.randint(0, 7))] or None for _ in range(4)]
        slots = C.align(readings)
        for k, r in enumerate(readings):
            own = [s[k] for s in slots]
            assert own == [None] * len(own) if r is None else [w for w in own if w] == r


def test_weights_decide_ties():
    counts = {"aaaa": 1000, "abaa": 30, "aaba": 60, "abbb": 80, "aaab": 5, "abab": 6, "abba": 4, "ab--": 2, "----": 1}
    winners, report = C.discover(counts, 4)
    assert winners["abab"] == "b" and winners["abbb"] == "b" and winners["abba"] == "a" and winners["aaab"] == "a"
    assert [r["claims"] for r in report] == [1187, 1187, 1185, 1185]
    assert report[3]["weight"] == max(r["weight"] for r in report)
    few, _ = C.discover({"ab": 1}, 2), None
    assert few[0]["ab"] == "a"


def test_chi_squared_quantiles():
    assert C.chi_squared_quantile(0.05, 10) == pytest.approx(3.940, abs=0.02)
    assert C.chi_squared_quantile(0.05, 100) == pytest.approx(77.93, abs=0.05)


def test_consensus(spark):
    truth = "the agent moved twelve frames from the quiet room"
    rows = [(i, truth, truth, truth.replace("twelve", "12"), truth) for i in range(50)]
    rows += [(60, truth.replace("agent", "host"), truth, truth, truth), (61, truth + " room", truth, truth.replace("quiet ", ""), truth), (62, None, "", truth, truth.upper() + "!"), (63, None, None, None, None), (64, "play head", "playhead", "playhead", None)]
    rows += [rows[50], (None, truth, truth, truth, truth)]
    df = spark.createDataFrame(rows, READINGS).withColumn("key", F.lit("x")).withColumn("slots", F.lit(1))
    items, engines = C.consensus(df.repartition(3), ENGINES)
    got = {r.utterance_id: r for r in items.collect()}
    assert len(got) == 55
    assert got[60].wording == truth and got[60].differs == [True, False, False, False] and got[60].agreement == pytest.approx(35 / 36)
    assert got[61].wording == truth and got[61].differs == [True, False, True, False]
    assert got[62].differs == [None, None, False, False] and got[62].agreement == 1
    assert got[63].wording == "" and got[63].agreement is None
    assert got[64].differs[:3] == [False, False, False]
    assert {r.engine: r.n_errors > 0 for r in engines.collect()}["b"] is False


def test_consensus_of_nothing(spark):
    items, engines = C.consensus(spark.createDataFrame([], READINGS), ENGINES)
    assert items.count() == 0 and [r.n_claims for r in engines.collect()] == [0] * 4


def test_word_distance():
    rng = random.Random(5)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 80))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        assert C.word_distance(a, b) == row[-1]


def test_many_engines_go_through_claims(spark, monkeypatch):
    rng = random.Random(6)
    words = "the a cut shot we moved twelve frames".split()
    rows = []
    for i in range(80):
        truth = [rng.choice(words) for _ in range(8)]
        rows.append((i, *(" ".join(w if rng.random() > bad else rng.choice(words) for w in truth) if rng.random() > 0.1 else None for bad in (0.02, 0.1, 0.2, 0.05))))
    df = spark.createDataFrame(rows + [(99, None, None, None, None)], READINGS)
    items, engines = (sorted(map(str, x.collect())) for x in C.consensus(df, ENGINES))
    monkeypatch.setattr(C, "PATTERN_ENGINES", 2)
    items_2, engines_2 = (sorted(map(str, x.collect())) for x in C.consensus(df, ENGINES))
    assert [e[:40] for e in engines] == [e[:40] for e in engines_2]
    # votes that are equal may be told apart otherwise
    assert len(set(items) - set(items_2)) <= 3


def _discovered(claims, weighting):
    """Truth discovery in plain Python."""
    by_item, of = {}, {}
    for i, a, l in claims:
        by_item.setdefault(i, {})[a] = min(l, by_item.get(i, {}).get(a, l))
    for i, own in by_item.items():
        for a, l in own.items():
            of.setdefault(a, []).append((i, l))
    weight = dict.fromkeys(of, 1.0)
    for _ in range(C.ROUNDS):
        truth = _truths(by_item, weight)
        new = {}
        for a, own in of.items():
            bound = (sum(truth[i] != l for i, l in own) + 0.5) / C.chi_squared_quantile(C.ALPHA, len(own))
            new[a] = C.weight_of(bound, weighting)
        still = max(abs(new[a] - weight[a]) / new[a] for a in new) < 1e-9
        weight = new
        if still:
            break
    return _truths(by_item, weight), weight


def _truths(by_item, weight):
    out = {}
    for i, own in by_item.items():
        votes = {}
        for a, l in own.items():
            v, top = votes.get(l, (0.0, 0.0))
            votes[l] = (v + weight[a], max(top, weight[a]))
        out[i] = min(votes, key=lambda l: (-round(votes[l][0], 9), -votes[l][1], l))
    return out


@pytest.mark.parametrize("weighting", ["inverse", "log"])
def test_truth_discovery_with_a_long_tail_of_annotators(spark, weighting):
    rng = random.Random(7)
    labels = ["host", "guest", "caller", "noise"]
    truth = {i: rng.choice(labels) for i in range(1500)}
    claims = []
    for a in range(2000):
        bad = rng.choice([0.02, 0.1, 0.5]) if a % 4 else 0.05
        for i in rng.sample(range(1500), 200 if a < 10 else rng.randint(1, 4)):
            claims.append((i, f"a{a}", truth[i] if rng.random() > bad else rng.choice(labels)))
    claims += [claims[0], (3, "a5", "host"), (None, "a1", "x"), (1, None, "x"), (1, "a1", None)]
    df = spark.createDataFrame(claims, "item bigint, annotator string, label string").withColumn("weight", F.lit("x")).withColumn("l", F.lit(1))
    items, annotators, overall = C.truth_discovery(df.repartition(5), weighting=weighting)
    expected, weights = _discovered([c for c in claims if None not in c], weighting)
    got = {r.item: r for r in items.collect()}
    assert {i: r.label for i, r in got.items()} == expected
    assert all(0 < r.support <= 1 + 1e-12 and (r.agreement is None) == (r.n_claims == 1) for r in got.values())
    for r in annotators.collect():
        assert r.weight == pytest.approx(weights[r.annotator], rel=1e-6)
    # one claim is trusted less than many, whatever it says
    by = {r.annotator: r for r in annotators.collect()}
    assert min(by[f"a{k}"].weight for k in (0, 4, 8)) > max(r.weight for r in by.values() if r.n_claims == 1)
    assert sum(expected[i] == truth[i] for i in expected) > 0.85 * len(expected)
    own = {}
    for i, a, l in {(i, a): (i, a, l) for i, a, l in sorted((c for c in claims if None not in c), reverse=True)}.values():
        own.setdefault(i, []).append(l)
    own = [v for v in own.values() if len(v) > 1]
    n, counts = sum(map(len, own)), {}
    for v in own:
        for l in v:
            counts[l] = counts.get(l, 0) + 1
    apart = sum(sum(x != y for x in v for y in v) / (len(v) - 1) for v in own) / n
    chance = sum(counts[x] * (n - counts[x]) for x in counts) / (n * (n - 1))
    assert overall.first().alpha == pytest.approx(1 - apart / chance)


def test_truth_discovery_of_nothing(spark):
    items, annotators, overall = C.truth_discovery(spark.createDataFrame([], "item bigint, annotator string, label string"))
    assert items.count() == annotators.count() == 0 and tuple(overall.first()) == (0, 0, None)
    items, annotators, overall = C.truth_discovery(spark.createDataFrame([(1, "a", "x")], "item bigint, annotator string, label string"))
    assert tuple(items.first()) == (1, "x", 1.0, None, 1) and overall.first().alpha is None


LEFT = "id bigint, asset string, start_num bigint, start_den bigint"
RIGHT = "frame_id bigint, asset string, time_num bigint, time_den bigint"


def _nearest(left, right, tol):
    out = []
    for i, a, n, d in {r for r in left if None not in r and r[3]}:
        t = Fraction(n, d)
        near = min(((abs(Fraction(fn, fd) - t), Fraction(fn, fd), f) for f, b, fn, fd in right if b == a and None not in (f, fn, fd) and fd), default=None)
        if near and near[0] <= tol:
            out.append((i, near[2]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_in_time(spark, seed):
    rng = random.Random(seed)
    t = lambda: (lambda d: (rng.randint(-5 * d, 40 * d), d))(rng.choice([1, 5, 1000, 15360, 600, 7]))
    right = [(i, rng.choice("ab"), *t()) for i in range(150)]
    left = [(i, rng.choice("abc"), *t()) for i in range(200)]
    left += [(900, "z", 10, 5), (901, "z", 24, 10), (902, "z", 2401, 1000), (903, "z", 15, 1)] + left[:9]
    right += [(501, "z", 8, 4), (502, "z", 14, 5), (503, "z", 28, 10), (504, "z", 149, 10), (505, "z", 151, 10)] + right[:9]
    left += [(904, None, 1, 1), (905, "z", None, 1), (906, "z", 1, 0), (907, "z", 1, None)]
    right += [(601, None, 2, 1), (602, "z", None, 1), (603, "z", 2, 0)]
    l = spark.createDataFrame(left, LEFT).withColumn("e", F.lit(1)).withColumn("rid", F.lit(2)).withColumn("k0", F.lit(3))
    r = spark.createDataFrame(right, RIGHT).withColumn("b", F.lit(1)).withColumn("id", F.lit(2))
    for tol, width in (((2, 5), 8), ((3, 1), 4), ((0, 1), 1)):
        got = sorted(map(tuple, nearest_in_time(l, r, ["id"], "frame_id", tolerance=tol, bucket_seconds=width).collect()))
        assert got == _nearest(left, right, Fraction(*tol))


def test_nearest_refuses_what_it_cannot_tell_apart(spark):
    left, right = spark.createDataFrame([(1, "a", 1, 10**9)], LEFT), spark.createDataFrame([(1, "a", 1, 3)], RIGHT)
    with pytest.raises(Exception, match="denominator over"):
        nearest_in_time(left, right, ["id"], "frame_id").collect()


def test_nearest_of_nothing(spark):
    l, r = spark.createDataFrame([], LEFT), spark.createDataFrame([(1, "a", 1, 1)], RIGHT)
    assert nearest_in_time(l, r, ["id"], "frame_id").count() == 0
    assert nearest_in_time(spark.createDataFrame([(1, "a", 1, 1)], LEFT), r.where("false"), ["id"], "frame_id").count() == 0


BOX = "struct<x:double,y:double,width:double,height:double,confidence:double>"
FRAMES = f"frame_id bigint, asset string, time_num bigint, time_den bigint, faces array<{BOX}>, text array<struct<text:string,box:{BOX}>>"
LINES = ["TAKE 15 OF 40", "Kettle noise gone", "CHAPTER 13", "phone mic only"]


def test_same_line():
    same = R.same_line
    assert same("kett1e noise gone", "kettle n0ise gone") and same("chap7er 13", "chapter 13") and same("dont toch the ceiling", "dont touh the ceiling")
    assert same("of take 15 40", "take 15 of 40")
    assert not same("chapter 13", "chapter 14") and not same("take 15 of 40", "take 15 of 41")
    assert not same("kettle noise gone", "kettle noise") and not same("step 6", "shot 6") and not same("k3ttl3 n0ise gone", "kettle noise gone")
    assert R.edit_distance("abc", "abd", 2) == 1 and R.edit_distance("abcdef", "a", 2) == 3


def test_pairing_is_one_to_one():
    assert R.same_lines(["kettle", "kettl3"], ["kettles", "kettle"])
    assert not R.same_lines(["a b", "a b"], ["a b", "c d"])
    import numpy as np

    assert R.same_faces(np.array([0.0, 0, 100, 15, 0, 100]), np.array([12.0, 0, 100, 9, 0, 100]))
    assert not R.same_faces(np.array([0.0, 0, 100]), np.array([11.0, 0, 100]))


def _frames(rng, asset, n, first):
    out, t, shown, face = [], Fraction(rng.randint(0, 700)), list(LINES[:2]), 100.0
    for i in range(n):
        t += rng.choice([Fraction(1, 3), Fraction(1001, 1000), Fraction(3), Fraction(46081, 15360), Fraction(4)])
        if rng.random() < 0.2:
            shown = rng.sample(LINES, rng.randint(0, 3))
        if rng.random() < 0.1:
            face += 40
        lines = [(rng.choice([str.upper, str.lower, str])(x.replace("e", "3", 1) if rng.random() < 0.2 and "settle" in x else x) + rng.choice(["", " -", "  "]), (0.0, 0.0, 9.0, 9.0, rng.choice([0.3, 0.9, None]))) for x in shown]
        lines += [("junk", (0.0, 0.0, 1.0, 1.0, 0.29))] * rng.randint(0, 1)
        rng.shuffle(lines)
        faces = [(face + rng.uniform(-4, 4), 50.0, 100.0, 100.0, 0.8)] + [(0.0, 0.0, 5.0, 5.0, 0.1)] * rng.randint(0, 1)
        d = rng.choice([1, 2, 5]) * 46080000
        out.append((first + i, asset, int(t * d), d, faces, lines))
    return out


def _brute_runs(rows):
    import re

    import numpy as np

    best = {}
    for r in rows:
        if None not in r[:6] and r[3]:
            best[r[0]] = r
    out = []
    sure = lambda box: box is None or box[4] is None or box[4] >= 0.3
    plain = lambda s: " ".join(re.sub(r"[^\w\s]|_", "", s.lower()).split())
    for a in {r[1] for r in best.values()}:
        prev = None
        for r in sorted((r for r in best.values() if r[1] == a), key=lambda r: (Fraction(r[2], r[3]), r[0])):
            own = (Fraction(r[2], r[3]), [plain(x) for x, b in r[5] if x is not None and sure(b)], np.array([v for f in r[4] if sure(f) for v in f[:3]]))
            if prev and own[0] - prev[0] <= 3 and R.same_lines(prev[1], own[1]) and R.same_faces(prev[2], own[2]):
                out[-1][2] = r[0]
                out[-1][3] += 1
            else:
                out.append([a, r[0], r[0], 1])
            prev = own
    return sorted(map(tuple, out))


@pytest.mark.parametrize("seed,chunk", [(1, 4), (2, 4), (3, 256)])
def test_collapse_runs(spark, seed, chunk):
    rng = random.Random(seed)
    rows = [r for k, a in enumerate("abc") for r in _frames(rng, a, 60, 1000 * k)]
    rows += rows[:15] + [(1, None, 1, 1, [], []), (2001, "a", None, 1, [], []), (2002, "a", 1, 1, None, []), (2003, "a", 1, 1, [], None), (2004, "a", 1, 0, [], [])]
    rows += [(3000 + i, "quiet", i, 1, [], []) for i in range(40)] + [(4000, "alone", 5, 1, [], [(None, None)])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, FRAMES).withColumn("chunk", F.lit(1)).withColumn("lines", F.lit(2)).withColumn("same", F.lit(3))
    got = R.collapse_runs(df.repartition(3), chunk_seconds=chunk)
    assert sorted((r.asset, r.first_frame_id, r.last_frame_id, r.n_frames) for r in got.collect()) == _brute_runs(rows)


def test_runs_of_nothing(spark):
    assert R.collapse_runs(spark.createDataFrame([], FRAMES)).count() == 0
