"""Set-form edits against the fold, and the sequence kernels against brute force."""

import collections
import itertools
import random

import numpy as np
import pytest

from tapewright.operators import command_log as C
from tapewright.operators import scripts as X
from tapewright.operators import selection as H
from tapewright.operators import sequences as Q
from tapewright.operators import timeline as L


def _placed(rng, docs):
    commands, rows = [], []
    for d in docs:
        at = 0
        for i in range(rng.randint(1, 6)):
            s = rng.randint(0, 500)
            n = rng.randint(5, 80)
            commands.append((d, i, "place", 0, f"s{i}", s, s + n, at))
            rows.append((d, 0, i, f"s{i}", s, s + n, at))
            at += n + rng.choice([0, 0, 7])
    return commands, rows


CLIPS = "doc string, track int, clip int, asset string, source_start bigint, source_end bigint, start bigint"
LOG = "doc string, seq int, kind string, track int, asset string, a bigint, b bigint, to bigint"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ripple_set_form_is_the_fold(spark, seed):
    rng = random.Random(seed)
    docs = [f"d{i}" for i in range(12)]
    commands, rows = _placed(rng, docs)
    removals = []
    for d in docs:
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 250)
            removals.append((d, 0, a, a + rng.randint(1, 60)))
    # the fold takes disjoint ranges, the last first, so that earlier ones keep their places
    for d in docs:
        points = sorted({t for k, _, a, b in removals if k == d for t in range(a, b)}, reverse=True)
        runs = []
        for p in points:
            if runs and runs[-1][0] == p + 1:
                runs[-1][0] = p
            else:
                runs.append([p, p + 1])
        commands += [(d, 100 + i, "ripple", 0, None, a, b, None) for i, (a, b) in enumerate(runs)]
    want = sorted(tuple(r) for r in C.replay(spark.createDataFrame(commands, LOG)).collect())
    clips = spark.createDataFrame(rows, CLIPS)
    got = L.ripple_delete(clips, spark.createDataFrame(removals, "doc string, track int, start bigint, end bigint"), 50)
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_move_set_form_is_the_fold(spark, seed):
    rng = random.Random(seed)
    docs = [f"d{i}" for i in range(15)]
    commands, rows = _placed(rng, docs)
    moves = [(d, a, a + rng.randint(0, 50), rng.randint(0, 250)) for d in docs for a in [rng.randint(0, 150)]]
    commands += [(d, 100, "move", 0, None, a, b, to) for d, a, b, to in moves]
    want = sorted(tuple(r) for r in C.replay(spark.createDataFrame(commands, LOG)).collect())
    got = L.move_range(spark.createDataFrame(rows, CLIPS), spark.createDataFrame(moves, "doc string, a bigint, b bigint, to bigint"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_move_cases():
    one = {0: (C.Clip("x", 0, 300, 0),)}
    assert [(c.source_start, c.source_end) for c in C.move(one, 0, 200, 260, 100)[0]] == [(0, 100), (200, 260), (100, 200), (260, 300)]
    assert [c.start for c in C.move(one, 0, 0, 60, 300)[0]] == [0, 240]
    assert next(c.start for c in C.move(one, 0, 0, 60, 150)[0] if c.source_start == 0) == 90
    with pytest.raises(C.Refused):
        C.move(one, 0, 0, 60, 60)


def test_undo_is_a_shorter_prefix(spark):
    commands = [("d", 0, "place", 0, "x", 0, 300, 0), ("d", 1, "ripple", 0, None, 100, 160, None)]
    df = spark.createDataFrame(commands, LOG)
    assert [tuple(r)[4:6] for r in C.replay(df).collect()] == [(0, 100), (160, 300)]
    assert [tuple(r)[4:6] for r in C.replay(df, 1).collect()] == [(0, 300)]
    before, after = C.replay(df, 1), C.replay(df)
    assert [tuple(r)[-3:] for r in L.diff(before, after).select("source_start", "source_end", "change").collect()] == [(100, 160, "removed")]


def _brute_lcs(a, b):
    for n in range(min(len(a), len(b)), 0, -1):
        subs = {tuple(a[i] for i in c) for c in itertools.combinations(range(len(a)), n)}
        if subs & {tuple(b[i] for i in c) for c in itertools.combinations(range(len(b)), n)}:
            return n
    return 0


def test_lcs_and_vote(spark):
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 7))] for _ in range(2))
        n = _brute_lcs(a, b)
        assert len(Q.matched_indices(a, b)) == n
        assert Q.similarity(a, b) == (n / max(len(a), len(b)) if a and b else 0)
    mine, theirs = "get my voice closer".split(), "get my own voice close".split()
    assert Q.matched_indices(mine, theirs) == [0, 1, 2]
    w = lambda xs, shift: spark.createDataFrame([("a", i, x, i * 400 + shift, i * 400 + shift + 300) for i, x in enumerate(xs)], "k string, idx int, word string, start_ms bigint, end_ms bigint")
    got = {r.idx: (r.confidence, r.n_sources) for r in Q.vote(w(mine, 0), w(theirs, 330), "k").collect()}
    assert got == {0: (0.95, 2), 1: (0.95, 2), 2: (0.95, 2), 3: (0.55, 1)}


def _brute_corrections(words, start, end, least=0.7):
    w = [Q.word_key(x) for x in words]
    out, i = [], 0
    while i < len(w) - 3:
        best = None
        for n in range(12, 1, -1):
            for m in range(12, 1, -1):
                if i + n + m <= len(w) and start[i + n] - end[i + n - 1] <= 2500:
                    s = Q.similarity(w[i : i + n], w[i + n : i + n + m])
                    if s >= least and (best is None or s > best[0] + 0.001):
                        best = (s, n, m)
        if best:
            out.append((i, i + best[1] - 1, i + best[1], i + best[1] + best[2] - 1, best[0]))
            i += best[1]
        else:
            i += 1
    return out


def test_self_corrections():
    rng = random.Random(4)
    for _ in range(40):
        words = [rng.choice("the a we cut it then shot".split()) for _ in range(rng.randint(0, 30))]
        start = list(itertools.accumulate([rng.choice([300, 300, 3500]) for _ in words]))
        end = [s + 200 for s in start]
        assert Q.self_corrections(words, start, end) == _brute_corrections(words, start, end)


def test_leader_groups():
    rng = random.Random(7)
    for _ in range(30):
        lines = [[rng.choice("abcdef") for _ in range(rng.randint(1, 6))] for _ in range(25)]
        leaders, want = [], []
        for line in lines:
            g = next((k for k, x in enumerate(leaders) if Q.similarity(x, line) >= 0.72), None)
            if g is None:
                g = len(leaders)
                leaders.append(line)
            want.append(g)
        assert Q.leader_groups(lines) == want


def test_locate_line():
    rng = random.Random(8)
    for _ in range(60):
        want = [rng.choice("abcde") for _ in range(rng.randint(1, 6))]
        heard = [rng.choice("abcdexyz") for _ in range(rng.randint(0, 25))]
        best = (0.0, None, None)
        n = len(want)
        for i in range(len(heard)):
            for size in sorted({n, n * 3 // 2 + 1, max(n * 7 // 10, 2)}):
                part = heard[i : i + size]
                s = _brute_lcs(want, part) / max(n, len(part))
                if len(part) >= 2 and s > best[0]:
                    best = (s, i, i + len(part) - 1)
        got = Q.locate_line(want, heard, [False] * len(heard))
        assert (got is None) == (best[1] is None)
        if got:
            s, a, z = best
            while s >= 0.45 and a < z and heard[a] not in want:
                a += 1
            while s >= 0.45 and z > a and heard[z] not in want:
                z -= 1
            assert got == (a, z, s)


def test_same_words_and_normalisers():
    assert all(Q.same_word(a, b) for a, b in [("files", "file"), ("testing", "test"), ("cinematic", "cinematik"), ("instruction", "instructions"), ("a", "a")])
    assert not any(Q.same_word(a, b) for a, b in [("to", "it"), ("cat", "cut"), ("hook", "book s"), ("plan", "panel")])
    assert Q.trimmed("“Don't—") == "don't" and Q.word_key("“Don't—") == "dont" and Q.key_words("Second: instruction-files. ") == ["second", "instructionfiles"]
    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 40))] for _ in range(2))
        near = lambda x, y: x == y or {x, y} == {"x", "y"}
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if near(x, y) else max(t[i][j + 1], t[i + 1][j])
        assert Q.similarity(a, b, near) == (t[-1][-1] / max(len(a), len(b)) if a and b else 0)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        assert Q.word_errors(a, b) == row[-1]


def _said(spark, text, gaps=(), key="r"):
    rows, at = [], 0
    for i, w in enumerate(text.split()):
        at += dict(gaps).get(i, 100)
        rows.append((key, i, w, at, at + 200))
        at += 200
    return spark.createDataFrame(rows, "k string, idx int, word string, start_ms bigint, end_ms bigint")


def test_scripts(spark):
    # a word heard otherwise, a line that begins behind a full stop, and one that isn't there
    said = _said(spark, "First folders. Pinklot Second instructions file goes here um and random nothing else matters", {2: 600, 3: 500, 8: 700})
    lines = spark.createDataFrame([("r", 1, "First folders"), ("r", 2, "Second: instruction files"), ("r", 3, "a line of quite other speech")], "k string, ord int, line string")
    got = {r.ord: r for r in X.locate_lines(lines, said, "k").collect()}
    assert (got[1].first_idx, got[1].last_idx, got[1].similarity) == (0, 1, 1.0)
    assert (got[2].first_idx, got[2].last_idx) == (3, 7) and got[2].similarity >= 0.6
    assert got[3].first_idx is None and 0 <= got[3].similarity < 0.45
    located = spark.createDataFrame([("r", 2, "Second: instruction files goes", 2, 7, 1200, 3200)], "k string, ord int, line string, first_idx int, last_idx int, start_ms bigint, end_ms bigint")
    found = X.stumbles(located, said, "k")
    assert [(r.ord, r.idx, r.edge) for r in found.orderBy("idx").collect()] == [(2, 2, "first"), (2, 7, "last")]
    cut = X.without_stumbles(located, found, "k").first()
    at = {r.idx: r for r in said.collect()}
    assert (cut.start_ms, cut.end_ms) == (at[2].end_ms, at[7].start_ms)
    problems = {(r.ord, r.problem) for r in X.script_problems(X.locate_lines(lines, said, "k"), said, "k").collect()}
    assert (3, "not found") in problems and not any(p == "overlaps another line" for _, p in problems)


def test_read_back(spark):
    source = _said(spark, "automate it with a hook then write down your notes today and so on")
    plan = [("r", 0, "Automate it with a hook", 0, 1500, 0, 1500), ("r", 1, "write down your notes", 1800, 3000, 1500, 2700)]
    schema = "k string, ord int, line string, source_start bigint, source_end bigint, start bigint, end bigint"
    run = lambda text: {r.ord: r for r in X.read_back(spark.createDataFrame(plan, schema), _said(spark, text), source, "k").collect()}
    good = run("automate it with a hook write down your notes")
    assert all(r.heard and r.chopped is None and r.repeated is None for r in good.values())
    assert run("automate it with a then write down your notes")[0].chopped is None
    bad = run("automate it with more speech entirely")
    assert bad[0].heard and bad[0].chopped == "a hook" and not bad[1].heard
    twice = run("automate it with a hook or some hook down your notes")
    assert twice[0].repeated == "hook"
    heard = X.times_heard(spark.createDataFrame([("r", "with a hook")], "k string, phrase string"), _said(spark, "with a hook and with the hook with a"), "k")
    assert heard.first().times == 2


def test_joins():
    rate = 8000
    tone = lambda hz, s, level=0.3: level * np.sin(2 * np.pi * hz * np.arange(int(s * rate)) / rate)
    assert H.pitch(tone(150, 0.12), rate) == pytest.approx(150, abs=3) and H.pitch(np.zeros(900), rate) is None and H.pitch(tone(150, 0.12)[:64], rate) is None
    same = H.measure_join(tone(150, 0.36), tone(150, 0.12), rate)
    assert same["settled"] and same["cost"] < 0.05
    apart = H.measure_join(tone(150, 0.36), tone(300, 0.12, 0.15), rate)
    assert apart["level_step"] == pytest.approx(-6.02, abs=0.1) and apart["pitch_step"] == pytest.approx(12, abs=0.5)
    assert apart["cost"] == pytest.approx(6.02 / 6 + 1.5 + 3.0, abs=0.1)
    rising = np.concatenate([tone(150, 0.12, 0.1), tone(150, 0.24, 0.3)])
    assert not H.measure_join(rising, tone(150, 0.12), rate)["settled"]
    assert H.join_cost(12, 8, 10, False) == 1.5 + 1.5 + 3.0 + 1.0 and H.join_cost(-3, 2, None, True) == 1.0


def test_echoes():
    rng = np.random.default_rng(1)
    rate = 4000
    dry = rng.normal(size=2 * rate) * (rng.random(2 * rate // 200).repeat(200) > 0.7)
    wet = dry.copy()
    wet[400:] += dry[:-400]
    got = H.echo_lag(wet, rate)
    assert got is None or got == pytest.approx(0.1, abs=0.011)
    assert H.echo_lag(np.ones(4 * rate), rate) is None and H.echo_lag(wet[:900], rate) is None
    first = [np.full(4, 10.0 * i) for i in range(30)]
    far = lambda a, b: float(np.abs(a - b).mean())
    assert H.echo_shift(first, [first[max(i - 3, 0)] for i in range(30)], far, 10) == 3
    assert H.echo_shift(first, first, far, 10) is None and H.echo_shift(first[:6], first[:6], far, 3) is None


def test_cheapest_path():
    rng = random.Random(9)
    for _ in range(30):
        costs = [[rng.random() for _ in range(rng.randint(1, 3))] for _ in range(4)]
        joins = {k: rng.random() for k in itertools.product(range(5), range(3), range(3))}
        total = lambda p: sum(costs[k][j] for k, j in enumerate(p)) + sum(joins[k, p[k - 1], p[k]] for k in range(1, 4))
        best = min(total(p) for p in itertools.product(*(range(len(c)) for c in costs)))
        assert total(Q.cheapest_path(costs, lambda k, i, j: joins[k, i, j])) == pytest.approx(best)


def test_takes_and_scores():
    takes = [["the hook goes here".split(), "and then we cut".split()], ["so hello".split(), "the um hook goes here".split(), "and then".split(), "we cut".split()]]
    rows = Q.align_takes(takes)
    spine = 1
    assert [r[spine] for r in rows] == [(k, k) for k in range(4)]
    assert rows[1][0] == (0, 0)
    a = Q.rendition_score(5, 0, 0, 0, 0.9, None)
    b = Q.rendition_score(5, 1, 0, 0, 0.9, None)
    assert Q.deciding_axis(a, b) == "fluency" and a["score"] > b["score"]
    assert Q.deciding_axis(a, a) == "near tie"


def test_diarization_error():
    ref = [("a", 0, 100), ("b", 100, 200)]
    assert Q.diarization_error(ref, [("x", 0, 100), ("y", 100, 200)]) == {"speech": 200, "missed": 0, "false": 0, "confused": 0}
    assert Q.diarization_error(ref, [("x", 0, 150), ("y", 150, 210)]) == {"speech": 200, "missed": 0, "false": 10, "confused": 50}
    assert Q.diarization_error(ref, []) == {"speech": 200, "missed": 200, "false": 0, "confused": 0}


def test_passes_and_captions():
    assert Q.count_passes([0, 1, 2, 3, 4, 5, 0, 1, 2, 3], 6) == 2
    assert Q.count_passes([], 0) == 0
    assert Q.caption_groups("a b c. d e f g h".split(), [0, 100, 200, 300, 900, 1000, 1100, 1200], [90, 190, 290, 390, 990, 1090, 1190, 1290]) == [0, 0, 0, 1, 2, 2, 2, 2]


def test_sections(spark):
    rng = random.Random(15)
    cosine = lambda a, b: sum(a[t] * b[t] for t in a) / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5 if a and b else 0.0
    texts = {"long": [rng.choice([["kettle", "hinge", "the"], ["slate", "reel", "of"], ["voice", "mixer", "hinge"]][min(i // 70, 2)]) for i in range(220)], "short": ["word"] * 60, "even": ["of"] * 130}
    df = spark.createDataFrame([(k, i, w) for k, ws in texts.items() for i, w in enumerate(ws)], "k string, idx int, word string")
    got = {}
    for r in X.cohesion_at_gaps(df, "k", 30, 50).collect():
        got[r.k, r.idx] = r.cohesion
    want = {}
    for k, ws in texts.items():
        t = [w if len(w) > 2 and w != "the" else None for w in ws]
        for i in range(30, len(ws) - 29):
            want[k, i] = cosine(collections.Counter(x for x in t[i - 30 : i] if x), collections.Counter(x for x in t[i : i + 30] if x))
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    cuts = {}
    for r in X.sections(df, "k", 3, 30).orderBy("k", "section").collect():
        cuts.setdefault(r.k, []).append(r.first_idx)
    expected = {}
    for k, ws in texts.items():
        free, chosen = sorted((round(want[k, i], 12), i) for i in range(30, len(ws) - 30) if len(ws) > 60), []
        while len(chosen) < 2 and free:
            chosen.append(free[0][1])
            free = [(s, i) for s, i in free if abs(i - chosen[-1]) >= max(len(ws) // 9, 30)]
        expected[k] = [0, *sorted(chosen)]
    assert cuts == expected and abs(cuts["long"][1] - 70) < 8 and abs(cuts["long"][2] - 140) < 8


@pytest.mark.parametrize("width", [7, 60])
def test_mix_is_the_sum_over_clips(spark, width):
    rng = random.Random(width)
    rows = []
    for i in range(40):
        s = rng.randint(0, 300)
        rows.append(("d" + str(i % 3), "a" + str(i % 2), s, s + rng.choice([0, 1, 30, 200]), rng.randint(0, 400), rng.choice([None, 0.5, 2.0])))
    want = {}
    for d, _, s, e, at, g in rows:
        for n in range(s, min(e, 450)):
            want[d, n - s + at] = want.get((d, n - s + at), 0.0) + n % 5 * (1.0 if g is None else g)
    clips = spark.createDataFrame(rows, "doc string, asset string, source_start bigint, source_end bigint, start bigint, gain double")
    samples = spark.createDataFrame([(a, n, n % 5) for a in ("a0", "a1") for n in range(450)], "asset string, n bigint, v bigint")
    assert {(r.doc, r.n): r.v for r in L.mix(clips, samples, width).collect()} == want


@pytest.mark.parametrize("width", [1, 7, 60])
def test_mix_of_odd_rows(spark, width):
    # samples far apart, repeated, before 0, without a value or a place; clips without a place, without length, before 0
    samples = [("a", -70, 1.0), ("a", -1, 2.0), ("a", 0, 3.0), ("a", 0, 4.0), ("a", 59, None), ("a", 60, 5.0), ("a", 1000, 6.0), ("a", None, 7.0), (None, 3, 8.0)]
    clips = [
        ("d", "a", -80, 61, 5, None), ("d", "a", 0, 1, 1005, 0.5), ("d", "a", 1000, 1001, -200, 2.0), ("e", "a", 59, 60, 0, 1.0), (None, "a", 60, 61, 0, 1.0),
        ("f", "a", 0, 61, None, 1.0), ("f", "a", 5, 5, 0, 1.0), ("f", "a", 9, 5, 0, 1.0), ("f", None, 0, 9, 0, 1.0), ("f", "b", 0, 9, 0, 1.0), ("f", "a", None, 9, 0, 1.0),
    ]
    want = {}
    for d, asset, s, e, at, gain in clips:
        for a, n, v in samples:
            if asset is not None and s is not None and asset == a and n is not None and s <= n < e:
                want.setdefault((d, None if at is None else n - s + at), []).append(None if v is None else v * (1.0 if gain is None else gain))
    want = {k: sum(x for x in v if x is not None) if any(x is not None for x in v) else None for k, v in want.items()}
    c = spark.createDataFrame(clips, "doc string, asset string, source_start bigint, source_end bigint, start bigint, gain double")
    got = L.mix(c, spark.createDataFrame(samples, "asset string, n bigint, v double"), width).collect()
    assert len(got) == len(want) and {(r.doc, r.n): r.v for r in got} == want


def test_timeline_mix_has_every_second(spark, data, tmp_path):
    # a recording that goes on long after its first 3000 s, over the edge of a block of samples, and a short one
    from pyspark.sql import functions as F

    from tapewright.plans.more_queries import timeline_mix
    from tapewright.sources.tables import table

    shots = [(1, "long", 10, 20), (2, "long", 2990, 3010), (3, "long", 4090, 4100), (4, "long", 9000, 9003), (5, "short", 0, 4), (6, "short", 6, 6)]
    like = table(spark, data, "shots")
    given = {"shot_id": "shot_id", "asset": "asset", "start_num": "a", "start_den": "1", "end_num": "b", "end_den": "1"}
    df = spark.createDataFrame(shots, "shot_id bigint, asset string, a bigint, b bigint")
    df.select(*[F.expr(given.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in like.schema]).write.parquet(str(tmp_path / "shots.parquet"))
    want, at = {}, {}
    for i, (_, asset, s, e) in enumerate(shots[:5]):
        gain = 0.5 if asset == "short" or i % 2 == 0 else 1.0
        for n in range(s, e):
            want[asset, at.setdefault(asset, 0)] = n % 7 * gain
            at[asset] += 1
    assert {(r.doc, r.n): r.v for r in timeline_mix(spark, str(tmp_path)).collect()} == want


def test_gates_of_the_fold(spark):
    log = "doc string, seq int, kind string, track int, asset string, a bigint, b bigint, to bigint, confidence double, placement string"
    rows = [
        ("d", 0, "addAsset", None, "x", None, 300, None, None, None),
        ("d", 1, "addTrack", None, "video", None, None, None, None, None),
        ("d", 2, "addTrack", None, "audio", None, None, None, None, None),
        ("d", 3, "place", 0, "x", 0, 100, 0, 0.9, None),
        ("d", 4, "place", 0, "x", 0, 100, 200, 0.6, None),
        ("d", 5, "place", 2, "x", 0, 100, 200, 0.9, None),
        ("d", 6, "place", 0, "y", 0, 100, 200, 0.9, None),
        ("d", 7, "place", 0, "x", 250, 350, 200, 0.9, None),
        ("d", 8, "place", 0, "x", 0, 100, 205, 0.9, None),
        ("d", 9, "place", 1, "x", 0, 103, 205, 0.9, None),
        ("d", 10, "place", 0, "x", 0, 50, 90, 0.9, None),
        ("d", 11, "placeInFrame", 0, None, 0, None, None, 0.9, "left"),
        ("d", 12, "placeInFrame", 1, None, 0, None, None, 0.9, "left"),
        ("d", 13, "placeInFrame", 0, None, 7, None, None, 0.9, "left"),
        ("d", 14, "recordDecision", None, None, None, None, None, 0.69, None),
        ("d", 15, "recordDecision", None, None, None, None, None, 0.7, None),
        ("d", 16, "ripple", 0, None, 20, 40, None, 0.9, None),
        ("d", 17, "ripple", 0, None, 40, 40, None, 0.9, None),
        ("d", 18, "ripple", 0, None, 41, 50, None, 0.9, None),
        ("d", 19, "move", 0, None, 500, 600, 0, 0.9, None),
        ("d", 20, "move", 0, None, 0, 10, 5, 0.9, None),
    ]
    df, gates = spark.createDataFrame(rows, log), C.Gates(frame=10)
    why = {r.seq: r.why for r in C.refusals(df, gates).collect()}
    assert why == {
        4: "confidence below floor", 5: "no such track", 6: "no such asset", 7: "past the end of the source", 8: "off the grid", 10: "overlaps a clip",
        12: "not a video track", 13: "no such clip", 14: "confidence below floor", 17: "empty range", 18: "off the grid", 19: "empty range", 20: "off the grid",
    }
    got = [tuple(r)[1:] for r in C.replay(df, gates=gates).orderBy("track", "clip").collect()]
    # a cut in time keeps the place in the frame
    assert got == [(0, 0, "x", 0, 20, 0, "left"), (0, 1, "x", 40, 100, 20, "left"), (1, 0, "x", 0, 103, 205, None)]


def test_captions_and_corrections_across_blocks(spark):
    rng = random.Random(13)
    rows, want_c, want_s = [], {}, {}
    for k in ("a", "b"):
        words = [rng.choice(["the", "a", "we", "cut.", "it", "then", "shot", "so!"]) for _ in range(130)]
        start = list(itertools.accumulate([rng.choice([300, 300, 700, 3500]) for _ in words]))
        rows += [(k, i, w, s, s + 200) for i, (w, s) in enumerate(zip(words, start))]
        want_c[k] = Q.caption_groups(words, start, [s + 200 for s in start])
        want_s[k] = _brute_corrections(words, start, [s + 200 for s in start])
    df = spark.createDataFrame(rows, "k string, idx int, word string, start_ms bigint, end_ms bigint")
    got = {(r.k, r.caption): (r.text, r.start_ms, r.end_ms) for r in Q.caption(df, "k", block=7).collect()}
    for k, groups in want_c.items():
        own = [r for r in rows if r[0] == k]
        for n in set(groups):
            part = [r for r, g in zip(own, groups) if g == n]
            assert got[k, n] == (" ".join(r[2] for r in part), part[0][3], part[-1][4])
    assert len(got) == sum(len(set(g)) for g in want_c.values())
    found = Q.find_self_corrections(df, "k", chunk=30).collect()
    for k, want in want_s.items():
        assert sorted(tuple(r)[1:] for r in found if r.k == k) == want


def test_diarization_errors_are_those_of_the_kernel(spark):
    rng = random.Random(14)
    turn = lambda names: (rng.choice(names), s := rng.randint(0, 300), s + rng.randint(0, 60))
    ref = {k: [turn("abc") for _ in range(12)] for k in ("x", "y")}
    hyp = {"x": [turn("pqrs") for _ in range(12)], "z": [turn("p")]}
    frame = lambda d: spark.createDataFrame([(k, *t) for k, own in d.items() for t in own] + [("x", None, 0, 9)], "k string, speaker string, start bigint, `end` bigint")
    got = {r.k: r for r in Q.diarization_errors(frame(ref), frame(hyp), "k", 20, 50).collect()}
    assert set(got) == {"x", "y"}
    for k, r in got.items():
        keep = lambda rows: [t for t in rows if t[2] > t[1]]
        want = Q.diarization_error(keep(ref[k]), keep(hyp.get(k, [])))
        assert (r.speech, r.missed, r.false_alarm) == (want["speech"], want["missed"], want["false"]) and r.confused == want["confused"]
