"""Transcripts, packing, mixing and sentences: cases, invariants and edge cases."""

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from tapewright.llm import mixing as M
from tapewright.llm import packing as P
from tapewright.llm import sentences as S
from tapewright.llm import tokens as K
from tapewright.llm import transcript_grammar as G
from tapewright.llm import turns as T
from tapewright.llm.turns import _groups_of, speaker_turns

# ---- transcripts -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "line,second,nanos,label,plain",
    [
        ("[00:00:05.220] PELLOWICK: The agent muted.", 5, 220_000_000, "pellowick", "the agent muted"),
        ("00:01:02,304 --> 00:01:03,804 MASKELIN — Nine percent", 62, 304_000_000, "maskelin", "nine percent"),
        ("Speaker 1 00:00:30,163 --> 00:00:31,663: If the", 30, 163_000_000, "speaker 1", "if the"),
        ("SPEAKER_01 [2:40]: That late hiss", 160, None, "speaker 1", "that late hiss"),
        ("<Spkr two> (26.5s) The closer", 26, 500_000_000, "speaker 2", "the closer"),
        ("(13.6s) Producer [on phone]: um, *coughs* [door (left) closes] ((crosstalk)) ♪ la la ♪ {x} <noise> so", 13, 600_000_000, "producer", "so"),
        ("  [3:23] I mm-hmm shifted uhhh... it", 203, None, None, "i shifted it"),
        ("<noise> nothing said", None, None, None, "nothing said"),
        ("Pellowick T.: [laughs] Mmm - eh?", None, None, "pellowick", ""),
        ("[0:19] Speaker 1: We go", 19, None, "speaker 1", "we go"),
        ("00:00:15,299 --> 00:00:16,799 speaker-03: so", 15, 299_000_000, "speaker 3", "so"),
        ("Speaker 2 00:04:14: Eh?", 254, None, "speaker 2", ""),
        ("S1: so", None, None, "speaker 1", "so"),
        ("just words here", None, None, None, "just words here"),
        ("[unclosed and more", None, None, None, "unclosed and more"),
        ("", None, None, None, ""),
        (None, None, None, None, ""),
    ],
)
def test_lines(line, second, nanos, label, plain):
    got = G.parse_line(line)
    assert (got.second, got.nanos, got.label, " ".join(got.plain)) == (second, nanos, label, plain)


def test_annotations_nest_and_need_not_close():
    plain = lambda t: " ".join(G.parse_line(t).plain)
    assert plain("a [b (c] d) e] f") == "a f" and plain("a [b (c) d] e") == "a e"
    assert plain("a [b (c d] e") == "a e" and plain("a (b [c) d") == "a d"
    assert plain("x *a** b*c* y ♪ la ♪ z ♪ w") == "x b y z w"
    assert plain("uhhm mmmm-hmm um-ear umm- a") == "ear a"
    # the old way of reading: every construct anew at every place
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("[](){}ab ") for _ in range(rng.randint(0, 14)))
        assert plain("x. " + text) == " ".join(["x", *regex.findall(r"[ab]+", _without_brackets(text))])


def _without_brackets(text):
    closing = {"[": "]", "(": ")", "{": "}"}

    def annotation(i):
        close, j = closing.get(text[i]), i + 1
        if close is None:
            return None
        while j < len(text):
            inner = annotation(j)
            if inner is not None:
                j = inner
            elif text[j] == close:
                return j + 1
            else:
                j += 1
        return None

    out, i = "", 0
    while i < len(text):
        end = annotation(i)
        out, i = (out + " ", end) if end is not None else (out + text[i], i + 1)
    return out


@pytest.mark.parametrize("unit", ["[", "[(", "(so <a ", "*", "* ", "♪", "uh-", "m", "a = b, ", "word "])
def test_time_of_a_line_is_in_proportion(unit):
    took = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        G.parse_line(unit * n + "x")
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 0.2


def test_rosters():
    assert G.parse_line("Voices - S1 is Host, S2 = Guest").equal == [("speaker 1", "host"), ("speaker 2", "guest")]
    assert G.parse_line("# speakers: S1 is Host").equal == [("speaker 1", "host")]
    assert G.parse_line("[0:05] Host: that is fine").equal == []


def test_labels_are_reconciled():
    g = _groups_of([("caller", 9), ("claler", 1), ("caaller", 1), ("host", 4), ("hsot", 1), ("speaker 1", 3), ("speaker 2", 3)], [("speaker 1", "host")])
    assert g["claler"] == g["caaller"] == "caller" and g["hsot"] == g["speaker 1"] == g["host"] and g["speaker 2"] == "speaker 2"


LINES = "transcript_id bigint, line_id bigint, line_no int, raw_line string"
CORRECTIONS = "correction_id bigint, transcript_id bigint, abandoned_start_num bigint, abandoned_start_den bigint, text string"


def test_turns(spark):
    lines = [
        (1, 10, 0, "Speakers: S1 is Host, S2 = Guest"),
        (1, 11, 1, "[0:05] Host: Hello there."),
        (1, 12, 2, "still me without a stamp"),
        (1, 13, 3, "[0:20] Guest: I moved"),
        (1, 14, 4, "[0:12] S1: out of order um"),
        (1, 15, 5, "[0:30] Hots (cont.): [laughs]"),
        (1, 16, 6, "[0:35] Geust: (sighs) right"),
        (1, 17, 7, "[0:40.5] Host: I moved the I moved the kettle"),
        (1, 17, 7, "[0:40.5] Host: I moved the I moved the kettle"),
        (1, 18, 8, None),
        (2, 30, 0, "nobody named"),
        (2, 31, 1, "[0:01] still nobody"),
        (2, 32, 2, "[0:02] A: one"),
        (3, 40, 0, "[0:01] A: um"),
        (None, 50, 0, "[0:01] A: lost"),
    ]
    corrections = [(1, 1, 20_400, 1000, "I moved."), (2, 1, 81, 2, "i MOVED, um, the"), (3, 1, None, 1, "x"), (4, 1, 5, 1, None), (1, 1, 20_400, 1000, "I moved.")]
    df = spark.createDataFrame(lines, LINES).withColumn("label", F.lit("x")).withColumn("speaker", F.lit("y"))
    got = speaker_turns(df.repartition(3), spark.createDataFrame(corrections, CORRECTIONS)).orderBy("transcript_id", "turn_no").collect()
    assert [(r.transcript_id, r.first_line_id, r.last_line_id, r.n_lines) for r in got] == [(1, 11, 14, 3), (1, 16, 16, 1), (1, 17, 17, 1), (2, 30, 31, 2), (2, 32, 32, 1)]
    assert got[0].text == "Hello there. still me without a stamp out of order" and got[2].text == "I moved the kettle"
    assert got[0].speaker == got[2].speaker != got[1].speaker and got[3].speaker is None


def test_turns_across_blocks(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for t in range(6):
        clock = 0
        for k in range(60):
            clock += rng.choice([0, 0, 1, 3, 30])
            stamp = rng.choice(["", f"[{clock // 60}:{clock % 60:02}] "]) if t else ""
            if rng.random() < 0.1:
                stamp = f"[0:{rng.randint(0, 59):02}] "
            who = rng.choice(["", "", "A: ", "B: "]) if t < 3 or k > 20 else ""
            rows.append((t, 100 * t + k, k, stamp + who + rng.choice(["so it went", "um", "[laughs]", "right"])))
    df, none = spark.createDataFrame(rows, LINES), spark.createDataFrame([], CORRECTIONS)
    whole = sorted(map(str, speaker_turns(df, none).collect()))
    assert len(whole) > 60
    monkeypatch.setattr(T, "SECONDS_PER_BLOCK", 7)
    monkeypatch.setattr(T, "LINES_PER_BLOCK", 4)
    assert sorted(map(str, speaker_turns(df, none).collect())) == whole
    keys = speaker_turns(df, none, text=False)
    assert "text" not in keys.columns and keys.count() == len(whole)


def test_turns_of_nothing(spark):
    assert speaker_turns(spark.createDataFrame([], LINES), spark.createDataFrame([], CORRECTIONS)).count() == 0


# ---- packing ---------------------------------------------------------------------------------------------------------


def test_shortest_pack_first():
    rng = random.Random(1)
    for _ in range(50):
        cap = rng.randint(1, 60)
        hist = {rng.randint(1, cap): rng.randint(1, 30) for _ in range(rng.randint(0, 12))}
        packs = P.shortest_pack_first(hist.items(), cap)
        placed = {}
        for pattern, count in packs:
            assert count > 0 and sum(n * k for n, k in pattern) <= cap
            for n, k in pattern:
                placed[n] = placed.get(n, 0) + k * count
        assert placed == hist
        # no two packs could be one: a length never opens a pack while an older one has room
        fills = sorted((sum(n * k for n, k in p), min(n for n, _ in p)) for p, c in packs for _ in range(c))
        assert sum(c for _, c in packs) <= sum(hist.values()) and (len(fills) < 2 or fills[0][0] + fills[1][0] > cap)


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 3, 7, 8, 20, 45, None, 0])) for i in range(400)] + [(7, 3), (None, 4), (1000, 333), (1001, 10)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens bigint").withColumn("pack_no", F.lit(1)).withColumn("length", F.lit(2))
    kinds = spark.createDataFrame([("small", 10), ("large", 64), ("large", 64), (None, 5), ("none", 0)], "container string, capacity_tokens int")
    got = P.pack(df.repartition(4), kinds).collect()
    sized = [r for r in rows if r[0] is not None and r[1]]
    for name, cap in (("small", 10), ("large", 64)):
        own = [r for r in got if r.container == name]
        assert sum(r.tokens for r in own) == sum(t for _, t in sized)
        assert len(own) == sum(-(-t // cap) for _, t in sized)
        fill = {}
        for r in own:
            fill.setdefault(r.pack_no, []).append(r)
            assert r.tokens <= cap and r.capacity == cap
        assert sorted(fill) == list(range(len(fill)))
        for rs in fill.values():
            assert sum(r.tokens for r in rs) == rs[0].fill_tokens <= cap
        pieces = {}
        for r in own:
            pieces.setdefault(r.doc_id, []).append((r.piece_no, r.token_start, r.tokens))
        for d, t in sized:
            if t > cap and [x for x, _ in sized].count(d) == 1:
                assert sorted(pieces[d]) == [(k, k * cap, min(cap, t - k * cap)) for k in range(-(-t // cap))]
    assert {r.container for r in got} == {"small", "large"}


def test_pack_across_blocks_and_in_units(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 2, 5, 9, 40, 90, 91, 250])) for i in range(700)]
    df, kinds = spark.createDataFrame(rows, "doc_id bigint, tokens bigint"), spark.createDataFrame([("a", 97), ("b", 40)], "container string, capacity_tokens int")
    whole = P.pack(df, kinds).groupBy("container").agg(F.countDistinct("pack_no").alias("n"), F.sum("tokens").alias("t")).collect()
    monkeypatch.setattr(P, "TEXTS_PER_BLOCK", 16)
    got = P.pack(df, kinds).collect()
    for r in whole:
        own = [x for x in got if x.container == r.container]
        fill = {}
        for x in own:
            fill[x.pack_no] = fill.get(x.pack_no, 0) + x.tokens
        assert len(fill) == r.n and sum(fill.values()) == r.t and all(fill[x.pack_no] == x.fill_tokens <= x.capacity for x in own)
        assert len({(x.doc_id, x.piece_no) for x in own}) == len(own)
    # a histogram that may have few entries: counted in units, whole and within the capacity
    monkeypatch.setattr(P, "MAX_ENTRIES", 30)
    for r in P.pack(df, kinds).groupBy("container", "pack_no").agg(F.sum("tokens").alias("t"), F.max("fill_tokens").alias("f"), F.max("capacity").alias("c")).collect():
        assert r.t == r.f <= r.c
    assert {r.container: r.t for r in P.pack(df, kinds).groupBy("container").agg(F.sum("tokens").alias("t")).collect()} == {r.container: r.t for r in whole}


def test_many_texts_make_few_rows():
    rng = random.Random(4)
    hist = {n: rng.randint(1, 3 * 10**9) for n in range(1, 600)}
    hist[512] = 4 * 10**10
    rows = P._places("c", P.shortest_pack_first({n: k for n, k in hist.items() if n <= 512}.items(), 512))
    assert len(rows) < 20_000
    for n in range(1, 513):
        ranges = sorted((r[2], r[2] + r[3]) for r in rows if r[1] == n)
        assert ranges[0][0] == 0 and ranges[-1][1] == hist[n] and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    width = P.block_width(max(hist.values()))
    assert sum(-(-r[3] // width) + 1 for r in rows) < 20 * P.MAX_BLOCKS and max(r[3] for r in rows) // width <= P.MAX_BLOCKS


def test_pack_of_nothing(spark):
    kinds = spark.createDataFrame([("small", 10)], "container string, capacity_tokens int")
    assert P.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), kinds).count() == 0
    assert P.pack(spark.createDataFrame([(1, 5)], "doc_id bigint, tokens bigint"), kinds.where("false")).count() == 0


def test_token_sizes(spark):
    import os

    if not os.path.exists(K.DEFAULT_TOKENIZER):
        pytest.skip("no tokenizer")
    texts = [None, "", "hello", "<|endoftext|>", "間はそのまま残す。" * 500, " ", "word " * 20_000]
    got = K.sizes(texts, K.DEFAULT_TOKENIZER)
    assert got[:3] == [0, 0, 1] and got[3] > 1 and len(got) == len(texts) and got[6] >= 20_000
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert [r.tokens for r in K.token_counts(df, ["doc_id"]).orderBy("doc_id").collect()] == got


# ---- mixing ----------------------------------------------------------------------------------------------------------


def test_pivot_keeps_tokens_and_expectation():
    items = [(i, [0.2, 0.5, 0.9][i % 3], 1 + i * i % 23 + (400 if i == 5 else 0)) for i in range(30)]
    total, hits = sum(p * s for _, p, s in items), [0.0] * 30
    for seed in range(1500):
        done, held = M.pivot_pairs(items, random.Random(f"x{seed}"))
        assert sum(done[x] * items[x][2] for x in done) + (held[1] * held[2] if held else 0) == pytest.approx(total)
        assert len(done) + (held is not None) == 30
        for x, v in done.items():
            hits[x] += v
        if held:
            hits[held[0]] += held[1]
    assert all(abs(h / 1500 - p) < 0.05 for h, (_, p, _) in zip(hits, items))
    assert M.pivot_pairs([], random.Random(1)) == ({}, None)


def test_large_texts_are_settled_against_the_rest():
    large, rest = [(0, 5000), (1, 300), (2, 200)], 10_000
    for times, most in ((0.4, 1), (1.3, 2), (0.9, 2)):
        hits, left = [0, 0, 0], 0.0
        for seed in range(3000):
            done, t = M.settle_large(large, times, most, rest + 5500, random.Random(f"y{seed}"))
            assert sum(done[x] * s for x, s in large) + t * rest == pytest.approx(times * (rest + 5500)) and 0 <= t <= most
            hits, left = [h + done[x] for x, h in enumerate(hits)], left + t
        assert all(abs(h / 3000 - times) < 0.03 for h in hits) and abs(left / 3000 - times) < 0.02
    # a text alone, or one that outweighs the others, is drawn by its own probability and leaves them as they are
    assert M.settle_large([(0, 10)], 0.5, 1, 10, random.Random(1))[1] == 0.5
    assert {M.settle_large([(0, 1000)], 0.5, 1, 1010, random.Random(i))[1] for i in range(20)} == {0.5}


def test_wanted_tokens():
    assert M.wanted_tokens({"a": (0.5, 100), "b": (0.5, 100)}, 100) == {"a": 50, "b": 50}
    # b and c are exhausted, the second only because of what the first lacks; an empty source lacks all
    got = M.wanted_tokens({"a": (0.4, 1000), "b": (0.3, 10), "c": (0.2, 22), "empty": (0.1, 0)}, 100)
    assert got == pytest.approx({"a": 68, "b": 10, "c": 22, "empty": 0})
    assert M.wanted_tokens({"a": (0.5, 7), "b": (0.5, 9)}, 100) == {"a": 7, "b": 9}
    assert M.wanted_tokens({}, 5) == {}
    rng = random.Random(3)
    for _ in range(200):
        sources = {str(i): (rng.random() + 0.01, rng.choice([0, rng.random() * 50, 1000])) for i in range(rng.randint(1, 8))}
        total = rng.random() * 200
        got = M.wanted_tokens(sources, total)
        assert sum(got.values()) == pytest.approx(min(total, sum(m for _, m in sources.values())))
        levels = {got[s] / share for s, (share, most) in sources.items() if got[s] < most - 1e-9}
        assert not levels or max(levels) == pytest.approx(min(levels))
        assert all(got[s] <= m + 1e-9 and (not levels or got[s] / share <= max(levels) + 1e-9) for s, (share, m) in sources.items())


SIZED = "doc_id bigint, source string, tokens bigint"
TARGETS = "source string, target_share double, max_repeats int"


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["A b", "a_b ", "A  B"]), rng.randint(1, 50)) for i in range(6000)]
    rows += [(40_000 + i, "Large-One", rng.randint(1, 50) if i else 9000) for i in range(9000)]
    rows += [(10_000 + i, "small", rng.randint(1, 9)) for i in range(40)] + [(20_000 + i, "other", 5) for i in range(50)]
    rows += [(30_000, None, 5), (None, "small", 5), (30_001, "small", None), (30_002, "small", 0), (10_000, "small", 3)]
    targets = [("a b", 0.5, 2), ("large one", 0.2, 3), ("small", 0.2, 4), ("absent", 0.1, 3), (None, 0.3, 1), ("zero", 0.0, 1)]
    df = spark.createDataFrame(rows, SIZED).withColumn("p", F.lit(1)).withColumn("bucket", F.lit(2))
    draw, shares = M.mix(df.repartition(3), spark.createDataFrame(targets, TARGETS))
    got = draw.collect()
    assert all(1 <= r.copies <= {"a_b": 2, "small": 4, "large_one": 3}[r.source] for r in got)
    by = {r.source: r for r in shares.collect()}
    assert set(by) == {"a_b", "large_one", "small", "absent", "zero"}
    # the tiny source is used up, the absent one lacks everything, the others make up for them in proportion
    held = sum(t or 0 for k, s, t in rows if k is not None and s not in (None, "other"))
    drawn = sum(r.tokens_drawn for r in by.values())
    assert drawn == pytest.approx(held, abs=100)
    assert by["small"].capped and by["small"].tokens_drawn == 4 * by["small"].tokens_available and by["small"].shortfall_tokens == pytest.approx(0.2 * held - by["small"].tokens_drawn, abs=50)
    assert by["absent"].capped and by["absent"].shortfall_tokens == pytest.approx(0.1 * held, abs=50) and by["absent"].actual_share == by["zero"].actual_share == 0
    rest = held - by["small"].tokens_drawn
    assert by["a_b"].tokens_drawn == pytest.approx(rest * 5 / 7, abs=50) and by["large_one"].tokens_drawn == pytest.approx(rest * 2 / 7, abs=50)
    assert not by["a_b"].capped and by["a_b"].shortfall_tokens == by["large_one"].shortfall_tokens == 0
    assert by["a_b"].tokens_drawn == sum(r.tokens * r.copies for r in got if r.source == "a_b")
    again = M.mix(df.repartition(5), spark.createDataFrame(targets, TARGETS))[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_mix_to_a_total(spark):
    rng = random.Random(5)
    rows = [(i, "a", rng.randint(1, 20)) for i in range(3000)] + [(9000 + i, "b", rng.randint(1, 20)) for i in range(60)]
    df, targets = spark.createDataFrame(rows, SIZED), spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 2)], TARGETS)
    by = {r.source: r for r in M.mix(df, targets, total_tokens=8000)[1].collect()}
    assert by["a"].tokens_drawn == pytest.approx(7200, abs=20) and by["b"].tokens_drawn == pytest.approx(800, abs=20)
    assert not by["a"].capped and not by["b"].capped
    by = {r.source: r for r in M.mix(df, targets, total_tokens=10**9)[1].collect()}
    assert by["a"].tokens_drawn == by["a"].tokens_available and by["b"].tokens_drawn == 2 * by["b"].tokens_available and by["a"].capped and by["b"].capped


def test_mix_of_nothing(spark):
    draw, shares = M.mix(spark.createDataFrame([], SIZED), spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert draw.count() == 0 and [r.actual_share for r in shares.collect()] == [0.0]
    draw, shares = M.mix(spark.createDataFrame([(1, "a", 3)], SIZED), spark.createDataFrame([], TARGETS))
    assert draw.count() == 0 and shares.count() == 0


# ---- sentences -------------------------------------------------------------------------------------------------------

# "|" marks the boundaries
CASES = [
    "The U.S. master and the E.U. master share a tape. |It faded (barely!) before the hinge.",
    "Mr. Tamvik dropped it at 00:09:26.5 exactly. |See fig. 20 for the limiter. |We lost approx. 28 frames.",
    "“Leave it. Nobody hears the splice,” said Dunhollow. |He shouted \"Stop!\" and the hallway lands.",
    "The log says 'done.' and nothing else. |Bring the slate, the tape, etc. to the drawer. |Keep the tape, etc. |At -49.8 dB it holds.",
    "Wait... and then it clips. |The fragment fades... |The rest stays. |Why the retake? is not a good opener.",
    "What happened?! |Really? |We stopped at 8 p.m. |Four percent starts.",
    "The cut is done at the turn.|It faded. |The clip take_47.mov never left. |Version 7.32.0 broke it.",
    "J. Q. Oradel recorded it. |(The chain was never muted.) |Two came.",
    "Am 3. Mai wurde neu gemischt. |Im 8. Durchgang war Brummen. |Es bleibt in Szene 7. |Das gilt z. B. für alle. |Ton, Licht usw. |Nein!",
    "I am 5. |You are 6. |The 3. |It goes on.",
    "M. Pellowick a vérifié la piste. |« Encore une prise ! » a crié Quorl. |Le plan n° 22 dure env. 1,22 s. |Quelle coupe !",
    "¿Se oye? preguntó Oradel. |La Dra. Quorl oyó un zumbido. |Véase la pág. 34 del guion. |¡Qué corte!",
    "Мы сняли это в 2028 г. заново. |Щелчки и т. д. до финала. |«Тише!» — крикнул Oradel. |Длина ок. 26 с. |См. рис. 16 в плане.",
    "Ο κ. Quorl έλεγξε το κανάλι. |Πού πήγε η παύση; |Γράφει «Κόψε εδώ. Κράτα το τέλος.» και τίποτα άλλο. |Στοπ!",
    "等等……然后再剪。|“安静一点！”她说。|他说：“先别动。”|编辑喜欢。|笔记上写着“在这里剪。保留结尾。”就没有别的了。|文件take_39.mov丢了！",
    "待って……それから切る。|「静かにして！」と誰かが言った。|メモには「ここで切る。残りは使う。」と書いてある。|本当に必要ですか？",
    "डॉ. Quorl ने ट्रैक देखा। |नोट में लिखा है \"यहाँ काटो। बाकी रखो।\" और कुछ नहीं। |रुको! |क्या यह रहेगा?",
    "د. Yevrani راجع المسار. |في الملاحظة \"اقطع هنا. احتفظ بالباقي.\" ولا شيء آخر. |هل تبقى اللقطة؟ |توقف!",
    "ช่วงเงียบลดลงหลังจากตัดต่อ |ไฟล์ take_54.mov ใช้ไม่ได้แล้วครับ |ทีมงานชอบเสียงพูด แต่แขกไม่ชอบ |หลังจาก 17 วินาที ทีมงานชอบภาพ แต่แขกไม่ชอบ |หยุดก่อน! |ภาพคงที่จนจบ",
    "ภาพคงที่จนจบ |The kettle (see p. 19) clips again. |ในรอบที่สองช่วงเงียบช้าไป 19 เฟรม |ช่วงเงียบคงที่จนจบ |编辑喜欢画面，但是嘉宾不喜欢。",
    "the first one drifts. |at -12.6 db, it drops, and e.g. the rest stays! |why not? |because it is.".replace(" |because it is.", " because it is."),
    "Heading without a mark\n\n|The body wraps\nover a line. |Then more.\n\n|- First item. Second part\n|- Another\n\n|1. One\n|2. Two",
    "HOST: It starts. |It goes on\n|GUEST: Really? |SPEAKER 2: No",
    "   ",
    "one",
    "...",
    "It ends \"here. |And is never closed. |Another one.",
    "ስላም ነው። |ደህና ነኝ።",
    "သူသွားသည်။|သူမလာပါ။",
    "ខ្ញុំទៅ។ |គាត់មក។",
    "བཀྲ་ཤིས་བདེ་ལེགས། |ཁྱེད་རང་བདེ་པོ།",
    "Բարեւ ձեզ։ |Ես լավ եմ։",
    "یہ ایک جملہ ہے۔ |یہ دوسرا ہے۔",
]


@pytest.mark.parametrize("case", CASES)
def test_sentence_cases(case):
    parts = [p.strip() for p in case.split("|") if p.strip()]
    text = case.replace("|", "")
    spans = S.sentence_spans(text)
    assert [text[a:b] for a, b in spans] == parts
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())


def test_length_of_spans_counts():
    # two short phrases are one sentence, the same space between long ones divides
    assert S.sentence_spans("สวัสดี สมชาย") == [(0, 12)]
    long = "ช่วงเงียบลดลงหลังจากตัดต่อ"
    assert S.sentence_spans(f"{long} {long}") == [(0, len(long)), (len(long) + 1, 2 * len(long) + 1)]
    # short sentences with marks stay divided, and a time goes with what follows it
    assert len(S.sentence_spans("No. Go! Why? 好。不。")) == 5
    assert S.sentence_spans(f"{long} หลังจาก 33 วินาที {long}")[0] == (0, len(long))


def test_the_best_division_is_found(monkeypatch):
    """The same programme with every start tried for every end."""
    rng = random.Random(8)
    units = ["It fades", "the long and quiet narration of the second reel goes on and on", "“", "”", "(", ")", ". ", ", ", "! ", "« ", " »", "e.g. ", "ภาพคงที่จนจบ ", "ช่วงเงียบลดลงหลังจากตัดต่อ ", "ในฉากที่ 7 ", "--- " * 60, "？", "他说：", "好", '"', " "]
    texts = ["".join(rng.choice(units) for _ in range(rng.randint(1, 120))) for _ in range(250)]
    got = [S.sentence_spans(t) for t in texts]
    monkeypatch.setattr(S, "FAR", float("inf"))
    assert got == [S.sentence_spans(t) for t in texts]


@pytest.mark.parametrize("head,unit", [("", "ภาพคงที่จนจบ ช่วงเงียบลดลงหลังจากตัดต่อ "), ("“", "It ended here. "), ("", "(so it goes. "), ("", "a.b."), ("", "! "), ("", "A_B "), ("", " "), ("", "“("), ("(“", ")”"), ("", "J. Q. "), ("", "line\n")])
def test_time_of_a_text_is_in_proportion(head, unit):
    took = []
    for n in (20_000, 160_000):
        text = head + unit * (n // len(unit))
        began = time.perf_counter()
        S.sentence_spans(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 0.2


def test_sentences_of_documents(spark):
    long = "The cut holds. " * 40_000
    rows = [(1, "One. Two."), (2, None), (3, ""), (4, " \n\t "), (5, long), (1, "Again."), (None, "No id. None.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit("x")).withColumn("start_char", F.lit(1))
    got = S.sentences(df.repartition(3), "doc_id").collect()
    assert sum(r.doc_id == 5 for r in got) == 40_000
    assert sorted(r.sentence for r in got if r.doc_id == 1) == ["Again.", "One.", "Two."]
    assert {r.doc_id for r in got} == {1, 5, None}
    assert S.sentences(df.where("false")).count() == 0
