"""Rules on small cases with known answers."""

from tapewright.operators import rules as R

DECISIONS = "decision bigint, kind string, `at` bigint, basis string, confidence double, supersedes bigint"


def _found(df):
    return {(r.rule, r.subject, r.mode, r.at) for r in df.collect()}


def test_sets_of_rules():
    brief = R.Brief("grave", "high")
    assert [len(R.rules_for()), len(R.rules_for(brief)), len(R.rules_for(perception=True)), len(R.rules_for(brief, True))] == [11, 15, 16, 20]


def test_a_register_forbids_devices(spark):
    d = spark.createDataFrame([(1, "whip", 2_000_000, "craft", 0.96, None), (2, "dissolve", 1, "client", 0.9, None), (3, "memeCaption", 5, "craft", 0.7, None)], DECISIONS)
    blocked = lambda register, more=(): sorted(r.subject for r in R.no_prohibited_device(d, register, more).collect())
    assert blocked("grave") == ["1", "3"] and blocked("earnest") == ["3"] and blocked("playful") == [] and blocked("neutral", ["dissolve"]) == ["2"]
    held = lambda stakes: sorted(r.subject for r in R.stakes_raise_the_bar(d, stakes).collect())
    assert held("routine") == [] and held("elevated") == ["3"] and held("high") == ["2", "3"] and held("irreversible") == ["1", "2", "3"]


def test_house_rules_name_devices(spark):
    df = spark.createDataFrame([("No ZoomPunch please, and no whip",), ("keep it calm",), ("musicbed under all",)], "rule string")
    assert [r.device for r in R.compile_brief(df, "rule").collect()] == ["whip", None, "musicBed"]


def test_a_rule_that_cannot_run_is_not_a_pass(spark):
    d = spark.createDataFrame([(1, "whip", 7, None, 0.5, None), (2, "cut", 9, "safety", 0.9, None), (3, "cut", 11, "craft", 0.8, 2)], DECISIONS)
    clips = spark.createDataFrame([("d", 0, 1, "x", 0, 400_000, 0, 400_000), ("d", 0, 2, "x", 0, 100_000, 390_000, 490_000), ("d", 0, 3, "y", 0, 400_000, 800_000, 1_200_000)], "doc string, track int, clip int, asset string, source_start bigint, source_end bigint, start bigint, `end` bigint")
    assets = spark.createDataFrame([("x", 300_000)], "asset string, duration bigint")
    docs = spark.createDataFrame([("d",), ("empty",)], "doc string")
    out = R.verify(R.rules_for(R.Brief("grave", "elevated", required=("whip", "musicBed")), True), {"decisions": d, "applied": d, "clips": clips, "assets": assets, "docs": docs, "readings": None}, spark)
    got = _found(out)
    assert {
        ("every decision has a basis", "1", "block", None),
        ("no decision below the floor", "1", "block", 7),
        ("safety is not overridden", "3", "block", 11),
        ("low confidence holds", "3", "hold", 11),
        ("clips do not overlap", "d", "block", 390_000),
        ("clips are on the grid", "d", "block", 390_000),
        ("no shot is too short", "d", "warn", 390_000),
        ("sources are within their assets", "d", "block", 0),
        ("sources are within their assets", "d", "block", 800_000),
        ("timeline is not empty", "empty", "block", None),
        ("no prohibited device", "1", "block", 7),
        ("required devices are used", "musicBed", "warn", None),
        ("loudness within target", None, "warn", None),
        ("true peak below ceiling", None, "warn", None),
        ("no cut inside a word", None, "warn", None),
    } <= got
    assert {r.rule_ord for r in out.collect()} >= {0, 8, 15, 19}
    assert not R.can_render(out, ["mode"]).where("mode = 'block'").first().can_render


def test_proposals(spark):
    from pyspark.sql import functions as F

    rows = [("smell", 5, True, 0, 1, 1), ("textContrast", 5, False, 0, 1, 1), ("textContrast", 5, True, None, 1, 1), ("textContrast", 5, True, 1_000_001, 1, 1), ("textSafeArea", 5, True, 9, 0, 1), ("subjectInFrame", 5, True, 9, 1, 0), ("subjectInFrame", 5, True, 9, 0, 1), ("textDuration", None, True, None, 0, 0)]
    df = spark.createDataFrame(rows, "kind string, `at` bigint, looked boolean, gap bigint, l int, f int")
    got = [r[0] for r in df.select(R.proposal_rejection(F.col("kind"), F.col("at"), F.col("looked"), F.col("gap"), F.col("l"), F.col("f"))).collect()]
    assert got == ["no such measurement", "not looked at", "nothing was observed", "too far from what was observed", "no text to measure", "no subject to measure", None, None]


def test_reference_differences(spark):
    schema = "doc string, band int, face double, ref_face double, faceless_run double, ref_faceless_run double, captions double, ref_captions double, label boolean, ref_label boolean"
    rows = [("same", 0, 0.3, 0.3, 2.0, 1.5, 0.6, 0.9, True, True), ("off", 0, 0.2, 0.3, 2.1, 1.5, 0.4, 0.9, False, True), ("none", 0, None, 0.3, 1.5, 0.0, None, 0.6, False, False), ("calm", 0, 0.3, None, 1.4, None, None, 0.5, False, False)]
    got = {}
    for r in R.reference_differences(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.doc, []).append(r.differs)
    assert got == {"off": ["no label", "face size", "longer without a face", "fewer captions"], "none": ["no face", "no captions"]}


def test_source_checks(spark):
    df = spark.createDataFrame([("{ return c; }",), ("}{ return c; ",), ("{ { return c; }",), ("{ c; }",), ("{ while(1) return c; }",), ("{ {} return c; {} }",)], "b string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(R.unsafe_source(F.col("b"), ["while"])).collect()] == [None, "unbalanced braces", "unbalanced braces", "no return", "forbidden: while", None]


def test_cut_instants(spark):
    clips = spark.createDataFrame([("d", 0, 0, "x", 5, 9, 0), ("d", 0, 1, "x", 20, 30, 4), ("d", 1, 0, "y", 7, 9, 3), ("d", 2, 0, "z", 1, 2, 8)], "doc string, track int, clip int, asset string, source_start bigint, source_end bigint, start bigint")
    kinds = spark.createDataFrame([("d", 0, "video"), ("d", 1, "audio"), ("d", 2, "text")], "doc string, track int, kind string")
    assert sorted((r.track, r.at, r.source_at) for r in R.cut_instants(clips, kinds).collect()) == [(0, 4, 20), (1, 3, 7)]
