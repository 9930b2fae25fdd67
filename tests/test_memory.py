"""Queries whose exploded rows are many more than their input lets Spark believe: none of them may be sent to the driver."""

from pyspark.sql import functions as F

from tests.compare import canonical, duck


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _texts(spark, data, folder, texts, name="documents", key="doc_id"):
    from tapewright.sources.tables import table

    like = table(spark, data, name).schema
    df = spark.createDataFrame(texts, f"{key} bigint, asset string, text string")
    df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in like]).write.parquet(f"{folder}/{name}.parquet")


def test_sentence_context_sends_no_words_to_the_driver(spark, data, tmp_path):
    from tapewright.operators import wording as W
    from tapewright.plans.text_queries import text_sentence_context
    from tapewright.sources.standins import words

    _texts(spark, data, tmp_path, [(1, "a", "One two. Three four five? six"), (2, "a", "one two"), (3, None, "a b c"), (4, "b", None), (5, "b", " ".join(["w"] * 50) + ".")])
    df = text_sentence_context(spark, str(tmp_path))
    assert "Broadcast" not in _plan(df)
    rows = {(r.doc_id, r["first"]): (r["last"], r["from"], r["to"]) for r in df.collect()}
    assert {k: v for k, v in rows.items() if k[0] < 5} == {(1, 0): (2, 0, 4), (1, 1): (3, 0, 4), (1, 2): (4, 2, 5), (1, 3): (5, 2, 5), (3, 0): (2, 0, 2)}
    assert rows[5, 24] == (26, 4, 46) and len([k for k in rows if k[0] == 5]) == 48
    # the operator for any spans says the same
    w = words(spark, str(tmp_path))
    spans = w.select("doc_id", F.col("idx").alias("first"), (F.col("idx") + 2).alias("last"))
    again = W.sentence_context(w, "doc_id", spans, 20)
    assert "Broadcast" not in _plan(again)
    assert canonical(again.columns, again.collect()) == canonical(df.columns, df.collect())


def test_cuts_and_words_send_no_words_to_the_driver(spark, data, tmp_path):
    from tapewright.operators import rules as R
    from tapewright.plans.rule_queries import rule_cuts_and_words

    texts = [(d, "a", " ".join(f"{'word' * (n % 4 + 1)}{'.' if (n + d) % 9 == 0 else ''}" for n in range(400))) for d in range(4)]
    _texts(spark, data, tmp_path, texts)
    df = rule_cuts_and_words(spark, str(tmp_path))
    assert "Broadcast" not in _plan(df)
    # by brute force
    want = []
    for d, _, text in texts:
        words = []
        for i, x in enumerate(text.split()):
            s = i * 400 + i // 11 * 900 + (d * 31 + i * 17) % 90
            words.append((i, x, s, s + 120 + (len(x) * 37 + i * 11) % 180, (d * 13 + i * 7 + len(x) * 5) % 60 + 40))
        for at in {words[i][2] + 150 for i in range(1, len(words)) if words[i - 1][1].endswith(".")}:
            want += [("no cut inside a word", str(d), at, f"word {i}") for i, _, s, e, _ in words if at - s > 20 and e - at > 20]
            near = sorted((c, i) for i, _, s, e, c in words if min(abs(s - at), abs(e - at)) <= 500)
            want += [("cuts rest on confident words", str(d), at, f"word {i}") for c, i in near[:1] if c < 70]
    assert len({w[0] for w in want}) == 2
    assert sorted((r.rule, r.subject, r["at"], r.detail) for r in df.collect()) == sorted(want)
    # the edge of the reach counts
    cuts = spark.createDataFrame([("d", 1000)], "doc string, at bigint")
    far = spark.createDataFrame([("d", 0, 41, 0, 499), ("d", 1, 52, 100, 500), ("d", 2, 41, 1501, 1600)], "doc string, idx int, conf int, start bigint, end bigint")
    assert [r.detail for r in R.cuts_rest_on_confident_words(cuts, far, 500, 70, 2000).collect()] == ["word 1"]


def test_inverted_links_send_no_words_to_the_driver(spark, data, tmp_path):
    from tapewright.operators import timeline as L
    from tapewright.plans.timeline_queries import _narrative, timeline_inverted_links

    _texts(spark, data, tmp_path, [(d, "a", " ".join(["w"] * n)) for d, n in ((1, 200), (2, 61), (3, 60), (4, 1), (777, 1000))])
    df = timeline_inverted_links(spark, str(tmp_path))
    assert "Broadcast" not in _plan(df)
    at = lambda d, beat: (beat * 30 * 7919 + d) % 1000
    want = [(d, b, b, b + 2) for d, n in ((1, 200), (2, 61), (3, 60), (4, 1), (777, 1000)) for b in range((n - 1) // 30 - 1) if at(d, b + 2) < at(d, b)]
    got = sorted((r.doc, r.link, r.setup, r.payoff) for r in df.collect())
    assert got == sorted(want) and got
    # the positions of all words give the same
    w, beats, links = _narrative(spark, str(tmp_path))
    again = L.inverted_links(beats, links, w.select("doc", "idx", ((F.col("idx") * 7919 + F.col("doc")) % 1000).alias("position")))
    assert "Broadcast" not in _plan(again)
    assert sorted((r.doc, r.link, r.setup, r.payoff) for r in again.collect()) == got


def test_mix_sends_no_samples_to_the_driver(spark, data):
    from tapewright.operators import timeline as L

    clips = spark.createDataFrame([("d", "a", 0, 50, 0, None), ("d", "a", 20, 40, 10, 0.5)], "doc string, asset string, source_start bigint, source_end bigint, start bigint, gain double")
    # samples made from so few rows that Spark takes them for small
    seconds = spark.range(1).select(F.lit("a").alias("asset"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(99).cast("bigint"))).alias("n")).withColumn("v", F.col("n") % 7)
    df = L.mix(clips, seconds, 60)
    assert "Broadcast" not in _plan(df)
    want = {n: n % 7 + (0.5 * ((n + 10) % 7) if 10 <= n < 30 else 0.0) for n in range(50)}
    assert {r.n: r.v for r in df.collect()} == want
    # in the end too, when the sizes of what was shuffled are known
    assert "Broadcast" not in _plan(df)


def test_requested_removals_send_no_words_to_the_driver(spark, data, tmp_path):
    import pyarrow.parquet as pq

    from tapewright.operators import wording as W
    from tapewright.plans.text_queries import CATALOG, text_requested_removals
    from tapewright.sources.tables import table

    n_words = {1: 30, 2: 1, 3: 0, 4: 12, 5: 12}
    _texts(spark, data, tmp_path, [(d, {5: "b", 4: None}.get(d, "a"), " ".join(["word"] * n) or None) for d, n in n_words.items()])
    like = table(spark, data, "cut_plans").schema
    plans = spark.createDataFrame([(1, "a", [3, 4, 4, None, 9, -1]), (2, "a", [4, 30, 0]), (2, "a", [4, 30, 0]), (3, None, [1]), (4, "c", [1]), (5, "b", [])], "plan_id bigint, asset string, removed_words array<int>")
    plans.select(*[F.col(f.name).cast(f.dataType) if f.name in plans.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in like]).write.parquet(f"{tmp_path}/cut_plans.parquet")
    df = text_requested_removals(spark, str(tmp_path))
    assert "Broadcast" not in _plan(df)
    rows = df.collect()
    unknown = {(r.doc_id, r.idx) for r in rows if r.kind == "unknown"}
    assert unknown == {(1, -1), (1, 30), *((2, i) for i in (-1, 3, 4, 9, 30)), *((3, i) for i in (-1, 0, 3, 4, 9, 30))}
    assert {r.doc_id for r in rows if r.kind == "cut"} == {1, 2}
    # one file of each table, as the views want it
    (tmp_path / "one").mkdir()
    for t in ("documents", "cut_plans"):
        pq.write_table(table(spark, str(tmp_path), t).toArrow(), tmp_path / "one" / f"{t}.parquet")
    rel = duck(str(tmp_path / "one")).sql(CATALOG.oracle_sql()["text_requested_removals"])
    assert canonical(df.columns, rows) == canonical(rel.columns, rel.fetchall())
    # words that begin elsewhere than at 0, requested twice
    w = spark.createDataFrame([("k", i, "w", i * 100, i * 100 + 50) for i in range(5, 9)], "k string, idx int, word string, start_ms bigint, end_ms bigint")
    plan, lost = W.requested_removals(w, spark.createDataFrame([("k", 6), ("k", 6), ("k", 4), ("k", None), (None, 6)], "k string, idx int"), "k", 0.0)
    assert [(r.start_ms, r.end_ms) for r in plan.collect()] == [(550, 700)] and [(r.k, r.idx) for r in lost.collect()] == [("k", 4)]


def test_mix_moves_samples_in_arrays(spark, data, tmp_path):
    from tapewright.plans.more_queries import timeline_mix
    from tapewright.sources.tables import table

    # 40 recordings of 3000 s, each shot delivered twice, one recording with two more clips
    given = {"shot_id": "shot_id", "asset": "asset", "start_num": "a", "start_den": "1", "end_num": "b", "end_den": "1"}
    like = table(spark, data, "shots")
    rows = [(i, f"a{i}", 0, 3000) for i in range(40)] + [(40, "a0", 3010, 3020), (41, "a0", 3021, 3022)]
    df = spark.createDataFrame(rows * 2, "shot_id bigint, asset string, a bigint, b bigint")
    df.select(*[F.expr(given.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in like.schema]).write.parquet(str(tmp_path / "shots.parquet"))
    store = spark.sparkContext._jsc.sc().statusStore()

    def moved():
        # the records that were shuffled so far
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = store.stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    was = moved()
    got = {(r.doc, r.n): r.v for r in timeline_mix(spark, str(tmp_path)).collect()}
    want = {(f"a{i}", n): n % 7 * 0.5 for i in range(40) for n in range(3000)}
    want |= {("a0", 3000 + n): (3010 + n) % 7 * 1.0 for n in range(10)} | {("a0", 3010): 3021 % 7 * 0.5}
    assert got == want
    assert moved() - was < len(want) / 5
