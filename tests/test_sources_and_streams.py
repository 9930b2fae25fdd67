"""Round trips of the stores, the layered cache, and streams against their batch forms."""

import pytest
from pyspark.sql import functions as F

from tapewright.operators import command_log as C
from tapewright.sources import stores as S
from tapewright.streaming import sessions as W


def test_rttm_round_trip(spark, tmp_path):
    rows = [("a", 0, 0, 1_500_000), ("a", 1, 1_000_000, 2_000_001), ("b", 0, 5, 5)]
    t = spark.createDataFrame(rows + [("b", None, 1, 2), (None, 1, 1, 2)], "asset string, speaker int, start_us bigint, end_us bigint")
    S.write_rttm(t, f"{tmp_path}/x")
    assert sorted(map(tuple, S.read_rttm(spark, f"{tmp_path}/x").collect())) == sorted((a, str(k), s, e) for a, k, s, e in rows)


def test_records_and_references(spark, tmp_path):
    df = spark.createDataFrame([("v", 1.5), ("w", None)], "video string, value double")
    S.append_records(df, f"{tmp_path}/j")
    S.append_records(df, f"{tmp_path}/j")
    (tmp_path / "j" / "bad.json").write_text("{nonsense\n")
    got = S.read_records(spark, f"{tmp_path}/j", "video string, value double, note string")
    assert got.where("video IS NOT NULL").count() == 4 and got.columns == ["video", "value", "note"]
    assert [r.value for r in S.malformed_records(spark, f"{tmp_path}/j", "video string, value double").collect()] == ["{nonsense"]
    (tmp_path / "x.rttm").write_text("SPEAKER a 1 0.5 1.0 <NA> <NA> 3 <NA> <NA>\nSPEAKER a 1 x 1.0 <NA> <NA> 3\nLEXEME a\n")
    assert S.read_rttm(spark, f"{tmp_path}/x.rttm").count() == 1 and S.malformed_rttm(spark, f"{tmp_path}/x.rttm").first().value.startswith("SPEAKER a 1 x")
    (tmp_path / "ref.txt").write_text("u1 THE CAT\n\nu2\n")
    assert sorted(map(tuple, S.read_references(spark, f"{tmp_path}/ref.txt").collect())) == [("u1", "THE CAT"), ("u2", "")]


def test_layer_cache(spark, tmp_path):
    assets = S.fingerprints(spark.createDataFrame([("a", 1), ("b", 2)], "asset string, size int"), "asset", "size")
    made = []

    def make(df):
        made.append(df.count())
        return df.select("fingerprint", F.lit(7).alias("x"))

    cache = S.LayerCache(spark, str(tmp_path), {"shots": "1"})
    assert cache.get("shots", assets.where("asset = 'a'"), make).count() == 1
    assert cache.get("shots", assets, make).count() == 2 and made == [1, 1]
    assert cache.get("shots", assets, make).count() == 2 and made == [1, 1]
    assert S.LayerCache(spark, str(tmp_path), {"shots": "2"}).missing("shots", assets).count() == 2
    assert cache.clear("shots") == 2 and cache.count("shots") == 0


def test_file_fingerprints(spark, tmp_path):
    import hashlib
    import os

    want = {}
    for name, size in (("small", 10), ("two", 2 << 20), ("large", (2 << 20) + 7)):
        data = os.urandom(size)
        (tmp_path / name).write_bytes(data)
        os.utime(tmp_path / name, (1_700_000_000, 1_700_000_000))
        tail = data[-(1 << 20) :] if size > 2 << 20 else b""
        want[name] = hashlib.sha256(f"{size}\x1f1700000000000\x1f".encode() + data[: 1 << 20] + tail).hexdigest()
    assert {r.path.rsplit("/", 1)[1]: r.fingerprint for r in S.file_fingerprints(spark, str(tmp_path)).collect()} == want


def test_transcripts_as_text(spark, tmp_path):
    w = spark.createDataFrame([("a", 1, "world"), ("a", 0, "hello"), ("b", 0, "x")], "k string, idx int, word string")
    S.write_transcript(w, "k", f"{tmp_path}/t")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == ["a\thello world", "b\tx"]


def _run(stream, name):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_sessions_stream_as_they_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    for i, (lo, hi) in enumerate([(0, 500), (500, 1000)]):
        e.withColumn("n", F.row_number().over(__import__("pyspark").sql.Window.orderBy("ts"))).where(f"n > {lo} AND n <= {hi}").drop("n").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    _run(W.sessions(stream, "user_id", "ts", "value"), "sessions_out")
    got = {tuple(r)[:4] for r in spark.table("sessions_out").collect()}
    want = {tuple(r)[:4] for r in W.sessions(e, "user_id", "ts", "value").collect()}
    assert got and got <= want


def test_live_documents_end_as_the_fold(spark, tmp_path):
    log = "doc string, seq bigint, kind string, track int, asset string, a bigint, b bigint, to bigint"
    one = [("d", 0, "place", 0, "x", 0, 300, 0), ("e", 0, "place", 0, "y", 0, 50, 0), ("d", 1, "place", 0, "x", 0, 10, 5)]
    two = [("d", 1, "place", 0, "x", 0, 10, 5), ("d", 2, "ripple", 0, None, 100, 160, None), ("d", 3, "move", 0, None, 0, 50, 200)]
    for i, rows in enumerate((one, two)):
        spark.createDataFrame(rows, log).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = spark.createDataFrame([], log).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    _run(W.live_documents(stream), "documents_out")
    last = {r.doc: (r.n_clips, r.length) for r in spark.table("documents_out").orderBy("seq").collect()}
    folded = C.replay(spark.createDataFrame(one + two[1:], log)).collect()
    for d in ("d", "e"):
        own = [r for r in folded if r.doc == d]
        assert last[d] == (len(own), max(r.start + r.source_end - r.source_start for r in own))
    assert [r.refused for r in spark.table("documents_out").where("doc = 'd'").orderBy("seq").collect()] == [False, True, False, False]


def test_commands_wait_for_those_before_them(spark, tmp_path):
    log = "doc string, seq bigint, kind string, track int, asset string, a bigint, b bigint, to bigint"
    batches = [
        [("d", 2, "ripple", 0, None, 100, 160, None), ("d", 0, "place", 0, "x", 0, 300, 0)],
        [("d", 3, "move", 0, None, 0, 50, 200), ("d", 0, "place", 0, "x", 0, 300, 0)],
        [("d", 1, "place", 0, "x", 0, 10, 300)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, log).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = spark.createDataFrame([], log).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    _run(W.live_documents(stream), "waiting_out")
    got = [tuple(r) for r in spark.table("waiting_out").orderBy("seq").collect()]
    assert [r[1] for r in got] == [0, 1, 2, 3] and not any(r[4] for r in got)
    whole = C.replay(spark.createDataFrame(list(dict.fromkeys(r for b in batches for r in b)), log)).collect()
    assert got[-1][2:4] == (len(whole), max(r.start + r.source_end - r.source_start for r in whole))


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_windowed_levels(spark, data, slide):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    w = W.windowed_levels(e, "ts", "event_type", "value", "1 hour", slide)
    assert w.agg(F.sum("n_events")).collect()[0][0] == e.count() * (2 if slide else 1)


def test_a_cluster_must_name_a_checkpoint_folder():
    from types import SimpleNamespace

    from tapewright.session import checkpoint_folder

    seen = []
    sc = lambda master, named=None: SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": named}, getCheckpointDir=lambda: None, setCheckpointDir=seen.append)
    session = lambda c: SimpleNamespace(sparkContext=c, conf=SimpleNamespace(get=lambda k, d: d))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            checkpoint_folder(session(sc(master)))
    assert checkpoint_folder(session(sc("yarn", "hdfs://x/y"))) == "hdfs://x/y" and seen == ["hdfs://x/y"]
    assert checkpoint_folder(session(sc("local[4]"))) == seen[-1]
