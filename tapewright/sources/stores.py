"""Sources and sinks: turns as RTTM, transcripts as text, records as JSON lines, and the layered cache of derived tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tapewright.functions.exact_time import int_div


def write_rttm(turns: DataFrame, path: str) -> None:
    """Turns (asset, speaker, start_us, end_us) as RTTM lines, one folder of text files; turns without a speaker are left out."""
    sec = lambda c: F.format_string("%d.%06d", int_div(c, F.lit(10**6)), c % 10**6)
    line = F.concat(F.lit("SPEAKER "), "asset", F.lit(" 1 "), sec(F.col("start_us")), F.lit(" "), sec(F.col("end_us") - F.col("start_us")), F.lit(" <NA> <NA> "), F.col("speaker").cast("string"), F.lit(" <NA> <NA>"))
    turns.where("asset IS NOT NULL AND speaker IS NOT NULL AND end_us >= start_us").select(line.alias("value")).write.mode("overwrite").text(path)


def _rttm(spark: SparkSession, path: str) -> DataFrame:
    p = F.split(F.trim("value"), r"\s+")
    us = lambda i: F.round(F.get(p, F.lit(i)).try_cast("decimal(20,9)") * 10**6).cast("bigint")
    return spark.read.text(path).where(F.col("value").startswith("SPEAKER ")).select("value", F.get(p, F.lit(1)).alias("asset"), us(3).alias("start_us"), us(4).alias("dur"), F.get(p, F.lit(7)).alias("speaker"))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """RTTM lines as turns; overlaps stay, lines of other kinds and malformed ones are left out (``malformed_rttm`` has those)."""
    t = _rttm(spark, path).where("start_us IS NOT NULL AND dur IS NOT NULL")
    return t.select("asset", "speaker", "start_us", (F.col("start_us") + F.col("dur")).alias("end_us"))


def malformed_rttm(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``read_rttm`` can't read: value."""
    return _rttm(spark, path).where("start_us IS NULL OR dur IS NULL").select("value")


def _records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    kind = spark.createDataFrame([], schema).schema
    return spark.read.text(path).where("trim(value) <> ''").select("value", F.from_json("value", StructType([*kind.fields, StructField("__malformed", StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__malformed"}).alias("r"))


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a fixed schema: fields that are missing are NULL, malformed lines are left out (``malformed_records`` has those)."""
    return _records(spark, path, schema).where("r.__malformed IS NULL").select("r.*").drop("__malformed")


def malformed_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The lines that ``read_records`` can't read: value."""
    return _records(spark, path, schema).where("r.__malformed IS NOT NULL").select("value")


def append_records(records: DataFrame, path: str) -> None:
    """Adds rows to a store of JSON lines (catalogue, preferences, autonomy and elicitation logs)."""
    records.write.mode("append").json(path)


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """Reference transcripts of the form "ID words …", one per line: utterance, text."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^(\S+)", 1).alias("utterance"), F.trim(F.regexp_replace("value", r"^\S+\s*", "")).alias("text")).where("utterance <> ''")


def write_transcript(words: DataFrame, key: str, path: str) -> None:
    """Words of each recording as one line of text."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ")
    words.groupBy(key).agg(said.alias("t")).select(F.concat(F.col(key).cast("string"), F.lit("\t"), "t").alias("value")).write.mode("overwrite").text(path)


class LayerCache:
    """Derived tables kept by layer and version, one row set per fingerprint.

    A layer made by another version is no hit. ``missing`` tells what has to be made; ``get`` makes only that and returns everything asked for. What is made is written
    beside the layer and renamed into it, so a reader sees all of it or nothing.
    """

    def __init__(self, spark: SparkSession, root: str, versions: dict[str, str]) -> None:
        self.spark, self.root, self.versions = spark, root.rstrip("/"), versions

    def _path(self, layer: str) -> str:
        return f"{self.root}/layer={layer}/version={self.versions[layer]}"

    def load(self, layer: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._path(layer)).drop("part")
        except Exception as e:  # no such folder yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def missing(self, layer: str, wanted: DataFrame) -> DataFrame:
        """The fingerprints of ``wanted`` that the layer doesn't hold."""
        have = self.load(layer)
        asked = wanted.select("fingerprint").distinct()
        return asked if have is None else asked.join(have.select("fingerprint").distinct(), "fingerprint", "left_anti")

    def _add(self, layer: str, made: DataFrame) -> None:
        name = uuid.uuid4().hex
        made.write.parquet(f"{self.root}/_writing/{name}")
        jvm = self.spark._jvm.org.apache.hadoop.fs
        source, target = jvm.Path(f"{self.root}/_writing/{name}"), jvm.Path(f"{self._path(layer)}/part={name}")
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(target.getParent())
        if not files.rename(source, target):
            raise OSError(f"can't rename {source} to {target}")

    def get(self, layer: str, wanted: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        todo = self.missing(layer, wanted)
        if not todo.isEmpty():
            self._add(layer, make(wanted.join(todo, "fingerprint", "left_semi")))
        have = self.load(layer)
        if have is None:
            return make(wanted.limit(0))
        return have.join(wanted.select("fingerprint").distinct(), "fingerprint", "left_semi")

    def count(self, layer: str) -> int:
        have = self.load(layer)
        return 0 if have is None else have.select("fingerprint").distinct().count()

    def clear(self, layer: str) -> int:
        """Forgets a layer's version; the number of fingerprints it held."""
        n = self.count(layer)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(layer))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return n


MIB = 1 << 20


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path and fingerprint of files: SHA-256 over their size, time of change (ms), first MiB and, if they are over 2 MiB, last MiB. Empty files have no row."""
    f = spark.read.format("binaryFile").load(path)
    size = F.col("length")
    tail = F.when(size > 2 * MIB, F.substring("content", -MIB, MIB)).otherwise(F.lit(b""))
    head = F.encode(F.concat_ws("\u001f", size.cast("string"), F.unix_millis("modificationTime").cast("string"), F.lit("")), "UTF-8")
    return f.select("path", F.sha2(F.concat(head, F.substring("content", 1, MIB), tail), 256).alias("fingerprint"))


def fingerprints(assets: DataFrame, *fields: str) -> DataFrame:
    """SHA-256 of what identifies a recording's content."""
    return assets.withColumn("fingerprint", F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in fields]), 256))
