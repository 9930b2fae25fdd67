"""Session set-up and the one place where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on; the rest is the cluster's business.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "tapewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the semantic settings; ``conf`` adds to or overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints: ``spark.checkpoint.dir`` if the cluster names one.

    Only where it is unset and everything runs on this machine (tests, a laptop) a local temporary folder is used. On a cluster
    without the setting this is an error: each executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tapewright-checkpoint-")
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder.

    A reliable checkpoint: it survives the loss of any executor, unlike a cached or locally
    checkpointed table.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
