"""Session factory and the settings that the read contract needs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that change results, so every read sets them.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the required settings to a session that someone else made."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_session(app: str = "rowsmith", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; `master` is only given on one machine."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true")
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    for key, value in {**REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def with_knobs(spark: SparkSession, concurrency: int | None = None, batch_rows: int | None = None) -> SparkSession:
    """A session of the same application for one read: about `concurrency` splits of a scan (None or below 1: as
    many as Spark takes), `batch_rows` rows to a decoded batch."""
    conf = {}
    if concurrency is not None and concurrency > 0:
        conf |= {"spark.sql.files.maxPartitionNum": str(concurrency), "spark.sql.files.minPartitionNum": str(concurrency)}
    if batch_rows is not None:
        conf["spark.sql.parquet.columnarReaderBatchSize"] = str(max(1, batch_rows))
    if not conf:
        return configure(spark)
    keep = dict(spark.conf.getAll)
    own = spark.newSession()
    for key, value in {**{k: v for k, v in keep.items() if k.startswith("spark.sql.") and own.conf.isModifiable(k)}, **REQUIRED, **conf}.items():
        own.conf.set(key, value)
    return own


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Where it is unset, a local session gets a
    folder of its own; on a cluster that is an error, since executors wouldn't see a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found
