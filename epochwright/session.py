"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "epochwright", **conf) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` keys use ``__`` for dots.

    Shuffle width is left to AQE: a high initial partition number is coalesced
    at run time by size, so one setting serves 1 GB and 100 TB. Only a caller
    who knows better (tests, local runs) passes ``spark__sql__shuffle__partitions``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    options = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # signal rows carry arrays of thousands of values: keep Arrow batches small
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    options.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets a temporary folder; a
    cluster session is refused, because executors cannot see the driver's disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="epochwright-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's part of :func:`shared_dir`."""
    return f"{_scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _scratch_dir(spark: SparkSession) -> str:
    application = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/epochwright-{application}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once their results are no longer needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, label: str = "side") -> DataFrame:
    """The smaller side of a join, with a size the planner can rely on.

    Spark broadcasts a side it estimates below its threshold. An aggregate over
    a big table is estimated as big, however few rows it yields, and the other
    side would be shuffled before the true size shows. Such a side is written
    first: then it is broadcast if it is small, without moving the large side,
    or else joined by a shuffle with skew handling.
    """
    threshold = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if estimate <= threshold else materialize(df, label)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and fixes values that must not be computed twice. A
    Parquet table survives the loss of any executor, keeps column pruning, and
    gives the planner true sizes for the joins that follow.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
