"""Session set-up and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "docketry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster leave ``master`` unset and let the submit command decide; AQE
    then sizes the shuffle partitions and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # call sites of every single column expression cost more than building the plan itself
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for stage tables, stream checkpoints and written files.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Where that is unset, a folder in the
    warehouse serves, which executors share as well; no folder of one machine is ever chosen.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(table: DataFrame, purpose: str) -> DataFrame:
    """Write a table that several parts of a plan read, so that it is computed once, and read it back."""
    spark = table.sparkSession
    path = work_dir(spark, purpose)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
