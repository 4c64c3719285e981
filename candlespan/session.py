"""Session settings and scratch storage shared by the bench, the tests and the queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "candlespan", master: str | None = None, shuffle_partitions: int | None = None,
                  memory: str | None = None) -> SparkSession:
    """A session with adaptive execution on and the clock pinned to UTC.

    `master`, `shuffle_partitions` and `memory` are for local runs only; on a cluster they come from spark-submit.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory:
        b = b.config("spark.driver.memory", memory)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path on the storage the cluster shares.

    `spark.checkpoint.dir` names that storage. Only where it is unset and everything runs on one machine is a temporary
    folder used; executors elsewhere could not read one, so on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="candlespan-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written once to the shared storage and read back, for plans that use them several times."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
