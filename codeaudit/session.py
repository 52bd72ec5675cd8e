"""SparkSession construction and the shared checkpoint location.

On a cluster the session is built elsewhere and ``spark.checkpoint.dir`` points
at shared storage; we only read it.  Sessions with a local master (tests,
bench) get a fresh scratch directory when the setting is absent; on a cluster
a missing setting is an error, never a machine-local folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rule tables are tiny and constant; everything else must be size-checked
    # before a broadcast, so keep the automatic threshold at its default.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def get_spark(app: str = "codeaudit", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The lineage-cutting location: ``spark.checkpoint.dir`` from the session.
    Unset, a local master gets a fresh scratch directory and any other master
    an error, since executors could not see a folder of the driver's."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="codeaudit-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the checkpoint folder and read back, for what
    several branches of a plan would make anew."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the session's default file system, if it has
    none: what Spark takes for a shared folder must not become each executor's
    own disk where Python opens it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
