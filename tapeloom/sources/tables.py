"""Parquet tables of a folder, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``, through Spark's own reader (any file system it knows)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A fresh path in the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session may leave it unset (tests, a laptop): a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = held.rsplit("/", 1)[0] if held else tempfile.mkdtemp(prefix="tapeloom-")
        if not held:
            spark.sparkContext.setCheckpointDir(base)
    path = f"{base}/tapeloom-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Paths handed out, by application.
_MADE: dict[str, list[str]] = {}


def clear_work(spark: SparkSession) -> int:
    """Delete what this application has written to the shared folder, through Spark's own file systems; results that still read from there have to be kept before. Gives the number of folders."""
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
        system = parent.getFileSystem(conf)
        for found in system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}*")) or []:  # a note may follow the name
            gone += bool(system.delete(found.getPath(), True))
    return gone


def written(df: DataFrame, note: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, outlives lost executors."""
    path = f"{work_dir(df.sparkSession)}-{note}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
