"""Intermediate tables of this subpackage, in the folder that the cluster names in spark.checkpoint.dir."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir.

    The path names its file system, so that tasks can open it too. Where the setting is unset, a local master gets a temporary folder (tests); a cluster must name a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evidloom-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/evidloom-{name}-{uuid.uuid4().hex}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: one evaluation for all consumers, a short lineage after it."""
    path = f"{shared_folder(df.sparkSession, name)}/table.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
