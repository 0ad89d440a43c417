"""The folder that all executors share, and tables kept there for a while."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a local master gets a temporary one and a cluster an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="coppice-")
    context.setCheckpointDir(root)
    return root


def write_aside(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read from there, and the path for ``delete``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/coppice-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
