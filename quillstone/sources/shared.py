"""Tables and folders that all executors share, under the folder of spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path that all executors reach. In local mode a folder is made where none is set; a cluster without one is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/quillstone/{name}-{uuid.uuid4().hex[:12]}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: what reads them several times, or after an executor is lost, finds the same."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder; an error if the new name is taken."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    files = kind(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(kind(new)) or not files.rename(kind(old), kind(new)):
        raise FileExistsError(f"{new} is taken")


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
