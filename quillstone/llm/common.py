"""Shared helpers: the cluster's shared folder, cut lineage, and byte-level text rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: blank, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: A word of the text contracts.
WORD = r"[^\x20\x09-\x0D]+"
#: No more than this many keys can each hold more than 1/HOT_SHARE of all rows.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: that of spark.checkpoint.dir, or the context's. In local mode one is made where there is none; a cluster without one is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_owner: ContextVar[str | None] = ContextVar("owner", default=None)
#: Paths of work tables by owner.
_made: dict[str, list[str]] = {}


@contextmanager
def owned(owner: str):
    """Work tables made meanwhile are the owner's, and go with drop_owned()."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. What has no owner stays as long as the folder: results that are lazy still read it."""
    path = f"{shared_dir(spark)}/quillstone/{name}-{uuid.uuid4().hex[:12]}"
    if owner := _owner.get():
        _made.setdefault(owner, []).append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_owned(spark: SparkSession, owner: str) -> None:
    """Remove an owner's work tables; its results that still read them must have been written before."""
    for path in _made.pop(owner, []):
        drop_path(spark, path)


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Large rows go to Python tasks in batches of so many, in what is executed meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def no_null(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def bucket_of(column: Column) -> Column:
    """crc32 of the id written as text, unsigned."""
    return F.crc32(column.cast("string").cast("binary"))


def byte_slices(values: list, limit: int = 1 << 21):
    """Consecutive (start, end) slices of a list of bytes, of about ``limit`` bytes each, one value at least."""
    start, held = 0, 0
    for i, v in enumerate(values):
        if held and held + len(v) > limit:
            yield start, i
            start, held = i, 0
        held += len(v) + 1
    if start < len(values):
        yield start, len(values)
