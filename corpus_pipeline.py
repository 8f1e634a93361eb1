"""A corpus pipeline: language ID, exact dedup, near dedup, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and reads ``docs`` whole; all but the last return the columns of documents.
``docs`` must be a table that is read the same way twice, as one in files is: its rows are numbered, and each row, of a
null or repeated id too, has its own fate. Null and empty texts have no language and go in the first stage; later
stages treat them as empty. Ties go to the smallest id, then to the first row. An empty table stays empty, very long
texts stay whole, and other columns, whatever their names, are carried along.

A stage's result is to be written before the next stage of the same folder and thread is called, as run() does: a
stage begins by removing the work tables of the one before it.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import batches_of, drop_owned, drop_path, free_name, owned, work_path, written
from quillstone.llm.exact_dedup import content_sort_dedup
from quillstone.llm.jaccard import jaccard_components
from quillstone.llm.language_id import identify
from quillstone.llm.mixing import local_order, mix
from quillstone.llm.pieces import encode, ids_digest

#: A document whose language has less than this pooled probability is rejected.
LEAST_SCORE = 0.4


def _fresh(spark: SparkSession, sf_dir: str) -> str:
    """The owner of this stage's work tables; those of the stage before are removed."""
    owner = f"pipeline {sf_dir} {threading.get_ident()}"
    drop_owned(spark, owner)
    return owner


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a column of row numbers, and its name."""
    row = free_name(docs, "row")
    return docs.withColumn(row, F.monotonically_increasing_id()), row


def _only(rows: DataFrame, row: str, stay: DataFrame) -> DataFrame:
    """Rows whose number is in the one column of ``stay``, without the number."""
    return rows.join(stay.toDF(row), row, "left_semi").drop(row)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters, or without a likely language, go."""
    with owned(_fresh(spark, sf_dir)):
        rows, row = _numbered(docs)
        found = identify(rows, row_col=row).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row")
        with batches_of(spark, 1000):  # full texts
            found = written(found, "languages")
        return _only(rows, row, found)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, one document stays: that with most code points, then the smallest id."""
    with owned(_fresh(spark, sf_dir)):
        rows, row = _numbered(docs)
        key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
        found = content_sort_dedup(rows.select(key.alias("key"), "text"), "key")
        return _only(rows, row, found.filter("kept").select("doc_id.row"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar sets of 5-word shingles (80 % or more), the one with the smallest id stays."""
    with owned(_fresh(spark, sf_dir)):
        rows, row = _numbered(docs)
        found = jaccard_components(rows, row, k=5, per=80).select(F.col("doc_id").alias("row"), "component_id")
        ids = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
        return _only(rows, row, found.join(ids, "row").groupBy("component_id").agg(first.alias("x")).select("x.row"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, shuffled inside output shards; documents it doesn't take go. A document that it takes in part, one a source at most, is a row of its own whole text."""
    with owned(_fresh(spark, sf_dir)):
        rows, row = _numbered(docs)
        shard, nth = free_name(rows, "shard"), free_name(rows, "pass")
        draws = mix(rows, row_col=row).select("row", F.explode("draws").alias("d")).select("row", "d.shard", "d.pass")
        taken = rows.join(draws.distinct().toDF(row, shard, nth), row)
        return local_order(taken, shard, nth).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's best segmentation, with its score, those of the N best, and a digest of the ids."""
    with owned(_fresh(spark, sf_dir)):
        return encode(docs).withColumn("ids_sha256", ids_digest())


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_jaccard_join", ngram_jaccard_join), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: SQL can't express the trained language model, so the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result a table in the shared folder until the next is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            drop_path(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
