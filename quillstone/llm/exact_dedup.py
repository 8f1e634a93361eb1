"""Exact dedup by content sort, in DataFrame functions only.

Splitters sampled by Spark range-partition the normalised text (its first characters, then a hash, so that
one common opening doesn't fill a partition), an external sort places equal texts side by side, and the window
operator compares each text with its neighbour in full. Groups that hold more than 1/1000 of all rows (1,000
such groups at most) are dealt over salted sub-groups; each sub-group is sorted and compared alike, and its
one summary row is merged with the others by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, SPACE, no_null


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: int = HOT_SHARE, hot_least: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty, and empty texts form a group.
    The row with most code points, then the smallest id stays; a null id comes last. Of rows that repeat the
    staying row in full, one is kept. Other columns of ``docs``, whatever their names, are not read.
    An empty table gives an empty table.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(no_null(text_col)).alias("n_code"),
        F.regexp_replace(no_null(text_col), SPACE + "+", "").alias("norm"),
    ).withColumn("h", F.xxhash64("norm"))
    least = max(hot_least, docs.count() // hot_share)
    hot = [r.h for r in rows.groupBy("h").count().filter(F.col("count") > least).select("h").collect()]
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    rows = rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("doc_id", "n_code"), F.lit(hot_share // 3))).otherwise(F.lit(0)))
    rows = rows.withColumn("opening", F.substring("norm", 1, 64)).repartitionByRange("opening", "h", "salt")
    group = Window.partitionBy("opening", "h", "salt", "norm")
    order = group.orderBy(F.desc("n_code"), F.asc_nulls_last("doc_id"))
    rows = rows.select(
        "doc_id", "h",
        F.row_number().over(order).alias("rank"),
        F.first(F.struct((-F.col("n_code")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id")).over(order).alias("best"),
        F.count(F.lit(1)).over(group).alias("n"),
        F.sha2("norm", 256).alias("text_sha256"),
        "n_code",
    )
    cold = rows.filter(~is_hot).select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rank") == 1).alias("kept"), "text_sha256")
    if not hot:
        return cold
    warm = rows.filter(is_hot)
    merged = warm.filter("rank = 1").groupBy("text_sha256").agg(F.min("best").alias("top"), F.sum("n").alias("total"))
    warm = warm.join(F.broadcast(merged), "text_sha256").select(  # a row for each hot group: 1,000 at most
        "doc_id", F.col("top.doc_id").alias("keep_id"), F.col("total").alias("group_size"),
        ((F.col("rank") == 1) & F.col("best").eqNullSafe(F.col("top"))).alias("kept"), "text_sha256",
    )
    return cold.unionByName(warm)
