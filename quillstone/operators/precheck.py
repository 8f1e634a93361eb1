"""Structure of sheets in long cells: visibility, headers, blank rows, pivot, areas over target columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import MESSAGES, TARGETS

KEY = ("path", "sheet_idx")


def visible(sheets: DataFrame) -> DataFrame:
    """Adds skipped: states other than visible, and names that begin with hidden@."""
    return sheets.withColumn("skipped", (F.coalesce("state", F.lit("visible")) != "visible") | F.lower("sheet").startswith("hidden@"))


def headers(cells: DataFrame, targets: Iterable[str] = TARGETS, key: tuple = KEY) -> DataFrame:
    """Target headers of row 1, by exact equality: the last column wins, the first sets the order; n counts them."""
    head = cells.filter((F.col("row_num") == 1) & F.col("raw").isin(*targets))
    return head.groupBy(*key, F.col("raw").alias("field")).agg(F.max("col_idx").alias("col_idx"), F.min("col_idx").alias("field_ord"), F.count(F.lit(1)).alias("n"))


def header_issues(cells: DataFrame, name: str, code: str, targets: Iterable[str] = TARGETS, key: tuple = KEY) -> DataFrame:
    """Repeated target headers, one issue for each repeat, and a name column without a code column."""
    head = cells.filter((F.col("row_num") == 1) & F.col("raw").isin(*targets))
    nth = F.row_number().over(Window.partitionBy(*key, "raw").orderBy("col_idx"))
    repeats = head.withColumn("nth", nth).filter("nth > 1").select(*key, F.col("raw").alias("field"), "col_idx", F.lit(MESSAGES["DUPLICATE"]).alias("message"))
    h = headers(cells, targets, key)
    bare = h.filter(F.col("field") == name).join(h.filter(F.col("field") == code).select(*key), list(key), "left_anti")
    return repeats.unionByName(bare.select(*key, "field", "col_idx", F.lit(MESSAGES["NO_CODE"]).alias("message")))


def filled_rows(cells: DataFrame, key: tuple = KEY) -> DataFrame:
    """Rows from 2 on in which some cell has a formula or a value; white space is a value."""
    some = F.col("formula").isNotNull() | (F.coalesce("raw", F.lit("")) != "")
    return cells.filter(F.col("row_num") >= 2).filter(some).select(*key, "row_num").distinct()


def pivoted(cells: DataFrame, heads: DataFrame, targets: Iterable[str] = TARGETS, key: tuple = KEY) -> DataFrame:
    """A row for each filled row, with a struct (coordinate, cell_type, raw, formula, number_format) for each target."""
    found = cells.filter(F.col("row_num") >= 2).join(heads.select(*key, "field", "col_idx"), [*key, "col_idx"])
    wide = found.groupBy(*key, "row_num").pivot("field", list(targets)).agg(F.first(F.struct("coordinate", "cell_type", "raw", "formula", "number_format")))
    return filled_rows(cells, key).join(heads.select(*key).distinct(), list(key), "left_semi").join(wide, [*key, "row_num"], "left")


def overlaps(regions: DataFrame, heads: DataFrame, key: tuple = KEY) -> DataFrame:
    """Areas that reach row 2 or below and cover a target's column: one row for each area and field."""
    r, h = regions.alias("r"), heads.alias("h")
    on = [F.col(f"r.{k}") == F.col(f"h.{k}") for k in key] + [F.col("h.col_idx").between(F.col("r.c1"), F.col("r.c2")), F.col("r.r2") >= 2]
    both = r.join(h, on)
    text = F.when(F.col("r.kind") == "merge", MESSAGES["MERGED"]).otherwise(MESSAGES["FORMULA_RANGE"])
    return both.select(*(F.col(f"r.{k}") for k in key), "h.field", "h.col_idx", F.greatest(F.lit(2), F.col("r.r1")).alias("row_num"), "r.kind", "r.formula", F.concat(text, F.lit("（"), F.col("r.ref"), F.lit("）")).alias("message"))
