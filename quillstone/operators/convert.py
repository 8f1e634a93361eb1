"""Conversion of wide ledger rows: candidates, issues, statistics and the all-or-nothing gate."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.codes import normalize_device_code
from ..functions.dates import with_dates
from ..model import MESSAGES
from ..sources.shared import move, remove, shared_folder
from .mapping import is_blank, lookup, unmatched

DATE_COLUMNS = ("d1", "d2", "d3")
ISSUE = ("sheet", "row_num", "phase", "field", "kind", "value", "message")


def candidates(ledger: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows with a value, and what each would become. Needs sheet, row_num, name, code, d1, d2, d3, device; d2 is numeric."""
    wide = ledger.filter(~(is_blank(F.col("name")) & is_blank(F.col("code")) & is_blank(F.col("d1")) & is_blank(F.col("d2")) & is_blank(F.col("d3")) & is_blank(F.col("device"))))
    wide = lookup(wide, mapping)
    wide = wide.withColumns({"device_new": normalize_device_code(F.col("device")), "unmatched": unmatched(wide)})
    return with_dates(wide, {f"{c}_new": {"value": F.col(c)} | ({"numeric": F.lit(True)} if c == "d2" else {}) for c in DATE_COLUMNS})


def issues(rows: DataFrame) -> DataFrame:
    """Every blocking problem of every row, in one pass: no early stop, no dedup."""
    issue = lambda phase, field, kind, value, message: F.struct(F.lit(phase).alias("phase"), F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.coalesce(value, F.lit("")).alias("value"), message.alias("message"))
    no_name = is_blank(F.col("name"))
    found = [F.when(F.col("unmatched"), issue(6, "name", "UNMATCHED", F.col("name"), F.when(no_name, MESSAGES["NO_NAME"]).otherwise(MESSAGES["UNMATCHED"])))]
    found += [F.when(F.col(f"{c}_new.status") == "YEAR_ONLY", issue(7, c, "YEAR_ONLY", F.col(c), F.lit(MESSAGES["YEAR_ONLY"]))) for c in DATE_COLUMNS]
    return rows.select("sheet", "row_num", F.explode(F.array_compact(F.array(*found))).alias("i")).select("sheet", "row_num", "i.*")


def issue_counts(issues: DataFrame) -> DataFrame:
    """How many issues there are of each kind."""
    return issues.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _sums() -> list[Column]:
    status = lambda s: sum((F.col(f"{c}_new.status") == s).cast("long") for c in DATE_COLUMNS)
    none = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return [
        F.count(F.lit(1)).alias("rows"), none(F.col("unmatched").cast("long") + status("YEAR_ONLY")).alias("issues"), F.count("mapped_code").alias("subcategory_filled"),
        none(status("OK")).alias("dates_converted"), none(status("CLEARED")).alias("dates_cleared"), F.count("device_new").alias("codes_formatted"),
    ]


def statistics(rows: DataFrame, gated: bool = True) -> DataFrame:
    """One row of counters; with any issue the four conversion counters are 0, rows stays."""
    sums = rows.agg(*_sums())
    if not gated:
        return sums
    keep = lambda c: F.when(F.col("issues") == 0, F.col(c)).otherwise(0).alias(c)
    return sums.select("rows", "issues", *map(keep, ("subcategory_filled", "dates_converted", "dates_cleared", "codes_formatted")))


def converted(rows: DataFrame) -> DataFrame:
    """The rows as they are to go out."""
    return rows.select("sheet", "row_num", "name", F.coalesce("mapped_code", "code").alias("code"), *(F.col(f"{c}_new.value").alias(c) for c in DATE_COLUMNS), F.col("device_new").alias("device"))


def publish(rows: DataFrame, path: str) -> dict[str, int]:
    """Write the converted ledger to a new folder, in one pass: rows are staged beside it while their issues and counters are observed, and the stage gets the folder's name only if nothing blocks. The counters, as statistics() gives them; with issues, nothing is left.

    Counters are those of the write that succeeded: lost tasks that run again count once.
    """
    spark, seen = rows.sparkSession, Observation()
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex[:12]}"
    converted(rows.observe(seen, *_sums())).write.parquet(staged)
    found = seen.get
    if found["issues"]:
        remove(spark, staged)
        return found | dict.fromkeys(("subcategory_filled", "dates_converted", "dates_cleared", "codes_formatted"), 0)
    try:
        move(spark, staged, path)
    except FileExistsError:
        remove(spark, staged)
        raise
    return found


def output(rows: DataFrame) -> DataFrame:
    """The converted ledger as publish() writes it into the shared folder, empty if anything blocks."""
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, "ledger")
    out = converted(rows)
    return spark.createDataFrame([], out.schema) if publish(rows, path)["issues"] else spark.read.schema(out.schema).parquet(path)


def upsert(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Cells after changes by (part, coordinate). A change with a null value clears a cell, and does nothing where there is none."""
    c, d = cells.alias("c"), changes.withColumn("changed", F.lit(True)).alias("d")
    both = c.join(d, ["part", "coordinate"], "full_outer")
    value = F.when(F.col("d.changed"), F.col("d.new_value")).otherwise(F.col("c.raw"))
    return both.filter("c.raw IS NOT NULL OR d.new_value IS NOT NULL").select("part", "coordinate", value.alias("raw"))
