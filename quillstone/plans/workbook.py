"""Workbooks converted as a whole: precheck, rules, counters, the gate per workbook, rewritten packages."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import KEY as JSON_KEY
from ..functions.codes import normalize_device_code
from ..functions.dates import with_dates
from ..errors import MappingError
from ..functions.text import strip
from ..model import CODE, DATES, DEVICE, MAPPING_MESSAGES, MESSAGES, NAME, NO_BUSINESS, TARGETS
from ..operators import precheck
from ..operators.mapping import checked, fold, is_blank
from ..sources import datasource as D
from ..sources import workbook as W
from ..sources.shared import stored

KEY = ["path", "sheet_idx"]
COUNTERS = ("subcategory_filled", "dates_converted", "dates_cleared", "codes_formatted")


@dataclass
class Conversion:
    """issues in order (sheet_idx, phase, row_num, field_ord); changes of workbooks without issues; statistics, one row per workbook that has a business sheet; errors (path, message) of the others. rows and issues are tables, so that what is derived from them has a short plan."""

    rows: DataFrame
    issues: DataFrame
    changes: DataFrame
    statistics: DataFrame
    errors: DataFrame


def mapping_rows(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (sheet_idx, sheet, row_num, name, code, formula) of sheets with both headers once, and problems (sheet_idx, row_num, text) of those that repeat one."""
    heads = precheck.headers(cells, (NAME, CODE))
    both = heads.groupBy(*KEY).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("most")).filter("k = 2").drop("k")
    sheets = cells.select(*KEY, "sheet").distinct()
    twice = both.filter("most > 1").join(sheets, KEY).select("sheet_idx", F.lit(1).alias("row_num"), F.concat("sheet", F.lit("：" + MAPPING_MESSAGES["DUPLICATE"])).alias("text"))
    wide = precheck.pivoted(cells, heads.join(both.filter("most = 1"), KEY, "left_semi"), (NAME, CODE)).join(sheets, KEY)
    formula = F.col(f"{NAME}.formula").isNotNull() | F.col(f"{CODE}.formula").isNotNull()
    rows = wide.select("sheet_idx", "sheet", "row_num", F.col(f"{NAME}.raw").alias("name"), F.col(f"{CODE}.raw").alias("code"), formula.alias("formula"))
    return rows.filter("name IS NOT NULL OR code IS NOT NULL OR formula"), twice


def mapping_of(entries: DataFrame) -> DataFrame:
    """name, code of a configuration workbook's sheets with both headers (read with hidden sheets); rows with neither go."""
    return mapping_rows(W.cells(entries))[0].filter("name IS NOT NULL OR code IS NOT NULL").select("name", "code").distinct()


def mapping_messages(cells: DataFrame) -> DataFrame:
    """One row: n_pairs that the mapping accepts, and its problems in document order as one message, empty if it is sound."""
    rows, twice = mapping_rows(cells)
    at = F.concat("sheet", F.lit(" 第 "), F.col("row_num").cast("string"), F.lit(" 行："))
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    why = F.when(F.col("formula"), MAPPING_MESSAGES["FORMULA"]).when(blank("name") | blank("code"), MAPPING_MESSAGES["BLANK"])
    judged = rows.withColumn("why", why)
    folded = fold(judged.filter("why IS NULL"), ["sheet_idx", "row_num", "sheet"], at)
    plain = twice.unionByName(judged.filter("why IS NOT NULL").select("sheet_idx", "row_num", F.concat(at, F.col("why")).alias("text")))
    said = plain.unionByName(folded.select(F.explode("said").alias("x")).select("x.at.sheet_idx", "x.at.row_num", "x.text"))
    lines = said.agg(F.array_sort(F.collect_list(F.struct("sheet_idx", "row_num", "text"))).alias("lines"))
    none = F.when(F.col("n_pairs") == 0, F.array(F.lit(MAPPING_MESSAGES["NONE"]))).otherwise(F.array().cast("array<string>"))
    both = folded.select("n_pairs").crossJoin(F.broadcast(lines))  # one row each
    return both.select("n_pairs", F.array_join(F.concat(F.transform("lines", lambda x: x["text"]), none), "；").alias("message"))


def load_mapping(spark: SparkSession, source: str) -> DataFrame:
    """name, code of a configuration workbook, or a MappingError with all that is wrong with it."""
    entries = W.entries(W.files(spark, source), hidden=True).persist()
    try:
        if (bad := W.errors(entries).first()) or entries.isEmpty():
            raise MappingError(f"{MAPPING_MESSAGES['UNREADABLE']}：{posixpath.basename(bad.path if bad else source)}")
        if message := mapping_messages(W.cells(entries)).first().message:
            raise MappingError(message)
        found = mapping_of(entries)
        return spark.createDataFrame(found.collect(), found.schema)  # a dimension, of a workbook of 256 MiB at most
    finally:
        entries.unpersist()


def _rows(cells: DataFrame, top: DataFrame, heads: DataFrame, sheets: DataFrame, mapping: DataFrame) -> DataFrame:
    """A table of a row for each filled row of a business sheet, with what each target would become. ``top``: the cells of row 1. The rules, whose plan is long, are applied to a table, without an exchange."""
    spots = heads_letters(top).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("field", "at"))).alias("letters"))  # six at most
    wide = precheck.pivoted(cells, heads).join(sheets.select(*KEY, "sheet", "part", "is_1904"), KEY).join(spots, KEY)
    wide = wide.join(mapping.select(F.col("name").alias("__name"), F.col("code").alias("mapped_code")), F.col(f"{NAME}.raw") == F.col("__name"), "left").drop("__name")
    wide = stored(wide, "wide")
    formula = lambda f: F.col(f"{f}.formula").isNotNull()
    name, code = F.col(f"{NAME}.raw"), F.col(f"{CODE}.raw")
    has_name, has_code = (F.col("letters")[f].isNotNull() for f in (NAME, CODE))
    looked_up = ~formula(NAME) & ~formula(CODE)
    lost = looked_up & F.col("mapped_code").isNull() & ~(is_blank(name) & is_blank(code))
    out = {"unmatched": lost, "by_name": has_name, "fills": looked_up & F.col("mapped_code").isNotNull() & has_code, "device_new": F.when(~formula(DEVICE), normalize_device_code(F.col(f"{DEVICE}.raw"), F.col(f"{DEVICE}.cell_type") == "n", F.col(f"{DEVICE}.number_format")))}
    dated = {f"{f}_read": {"value": F.col(f"{f}.raw"), "numeric": F.col(f"{f}.cell_type") == "n", "number_format": F.col(f"{f}.number_format"), "is_1904": F.col("is_1904")} for f in DATES}
    wide = with_dates(wide, dated)
    for f in DATES:
        kind, d = F.col(f"{f}.cell_type"), F.col(f"{f}_read")
        cleared = F.struct(F.lit("CLEARED").alias("status"), F.lit(None).cast("string").alias("value"))
        d = F.when(kind.isin("b", "e", "str") & ~is_blank(F.trim(f"{f}.raw")), cleared).otherwise(d)
        out[f"{f}_new"] = F.when(F.col("letters")[f].isNotNull() & ~formula(f), d)
    return stored(wide.withColumns(out).drop(*dated), "rows")


def _at(field):
    return F.concat(F.col("letters")[field], F.col("row_num").cast("string"))


def _row_issues(rows: DataFrame) -> DataFrame:
    def issue(phase, order, field, kind, value, message):
        return F.struct(F.lit(phase).alias("phase"), F.lit(order).alias("field_ord"), field.alias("field"), _at(field).alias("coordinate"), F.lit(kind).alias("kind"), F.coalesce(value, F.lit("")).alias("value"), message.alias("message"))

    found = [F.when(F.col(f"{f}.formula").isNotNull(), issue(5, i, F.lit(f), "STRUCTURE", F.concat(F.lit("="), F.col(f"{f}.formula")), F.lit(MESSAGES["FORMULA"]))) for i, f in enumerate(TARGETS)]
    name, code = F.col(f"{NAME}.raw"), F.col(f"{CODE}.raw")
    by_name = F.col("by_name")
    said = F.when(is_blank(name), MESSAGES["NO_NAME"]).otherwise(MESSAGES["UNMATCHED"])
    found.append(F.when(F.col("unmatched"), issue(6, 0, F.when(by_name, NAME).otherwise(CODE), "UNMATCHED", F.when(by_name, name).otherwise(code), said)))
    for i, f in enumerate(DATES):
        restored = F.when((F.col(f"{f}.cell_type") == "n") & (F.col(f"{f}.number_format") == "0.00") & F.col(f"{f}.raw").rlike(r"\A[^.]{4}\.") & (F.length(f"{f}.raw") < 7), F.rpad(f"{f}.raw", 7, "0")).otherwise(F.col(f"{f}.raw"))
        found.append(F.when(F.col(f"{f}_new.status") == "YEAR_ONLY", issue(7, i, F.lit(f), "YEAR_ONLY", restored, F.lit(MESSAGES["YEAR_ONLY"]))))
    return rows.select(*KEY, "row_num", F.explode(F.array_compact(F.array(*found))).alias("i")).select(*KEY, "row_num", "i.*")


def _structure_issues(cells: DataFrame, top: DataFrame, heads: DataFrame, regions: DataFrame) -> DataFrame:
    place = lambda some: some.select(*KEY, "row_num", "col_idx", "coordinate", "raw", F.col("formula").alias("cell_formula"))
    first = precheck.header_issues(top, NAME, CODE).withColumn("row_num", F.lit(1)).join(place(top), [*KEY, "row_num", "col_idx"], "left")
    phase = F.when(F.col("message") == MESSAGES["NO_CODE"], 2).otherwise(1)
    head = first.select(*KEY, "row_num", phase.alias("phase"), F.col("col_idx").alias("field_ord"), "field", "coordinate", F.lit("STRUCTURE").alias("kind"), F.when(phase == 1, F.col("raw")).otherwise("").alias("value"), "message")
    over = precheck.overlaps(regions, heads).join(place(cells), [*KEY, "row_num", "col_idx"], "left").filter("kind = 'merge' OR cell_formula IS NULL")
    letters = heads_letters(top)
    over = over.join(letters, [*KEY, "field"])
    area = over.select(*KEY, "row_num", F.when(F.col("kind") == "merge", 3).otherwise(4).alias("phase"), F.col("col_idx").alias("field_ord"), "field", F.concat("at", F.col("row_num").cast("string")).alias("coordinate"),
                       F.lit("STRUCTURE").alias("kind"), F.when(F.col("kind") == "merge", F.coalesce("raw", F.lit(""))).otherwise(F.concat(F.lit("="), F.col("formula"))).alias("value"), "message")
    return head.unionByName(area)


def heads_letters(cells: DataFrame) -> DataFrame:
    return cells.filter((F.col("row_num") == 1) & F.col("raw").isin(*TARGETS)).groupBy(*KEY, F.col("raw").alias("field")).agg(F.max_by(F.regexp_replace("coordinate", "[0-9]+$", ""), "col_idx").alias("at"))


def convert(entries: DataFrame, mapping: DataFrame) -> Conversion:
    """Give the entries as a written table: they are read several times. A mapping that isn't one name to one code is a MappingError."""
    mapping = checked(mapping)
    few = stored(entries.filter("kind <> 'cell' OR row_num = 1"), "few")  # all but the rows below the headers
    cells, top, sheets, regions, errors = W.cells(entries), W.cells(few), W.sheets(few), W.regions(few), W.errors(few)
    heads = stored(precheck.headers(top), "heads")
    rows = _rows(cells, top, heads, sheets, mapping)
    issues = stored(_structure_issues(cells, top, heads, regions).unionByName(_row_issues(rows)).join(sheets.select(*KEY, "sheet"), KEY), "issues")
    blocked = issues.select("path").unionByName(errors.select("path")).distinct()
    change = lambda at, value: F.struct(at.alias("coordinate"), value.alias("new_value"))
    new = [F.when(F.col("fills"), change(_at(F.lit(CODE)), F.col("mapped_code")))]
    new += [F.when(F.col(f"{f}_new").isNotNull(), change(_at(F.lit(f)), F.col(f"{f}_new.value"))) for f in DATES]
    new.append(F.when(F.col("letters")[DEVICE].isNotNull() & F.col(f"{DEVICE}.formula").isNull(), change(_at(F.lit(DEVICE)), F.col("device_new"))))
    changes = rows.join(blocked, "path", "left_anti").select("path", "part", F.explode(F.array_compact(F.array(*new))).alias("c")).select("path", "part", "c.*")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    status = lambda s: sum(F.coalesce((F.col(f"{f}_new.status") == s).cast("long"), F.lit(0)) for f in DATES)
    sums = rows.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), n(F.col("fills")).alias(COUNTERS[0]), n(status("OK")).alias(COUNTERS[1]), n(status("CLEARED")).alias(COUNTERS[2]), F.count("device_new").alias(COUNTERS[3]))
    business = heads.select(KEY).distinct().withColumn("business", F.lit(True))
    listed = sheets.join(business, KEY, "left").groupBy("path").agg(*(
        F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("business", F.lit(False)) == b, F.struct("sheet_idx", "sheet")))), lambda s: s["sheet"]).alias(c) for c, b in (("sheets", True), ("skipped_sheets", False))
    )).filter(F.size("sheets") > 0).join(errors.select("path"), "path", "left_anti")
    by_path = blocked.withColumn("blocked", F.lit(True))
    stats = listed.join(sums, "path", "left").join(by_path, "path", "left")
    keep = lambda c: F.when(F.col("blocked").isNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    stats = stats.select("path", "sheets", "skipped_sheets", F.coalesce("rows", F.lit(0)).alias("rows"), *map(keep, COUNTERS), F.col("blocked").isNull().alias("success"))
    lacking = sheets_of(few).join(listed, "path", "left_anti").select("path", F.lit(NO_BUSINESS).alias("message"))
    return Conversion(rows, issues, changes, stats, errors.unionByName(lacking))


def convert_files(spark: SparkSession, source: str, mapping: str | DataFrame) -> Conversion:
    """convert() of the workbooks at a path, each sheet read by its own task and kept as a table in the shared folder.

    A mapping given as a path is loaded only if some business sheet has a name or code column.
    """
    entries = stored(D.planned(spark, source), "entries")
    if isinstance(mapping, str):
        asked = not precheck.headers(W.cells(entries), (NAME, CODE)).isEmpty()
        mapping = load_mapping(spark, mapping) if asked else spark.createDataFrame([], "name string, code string")
    return convert(entries, mapping)


def save_results(done: Conversion, folder: str, suffix: str = "_处理结果.xlsx") -> None:
    """Commit the results of workbooks that succeed, read from files, to a folder: all of them, or none."""
    D.commit_changes(stored(done.statistics.filter("success").select("path"), "paths"), done.changes, folder, suffix)


def sheets_of(entries: DataFrame) -> DataFrame:
    """Workbooks that could be read."""
    return entries.select("path").distinct().join(W.errors(entries), "path", "left_anti").select("path")


def json_results(done: Conversion) -> DataFrame:
    """path and the result as JSON: success, issues in order, sheet lists and rows, and the counters where it succeeded."""
    item = F.struct("n", "kind", "sheet", F.col("row_num").alias("row"), "field", F.col("coordinate").alias("cell"), "value", "message")
    said = ordered(done.issues).groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("issues"))
    issues = F.transform(F.coalesce("issues", F.array()), lambda i: i.dropFields("n"))
    name = F.concat(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""), F.lit("_处理结果.xlsx"))
    only = [F.when(F.col("success"), F.col(c)).alias(c) for c in COUNTERS]
    result = F.struct("success", issues.alias("issues"), "sheets", "skipped_sheets", "rows", F.when(F.col("success"), name).alias("filename"), *only)
    return done.statistics.join(said, "path", "left").select("path", F.to_json(result).alias("result"))


def ordered(issues: DataFrame) -> DataFrame:
    """Issues numbered in document order within their workbook."""
    order = Window.partitionBy("path").orderBy("sheet_idx", "phase_group", "row_key", "phase", "field_ord")
    rows = issues.withColumn("phase_group", F.least("phase", F.lit(5))).withColumn("row_key", F.when(F.col("phase") >= 5, F.col("row_num")).otherwise(0))
    return rows.withColumn("n", F.row_number().over(order)).drop("phase_group", "row_key")


def sample_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each thousand of customer keys: names, and keys to be formatted as device codes."""
    t = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("b"), F.floor(F.col("c_custkey") / 1000).cast("string")).alias("path"), "c_custkey", "c_name")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c_custkey")
        filled = [(str(k), n) for k, n in zip(rows["c_custkey"], rows["c_name"].fillna(""), strict=True)]
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "content": [W.new_package([(DEVICE, "备注"), *filled])]})

    return t.groupBy("path").applyInPandas(build, "path string, content binary")


def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the sample workbooks after conversion, read back from the rewritten packages."""
    packages = stored(sample_packages(spark, sf_dir), "packages")  # each read would build and parse all of them anew
    done = convert(stored(W.entries(packages), "entries"), spark.createDataFrame([], "name string, code string"))
    return W.cells(W.entries(results(packages, done))).select("path", "coordinate", "raw")


ROUNDTRIP_SQL = f"""WITH r AS (SELECT concat('b', CAST(c_custkey // 1000 AS VARCHAR)) AS path, c_custkey, c_name, 1 + row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey) AS n FROM customer)
SELECT path, concat('A', CAST(n AS VARCHAR)) AS coordinate, concat('{{"{JSON_KEY}":"', CAST(c_custkey AS VARCHAR), '"}}') AS raw FROM r UNION ALL SELECT path, concat('B', CAST(n AS VARCHAR)), c_name FROM r
UNION ALL SELECT DISTINCT path, 'A1', '{DEVICE}' FROM r UNION ALL SELECT DISTINCT path, 'B1', '备注' FROM r"""


def results(packages: DataFrame, done: Conversion) -> DataFrame:
    """path, content of the converted packages: only of workbooks that succeed."""
    return W.rewritten(packages.join(done.statistics.filter("success").select("path"), "path", "left_semi"), done.changes)
