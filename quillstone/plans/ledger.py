"""A ledger derived from the driver's orders, the same in Spark and in DuckDB, and the queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import normalize_device_code
from ..functions.dates import normalize_native_date, with_dates
from ..model import CODE, DATES, DEVICE, MESSAGES, NAME
from ..operators import convert, mapping, precheck

#: Both engines read this. :day: is the order date as yyyy-MM-dd, :days: counts days from 1899-12-30.
LEDGER = """
SELECT concat('S', CAST(k % 3 AS STRING)) AS sheet, k AS row_num,
 CASE k % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat(' ', o_orderpriority) WHEN 3 THEN 'UNKNOWN' ELSE o_orderpriority END AS name,
 CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'old' END AS code,
 CASE k % 12 WHEN 0 THEN day WHEN 1 THEN replace(day, '-', '/') WHEN 2 THEN replace(day, '-', '.') WHEN 3 THEN substr(day, 1, 7) WHEN 4 THEN substr(day, 1, 4) WHEN 5 THEN concat(substr(day, 1, 4), '.00')
  WHEN 6 THEN concat(substr(day, 1, 4), '-13-01') WHEN 7 THEN concat(substr(day, 1, 7), '/', substr(day, 9, 2)) WHEN 8 THEN '  ' WHEN 9 THEN NULL WHEN 10 THEN concat(day, 'T09:30:00') ELSE replace(day, '-', '') END AS d1,
 CASE k % 6 WHEN 0 THEN CAST(days AS STRING) WHEN 1 THEN concat(CAST(days AS STRING), '.75') WHEN 2 THEN concat(substr(day, 1, 4), '.', substr(day, 6, 2)) WHEN 3 THEN CAST(k % 70 AS STRING) WHEN 4 THEN 'x' ELSE NULL END AS d2,
 CASE WHEN k % 5 = 0 THEN concat(' ', day, ' ') END AS d3,
 CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN ' / ' WHEN 2 THEN 'Null' WHEN 3 THEN concat('A"B\\\\C', CAST(k AS STRING)) WHEN 4 THEN concat('{"注册代码":"', CAST(o_custkey AS STRING), '"}') WHEN 5 THEN '{"注册代码":"/"}' WHEN 6 THEN concat('000', CAST(o_custkey AS STRING)) ELSE CAST(o_custkey AS STRING) END AS device
FROM (SELECT o_orderkey AS k, o_custkey, o_orderpriority, :day: AS day, :days: AS days FROM orders) AS o
"""
DUCK_LEDGER = LEDGER.replace(":day:", "strftime(o_orderdate, '%Y-%m-%d')").replace(":days:", "date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE))").replace("\\\\", "\\").replace("STRING", "VARCHAR")
MAPPING = [("1-URGENT", "C-1"), ("2-HIGH", "C-2"), ("3-MEDIUM", "C-3"), ("4-NOT SPECIFIED", "C-4")]
DUCK_MAPPING = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}')" for n, c in MAPPING) + ") AS t(name, mapped_code)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt by their key: a file's row groups can't be split, and a large table in a few of them would keep as many cores busy, whatever is done to each row. The number is given, as else small shuffles are put together again."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, F.col(key))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(table(spark, sf_dir, "orders"), "o_orderkey").createOrReplaceTempView("ledger_orders")
    sql = LEDGER.replace(":day:", "date_format(o_orderdate, 'yyyy-MM-dd')").replace(":days:", "datediff(o_orderdate, DATE '1899-12-30')")
    return spark.sql(sql.replace("FROM orders", "FROM ledger_orders"))


def clean_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that nothing blocks."""
    return ledger(spark, sf_dir).filter(f"name IN ({', '.join(repr(n) for n, _ in MAPPING)}) AND row_num % 12 NOT IN (4, 5)")


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAPPING, "name string, code string")


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.candidates(ledger(spark, sf_dir), dimension(spark))


def _dated(df: DataFrame, key: str, value, **more) -> DataFrame:
    return with_dates(df.select(key, value.alias("v")), {"d": {"value": F.col("v")} | more}).select(key, "d.status", "d.value")


def header_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long cells: a sheet for each region, nations' names cut to two letters as headers, and data rows below."""
    n = table(spark, sf_dir, "nation")
    head = n.select(F.lit("b").alias("path"), F.col("n_regionkey").alias("sheet_idx"), F.lit(1).alias("row_num"), F.col("n_nationkey").alias("col_idx"), F.concat(F.lit("H"), (F.col("n_nationkey") % 4).cast("string")).alias("raw"))
    body = n.crossJoin(F.broadcast(spark.range(2, 6).toDF("r"))).select(F.lit("b").alias("path"), F.col("n_regionkey").alias("sheet_idx"), F.col("r").cast("int").alias("row_num"), F.col("n_nationkey").alias("col_idx"), F.when((F.col("n_nationkey") + F.col("r")) % 3 == 0, F.col("n_name")).when(F.col("r") == 4, " ").alias("raw"))
    cells = head.unionByName(body).withColumn("coordinate", F.concat_ws("-", "row_num", "col_idx")).withColumn("cell_type", F.lit("s")).withColumn("number_format", F.lit(""))
    return cells.withColumn("formula", F.when((F.col("row_num") == 5) & (F.col("col_idx") == 7), "1+1"))


H = ("H0", "H1", "H2")
DUCK_CELLS = """WITH cells AS (SELECT n_regionkey AS sheet_idx, 1 AS row_num, n_nationkey AS col_idx, concat('H', CAST(n_nationkey % 4 AS VARCHAR)) AS raw, NULL AS formula FROM nation UNION ALL
SELECT n_regionkey, r, n_nationkey, CASE WHEN (n_nationkey + r) % 3 = 0 THEN n_name WHEN r = 4 THEN ' ' END, CASE WHEN r = 5 AND n_nationkey = 7 THEN '1+1' END FROM nation, (VALUES (2), (3), (4), (5)) AS v(r)),
heads AS (SELECT sheet_idx, raw AS field, max(col_idx) AS col_idx, min(col_idx) AS field_ord, count(*) AS n FROM cells WHERE row_num = 1 AND raw IN ('H0', 'H1', 'H2') GROUP BY 1, 2)
"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.lit("b").alias("path"), (F.col("l_orderkey") % 5).cast("int").alias("sheet_idx"), F.when(F.col("l_orderkey") % 2 == 0, "merge").otherwise("formula").alias("kind"), F.concat(F.lit("R"), F.col("l_orderkey").cast("string")).alias("ref"), (F.col("l_partkey") % 25).cast("int").alias("c1"), (F.col("l_partkey") % 25 + F.col("l_suppkey") % 4).cast("int").alias("c2"), (F.col("l_suppkey") % 3).cast("int").alias("r1"), (F.col("l_suppkey") % 3 + F.col("l_partkey") % 3).cast("int").alias("r2"), F.lit(None).cast("string").alias("formula"))


DUCK_REGIONS = """, regions AS (SELECT l_orderkey % 5 AS sheet_idx, CASE WHEN l_orderkey % 2 = 0 THEN 'merge' ELSE 'formula' END AS kind, concat('R', CAST(l_orderkey AS VARCHAR)) AS ref, l_partkey % 25 AS c1, l_partkey % 25 + l_suppkey % 4 AS c2, l_suppkey % 3 AS r1, l_suppkey % 3 + l_partkey % 3 AS r2 FROM lineitem)
"""


def changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    cells = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderstatus").alias("part"), F.col("o_orderkey").cast("string").alias("coordinate"), F.col("o_orderpriority").alias("raw"))
    new = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderstatus").alias("part"), F.col("o_orderkey").cast("string").alias("coordinate"), F.when(F.col("o_orderkey") % 5 != 0, F.lit("new")).alias("new_value"))
    return cells, new


def bad_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 97 == 0, " ").otherwise(F.concat(F.lit("n"), (F.col("p_partkey") % 50).cast("string"))).alias("name"), F.concat(F.lit("c"), (F.col("p_partkey") % 75).cast("string")).alias("code"))


def named_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat(' ', p_type) ELSE p_type END AS name"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'old' END AS code"))


def type_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.concat(F.lit("C-"), F.upper("p_type")).alias("code")).distinct().filter("name <> 'ECONOMY' AND name NOT LIKE 'STANDARD%'")


def fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("n"), (F.col("n_nationkey") % 5).cast("string")).alias("name"), F.concat(F.lit("c"), (F.col("n_nationkey") % 10).cast("string")).alias("code"))


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping of parts in which every pair conflicts with others: 211 names and 173 codes, dealt by the key's square and cube."""
    return table(spark, sf_dir, "part").select("p_partkey", F.expr("concat('n', (p_partkey * p_partkey + 3 * p_partkey) % 211) AS name"), F.expr("concat('c', (p_partkey * p_partkey * p_partkey + p_partkey) % 173) AS code"))


#: Forms of a time by event; the last three: a character before the zone, a separator that stops, digits of another script.
ISO_FORMS = """CASE event_id % 8 WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm') WHEN 2 THEN date_format(ts, "yyyy-MM-dd'T24:00:00'") WHEN 3 THEN date_format(ts, "yyyyMMdd'x'HHmm") WHEN 4 THEN date_format(ts, "yyyy-MM-dd'T'")
 WHEN 5 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm' Z'") WHEN 6 THEN date_format(ts, "yyyy-MM-dd'T'HH:mmss") ELSE translate(date_format(ts, 'yyyy/MM/dd'), '0123456789', '٠١٢٣٤٥٦٧٨٩') END"""
#: JSON texts by customer: an escaped key, a repeated key, another key beside it, a value that is no string, an inner sentinel, digits of another script as a number.
JSON_FORMS = """CASE c_custkey % 6 WHEN 0 THEN concat('{"', chr(92), 'u6ce8册代码" : "', c_name, '"}') WHEN 1 THEN concat('{"注册代码":"x","注册代码":"', c_name, '"}') WHEN 2 THEN concat('{"注册代码":"x","b":"', c_name, '"}') WHEN 3 THEN concat('{"注册代码":', CAST(c_custkey AS STRING), '}')
 WHEN 4 THEN '{"注册代码":" NULL "}' ELSE translate(CAST(c_custkey AS STRING), '0123456789', '０１２３４５６７８９') END"""


QUERIES = {
    "date_text_normalize": lambda s, d: _dated(ledger(s, d), "row_num", F.col("d1")),
    "date_year_only_issues": lambda s, d: convert.issues(converted(s, d)).filter("kind = 'YEAR_ONLY'").select("row_num", "field", "value", "message"),
    "date_iso_datetime": lambda s, d: _dated(spread(table(s, d, "events"), "event_id").withColumn("t", F.expr(ISO_FORMS)), "event_id", F.col("t")),
    "date_serial_1900": lambda s, d: _dated(ledger(s, d), "row_num", F.col("d2"), numeric=F.lit(True)),
    "date_serial_1904": lambda s, d: _dated(ledger(s, d), "row_num", F.col("d2"), numeric=F.lit(True), is_1904=F.lit(True)),
    "date_numeric_year_month": lambda s, d: _dated(spread(table(s, d, "orders"), "o_orderkey").withColumn("v", F.expr("CASE o_orderkey % 3 WHEN 0 THEN concat(year(o_orderdate), '.1') WHEN 1 THEN concat(year(o_orderdate), '.0') ELSE concat(year(o_orderdate) / 1000D, 'E3') END")), "o_orderkey", F.col("v"), numeric=F.lit(True), number_format=F.lit("0.00")),
    "device_code_wrap": lambda s, d: ledger(s, d).select("row_num", normalize_device_code(F.col("device")).alias("json")),
    "device_code_idempotent": lambda s, d: ledger(s, d).select("row_num", normalize_device_code(normalize_device_code(F.col("device"))).alias("json")),
    "device_code_json_forms": lambda s, d: spread(table(s, d, "customer"), "c_custkey").withColumn("v", F.expr(JSON_FORMS)).select("c_custkey", normalize_device_code(F.col("v"), F.col("c_custkey") % 6 == 5).alias("json")),
    "device_code_numeric_format": lambda s, d: spread(table(s, d, "customer"), "c_custkey").select("c_custkey", normalize_device_code(F.expr("CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey AS STRING) WHEN 1 THEN concat(c_custkey, '.50') ELSE concat(c_custkey, 'E+25') END"), F.lit(True), F.lit("000000")).alias("json")),
    "category_lookup": lambda s, d: mapping.lookup(named_parts(s, d), type_mapping(s, d)),
    "category_unmatched": lambda s, d: (lambda m: m.filter(mapping.unmatched(m)).select("p_partkey", F.coalesce("name", F.lit("")).alias("value"), F.when(mapping.is_blank(F.col("name")), MESSAGES["NO_NAME"]).otherwise(MESSAGES["UNMATCHED"]).alias("message")))(mapping.lookup(named_parts(s, d), type_mapping(s, d))),
    "mapping_validation": lambda s, d: mapping.problems(bad_mapping(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key")),
    "header_discovery": lambda s, d: precheck.headers(header_cells(s, d), H).select("sheet_idx", "field", "col_idx", "field_ord", "n"),
    "header_issues": lambda s, d: precheck.header_issues(header_cells(s, d), "H0", "H9", H).select("sheet_idx", "field", "col_idx", "message"),
    "sheet_visibility": lambda s, d: precheck.visible(table(s, d, "nation").select(F.expr("CASE WHEN n_nationkey % 4 = 0 THEN concat('Hidden@', n_name) ELSE n_name END AS sheet"), F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'visible' WHEN 1 THEN 'veryHidden' END AS state"))).select("sheet", "skipped"),
    "blank_row_filter": lambda s, d: precheck.filled_rows(header_cells(s, d)).select("sheet_idx", "row_num"),
    "pivot_target_fields": lambda s, d: (lambda c: precheck.pivoted(c, precheck.headers(c, H), H).select("sheet_idx", "row_num", *(F.col(f"{h}.raw").alias(h.lower()) for h in H)))(header_cells(s, d)),
    "merged_region_overlap": lambda s, d: precheck.overlaps(regions(s, d), precheck.headers(header_cells(s, d), H)).select("sheet_idx", "field", "row_num", "message"),
    "all_issues": lambda s, d: convert.issues(converted(s, d)),
    "conversion_stats": lambda s, d: convert.statistics(converted(s, d)).unionByName(convert.statistics(convert.candidates(clean_ledger(s, d), dimension(s)))),
    "gated_output": lambda s, d: convert.output(convert.candidates(clean_ledger(s, d), dimension(s))).unionByName(convert.output(converted(s, d))),
    "changes_upsert": lambda s, d: convert.upsert(*changes(s, d)),
    "mapping_fold_messages": lambda s, d: mapping.fold(fold_rows(s, d), "n_nationkey").drop("said"),
    "mapping_fold_parts": lambda s, d: mapping.fold(part_rows(s, d), "p_partkey").drop("said"),
    "mapping_rejections": lambda s, d: mapping.rejections(part_rows(s, d), "p_partkey")[1].select("at.p_partkey", "name", "code", "kind"),
    "issue_counts": lambda s, d: convert.issue_counts(convert.issues(converted(s, d))),
    "date_native": lambda s, d: table(s, d, "events").select("event_id", normalize_native_date(F.col("ts")).alias("d")).select("event_id", "d.status", "d.value"),
}

#: Dates of the derived ledger in DuckDB: status and value of d1 and d2 by row.
_D1 = """CASE k12 WHEN 4 THEN 'YEAR_ONLY' WHEN 5 THEN 'YEAR_ONLY' WHEN 6 THEN 'CLEARED' WHEN 7 THEN 'CLEARED' WHEN 8 THEN 'BLANK' WHEN 9 THEN 'BLANK' ELSE 'OK' END AS status,
CASE WHEN k12 IN (0, 1, 2, 10) THEN replace(replace(substr(d1, 1, 10), '/', '-'), '.', '-') WHEN k12 = 3 THEN concat(d1, '-01') WHEN k12 = 11 THEN concat(substr(d1, 1, 4), '-', substr(d1, 5, 2), '-', substr(d1, 7, 2)) END AS value"""


def _d2(epoch: str) -> str:
    low = "'1904-01-01'" if epoch == "1904-01-01" else "NULL"
    bump = "" if epoch == "1904-01-01" else " + CASE WHEN x < 60 THEN 1 ELSE 0 END"
    day = f"strftime(DATE '{epoch}' + CAST(floor(x) AS INTEGER){bump}, '%Y-%m-%d')"
    value = f"CASE WHEN k6 = 2 THEN concat(replace(d2, '.', '-'), '-01') WHEN x IS NULL THEN NULL WHEN x < 1 THEN {low} ELSE {day} END"
    return f"SELECT row_num, d2, k6, {value} AS value FROM (SELECT row_num, d2, row_num % 6 AS k6, CASE WHEN row_num % 6 IN (0, 1, 3) THEN CAST(d2 AS DOUBLE) END AS x FROM ledger)"


_WITH = f"WITH ledger AS ({DUCK_LEDGER}), mapping AS ({DUCK_MAPPING})"
_JSON = """CASE row_num % 8 WHEN 3 THEN concat('{"注册代码":"A\\"B\\\\C', CAST(row_num AS VARCHAR), '"}') WHEN 4 THEN device WHEN 6 THEN concat('{"注册代码":"', device, '"}') WHEN 7 THEN concat('{"注册代码":"', device, '"}') END"""
_UNMATCHED = "(coalesce(name, '') <> '' OR coalesce(code, '') <> '') AND mapped_code IS NULL"
_WIDE = _WITH + f""", one AS (SELECT row_num, {_D1} FROM (SELECT *, row_num % 12 AS k12 FROM ledger)), two AS ({_d2('1899-12-30')}),
wide AS (SELECT l.sheet, l.row_num, l.name, l.code, l.d1, l.d2, l.d3, m.mapped_code, one.status AS s1, one.value AS v1, CASE WHEN l.d2 IS NULL THEN 'BLANK' WHEN two.value IS NULL THEN 'CLEARED' ELSE 'OK' END AS s2, two.value AS v2, trim(l.d3) AS v3, {_JSON.replace('row_num', 'l.row_num').replace('device', 'l.device')} AS json
FROM ledger l LEFT JOIN mapping m ON l.name = m.name JOIN one ON one.row_num = l.row_num JOIN two ON two.row_num = l.row_num
WHERE coalesce(l.name, '') <> '' OR coalesce(l.code, '') <> '' OR coalesce(l.d1, '') <> '' OR l.d2 IS NOT NULL OR l.d3 IS NOT NULL OR l.device IS NOT NULL)"""
_ISSUES = f"""SELECT sheet, row_num, 6 AS phase, 'name' AS field, 'UNMATCHED' AS kind, coalesce(name, '') AS value, CASE WHEN coalesce(name, '') = '' THEN '{MESSAGES["NO_NAME"]}' ELSE '{MESSAGES["UNMATCHED"]}' END AS message FROM wide WHERE {_UNMATCHED}
UNION ALL SELECT sheet, row_num, 7, 'd1', 'YEAR_ONLY', d1, '{MESSAGES["YEAR_ONLY"]}' FROM wide WHERE s1 = 'YEAR_ONLY'"""
_PARTS = """WITH rows AS (SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat(' ', p_type) ELSE p_type END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'old' END AS code FROM part),
mapping AS (SELECT DISTINCT p_type AS n, concat('C-', upper(p_type)) AS mapped_code FROM part WHERE p_type <> 'ECONOMY' AND p_type NOT LIKE 'STANDARD%')"""
_CLEAN = "mapped_code IS NOT NULL AND row_num % 12 NOT IN (4, 5)"
_COUNTS = "count(*) AS rows, CAST(0 AS BIGINT) AS issues, count(mapped_code) AS subcategory_filled, sum(CASE WHEN s1 = 'OK' THEN 1 ELSE 0 END + CASE WHEN s2 = 'OK' THEN 1 ELSE 0 END + CASE WHEN v3 IS NOT NULL THEN 1 ELSE 0 END) AS dates_converted, sum(CASE WHEN s1 = 'CLEARED' THEN 1 ELSE 0 END + CASE WHEN s2 = 'CLEARED' THEN 1 ELSE 0 END) AS dates_cleared, count(json) AS codes_formatted"

#: The greedy fold, row by row: names and codes taken so far, and what each row says.
_FOLD = """WITH RECURSIVE r AS (:rows:),
f AS (SELECT CAST(0 AS BIGINT) AS i, MAP([]::VARCHAR[], []::VARCHAR[]) AS names, MAP([]::VARCHAR[], []::VARCHAR[]) AS codes, '' AS said UNION ALL
SELECT r.i, CASE WHEN names[name] IS NULL AND codes[code] IS NULL THEN map_concat(names, MAP([name], [code])) ELSE names END,
CASE WHEN names[name] IS NULL AND codes[code] IS NULL THEN map_concat(codes, MAP([code], [name])) ELSE codes END,
CASE WHEN names[name] IS NOT NULL THEN CASE WHEN names[name] = code THEN '' ELSE 'MANY_CODES' END WHEN codes[code] IS NOT NULL THEN 'MANY_NAMES' ELSE '' END FROM f JOIN r ON r.i = f.i + 1)"""
_FOLDED = """ SELECT CAST(max(cardinality(names)) AS INTEGER) AS n_pairs, coalesce(string_agg(CASE said WHEN 'MANY_CODES' THEN concat(name, '对应多个编码') WHEN 'MANY_NAMES' THEN concat(code, '对应多个名称') END, '；' ORDER BY i), '') AS message FROM f LEFT JOIN r USING (i)"""
_PART_ROWS = "SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey AS k, concat('n', CAST((p_partkey * p_partkey + 3 * p_partkey) % 211 AS VARCHAR)) AS name, concat('c', CAST((p_partkey * p_partkey * p_partkey + p_partkey) % 173 AS VARCHAR)) AS code FROM part"

ORACLE_SQL = {
    "date_text_normalize": f"{_WITH} SELECT row_num, {_D1} FROM (SELECT *, row_num % 12 AS k12 FROM ledger)",
    "date_year_only_issues": f"{_WIDE} SELECT row_num, 'd1' AS field, d1 AS value, '{MESSAGES['YEAR_ONLY']}' AS message FROM wide WHERE s1 = 'YEAR_ONLY'",
    "date_iso_datetime": "SELECT event_id, CASE WHEN event_id % 8 IN (2, 4, 6) THEN 'CLEARED' ELSE 'OK' END AS status, CASE WHEN event_id % 8 NOT IN (2, 4, 6) THEN strftime(ts, '%Y-%m-%d') END AS value FROM events",
    "date_serial_1900": f"{_WITH} SELECT row_num, CASE WHEN d2 IS NULL THEN 'BLANK' WHEN value IS NULL THEN 'CLEARED' ELSE 'OK' END AS status, value FROM ({_d2('1899-12-30')})",
    "date_serial_1904": f"{_WITH} SELECT row_num, CASE WHEN d2 IS NULL THEN 'BLANK' WHEN value IS NULL THEN 'CLEARED' ELSE 'OK' END AS status, value FROM ({_d2('1904-01-01')})",
    "date_numeric_year_month": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'OK' ELSE 'YEAR_ONLY' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN concat(CAST(year(o_orderdate) AS VARCHAR), '-10-01') END AS value FROM orders",
    "device_code_wrap": f"{_WITH} SELECT row_num, {_JSON} AS json FROM ledger",
    "device_code_idempotent": f"{_WITH} SELECT row_num, {_JSON} AS json FROM ledger",
    "device_code_json_forms": """SELECT c_custkey, CASE c_custkey % 6 WHEN 2 THEN CAST(json_object('注册代码', concat('{"注册代码":"x","b":"', c_name, '"}')) AS VARCHAR) WHEN 3 THEN CAST(json_object('注册代码', concat('{"注册代码":', CAST(c_custkey AS VARCHAR), '}')) AS VARCHAR)
WHEN 4 THEN NULL WHEN 5 THEN CAST(json_object('注册代码', CAST(c_custkey AS VARCHAR)) AS VARCHAR) ELSE CAST(json_object('注册代码', c_name) AS VARCHAR) END AS json FROM customer""",
    "device_code_numeric_format": "SELECT c_custkey, concat('{\"注册代码\":\"', CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_custkey < 1000000 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE CAST(c_custkey AS VARCHAR) END WHEN 1 THEN concat(CAST(c_custkey AS VARCHAR), '.50') ELSE concat(CAST(c_custkey AS VARCHAR), repeat('0', 25)) END, '\"}') AS json FROM customer",
    "category_lookup": f"{_PARTS} SELECT p_partkey, name, code, mapped_code FROM rows LEFT JOIN mapping ON name = n",
    "category_unmatched": f"{_PARTS} SELECT p_partkey, coalesce(name, '') AS value, CASE WHEN coalesce(name, '') = '' THEN '{MESSAGES['NO_NAME']}' ELSE '{MESSAGES['UNMATCHED']}' END AS message FROM rows LEFT JOIN mapping ON name = n WHERE {_UNMATCHED}",
    "mapping_validation": "WITH r AS (SELECT CASE WHEN p_partkey % 97 = 0 THEN ' ' ELSE concat('n', CAST(p_partkey % 50 AS VARCHAR)) END AS name, concat('c', CAST(p_partkey % 75 AS VARCHAR)) AS code FROM part), p AS (SELECT 'BLANK' AS kind, name AS k FROM r WHERE name = ' ' UNION ALL SELECT 'MANY_CODES', name FROM r WHERE name <> ' ' GROUP BY name HAVING count(DISTINCT code) > 1 UNION ALL SELECT 'MANY_NAMES', code FROM r WHERE name <> ' ' GROUP BY code HAVING count(DISTINCT name) > 1) SELECT kind, count(*) AS n, min(k) AS first_key FROM p GROUP BY kind",
    "header_discovery": f"{DUCK_CELLS} SELECT * FROM heads",
    "header_issues": f"{DUCK_CELLS} SELECT sheet_idx, raw AS field, col_idx, '{MESSAGES['DUPLICATE']}' AS message FROM (SELECT *, row_number() OVER (PARTITION BY sheet_idx, raw ORDER BY col_idx) AS nth FROM cells WHERE row_num = 1 AND raw IN ('H0', 'H1', 'H2')) WHERE nth > 1 UNION ALL SELECT sheet_idx, field, col_idx, '{MESSAGES['NO_CODE']}' FROM heads WHERE field = 'H0'",
    "sheet_visibility": "SELECT CASE WHEN n_nationkey % 4 = 0 THEN concat('Hidden@', n_name) ELSE n_name END AS sheet, n_nationkey % 3 = 1 OR n_nationkey % 4 = 0 AS skipped FROM nation",
    "blank_row_filter": f"{DUCK_CELLS} SELECT DISTINCT sheet_idx, row_num FROM cells WHERE row_num >= 2 AND (raw IS NOT NULL OR formula IS NOT NULL)",
    "pivot_target_fields": f"{DUCK_CELLS} SELECT f.sheet_idx, f.row_num, " + ", ".join(f"max(CASE WHEN h.field = '{h}' THEN c.raw END) AS {h.lower()}" for h in H) + " FROM (SELECT DISTINCT sheet_idx, row_num FROM cells WHERE row_num >= 2 AND (raw IS NOT NULL OR formula IS NOT NULL)) f JOIN heads h ON h.sheet_idx = f.sheet_idx LEFT JOIN cells c ON c.sheet_idx = f.sheet_idx AND c.row_num = f.row_num AND c.col_idx = h.col_idx GROUP BY 1, 2",
    "merged_region_overlap": f"{DUCK_CELLS}{DUCK_REGIONS} SELECT r.sheet_idx, h.field, greatest(2, r.r1) AS row_num, concat(CASE WHEN kind = 'merge' THEN '{MESSAGES['MERGED']}' ELSE '{MESSAGES['FORMULA_RANGE']}' END, '（', ref, '）') AS message FROM regions r JOIN heads h ON h.sheet_idx = r.sheet_idx AND h.col_idx BETWEEN r.c1 AND r.c2 AND r.r2 >= 2",
    "all_issues": f"{_WIDE} {_ISSUES}",
    "issue_counts": f"{_WIDE} SELECT kind, count(*) AS n FROM ({_ISSUES}) GROUP BY kind",
    "date_native": "SELECT event_id, 'OK' AS status, strftime(ts, '%Y-%m-%d') AS value FROM events",
    "mapping_fold_messages": _FOLD.replace(":rows:", "SELECT row_number() OVER (ORDER BY n_nationkey) AS i, n_nationkey AS k, concat('n', CAST(n_nationkey % 5 AS VARCHAR)) AS name, concat('c', CAST(n_nationkey % 10 AS VARCHAR)) AS code FROM nation") + _FOLDED,
    "mapping_fold_parts": _FOLD.replace(":rows:", _PART_ROWS) + _FOLDED,
    "mapping_rejections": _FOLD.replace(":rows:", _PART_ROWS) + " SELECT k AS p_partkey, r.name, r.code, said AS kind FROM f JOIN r USING (i) WHERE said <> ''",
    "conversion_stats": f"{_WIDE} SELECT (SELECT count(*) FROM wide) AS rows, count(*) AS issues, 0 AS subcategory_filled, 0 AS dates_converted, 0 AS dates_cleared, 0 AS codes_formatted FROM ({_ISSUES}) UNION ALL SELECT {_COUNTS} FROM wide WHERE {_CLEAN}",
    "gated_output": f"{_WIDE} SELECT sheet, row_num, name, mapped_code AS code, v1 AS d1, v2 AS d2, v3 AS d3, json AS device FROM wide WHERE {_CLEAN}",
    "changes_upsert": "WITH c AS (SELECT o_orderstatus AS part, CAST(o_orderkey AS VARCHAR) AS coordinate, o_orderkey AS k, o_orderpriority AS raw FROM orders) SELECT part, coordinate, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 5 <> 0 THEN 'new' END ELSE raw END AS raw FROM c WHERE k % 3 <> 0 OR (k % 2 = 0 AND k % 5 <> 0)",
}
