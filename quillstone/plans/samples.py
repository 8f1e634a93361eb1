"""Workbook files derived from the driver's customers, and the queries over them: scan, issues, statistics, committed results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import KEY as JSON_KEY
from ..model import CODE, DEVICE, MAPPING_MESSAGES, MESSAGES, NAME, NO_BUSINESS
from ..sources import datasource as D
from ..sources import workbook as W
from ..sources.shared import shared_folder, stored
from .workbook import COUNTERS, Conversion, convert_files, json_results, mapping_messages, ordered, save_results

# Parts that each sample workbook has besides its sheets. Styles: general, 0.00, and a code of six digits.
_STYLES = f'<styleSheet xmlns="{W.MAIN[1:-1]}"><numFmts count="1"><numFmt numFmtId="170" formatCode="000000"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="2"/><xf numFmtId="170"/></cellXfs></styleSheet>'
_HEADS = (DEVICE, "备注", "启用日期", NAME, CODE, "出厂日期", "设备制造日期")
SHEETS_EACH = ("清单0", "清单1", "清单2", "Hidden@草稿")


def _ledger_sheets(rows: pd.DataFrame, place: dict[str, int]) -> list[tuple[str, str]]:
    """(name, XML) of a sample workbook's sheets: a cover, and customers by the remainder of their keys by 4. Strings are shared, by their place."""
    shared = lambda at, text: f'<c r="{at}" t="s"><v>{place[text]}</v></c>'
    number = lambda at, raw, style: f'<c r="{at}" s="{style}"><v>{raw}</v></c>'
    line = lambda i, cells: f'<row r="{i}">{"".join(cells)}</row>'
    worksheet = lambda body: f'<worksheet xmlns="{W.MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>'
    found = [("封面", worksheet(line(1, [shared("A1", "备注")])))]
    for rest, name in enumerate(SHEETS_EACH):
        lines = [line(1, [shared(f"{chr(65 + j)}1", h) for j, h in enumerate(_HEADS)])]
        for i, (k, note, segment) in enumerate(((k, n, s) for k, n, s in zip(rows["c_custkey"], rows["c_name"], rows["c_mktsegment"], strict=True) if k % 4 == rest), 2):
            made = f'<c r="G{i}"><f>A{i}</f><v>1</v></c>' if k % 700 == 13 else f'<c r="G{i}" t="inlineStr"><is><t>{"1999" if k % 900 == 6 else "2021/5"}</t></is></c>'
            lines.append(line(i, [number(f"A{i}", k, 2), shared(f"B{i}", note), number(f"C{i}", f"{2000 + k % 20}.1", 1), shared(f"D{i}", segment), number(f"F{i}", 30_000 + k, 0), made]))
        found.append((name, worksheet("".join(lines))))
    return found


def _ledger_book(rows: pd.DataFrame, is_1904: bool) -> bytes:
    texts = list(dict.fromkeys([*_HEADS, *rows["c_name"], *rows["c_mktsegment"]]))
    sheets = _ledger_sheets(rows, {t: i for i, t in enumerate(texts)})
    strings = "".join(f"<si><t xml:space=\"preserve\">{W.escape(t)}</t></si>" for t in texts)
    return W.package_of([(n, x) for n, x in sheets], {"xl/sharedStrings.xml": f'<sst xmlns="{W.MAIN[1:-1]}">{strings}</sst>', "xl/styles.xml": _STYLES}, is_1904)


def sample_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of workbooks derived from customer, one for each hundred of keys, every other one in the later epoch, one without a business sheet, and one file that is no workbook. Workbooks with a formula or a bare year in a visible sheet are blocked."""
    t = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") / 100).cast("long").alias("book"), "c_custkey", F.coalesce("c_name", F.lit("")).alias("c_name"), F.coalesce("c_mktsegment", F.lit("")).alias("c_mktsegment"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        book = int(rows["book"].iloc[0])
        return pd.DataFrame({"path": [f"b{book}.xlsx"], "content": [_ledger_book(rows.sort_values("c_custkey"), book % 2 == 1)]})

    folder = shared_folder(spark, "workbooks")
    junk = spark.createDataFrame([("junk.xlsx", b"no archive"), ("cover.xlsx", W.new_package([("说明",)]))], "path string, content binary")
    D.commit_packages(t.groupBy("book").applyInPandas(build, "path string, content binary").unionByName(junk), folder)
    return folder


def _book():
    return F.regexp_extract("path", r"([^/]+?)(?:_处理结果)?\.xlsx$", 1).alias("book")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_mktsegment IS NOT NULL").select(F.col("c_mktsegment").alias("name"), F.concat(F.lit("M-"), "c_mktsegment").alias("code")).distinct()


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the sample workbooks, read by sheet: shared strings, styles, the epoch, and the file that can't be read."""
    rows = D.scan(spark, sample_folder(spark, sf_dir)).filter(F.col("kind").isin("cell", "error"))
    return rows.select(_book(), "kind", "sheet", "is_1904", "coordinate", "cell_type", F.when(F.col("kind") == "cell", F.col("raw")).alias("raw"), "formula", "number_format")


def sample_conversion(spark: SparkSession, sf_dir: str) -> Conversion:
    return convert_files(spark, sample_folder(spark, sf_dir), segments(spark, sf_dir))


def sample_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the sample workbooks, numbered in document order."""
    done = sample_conversion(spark, sf_dir)
    return stored(ordered(done.issues).select(_book(), "n", "sheet", "row_num", "field", "coordinate", "kind", "value", "message"), "issues")


def sample_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet lists, counters and success of the sample workbooks; a row with what is wrong for those that can't be converted."""
    done = sample_conversion(spark, sf_dir)
    lists = [F.array_join(c, ",").alias(c) for c in ("sheets", "skipped_sheets")]
    wrong = F.when(F.col("message") == NO_BUSINESS, F.col("message")).otherwise("unreadable").alias("wrong")
    stats = done.statistics.select(_book(), *lists, "rows", *COUNTERS, "success", F.lit("").alias("wrong"))
    return stored(stats.unionByName(done.errors.select(_book(), wrong), allowMissingColumns=True), "statistics")


def sample_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the results of the sample workbooks, committed to a folder and read back."""
    done, folder = sample_conversion(spark, sf_dir), shared_folder(spark, "results")
    save_results(done, folder)
    return D.planned(spark, folder).filter("kind = 'cell'").select(_book(), "sheet", "coordinate", "raw")


def sample_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the sample workbooks as JSON."""
    done = sample_conversion(spark, sf_dir)
    return stored(json_results(done).select(_book(), "result"), "json")


def mapping_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration workbook derived from nation, faulty in each way: what the mapping accepts, and all that it says. Its codes are regions, so that a region's second nation conflicts; some rows are formulas, blank, or of neither."""
    t = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit("m.xlsx").alias("path"), "n_nationkey", F.coalesce("n_name", F.lit("")).alias("n_name"), "n_regionkey")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        text = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{W.escape(v)}</t></is></c>'
        row = lambda i, a, b: f'<row r="{i}">{a}{b}</row>'
        lines = [row(1, text("A1", NAME), text("B1", CODE))]
        for i, (k, name, region) in enumerate(sorted(zip(rows["n_nationkey"], rows["n_name"], rows["n_regionkey"], strict=True)), 2):
            code = f'<c r="B{i}"><f>A1</f></c>' if k % 9 == 4 else text(f"B{i}", "  " if k % 9 == 5 else f"C{region}")
            lines.append(row(i, text(f"A{i}", name), code))
        twice = row(1, text("A1", NAME) + text("B1", CODE), text("C1", NAME)) + row(2, text("A2", "x"), text("B2", "y"))
        none = row(1, text("A1", NAME), "") + row(2, text("A2", "x"), text("B2", "y"))
        sheets = [(n, f'<worksheet xmlns="{W.MAIN[1:-1]}"><sheetData>{x}</sheetData></worksheet>') for n, x in (("甲", "".join(lines)), ("乙", twice), ("丙", none))]
        return pd.DataFrame({"path": ["m.xlsx"], "content": [W.package_of(sheets)]})

    book = t.groupBy("path").applyInPandas(build, "path string, content binary")
    return mapping_messages(W.cells(stored(W.entries(book, hidden=True), "mapping")))


_CUSTOMERS = f"""WITH c AS (SELECT c_custkey AS k, c_custkey // 100 AS w, c_name AS note, c_mktsegment AS segment, concat('b', CAST(c_custkey // 100 AS VARCHAR)) AS book, 1 + row_number() OVER (PARTITION BY c_custkey // 100, c_custkey % 4 ORDER BY c_custkey) AS i FROM customer),
bad AS (SELECT DISTINCT w FROM c WHERE k % 4 <> 3 AND (k % 700 = 13 OR k % 900 = 6)), books AS (SELECT DISTINCT w, book, w % 2 = 1 AS late FROM c), s AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(SHEETS_EACH[:3]))}) AS v(rest, sheet)),
heads AS (SELECT * FROM (VALUES {', '.join(f"('{chr(65 + j)}1', '{h}')" for j, h in enumerate(_HEADS))}) AS v(coordinate, raw))"""
_EACH = "FROM c JOIN s ON s.rest = c.k % 4 JOIN books USING (w)"
_ROWS = lambda more, values: " UNION ALL ".join(f"SELECT c.book, s.sheet, concat('{at}', CAST(i AS VARCHAR)) AS coordinate, {value} AS raw{more(at)} {_EACH}" for at, value in values.items())
_RAW = {"A": "CAST(k AS VARCHAR)", "B": "note", "C": "concat(CAST(2000 + k % 20 AS VARCHAR), '.1')", "D": "segment", "F": "CAST(30000 + k AS VARCHAR)", "G": "CASE WHEN k % 700 = 13 THEN '1' WHEN k % 900 = 6 THEN '1999' ELSE '2021/5' END"}
_KIND = {"A": "'n'", "B": "'s'", "C": "'n'", "D": "'s'", "F": "'n'", "G": "CASE WHEN k % 700 = 13 THEN 'n' ELSE 'inlineStr' END"}
_FORMAT = {"A": "'000000'", "C": "'0.00'"}
_NEW = _RAW | {
    "A": f"concat('{{\"{JSON_KEY}\":\"', CASE WHEN k < 1000000 THEN lpad(CAST(k AS VARCHAR), 6, '0') ELSE CAST(k AS VARCHAR) END, '\"}}')", "C": "concat(CAST(2000 + k % 20 AS VARCHAR), '-10-01')", "E": "concat('M-', segment)",
    "F": "strftime(CASE WHEN late THEN DATE '1904-01-01' ELSE DATE '1899-12-30' END + CAST(30000 + k AS INTEGER), '%Y-%m-%d')", "G": "'2021-05-01'",
}
ORACLE_SQL = {
    "workbook_scan": f"""{_CUSTOMERS}, cells AS ({_ROWS(lambda at: f", late AS is_1904, {_KIND[at]} AS cell_type, " + ("CASE WHEN k % 700 = 13 THEN concat('A', CAST(i AS VARCHAR)) END" if at == "G" else "CAST(NULL AS VARCHAR)") + f" AS formula, {_FORMAT.get(at, "'General'")} AS number_format", _RAW)}
UNION ALL SELECT book, sheet, coordinate, raw, late, 's', NULL, 'General' FROM books, s, heads UNION ALL SELECT book, '封面', 'A1', '备注', late, 's', NULL, 'General' FROM books)
SELECT book, 'cell' AS kind, sheet, is_1904, coordinate, cell_type, raw, formula, number_format FROM cells UNION ALL SELECT 'cover', 'cell', 'Sheet1', FALSE, 'A1', 'inlineStr', '说明', NULL, '' UNION ALL SELECT 'junk', 'error', NULL, NULL, NULL, NULL, NULL, NULL, NULL""",
    "workbook_issues": f"""{_CUSTOMERS} SELECT c.book, CAST(row_number() OVER (PARTITION BY c.book ORDER BY s.rest, i) AS INTEGER) AS n, s.sheet, CAST(i AS INTEGER) AS row_num, '设备制造日期' AS field, concat('G', CAST(i AS VARCHAR)) AS coordinate,
CASE WHEN k % 700 = 13 THEN 'STRUCTURE' ELSE 'YEAR_ONLY' END AS kind, CASE WHEN k % 700 = 13 THEN concat('=A', CAST(i AS VARCHAR)) ELSE '1999' END AS value, CASE WHEN k % 700 = 13 THEN '{MESSAGES['FORMULA']}' ELSE '{MESSAGES['YEAR_ONLY']}' END AS message {_EACH} WHERE k % 700 = 13 OR k % 900 = 6""",
    "workbook_statistics": f"""{_CUSTOMERS}, n AS (SELECT w, count(*) AS k FROM c WHERE k % 4 <> 3 GROUP BY w) SELECT book, '清单0,清单1,清单2' AS sheets, '封面,Hidden@草稿' AS skipped_sheets, n.k AS rows, CASE WHEN bad.w IS NULL THEN n.k ELSE 0 END AS subcategory_filled, CASE WHEN bad.w IS NULL THEN 3 * n.k ELSE 0 END AS dates_converted,
CAST(0 AS BIGINT) AS dates_cleared, CASE WHEN bad.w IS NULL THEN n.k ELSE 0 END AS codes_formatted, bad.w IS NULL AS success, '' AS wrong FROM books JOIN n USING (w) LEFT JOIN bad USING (w) UNION ALL SELECT 'junk', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'unreadable' UNION ALL SELECT 'cover', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{NO_BUSINESS}'""",
    "workbook_results": f"""{_CUSTOMERS}, cells AS ({_ROWS(lambda at: "", _NEW)} UNION ALL SELECT book, sheet, coordinate, raw FROM books, s, heads UNION ALL SELECT book, '封面', 'A1', '备注' FROM books)
SELECT book, sheet, coordinate, raw FROM cells WHERE book NOT IN (SELECT book FROM books JOIN bad USING (w))""",
}
_LISTS = '"sheets":["清单0","清单1","清单2"],"skipped_sheets":["封面","Hidden@草稿"],"rows":'
ORACLE_SQL["workbook_json"] = f"""WITH i AS ({ORACLE_SQL["workbook_issues"]}), j AS (SELECT book, string_agg(concat('{{"kind":"', kind, '","sheet":"', sheet, '","row":', CAST(row_num AS VARCHAR), ',"field":"', field, '","cell":"', coordinate, '","value":"', value, '","message":"', message, '"}}'), ',' ORDER BY n) AS said FROM i GROUP BY book),
k AS (SELECT concat('b', CAST(c_custkey // 100 AS VARCHAR)) AS book, CAST(count(*) AS VARCHAR) AS n, CAST(3 * count(*) AS VARCHAR) AS n3 FROM customer WHERE c_custkey % 4 <> 3 GROUP BY 1)
SELECT book, CASE WHEN said IS NULL THEN concat('{{"success":true,"issues":[],{_LISTS}', n, ',"filename":"', book, '_处理结果.xlsx","subcategory_filled":', n, ',"dates_converted":', n3, ',"dates_cleared":0,"codes_formatted":', n, '}}') ELSE concat('{{"success":false,"issues":[', said, '],{_LISTS}', n, '}}') END AS result FROM k LEFT JOIN j USING (book)"""
ORACLE_SQL["mapping_workbook"] = f"""WITH r AS (SELECT 1 + row_number() OVER (ORDER BY n_nationkey) AS i, n_nationkey % 9 AS odd, n_regionkey AS region FROM nation), good AS (SELECT i, row_number() OVER (PARTITION BY region ORDER BY i) AS nth FROM r WHERE odd NOT IN (4, 5)),
said AS (SELECT i, concat('甲 第 ', CAST(i AS VARCHAR), ' 行：', CASE WHEN odd = 4 THEN '{MAPPING_MESSAGES["FORMULA"]}' WHEN odd = 5 THEN '{MAPPING_MESSAGES["BLANK"]}' ELSE concat('C', CAST(region AS VARCHAR), ' {MAPPING_MESSAGES["MANY_NAMES"]}') END) AS text FROM r LEFT JOIN good USING (i) WHERE coalesce(nth, 2) > 1 UNION ALL SELECT 999, '乙：{MAPPING_MESSAGES["DUPLICATE"]}')
SELECT (SELECT CAST(count(*) AS INTEGER) FROM good WHERE nth = 1) AS n_pairs, string_agg(text, '；' ORDER BY i) AS message FROM said"""
QUERIES = {"workbook_json": sample_json, "mapping_workbook": mapping_book, "workbook_scan": scanned, "workbook_issues": sample_issues, "workbook_statistics": sample_statistics, "workbook_results": sample_results}
