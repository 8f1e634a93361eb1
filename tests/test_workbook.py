"""Whole workbooks, built here part by part: reading, precheck, conversion, and the rewritten packages."""

import io
import json
import zipfile

import pytest
from xml.sax.saxutils import escape

from quillstone import MappingError, load_mapping
from quillstone.model import MESSAGES, NO_BUSINESS
from quillstone.operators.convert import issue_counts
from quillstone.plans import workbook as P
from quillstone.sources import workbook as W

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
def cell(at, v):
    """Text, (type, raw, style) or a formula with its value."""
    if v is None:
        return ""
    if isinstance(v, str):
        return f'<c r="{at}" s="1"><f>{v[1:]}</f><v>2</v></c>' if v.startswith("=") else f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    kind, raw, style = v
    return f'<c r="{at}" t="{kind}" s="{style}"><v>{raw}</v><extLst><ext uri="x"/></extLst></c>'


def sheet(rows, merged=(), more=""):
    body = "".join(f'<row r="{i}" hidden="{int(i == 3)}">' + "".join(cell(f"{chr(65 + j)}{i}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    tail = f'<mergeCells>{"".join(f"""<mergeCell ref="{m}"/>""" for m in merged)}</mergeCells>' if merged else ""
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<worksheet {NS}><sheetData>{body}</sheetData>{tail}{more}</worksheet>'


def book(parts, epoch=""):
    """Sheets are (name, state, xml)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = b"kept"
        z.writestr("xl/workbook.xml", f'<workbook {NS} {REL}><workbookPr date1904="{epoch}"/><sheets>' + "".join(f'<sheet name="{n}" state="{s}" r:id="r{i}"/>' for i, (n, s, _) in enumerate(parts)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(len(parts))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>阀门</t></si><si><r><t>储</t></r><r><t>罐</t></r><rPh><t>chǔ</t></rPh></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="000000"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="2"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/media/a.bin", bytes(range(256)))
        for i, (_, _, xml) in enumerate(parts):
            z.writestr(f"xl/worksheets/s{i}.xml", xml)
    return out.getvalue()


def pump_house(blocked=False):
    """One business sheet of three filled rows, a cover and a hidden draft; blocked: with two bad cells and one more sheet."""
    rows = [
        ["设备代码", "序号", "启用日期", "设备小类编码", "设备小类名称", "出厂日期"],
        [("n", 42, 2), "1", ("n", 45292, 0), "x1", "水塔" if blocked else ("s", 0, 0), "2023/5"],
        ["null", "=B2+1", "20240315", None, ("s", 1, 0), "31.12.2023"],
        ['{"注册代码": "Q7"}', ("b", 1, 0), "1999" if blocked else ("n", "2022.1", 1), "FJ-3", "风机", ("d", "2021-07-09T00:00:00", 0)],
        [], [None, ""],
    ]
    parts = [("封面", "visible", sheet([["台账说明"], ["共三行"]], ["A1:B1"])), ("泵房清单", "visible", sheet(rows)), ("草稿", "hidden", sheet([["设备代码"], ["1"]]))]
    return book([*parts, ("备用", "visible", sheet([["设备小类编码", "设备制造日期"], ["ZZ-9", "2018/02"]]))] if blocked else parts)


def packages(spark, **contents):
    return spark.createDataFrame([(k, v) for k, v in contents.items()], "path string, content binary")


def converted(spark, **contents):
    found = packages(spark, **contents)
    mapping = spark.createDataFrame([("阀门", "FM-1"), ("储罐", "CG-2"), ("风机", "FJ-3")], "name string, code string")
    return found, P.convert(W.entries(found).cache(), mapping)


def listed(done):
    return [(r.kind, r.sheet, r.row_num, r.field, r.coordinate, r.value) for r in P.ordered(done.issues).orderBy("path", "n").collect()]


def values(spark, content):
    return {(r.sheet, r.coordinate): r.raw for r in W.cells(W.entries(packages(spark, p=content), hidden=True)).collect()}


def test_a_workbook_that_passes(spark, tmp_path):
    content = pump_house()
    found, done = converted(spark, p=content)
    assert listed(done) == [] and done.errors.count() == 0
    s = done.statistics.first()
    assert (s.sheets, s.skipped_sheets, s.rows, s.subcategory_filled, s.dates_converted, s.dates_cleared, s.codes_formatted, s.success) == (["泵房清单"], ["封面", "草稿"], 3, 3, 5, 1, 2, True)
    out = P.results(found, done).collect()
    got, before = values(spark, bytes(out[0].content)), values(spark, content)
    want = {"A2": '{"注册代码":"000042"}', "C2": "2024-01-01", "D2": "FM-1", "F2": "2023-05-01", "A3": None, "C3": "2024-03-15", "D3": "CG-2", "F3": None, "A4": '{"注册代码":"Q7"}', "C4": "2022-10-01", "D4": "FJ-3", "F4": "2021-07-09"}
    assert got == before | {("泵房清单", k): v for k, v in want.items()}
    with zipfile.ZipFile(io.BytesIO(content)) as a, zipfile.ZipFile(io.BytesIO(bytes(out[0].content))) as b:
        assert a.namelist() == b.namelist() and b.comment == b"kept"
        assert all(a.read(n) == b.read(n) for n in a.namelist() if n != "xl/worksheets/s1.xml")
        xml = b.read("xl/worksheets/s1.xml").decode()
        assert '<c r="C4" s="1" t="inlineStr"><is><t xml:space="preserve">2022-10-01</t></is><extLst><ext uri="x"/></extLst></c>' in xml and "<f>B2+1</f>" in xml
    shown = json.loads(P.json_results(done).first().result)
    assert shown == {"success": True, "issues": [], "sheets": ["泵房清单"], "skipped_sheets": ["封面", "草稿"], "rows": 3, "filename": "p_处理结果.xlsx", "subcategory_filled": 3, "dates_converted": 5, "dates_cleared": 1, "codes_formatted": 2}


def test_saving(spark, tmp_path):
    kind = "path string, content binary"
    results = spark.createDataFrame([("hdfs:/x/清单.v2.xlsx", b"one")], kind)
    for _ in range(2):  # a repeated attempt finds its own file
        assert W.save(results, str(tmp_path)) == 1 and (tmp_path / "清单.v2_处理结果.xlsx").read_bytes() == b"one"
    with pytest.raises(Exception, match="FileExistsError"):
        W.save(spark.createDataFrame([("y/清单.v2.xlsx", b"two")], kind), str(tmp_path))
    with pytest.raises(Exception, match="不能覆盖原始"):
        W.save(spark.createDataFrame([(f"file:{tmp_path}/a.xlsx", b"x")], kind), str(tmp_path), ".xlsx")
    with pytest.raises(Exception, match="预检查未通过"):
        W.save(spark.createDataFrame([("b.xlsx", None)], kind), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["清单.v2_处理结果.xlsx"]


def test_blocked_workbook_leaves_others_alone(spark):
    found, done = converted(spark, bad=pump_house(blocked=True), fine=pump_house(), junk=b"PK but no archive", none=book([("s", "visible", sheet([["说明"], ["x"]]))]))
    assert listed(done) == [("UNMATCHED", "泵房清单", 2, "设备小类名称", "E2", "水塔"), ("YEAR_ONLY", "泵房清单", 4, "启用日期", "C4", "1999"), ("UNMATCHED", "备用", 2, "设备小类编码", "A2", "ZZ-9")]
    stats = {r.path: tuple(r)[3:] for r in done.statistics.collect()}
    assert stats == {"bad": (4, 0, 0, 0, 0, False), "fine": (3, 3, 5, 1, 2, True)}
    assert [r.path for r in P.results(found, done).collect()] == ["fine"]
    errors = {r.path: r.message for r in done.errors.collect()}
    assert set(errors) == {"junk", "none"} and "BadZipFile" in errors["junk"] and errors["none"] == NO_BUSINESS
    shown = {r.path: json.loads(r.result) for r in P.json_results(done).collect()}["bad"]
    assert "dates_converted" not in shown and "filename" not in shown and [i["cell"] for i in shown["issues"]] == ["E2", "C4", "A2"]
    assert shown["issues"][2] == {"kind": "UNMATCHED", "sheet": "备用", "row": 2, "field": "设备小类编码", "cell": "A2", "value": "ZZ-9", "message": MESSAGES["NO_NAME"]}
    assert {r.kind: r.n for r in issue_counts(done.issues).collect()} == {"UNMATCHED": 2, "YEAR_ONLY": 1}


def test_structure_and_odd_cells(spark):
    cases = {
        "bare": sheet([["序号", "设备小类名称"], ["1", "阀门"]]), "thrice": sheet([["启用日期"] * 3, ["2020-01-01"] * 3]), "formula": sheet([["出厂日期"], ["=TODAY()"]]),
        "merged": sheet([["备注", "设备代码"], ["a", "b"], ["c", "d"]], ["A3:B4", "A1:B1"]), "white": sheet([["设备代码", "启用日期"], [None, "\t "]]),
        "types": sheet([["出厂日期", "设备制造日期", "设备代码"], [("str", "2020-01-01", 0), ("b", 0, 0), ("e", "#N/A", 0)]]),
        "array": sheet([["启用日期", "合计"], ["2020-01-01", None]]).replace("</row></sheetData>", '<c r="B2"><f t="array" ref="A2:B3">C1:C2</f><v>1</v></c></row></sheetData>'),
        "own": sheet([["设备代码"], ["=D1"]]).replace("<f>D1</f>", '<f t="array" ref="A2:A2">D1</f>'),
    }
    _, done = converted(spark, **{k: book([("s", "visible", x)]) for k, x in cases.items()})
    got = {}
    for r in P.ordered(done.issues).orderBy("path", "n").collect():
        got.setdefault(r.path, []).append((r.coordinate, r.value, r.message))
    assert got == {
        "bare": [("B1", "", MESSAGES["NO_CODE"])], "thrice": [("B1", "启用日期", MESSAGES["DUPLICATE"]), ("C1", "启用日期", MESSAGES["DUPLICATE"])], "formula": [("A2", "=TODAY()", MESSAGES["FORMULA"])],
        "merged": [("B3", "d", MESSAGES["MERGED"] + "（A3:B4）")], "array": [("A2", "=C1:C2", MESSAGES["FORMULA_RANGE"] + "（A2:B3）")], "own": [("A2", "=D1", MESSAGES["FORMULA"])],
    }
    stats = {r.path: r for r in done.statistics.collect()}
    assert (stats["white"].success, stats["white"].rows, stats["white"].dates_cleared) == (True, 1, 0) and (stats["types"].dates_cleared, stats["types"].codes_formatted) == (2, 1)
    assert {(r.path, r.coordinate): r.new_value for r in done.changes.collect()}["types", "C2"] == '{"注册代码":"#N/A"}'


def test_rewriting_keeps_bytes():
    xml = b'<x:worksheet xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:q="u"><x:sheetData><x:row r="2"><x:c r="A2" t="s" s="7" q:z=\'>\'><x:f>1</x:f><x:v>0</x:v><x:extLst/></x:c><x:c r="C2"/></x:row></x:sheetData></x:worksheet>'
    got = W.rewrite_cells(xml, {"A2": "a<&b", "B2": "n", "C2": None, "D2": None, "AA2": "z"})
    t = b'<x:is><x:t xml:space="preserve">%b</x:t></x:is>'
    want = xml.replace(b' t="s"', b"").replace(b"q:z='>'>", b"q:z='>' t=\"inlineStr\">").replace(b"<x:f>1</x:f><x:v>0</x:v>", t % b"a&lt;&amp;b")
    want = want.replace(b'<x:c r="C2"/>', b'<x:c r="B2" t="inlineStr">' + t % b"n" + b'</x:c><x:c r="C2"></x:c><x:c r="AA2" t="inlineStr">' + t % b"z" + b"</x:c>")
    assert got == want
    assert W.bounds("$A:$C") == (1, 1, 3, W.LAST_ROW) and W.bounds("2:3") == (1, 2, W.LAST_COLUMN, 3)


def saved(tmp_path, name, *parts):
    (tmp_path / name).write_bytes(book(parts) if parts else b"junk")
    return str(tmp_path / name)


def test_mapping_files(spark, tmp_path):
    head, turned = ["设备小类名称", "设备小类编码"], ["设备小类编码", "x", "设备小类名称"]
    good = saved(tmp_path, "m.XLSX", ("甲", "hidden", sheet([turned, ["FM-1", None, "阀门"], [None, "y", None], ["FM-1", None, "阀门"]])), ("乙", "visible", sheet([["设备小类名称"], ["z"]])))
    assert [tuple(r) for r in load_mapping(spark, good).collect()] == [("阀门", "FM-1")]
    bad = saved(tmp_path, "b.xlsx", ("甲", "visible", sheet([head, ["阀门", "F1"], ["阀门", "F2"], ["储罐", "F1"], ["  ", "F3"], ["=A1", "F4"], ["储罐", "F2"], ["风机", "F5"]])), ("乙", "visible", sheet([[*head, "设备小类名称"], ["a", "b", "c"]])))
    with pytest.raises(MappingError) as e:
        load_mapping(spark, bad)
    assert str(e.value) == "甲 第 3 行：阀门 对应多个编码；甲 第 4 行：F1 对应多个名称；甲 第 5 行：名称或编码为空；甲 第 6 行：映射不能使用公式；乙：映射表头重复"
    with pytest.raises(MappingError, match="缺少有效"):
        load_mapping(spark, saved(tmp_path, "e.xlsx", ("甲", "visible", sheet([head]))))
    with pytest.raises(MappingError, match="无法读取设备小类映射文件：j.xlsx"):
        load_mapping(spark, saved(tmp_path, "j.xlsx"))
    with pytest.raises(MappingError, match="对应多个编码"):
        P.convert(W.entries(packages(spark, p=pump_house())), spark.createDataFrame([("a", "1"), ("a", "2")], "name string, code string"))


def test_the_later_epoch(spark):
    _, done = converted(spark, p=book([("s", "visible", sheet([["出厂日期"], [("n", 0, 0)], [("n", 366, 0)]]))], epoch="1"))
    assert sorted(r.new_value for r in done.changes.collect()) == ["1904-01-01", "1905-01-01"]
    assert converted(spark, p=book([]))[1].statistics.count() == 0


def test_roundtrip_parses_the_samples_once(spark, tmp_path):
    spark.range(2500).selectExpr("id AS c_custkey", "concat('n', id) AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    found = P.roundtrip(spark, str(tmp_path))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 1 and "customer.parquet" not in str(found.inputFiles())
    assert found.count() == 2 * (2500 + 3)


def test_what_is_derived_has_a_short_plan(spark):
    _, done = converted(spark, p=pump_house(), bad=pump_house(blocked=True), junk=b"none")
    for derived in (done.rows, done.issues, done.changes, done.statistics, done.errors, P.ordered(done.issues), P.json_results(done)):
        plan = derived._jdf.queryExecution().toString()
        assert len(plan) < 100_000 and "٠١٢" not in plan and "InMemoryRelation" not in plan  # neither the rules nor the cells again
