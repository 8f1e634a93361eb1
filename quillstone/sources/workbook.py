"""Spreadsheet packages (.xlsx) as DataFrames, and back.

entries() reads every package with Spark's binaryFile source, so from any store that Spark reads, and parses one
package per row into flat rows; sheets(), cells(), regions() and errors() select from these. Write the entries as a
table first if several of them are wanted, or each parses anew. rewritten() puts changed values into copies of the
packages, one package per group: a package is bounded by LARGEST bytes and can't be split.
"""

from __future__ import annotations

import io
import marshal
import os
import posixpath
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import islice
from typing import NamedTuple
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import WorkbookError
from ..model import CELLS, REGIONS, SHEETS, TARGETS

#: Bytes of all parts of a package, uncompressed.
LARGEST = 256 << 20
ENTRIES = "kind string, path string, sheet_idx int, sheet string, state string, part string, is_1904 boolean, has_data boolean, row_num int, col_idx int, coordinate string, cell_type string, raw string, formula string, style_idx int, number_format string, ref string, c1 int, r1 int, c2 int, r2 int"
# Names of the format's vocabulary, and the built-in formats that the rules ask for.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
BUILT_IN = {0: "General", 1: "0", 2: "0.00"}
LAST_ROW, LAST_COLUMN = 1_048_576, 16_384


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def bounds(ref: str) -> tuple[int, int, int, int]:
    """First column, first row, last column, last row of an area; of whole columns or rows too."""
    ends = [re.fullmatch(r"([A-Za-z]*)(\d*)", x) for x in ref.replace("$", "").split(":")]
    if not all(ends) or len(ends) > 2:
        raise WorkbookError(f"no area: {ref}")
    (a, x), (b, y) = ends[0].groups(), ends[-1].groups()
    return column_number(a) if a else 1, int(x or 1), column_number(b) if b else LAST_COLUMN, int(y or LAST_ROW)


def shown(e) -> str:
    """Plain and rich text of a string item, without phonetic runs."""
    return "".join(t.text or "" for path in (f"{MAIN}t", f"{MAIN}r/{MAIN}t") for t in e.iterfind(path))


class Strings:
    """Shared strings by place, in compressed pages of PAGE strings each; the pages used last are kept open."""

    PAGE, OPEN = 512, 128

    def __init__(self, found: Iterator[str]):
        self.pages, page = [], []
        for text in found:
            page.append(text)
            if len(page) == self.PAGE:
                self.pages.append(zlib.compress(marshal.dumps(page), 1))
                page = []
        self.size = len(self.pages) * self.PAGE + len(page)
        self.pages.append(zlib.compress(marshal.dumps(page), 1))
        self.page = lru_cache(self.OPEN)(lambda i: marshal.loads(zlib.decompress(self.pages[i])))

    def __getitem__(self, i: int) -> str:
        if not -self.size <= i < self.size:
            raise IndexError(f"no shared string {i}")
        return self.page(i % self.size // self.PAGE)[i % self.size % self.PAGE]


def elements(stream, tag: str) -> Iterator:
    """Elements of a name as they end. Those seen are forgotten, so that memory doesn't grow with the part."""
    stack = []
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            stack.append(e)
            continue
        stack.pop()
        if e.tag == tag:
            yield e
            stack[-1].clear()


class Package:
    """A package in a file of bytes that can be sought in; parts are read when they are asked for."""

    def __init__(self, file):
        self.zip = zipfile.ZipFile(file)
        if sum(i.file_size for i in self.zip.infolist()) > LARGEST:
            raise WorkbookError(f"the parts hold over {LARGEST} bytes")
        self.names = set(self.zip.namelist())
        self.book = self._xml("xl/workbook.xml")
        self.formats = self._formats() if "xl/styles.xml" in self.names else []
        about = self.book.find(f"{MAIN}workbookPr")
        self.is_1904 = about is not None and about.get("date1904") in ("1", "true")

    @cached_property
    def strings(self) -> Strings:
        if "xl/sharedStrings.xml" not in self.names:
            return Strings(iter(()))
        with self.zip.open("xl/sharedStrings.xml") as f:
            return Strings(shown(e) for e in elements(f, f"{MAIN}si"))

    def _xml(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def _formats(self) -> list[str]:
        styles = self._xml("xl/styles.xml")
        own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in styles.iterfind(f"{MAIN}numFmts/{MAIN}numFmt")}
        codes = BUILT_IN | own
        return [codes.get(int(e.get("numFmtId", 0)), "") for e in styles.iterfind(f"{MAIN}cellXfs/{MAIN}xf")]

    def sheets(self, hidden: bool) -> Iterator[dict]:
        """A row for each sheet in order; only those to be read have a part."""
        links = {e.get("Id"): e for e in self._xml("xl/_rels/workbook.xml.rels")}
        for i, e in enumerate(self.book.iterfind(f"{MAIN}sheets/{MAIN}sheet")):
            name, state = e.get("name", ""), e.get("state", "visible")
            part = None
            if hidden or (state == "visible" and not name.lower().startswith("hidden@")):
                link = links[e.get(RELATION)]
                part = posixpath.normpath(posixpath.join("/xl", link.get("Target", ""))).lstrip("/")
                if link.get("TargetMode") == "External" or not part.startswith("xl/") or part not in self.names:
                    raise WorkbookError(f"sheet {name}: no part of this package")
            yield {"kind": "sheet", "sheet_idx": i, "sheet": name, "state": state, "part": part, "is_1904": self.is_1904}

    def _cell(self, c, row: int) -> dict:
        at, kind, style = c.get("r"), c.get("t", "n"), int(c.get("s", 0))
        value, inline, formula = (c.find(f"{MAIN}{n}") for n in ("v", "is", "f"))
        raw = None if value is None else value.text
        if kind == "inlineStr":
            raw = None if inline is None else shown(inline)
        elif kind == "s" and raw is not None:
            raw = self.strings[int(raw)]
        if at is None and row == 1 and raw in TARGETS:
            raise WorkbookError(f"header {raw} has no coordinate")
        return {
            "kind": "cell", "row_num": row, "col_idx": at and column_number(at.rstrip("0123456789")), "coordinate": at, "cell_type": kind, "raw": raw, "style_idx": style,
            "formula": None if formula is None else formula.text or "", "number_format": self.formats[style] if 0 <= style < len(self.formats) else "",
        }

    def content(self, sheet: dict, rows: tuple[int, int] = (1, LAST_ROW)) -> Iterator[dict]:
        """Cells and areas of a sheet, row by row; the sheet's own row goes last, when has_data is known. Only rows from the first to the second number are decoded."""
        base, has_data = {k: sheet[k] for k in ("sheet_idx", "sheet", "part", "is_1904")}, False

        def area(kind, ref, formula=None):
            c1, r1, c2, r2 = bounds(ref)
            return base | {"kind": kind, "ref": ref, "c1": c1, "r1": r1, "c2": c2, "r2": r2, "formula": formula}

        stack = []
        with self.zip.open(sheet["part"]) as f:
            for event, e in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    stack.append(e)
                    continue
                stack.pop()
                has_data |= e.tag == f"{MAIN}sheetData"
                if e.tag == f"{MAIN}mergeCell":
                    yield area("merge", e.get("ref", ""))
                elif e.tag == f"{MAIN}row":
                    if e.get("r") is None:
                        raise WorkbookError(f"sheet {sheet['sheet']}: a row has no number")
                    number = int(e.get("r"))
                    for c in e.iterfind(f"{MAIN}c"):
                        if rows[0] <= number <= rows[1]:
                            yield base | self._cell(c, number)
                        formula = c.find(f"{MAIN}f")
                        if formula is not None and formula.get("ref"):
                            yield area("formula", formula.get("ref"), formula.text or "")
                    stack[-1].clear()  # what has been read is forgotten, so that memory doesn't grow with the sheet
        yield sheet | {"has_data": has_data}


def _entries(content: bytes, hidden: bool) -> Iterator[dict]:
    package = Package(io.BytesIO(content))
    for sheet in package.sheets(hidden):
        yield from package.content(sheet) if sheet["part"] else [sheet]


#: What reading a package that isn't sound can raise.
UNREADABLE = (ValueError, KeyError, IndexError, TypeError, ElementTree.ParseError, zipfile.BadZipFile, zlib.error, EOFError)


def arrow_schema() -> pa.Schema:
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(name, types[kind]) for name, kind in map(str.split, ENTRIES.split(", "))])


def record_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def files(spark: SparkSession, source: str) -> DataFrame:
    """path and content of each .xlsx file, upper case included, of a folder, file or pattern."""
    return spark.read.format("binaryFile").load(source).select("path", "content").filter(F.lower("path").endswith(".xlsx"))


def entries(packages: DataFrame, hidden: bool = False) -> DataFrame:
    """Rows of packages (path, content); a package that can't be read gives one row of kind error alone. Hidden sheets are read only if wanted; a null content is an error, no files give no rows."""
    schema = arrow_schema()

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                try:
                    found = list(record_batches(({"path": path, **e} for e in _entries(content.as_py() or b"", hidden)), schema))
                except UNREADABLE as error:
                    found = record_batches(iter([{"path": path, "kind": "error", "raw": said(error)}]), schema)
                yield from found

    return packages.select("path", "content").mapInArrow(parse, ENTRIES)


def _kind(rows: DataFrame, kinds: tuple, schema: str) -> DataFrame:
    return rows.filter(F.col("kind").isin(*kinds)).select([c.split()[0] for c in schema.split(", ")])


def sheets(rows: DataFrame) -> DataFrame:
    return _kind(rows, ("sheet",), SHEETS)


def cells(rows: DataFrame) -> DataFrame:
    return _kind(rows, ("cell",), CELLS)


def regions(rows: DataFrame) -> DataFrame:
    return _kind(rows, ("merge", "formula"), REGIONS)


def errors(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'error'").select("path", F.col("raw").alias("message"))


_TAG = re.compile(rb"<([^\s/>]+)((?:\s+[^\s=]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>")
_ATTRIBUTE = re.compile(rb"\s+([^\s=]+)\s*=\s*(\"[^\"]*\"|'[^']*')")


class _Rows:
    """Calls ``use`` with each row of a sheet as it ends: where it, its cells and their children stand in the bytes."""

    def __init__(self, xml: bytes, use):
        self.xml, self.use, self.stack = xml, use, []
        p = expat.ParserCreate()
        p.StartElementHandler = lambda name, attrs: self._start(name, attrs, p.CurrentByteIndex)
        p.EndElementHandler = lambda name: self._end(p.CurrentByteIndex)
        p.Parse(xml, True)

    def _start(self, name, attrs, at):
        node = {"local": name.rpartition(":")[2], "at": at, "r": attrs.get("r"), "children": []}
        if self.stack and self.stack[-1]["local"] in ("row", "c"):
            self.stack[-1]["children"].append(node)
        self.stack.append(node)

    def _end(self, at):
        node = self.stack.pop()
        if node["local"] == "row" or len(self.stack) > 2:  # rows and what is in them
            node["tag"] = _TAG.match(self.xml, node["at"])
            node["inner_end"] = at
            node["end"] = node["tag"].end() if node["tag"][3] else self.xml.index(b">", at) + 1
        if node["local"] == "row" and self.stack[-1]["local"] == "sheetData":
            self.use(node)


def _row_cuts(xml: bytes, row: dict, changes: dict[str, str | None]) -> Iterator[tuple]:
    """(start, column, end, new bytes) of a row's changes."""
    row_cells = [c for c in row["children"] if c["local"] == "c" and c["r"]]
    prefix = row["tag"][1].rpartition(b"row")[0]
    for at, value in changes.items():
        column = column_number(at.rstrip("0123456789"))
        cell = next((c for c in row_cells if c["r"] == at), None)
        text = b""
        if value is not None:
            plain = escape(value, {"\r": "&#13;"}).encode()
            text = b'<%bis><%bt xml:space="preserve">%b</%bt></%bis>' % (prefix, prefix, plain, prefix, prefix)
        if cell is None:
            if value is not None:
                after = next((c["at"] for c in row_cells if column_number(c["r"].rstrip("0123456789")) > column), row["inner_end"])
                yield after, column, after, b'<%bc r="%b" t="inlineStr">%b</%bc>' % (prefix, at.encode(), text, prefix)
            continue
        attributes = b"".join(m[0] for m in _ATTRIBUTE.finditer(cell["tag"][2]) if m[1] != b"t")
        kept = [c for c in cell["children"] if c["local"] not in ("v", "is", "f")]
        before = b"".join(xml[c["at"] : c["end"]] for c in kept if c["local"] != "extLst")
        behind = b"".join(xml[c["at"] : c["end"]] for c in kept if c["local"] == "extLst")
        kind = b' t="inlineStr"' if value is not None else b""
        yield cell["at"], column, cell["end"], b"<%bc%b%b>%b%b%b</%bc>" % (prefix, attributes, kind, before, text, behind, prefix)


def rewrite_cells(xml: bytes, changes: dict[str, str | None]) -> bytes:
    """The sheet with inline text in the changed cells; all other bytes stay. None empties a cell, and does nothing where there is none. A row is forgotten once it is done."""
    by_row: dict[int, dict] = {}
    for at, value in changes.items():
        by_row.setdefault(int(at[len(at.rstrip("0123456789")) :]), {})[at] = value
    cuts: list[tuple] = []

    def use(row):
        if row["r"] is None:
            raise WorkbookError("a row has no number")
        if wanted := by_row.pop(int(row["r"]), None):
            cuts.extend(_row_cuts(xml, row, wanted))

    _Rows(xml, use)
    if by_row:
        raise WorkbookError(f"no row for {next(iter(next(iter(by_row.values()))))}")
    out, done = [], 0
    for start, _, end, new in sorted(cuts):
        out += [xml[done:start], new]
        done = end
    return b"".join([*out, xml[done:]])


class Part(NamedTuple):
    """A rewritten part as it stands in the archive."""

    method: int
    crc: int
    size: int
    data: bytes


def packed(xml: bytes, method: int = zipfile.ZIP_DEFLATED) -> Part:
    """A part to be put into an archive: stored if it was, else deflated."""
    if method == zipfile.ZIP_STORED:
        return Part(method, zlib.crc32(xml), len(xml), xml)
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    return Part(zipfile.ZIP_DEFLATED, zlib.crc32(xml), len(xml), deflate.compress(xml) + deflate.flush())


def assembled(old, parts: dict[str, Part]) -> Iterator[bytes]:
    """The package in the file ``old`` with parts replaced, in pieces. All other members, their order, the directory's records and the comment are copied as they are, none of them inflated."""
    archive = zipfile.ZipFile(old)
    members = sorted(archive.infolist(), key=lambda i: i.header_offset)
    ends = [*(i.header_offset for i in members[1:]), archive.start_dir]
    if missing := parts.keys() - {i.filename for i in members}:
        raise WorkbookError(f"no part {min(missing)}")
    if any(i.header_offset > 0xFFFFFFFE or i.file_size > 0xFFFFFFFE for i in members):
        raise WorkbookError("the archive is too large")
    at, moved = 0, {}
    for info, end in zip(members, ends):
        old.seek(info.header_offset)
        moved[info.header_offset] = at
        if part := parts.get(info.filename):
            head = bytearray(old.read(30))
            head += old.read(sum(struct.unpack_from("<HH", head, 26)))
            _describe(head, 6, part)
            pieces = [bytes(head), part.data]
        else:
            pieces = iter(lambda n=[end - info.header_offset]: _some(old, n), b"")
        for piece in pieces:
            at += len(piece)
            yield piece
    old.seek(archive.start_dir)
    tail = bytearray(old.read())  # the directory, its end record, and the comment
    place, start = 0, at
    for info in archive.infolist():
        if part := parts.get(info.filename):
            _describe(tail, place + 8, part)
        struct.pack_into("<I", tail, place + 42, moved[info.header_offset])
        place += 46 + sum(struct.unpack_from("<HHH", tail, place + 28))
    end = tail.index(b"PK\x05\x06", place)
    struct.pack_into("<I", tail, end + 16, start)
    yield bytes(tail)


def _some(file, left: list[int]) -> bytes:
    """The next bytes of so many that are left, at most a MiB."""
    data = file.read(min(left[0], 1 << 20))
    left[0] -= len(data)
    return data


def _describe(record: bytearray, flags_at: int, part: Part) -> None:
    """Sizes of a rewritten part in a member's header or a directory's record, which differ in where they begin; no descriptor follows the data."""
    flags = struct.unpack_from("<H", record, flags_at)[0]
    struct.pack_into("<HH", record, flags_at, flags & ~8, part.method)
    struct.pack_into("<III", record, flags_at + 8, part.crc, len(part.data), part.size)


def rewrite_package(content: bytes, changes: dict[str, dict[str, str | None]]) -> bytes:
    """The package with changes by part; all else stays, compressed bytes included."""
    with zipfile.ZipFile(io.BytesIO(content)) as old:
        parts = {name: packed(rewrite_cells(old.read(name), new), old.getinfo(name).compress_type) for name, new in changes.items() if new}
    return b"".join(assembled(io.BytesIO(content), parts))


def package_of(sheets: list[tuple[str, str]], more: dict[str, str] | None = None, is_1904: bool = False) -> bytes:
    """A workbook of sheets (name, XML) and further parts."""
    space, package = MAIN[1:-1], "http://schemas.openxmlformats.org/package/2006"
    office, kind = RELATION[1:].partition("}")[0], "application/vnd.openxmlformats-officedocument.spreadsheetml"
    links = lambda found: f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/{to}" Target="{target}"/>' for i, (to, target) in enumerate(found, 1)) + "</Relationships>"
    kinds = {"xl/workbook.xml": "sheet.main", "xl/sharedStrings.xml": "sharedStrings", "xl/styles.xml": "styles"} | {f"xl/worksheets/sheet{i}.xml": "worksheet" for i in range(1, len(sheets) + 1)}
    own = {"sharedStrings": "xl/sharedStrings.xml", "styles": "xl/styles.xml"}
    listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets, 1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        + "".join(f'<Override PartName="/{part}" ContentType="{kind}.{k}+xml"/>' for part, k in kinds.items() if part not in own.values() or part in (more or {})) + "</Types>",
        "_rels/.rels": links([("officeDocument", "xl/workbook.xml")]),
        "xl/_rels/workbook.xml.rels": links([*(("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1)), *((k, p.removeprefix("xl/")) for k, p in own.items() if p in (more or {}))]),
        "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="{office}"><workbookPr date1904="{int(is_1904)}"/><sheets>{listed}</sheets></workbook>',
    } | {f"xl/worksheets/sheet{i}.xml": xml for i, (_, xml) in enumerate(sheets, 1)} | (more or {})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for part, xml in parts.items():
            z.writestr(zipfile.ZipInfo(part), xml, zipfile.ZIP_DEFLATED)  # of a fixed date, so that equal contents are equal files
    return out.getvalue()


def new_package(rows: list[tuple]) -> bytes:
    """A workbook of one sheet of texts, for tables that are to go out as a workbook; empty texts have no cell."""
    name = lambda j: (name(j // 26 - 1) if j >= 26 else "") + chr(65 + j % 26)
    line = lambda i, row: "".join(f'<c r="{name(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for j, v in enumerate(row) if v)
    body = "".join(f'<row r="{i}">{line(i, row)}</row>' for i, row in enumerate(rows, 1))
    return package_of([("Sheet1", f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')])


def rewritten(packages: DataFrame, changes: DataFrame) -> DataFrame:
    """path, content of the packages that pass: changes are (path, part, coordinate, new_value). A package without changes comes back as it is."""

    def each(found: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if found.empty:
            return pd.DataFrame({"path": [], "content": []})
        by_part: dict = {}
        for part, at, value in zip(new["part"], new["coordinate"], new["new_value"], strict=True):
            by_part.setdefault(part, {})[at] = value if isinstance(value, str) else None
        return pd.DataFrame({"path": [found["path"].iloc[0]], "content": [rewrite_package(found["content"].iloc[0], by_part)]})

    left = packages.select("path", "content").groupBy("path")
    return left.cogroup(changes.select("path", "part", "coordinate", "new_value").groupBy("path")).applyInPandas(each, "path string, content binary")


def save(results: DataFrame, folder: str, suffix: str = "_处理结果.xlsx") -> int:
    """Write each result under its source's name with a suffix into a folder that all executors mount; the number of files.

    Results are of workbooks that succeeded. A file of other contents is never overwritten, a source least of all; a
    file appears whole under its name or not at all, so an attempt that is repeated finds its own and goes on.
    """

    def put(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                to = f"{folder}/{posixpath.basename(path).rpartition('.')[0]}{suffix}"
                if os.path.realpath(to) == os.path.realpath(path.removeprefix("file:")):
                    raise WorkbookError("结果文件不能覆盖原始 Excel")
                if content is None:
                    raise WorkbookError("预检查未通过，不能生成结果文件")
                temporary = f"{to}.{uuid.uuid4().hex}"
                with open(temporary, "xb") as f:
                    f.write(content)
                try:
                    os.link(temporary, to)  # fails where the name is taken
                except FileExistsError:
                    with open(to, "rb") as f:
                        if f.read() != content:
                            raise
                finally:
                    os.unlink(temporary)
                yield pd.DataFrame({"to": [to]})

    return results.mapInPandas(put, "to string").count()
