"""Workbooks as a Spark data source: partitions of whole packages or of a sheet each, and a sink that commits in two phases.

    spark.dataSource.register(Workbooks)
    spark.read.format("workbooks").load("s3://bucket/folder")     # rows of ENTRIES, as workbook.entries() gives
    packages.write.format("workbooks").mode("append").save(folder)

Files are opened through pyarrow's filesystems, so paths can be of any store that these reach. A reading task seeks its
sheet's member in the archive, and parses it row by row; it holds a row, a batch of cells, and pages of shared strings.
Where there are few packages, the driver reads each one's directory and list of sheets, and each sheet is a partition.
Where there are many, it does so for the large ones alone: small packages, which it knows by their size, come whole,
several to a task, so that tasks and the driver's reads don't grow with their sheets.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import WorkbookError
from .workbook import ENTRIES, LAST_ROW, UNREADABLE, Package, Part, arrow_schema, assembled, packed, record_batches, rewrite_cells, said

NAME = "workbooks"
#: Sheets are put together once there would be more partitions.
MOST_PARTITIONS = 10_000
#: Up to so many packages are planned by sheet, whatever their size; of more, those of at least LARGE bytes.
FEW, LARGE = 32, 4 << 20
#: Small packages in a task: at most so many, and about so many bytes.
TOGETHER, TOGETHER_BYTES = 32, 8 << 20
#: Parts to be written: a whole package has no part; a rewritten part goes into a copy of the package at source.
PARTS = "target string, source string, part string, method int, crc long, size long, data binary"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of a path or URI, and the path inside it; file:/x and file:///x are local."""
    if local := re.fullmatch(r"(?:file:(?://)?)?(/.*)", path):
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), posixpath.abspath(path))


class _Raw(io.RawIOBase):
    """A file of a store as Python's own files behave: a place before the beginning is an OSError."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, to: int, whence: int = 0) -> int:
        at = to + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("a place before the beginning")
        self.file.seek(at)
        return at

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def opened(path: str) -> io.BufferedReader:
    files, inner = store(path)
    return io.BufferedReader(_Raw(files.open_input_file(inner)), 1 << 16)


def listed(path: str) -> list[tuple[str, int]]:
    """The .xlsx files, upper case included, of a folder and its subfolders, or the file itself, in order, each with its size. Names that begin with . or _ are left out."""
    files, inner = store(path)
    info = files.get_file_info(inner)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if info.type == fs.FileType.NotFound:
        raise WorkbookError(f"nothing at {path}")
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [i for i in files.get_file_info(fs.FileSelector(inner, recursive=True)) if i.type == fs.FileType.File]
    hidden = lambda p: any(x[:1] in "._" for x in posixpath.relpath(p, inner).split("/"))
    return sorted((prefix + i.path, i.size) for i in found if i.path.lower().endswith(".xlsx") and not hidden(i.path))


@dataclass
class Sheets(InputPartition):
    """Sheets of packages, as (path, number of the sheet, or None and an error, or None and no error for all sheets)."""

    found: list[tuple[str, int | None, str | None]] = field(default_factory=list)


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], hidden: bool):
        self.paths, self.hidden = paths, hidden
        self.rows, self.wanted = (1, LAST_ROW), {}

    def _planned(self, path: str) -> list[tuple]:
        try:
            with opened(path) as f:
                return [(path, s["sheet_idx"], None) for s in Package(f).sheets(self.hidden) if self._is_wanted(s)]
        except (*UNREADABLE, OSError) as error:
            return [(path, None, said(error))]

    def _is_wanted(self, values: dict) -> bool:
        return all(values[c] in some for c, some in self.wanted.items() if c in values and c not in ("path", "kind"))

    def partitions(self) -> list[Sheets]:
        files = [(p, size) for p, size in chain.from_iterable(map(listed, self.paths)) if p in self.wanted.get("path", (p,))]
        large = [p for p, size in files if len(files) <= FEW or size is None or size >= LARGE]
        with ThreadPoolExecutor(16) as pool:
            found = list(chain.from_iterable(pool.map(self._planned, large)))
        step = -(-len(found) // MOST_PARTITIONS) or 1
        apart = set(large)
        return [Sheets(found[i : i + step]) for i in range(0, len(found), step)] + self._whole([f for f in files if f[0] not in apart])

    @staticmethod
    def _whole(files: list[tuple[str, int]]) -> list[Sheets]:
        """Small packages, several to a partition."""
        made, held = [], 0
        for path, size in files:
            if not made or len(made[-1].found) == TOGETHER or held + size > TOGETHER_BYTES:
                made.append(Sheets())
                held = 0
            made[-1].found.append((path, None, None))
            held += size
        return made

    def read(self, partition: Sheets) -> Iterator:
        for path, of_path in groupby(partition.found, lambda s: s[0]):
            yield from record_batches(self._entries(path, list(of_path)), arrow_schema())

    def _entries(self, path: str, sheets: list[tuple]) -> Iterator[dict]:
        """Rows of a package's sheets. One that can't be read gives a row of kind error after what was read before it."""
        kinds = self.wanted.get("kind")
        if sheets[0][1] is None and sheets[0][2] is None:
            sheets = self._planned(path)  # here as in the driver: a package that can't be opened is an error row
        try:
            if not sheets:
                return
            if error := sheets[0][2]:
                yield {"path": path, "kind": "error", "raw": error}
                return
            with opened(path) as f:
                package, wanted = Package(f), {i for _, i, _ in sheets}
                for sheet in package.sheets(self.hidden):
                    if sheet["sheet_idx"] in wanted:
                        for e in package.content(sheet, self.rows) if sheet["part"] else [sheet]:
                            if not kinds or e["kind"] in kinds:
                                yield {"path": path, **e}
        except UNREADABLE as error:
            yield {"path": path, "kind": "error", "raw": said(error)}


class FilteringReader(Reader):
    """Also takes filters: by path, sheet and kind, by which partitions and rows are left out before they are parsed, and by bounds of row_num, outside of which cells aren't decoded. Spark applies all of them again."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("path", "kind", "sheet_idx", "sheet", "state", "part") and isinstance(f, EqualTo | In):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, some) & some
            elif column == "row_num" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                low, high = self.rows
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    high = min(high, f.value - isinstance(f, LessThan))
                self.rows = low, high
            yield f


@dataclass
class Staged(WriterCommitMessage):
    """Files of one task: (staged, final) paths inside the store."""

    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """Tasks stage packages under names of their own; commit() moves those of successful tasks to their names once none of these is taken by other contents, abort() removes them all."""

    def __init__(self, folder: str):
        self.folder = folder
        self.staging = posixpath.join(store(folder)[1], f"_staged-{uuid.uuid4().hex}")

    def write(self, iterator) -> Staged:
        files, inner = store(self.folder)
        files.create_dir(self.staging, recursive=True)
        done = []
        rows = chain.from_iterable(batch.to_pylist() for batch in iterator)
        for target, of_target in groupby(rows, lambda r: r["target"]):
            if not target or "/" in target or target[0] in "._":
                raise WorkbookError(f"no name of a result: {target}")
            staged = posixpath.join(self.staging, f"{uuid.uuid4().hex}.part")
            with files.open_output_stream(staged) as out:
                for piece in self._pieces(target, list(of_target)):
                    out.write(piece)
            done.append((staged, posixpath.join(inner, target)))
        return Staged(done)

    def _pieces(self, target: str, rows: list[dict]) -> Iterator[bytes]:
        source, whole = rows[0]["source"], [r["data"] for r in rows if r["part"] is None and r["data"] is not None]
        if whole or source is None:
            if len(rows) != 1 or not whole:
                raise WorkbookError(f"not one package for {target}")
            return iter(whole)
        if any(r["source"] != source for r in rows):
            raise WorkbookError(f"several sources for {target}")
        files, inner = store(source)
        if posixpath.realpath(posixpath.join(store(self.folder)[1], target)) == posixpath.realpath(inner) and isinstance(files, fs.LocalFileSystem):
            raise WorkbookError("结果文件不能覆盖原始 Excel")
        parts = {r["part"]: Part(r["method"], r["crc"], r["size"], r["data"]) for r in rows if r["part"] is not None}
        return self._copied(source, parts)

    @staticmethod
    def _copied(source: str, parts: dict[str, Part]) -> Iterator[bytes]:
        with opened(source) as old:
            yield from assembled(old, parts)

    def commit(self, messages: list) -> None:
        files, moves = store(self.folder)[0], sorted((final, staged) for m in messages if m for staged, final in m.files)
        if len({final for final, _ in moves}) < len(moves):
            raise WorkbookError("several results have one name")
        left = []
        for final, staged in moves:
            if files.get_file_info(final).type == fs.FileType.NotFound:
                left.append((staged, final))
            elif _content(files, final) != _content(files, staged):
                raise FileExistsError(f"{final} has other contents")
        for staged, final in left:
            files.move(staged, final)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        files = store(self.folder)[0]
        if files.get_file_info(self.staging).type == fs.FileType.Directory:
            files.delete_dir(self.staging)


def _content(files: fs.FileSystem, path: str) -> bytes:
    with files.open_input_file(path) as f:
        return f.read()


class Workbooks(DataSource):
    """Options: path (or several, by load([...])), hidden (read hidden sheets too), pushdown (take filters; needs spark.sql.python.filterPushdown.enabled)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ENTRIES

    def _flag(self, name: str) -> bool:
        return str(self.options.get(name, "")).lower() == "true"

    def reader(self, schema: StructType) -> Reader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return (FilteringReader if self._flag("pushdown") else Reader)(paths, self._flag("hidden"))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise WorkbookError("workbooks are never overwritten: write in mode append")
        if schema.names != [c.split()[0] for c in PARTS.split(", ")]:
            raise WorkbookError(f"rows to be written have the columns {PARTS}")
        return Writer(self.options["path"])


def scan(spark: SparkSession, source: str, hidden: bool = False) -> DataFrame:
    """Rows of the workbooks at a path, as workbook.entries() gives them, but read by sheet. Filters go to the source if the session allows it."""
    spark.dataSource.register(Workbooks)
    pushdown = str(spark.conf.get(PUSHDOWN, "false")).lower()
    return spark.read.format(NAME).option("hidden", str(hidden).lower()).option("pushdown", pushdown).load(source)


def planned(spark: SparkSession, source: str, hidden: bool = False) -> DataFrame:
    """The rows of scan() by the same partitions, but listed at once and by this process. scan() has Python workers of the driver do so, which stay there; it takes filters."""
    reader = Reader([source], hidden)
    found = [(p.found,) for p in reader.partitions()]

    def read(batches):
        for batch in batches:
            for some in batch["found"].to_pylist():
                yield from reader.read(Sheets([(s["path"], s["sheet_idx"], s["error"]) for s in some]))

    dealt = spark.sparkContext.parallelize(found, len(found) or 1)
    return spark.createDataFrame(dealt, "found array<struct<path: string, sheet_idx: int, error: string>>").mapInArrow(read, ENTRIES)


def _name(path: str, suffix: str):
    return F.concat(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), F.lit(suffix))


def commit(parts: DataFrame, folder: str) -> None:
    """Write rows of PARTS as packages: all that they name appear in the folder, or none. As the sink does, but this process commits, without Python workers of the driver."""
    writer, kind = Writer(folder), pa.schema([("staged", pa.string()), ("final", pa.string())])
    columns = [c.split() for c in PARTS.split(", ")]
    rows = parts.select(*(F.col(c).cast(kind).alias(c) for c, kind in columns)).repartition("target").sortWithinPartitions("target", "part")

    def stage(batches):
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, moved)) for moved in writer.write(batches).files], kind)

    try:
        writer.commit([Staged([tuple(r) for r in rows.mapInArrow(stage, "staged string, final string").collect()])])
    except BaseException:
        writer.abort([])
        raise


def commit_packages(packages: DataFrame, folder: str, suffix: str = ".xlsx") -> None:
    """Write whole packages (path, content) under the names of their paths."""
    none = lambda kind: F.lit(None).cast(kind)
    commit(packages.select(_name("path", suffix).alias("target"), none("string").alias("source"), none("string").alias("part"), none("int").alias("method"), none("long").alias("crc"), none("long").alias("size"), F.col("content").alias("data")), folder)


def commit_changes(paths: DataFrame, changes: DataFrame, folder: str, suffix: str = "_处理结果.xlsx") -> None:
    """Write a copy of each package of ``paths`` (path) with its changes (path, part, coordinate, new_value).

    Each changed part is rewritten in a group of its own, from the store; a package is put together in one task from
    its rewritten parts and the source's other members. A package without changes is copied as it is.
    """

    def rewrite(key: tuple, new: pd.DataFrame) -> pd.DataFrame:
        path, name = key
        with opened(path) as f, zipfile.ZipFile(f) as archive:
            info = archive.getinfo(name)
            values = [v if isinstance(v, str) else None for v in new["new_value"]]
            part = packed(rewrite_cells(archive.read(info), dict(zip(new["coordinate"], values))), info.compress_type)
        return pd.DataFrame({"source": [path], "part": [name], "method": [part.method], "crc": [part.crc], "size": [part.size], "data": [part.data]})

    kind = PARTS.removeprefix("target string, ")
    found = changes.join(paths.select("path"), "path", "left_semi").groupBy("path", "part").applyInPandas(rewrite, kind)
    all_of_it = paths.select(F.col("path").alias("source"), *(F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in kind.split(", ")[1:])))
    commit(found.unionByName(all_of_it).withColumn("target", _name("source", suffix)), folder)
