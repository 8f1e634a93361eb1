"""The workbooks data source: partitions by sheet, filters, and the sink's two phases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceRegistration

from quillstone.plans import samples
from quillstone.plans import workbook as P
from quillstone.sources import datasource as D
from quillstone.sources import workbook as W

from .test_workbook import book, pump_house, sheet


def folder(tmp_path, **contents):
    for name, content in contents.items():
        (tmp_path / f"{name}.xlsx").write_bytes(content)
    return str(tmp_path)


def rows(df):
    return sorted(str(r.asDict() | {"path": r.path.rpartition("/")[2]}) for r in df.collect())


def many_sheets(n=20):
    return book([(f"s{i}", "visible", sheet([["设备代码"], *([str(i * 10 + j)] for j in range(5))])) for i in range(n)])


def test_scan_equals_entries(spark, tmp_path):
    at = folder(tmp_path, a=pump_house(), b=pump_house(blocked=True), c=many_sheets(), junk=b"none")
    (tmp_path / "_left.xlsx").write_bytes(b"left out")
    for hidden in (False, True):
        whole = W.entries(W.files(spark, at), hidden)
        assert rows(D.scan(spark, at, hidden)) == rows(whole)
    assert rows(D.scan(spark, f"{at}/a.xlsx")) == rows(W.entries(W.files(spark, f"{at}/a.xlsx")))
    assert D.scan(spark, f"file://{at}").count() == D.scan(spark, at).count()


def test_a_partition_for_each_sheet(spark, tmp_path):
    at = folder(tmp_path, c=many_sheets())
    found = D.scan(spark, at)
    assert found.rdd.getNumPartitions() == 20
    cells = found.filter("kind = 'cell'").groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("sheet").alias("n"), F.count("*").alias("k")).collect()
    assert len(cells) == 20 and {(r.n, r.k) for r in cells} == {(1, 6)}


def test_many_small_packages_come_together(spark, tmp_path):
    contents = {f"p{i:03}": pump_house(blocked=i % 7 == 0) for i in range(2 * D.TOGETHER + 3)}
    at = folder(tmp_path, **contents, junk=b"none", cut=pump_house()[:-40])
    found = D.scan(spark, at)
    assert found.rdd.getNumPartitions() == 3
    for hidden in (False, True):
        assert rows(D.scan(spark, at, hidden)) == rows(W.entries(W.files(spark, at), hidden))
    spark.conf.set(D.PUSHDOWN, "true")
    try:
        whole = W.entries(W.files(spark, at)).withColumn("path", F.regexp_replace("path", "^file:", ""))
        for condition in ("sheet_idx = 0 AND row_num = 1", "sheet = '备用'", "kind = 'error'", f"path = '{at}/p003.xlsx'", "sheet = 'none'"):
            assert rows(D.scan(spark, at).filter(condition)) == rows(whole.filter(condition)), condition
    finally:
        spark.conf.unset(D.PUSHDOWN)


def test_filters_go_to_the_source(spark, tmp_path):
    at = folder(tmp_path, a=pump_house(), c=many_sheets())
    spark.conf.set(D.PUSHDOWN, "true")
    try:
        found = D.scan(spark, at)
        assert found.filter("sheet = 's3'").rdd.getNumPartitions() == 1 and found.filter("sheet_idx IN (0, 1)").rdd.getNumPartitions() == 4
        for condition in ("row_num = 1 AND kind = 'cell'", "row_num >= 2", "row_num > 2 AND row_num <= 4", "sheet = 's3'", "kind = 'merge'", "state = 'visible'", f"path = '{at}/a.xlsx'", "sheet = 's3' AND sheet = 's4'"):
            assert rows(found.filter(condition)) == rows(W.entries(W.files(spark, at)).withColumn("path", F.regexp_replace("path", "^file:", "")).filter(condition)), condition
    finally:
        spark.conf.unset(D.PUSHDOWN)


def test_results_are_committed_as_a_whole(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    fine = pump_house()
    at = folder(source, a=fine, b=pump_house(blocked=True), plain=book([("s", "visible", sheet([["启用日期"], [None]]))]))
    mapping = spark.createDataFrame([("阀门", "FM-1"), ("储罐", "CG-2"), ("风机", "FJ-3")], "name string, code string")
    done = P.convert_files(spark, at, mapping)
    for _ in range(2):  # a second run finds its own results
        P.save_results(done, str(out))
        assert sorted(p.name for p in out.iterdir()) == ["a_处理结果.xlsx", "plain_处理结果.xlsx"]
    packages = spark.createDataFrame([("a", fine)], "path string, content binary")
    apart = P.convert(W.entries(packages), mapping)
    assert (out / "a_处理结果.xlsx").read_bytes() == bytes(P.results(packages, apart).first().content)
    assert (out / "plain_处理结果.xlsx").read_bytes() == (source / "plain.xlsx").read_bytes()
    with pytest.raises(Exception, match="不能覆盖原始"):
        P.save_results(done, at, ".xlsx")
    done.rows.unpersist()


def test_the_mapping_is_loaded_only_if_asked_for(spark, tmp_path):
    at = folder(tmp_path, dates=book([("s", "visible", sheet([["启用日期"], ["2020/5"]]))]))
    done = P.convert_files(spark, at, f"{tmp_path}/none.xlsx")
    assert [r.new_value for r in done.changes.collect()] == ["2020-05-01"]
    done.rows.unpersist()
    folder(tmp_path, named=book([("s", "visible", sheet([["设备小类名称", "设备小类编码"], ["阀门", None]]))]))
    with pytest.raises(Exception, match="none.xlsx|PATH_NOT_FOUND"):
        P.convert_files(spark, at, f"{tmp_path}/none.xlsx")
    folder(tmp_path, m=book([("m", "visible", sheet([["设备小类名称", "设备小类编码"], ["阀门", "FM-1"]]))]))
    (tmp_path / "in").mkdir()
    (tmp_path / "named.xlsx").rename(tmp_path / "in" / "named.xlsx")
    done = P.convert_files(spark, f"{tmp_path}/in", f"{tmp_path}/m.xlsx")
    assert [r.new_value for r in done.changes.collect()] == ["FM-1"]
    done.rows.unpersist()


def test_nothing_is_left_of_an_aborted_write(spark, tmp_path):
    kind = "path string, content binary"
    D.commit_packages(spark.createDataFrame([("x/a.xlsx", b"one")], kind), str(tmp_path))
    with pytest.raises(Exception, match="other contents"):
        D.commit_packages(spark.createDataFrame([("b.xlsx", b"two"), ("a.xlsx", b"three")], kind), str(tmp_path))
    with pytest.raises(Exception, match="one package|one name"):
        D.commit_packages(spark.createDataFrame([("c.xlsx", b"4"), ("d/c.xlsx", b"5")], kind), str(tmp_path))
    with pytest.raises(Exception, match="never overwritten"):
        spark.createDataFrame([], D.PARTS).write.format(D.NAME).mode("overwrite").save(str(tmp_path))
    assert [(p.name, p.read_bytes()) for p in tmp_path.iterdir()] == [("a.xlsx", b"one")]
    broken = spark.createDataFrame([("e.xlsx", "no/such.xlsx", "p", 0, 0, 0, b"")], D.PARTS)
    with pytest.raises(Exception):
        D.commit(broken, str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["a.xlsx"]


def test_planned_equals_scan(spark, tmp_path):
    assert D.planned(spark, str(tmp_path)).count() == 0
    few = folder(tmp_path, a=pump_house(), c=many_sheets(), junk=b"none")
    assert D.planned(spark, few).rdd.getNumPartitions() == D.scan(spark, few).rdd.getNumPartitions()
    for hidden in (False, True):
        assert rows(D.planned(spark, few, hidden)) == rows(D.scan(spark, few, hidden))
    many = folder(tmp_path, **{f"p{i:03}": pump_house(blocked=i % 7 == 0) for i in range(D.TOGETHER + 3)})
    assert D.planned(spark, many).rdd.getNumPartitions() == 2 and rows(D.planned(spark, many)) == rows(D.scan(spark, many))


def test_results_need_no_workers_of_the_driver(spark, tmp_path, monkeypatch):
    """A data source in Python is looked up, planned and committed by Python workers that stay on the driver."""
    spark.range(800).selectExpr("id AS c_custkey", "concat('n', id) AS c_name", "'阀门' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(DataSourceRegistration, "register", None)
    done = samples.sample_results(spark, str(tmp_path))
    assert "BatchScan" not in done._jdf.queryExecution().toString()
    # Of 8 books two are blocked, by keys 6, 13 and 713. Each other has 75 visible rows on three sheets, each with a code.
    assert done.select("book").distinct().count() == 6 and done.filter("coordinate LIKE 'E%'").count() == 6 * (75 + 3)


def members(content):
    """Compressed bytes of each member, with what the directory says of it."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        found = {}
        for i in z.infolist():
            at = i.header_offset + 30 + int.from_bytes(content[i.header_offset + 26 : i.header_offset + 28], "little") + int.from_bytes(content[i.header_offset + 28 : i.header_offset + 30], "little")
            found[i.filename] = (content[at : at + i.compress_size], i.compress_type, i.CRC, i.external_attr, i.date_time, i.comment, i.extra)
        return found


def test_other_members_keep_their_compressed_bytes():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"a comment"
        z.writestr("first", b"x" * 5000, zipfile.ZIP_BZIP2)
        z.writestr("s.xml", b'<w><sheetData><row r="1"><c r="A1"/></row></sheetData></w>', zipfile.ZIP_STORED)
        info = zipfile.ZipInfo("last", (1999, 1, 2, 3, 4, 6))
        info.comment, info.external_attr, info.extra = b"said", 7 << 16, b"\x99\x99\x02\x00ab"
        z.writestr(info, b"abc" * 99, zipfile.ZIP_DEFLATED, 1)
    unseekable = io.BytesIO()

    class Stream(io.RawIOBase):  # sizes then follow the data
        def writable(self):
            return True

        def write(self, data):
            return unseekable.write(data)

    with zipfile.ZipFile(Stream(), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("s.xml", b'<w><sheetData><row r="1"><c r="A1"/></row></sheetData></w>')
        z.writestr("other", b"y" * 100)
    for content in (out.getvalue(), unseekable.getvalue()):
        new = W.rewrite_package(content, {"s.xml": {"A1": "v"}})
        before, after = members(content), members(new)
        assert list(before) == list(after) and all(before[n] == after[n] for n in before if n != "s.xml")
        with zipfile.ZipFile(io.BytesIO(new)) as z, zipfile.ZipFile(io.BytesIO(content)) as old:
            assert z.testzip() is None and z.comment == old.comment and b'preserve">v<' in z.read("s.xml") and z.getinfo("s.xml").compress_type == old.getinfo("s.xml").compress_type
        assert W.rewrite_package(content, {}) == content
    with pytest.raises(W.WorkbookError, match="no part"):
        list(W.assembled(io.BytesIO(out.getvalue()), {"none": W.packed(b"")}))


def test_shared_strings_in_pages():
    texts = [f"text {i}" * (i % 3) for i in range(5 * W.Strings.PAGE + 7)]
    strings = W.Strings(iter(texts))
    assert [strings[i] for i in range(len(texts))] == texts and strings[-1] == texts[-1] and strings.page.cache_info().maxsize == W.Strings.OPEN
    for i in (len(texts), -len(texts) - 1):
        with pytest.raises(IndexError):
            strings[i]
    assert len(W.Strings(iter(())).pages) == 1


def test_size_guard(monkeypatch, spark):
    monkeypatch.setattr(W, "LARGEST", 100)
    with pytest.raises(W.WorkbookError, match="over 100 bytes"):
        W.Package(io.BytesIO(pump_house()))
