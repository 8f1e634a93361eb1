"""Ledger queries against DuckDB, and the structure operators on a small workbook's cells."""

import glob
import os
import random

import duckdb
import pytest

from quillstone.operators import convert, mapping
from quillstone.plans import ledger, samples, workbook

QUERIES = ledger.QUERIES | {"xlsx_roundtrip": workbook.roundtrip} | samples.QUERIES
ORACLE_SQL = ledger.ORACLE_SQL | {"xlsx_roundtrip": workbook.ROUNDTRIP_SQL} | samples.ORACLE_SQL
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def shown(rows):
    return sorted(str([None if v is None or v != v else str(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_duckdb(spark, con, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]}) AS q").fetchall()
    assert shown(map(tuple, got.select(columns).collect())) == shown(want)


def test_mapping_rules(spark):
    t = spark.createDataFrame([("a", "1"), ("a", "1"), (None, None), ("b", " "), ("c", "2"), ("c", "3"), ("d", "1")], "name string, code string")
    assert sorted(map(tuple, mapping.problems(t).collect())) == [("BLANK", "b"), ("MANY_CODES", "c"), ("MANY_NAMES", "1")]
    fold = mapping.fold(spark.createDataFrame([(1, "n1", "A"), (2, "n1", "B"), (3, "n2", "B"), (4, "n3", "C"), (5, "n3", "C")], "i int, name string, code string"), "i").first()
    assert fold.n_pairs == 3 and fold.message == "n1对应多个编码"


def greedy(rows):
    """Accepted pairs, and (name, code, kind) of rejected rows, one by one."""
    names, codes, said = {}, {}, []
    for _, name, code in sorted(rows):
        if name in names:
            said += [(name, code, "MANY_CODES")] * (names[name] != code)
        elif code in codes:
            said.append((name, code, "MANY_NAMES"))
        else:
            names[name], codes[code] = code, name
    return sorted(names.items()), sorted(said)


def test_rounds_of_local_minima_equal_the_fold(spark):
    rng = random.Random(3)
    chain = [(i, f"n{(i + 1) // 2}", f"c{i // 2}") for i in range(24)]
    for rows in ([(i, f"n{rng.randrange(30)}", f"c{rng.randrange(25)}") for i in range(400)], chain, [(i, f"n{i}", f"c{i}") for i in range(20)], [(7, "n", "c"), (7, "n", "b"), (7, "m", "b")]):
        accepted, rejected = mapping.rejections(spark.createDataFrame(rows, "i int, name string, code string"), "i")
        got = sorted(tuple(r)[1:] for r in accepted.collect()), sorted(tuple(r)[1:] for r in rejected.collect())
        assert got == greedy(rows)
    empty = mapping.rejections(spark.createDataFrame([(1, None, "c")], "i int, name string, code string"), "i")
    assert [t.count() for t in empty] == [0, 0]


def test_publishing_in_one_pass(spark, tmp_path):
    rows = [("s", 2, "阀门", "x", "2019-03-02", None, None, "7"), ("s", 3, "未知", None, "2019", None, None, None)]
    t = spark.createDataFrame(rows, "sheet string, row_num int, name string, code string, d1 string, d2 string, d3 string, device string")
    m = spark.createDataFrame([("阀门", "FM-1")], "name string, code string")
    bad = convert.candidates(t, m)
    assert convert.publish(bad, f"{tmp_path}/bad") == convert.statistics(bad).first().asDict() == {"rows": 2, "issues": 2, "subcategory_filled": 0, "dates_converted": 0, "dates_cleared": 0, "codes_formatted": 0}
    assert not list(tmp_path.iterdir())
    fine = convert.candidates(t.filter("row_num = 2"), m)
    assert convert.publish(fine, f"{tmp_path}/fine") == convert.statistics(fine).first().asDict()
    assert [p.name for p in tmp_path.iterdir()] == ["fine"] and spark.read.parquet(f"{tmp_path}/fine").first().code == "FM-1"
    with pytest.raises(FileExistsError):
        convert.publish(fine, f"{tmp_path}/fine")


def test_gate_blocks_everything(spark):
    rows = [("s", 2, "阀门", "x", "2019-03-02", None, None, "7"), ("s", 3, "未知", None, "2019", None, None, None), ("s", 4, None, "", None, None, None, "")]
    t = spark.createDataFrame(rows, "sheet string, row_num int, name string, code string, d1 string, d2 string, d3 string, device string")
    m = spark.createDataFrame([("阀门", "FM-1")], "name string, code string")
    blocked = convert.candidates(t, m)
    assert sorted((r.row_num, r.kind) for r in convert.issues(blocked).collect()) == [(3, "UNMATCHED"), (3, "YEAR_ONLY")]
    assert tuple(convert.statistics(blocked).first()) == (2, 2, 0, 0, 0, 0) and convert.output(blocked).count() == 0
    fine = convert.candidates(t.filter("row_num <> 3"), m)
    assert tuple(convert.statistics(fine).first()) == (1, 0, 1, 1, 0, 1)
    assert tuple(convert.output(fine).first()) == ("s", 2, "阀门", "FM-1", "2019-03-02", None, None, '{"注册代码":"7"}')
