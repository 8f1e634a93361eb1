"""Scalar rules, line by line of the decision tables: dates D0 to D12, device codes C1 to C7."""

import datetime

from pyspark.sql import functions as F

from quillstone.functions.codes import normalize_device_code
from quillstone.functions.dates import normalize_date, normalize_native_date, with_dates

YEAR, BLANK, GONE = ("YEAR_ONLY", None), ("BLANK", None), ("CLEARED", None)


def ok(day):
    return "OK", day


#: Line of the table: (text or number, what comes out).
TEXTS = {
    "D1": [(None, BLANK), ("", BLANK), ("\t 　", BLANK)],
    "D4": [("1987", YEAR), (" 1987\n", YEAR), ("1987.000", YEAR), ("１９８７", YEAR)],
    "D5": [("1987-6-5", ok("1987-06-05")), ("1987/06/05", ok("1987-06-05")), ("1987.6.5", ok("1987-06-05")), ("1987.6", ok("1987-06-01")), ("1987-12", ok("1987-12-01")), ("2000-02-29", ok("2000-02-29")), ("1900-02-29", GONE), ("1987-00", GONE), ("1987/4/31", GONE), ("0000/5", GONE), ("0001-01", ok("0001-01-01"))],
    "D6": [("19870605", ok("1987-06-05")), ("1987-06-05 23", ok("1987-06-05")), ("1987-06-05_2359", ok("1987-06-05")), ("19870605T23:59:58.25-03:30", ok("1987-06-05")), ("1987-06-05T23:60", GONE), ("1987-06-05T", GONE), ("1987-06-05Z", GONE), ("1987-6-5 10:00", GONE), ("1987/06/05 10:00", GONE), ("198706", GONE), ("1987-156", GONE), ("31234", GONE), ("gestern", GONE), ("1987-06/05", GONE),
           ("2020-W53-5", ok("2021-01-01")), ("2020W535", ok("2021-01-01")), ("2021-W53-1", GONE), ("2019-W01", ok("2018-12-31")), ("2019-W00-1", GONE), ("2019-W10-8", GONE)],
}
NUMBERS = {
    "D4": [("1987", YEAR), ("1987.0", YEAR)],
    "D5": [("1987.6", ok("1987-06-01")), ("1987.11", ok("1987-11-01")), ("1987.13", GONE)],
    "D7": [("nan", GONE), ("twelve", GONE), ("1e", GONE)],
    "D8": [("1.987E3", YEAR), ("19.87e2", YEAR), ("9.999E+3", YEAR)],
    "D9": [("1.98711E3", ok("1987-11-01")), ("4321.5", ok("4321-05-01"))],
    "D11": [("0", GONE), ("0.999", GONE), ("-5", GONE)],
    "D12": [("1", ok("1900-01-01")), ("58.5", ok("1900-02-27")), ("60.25", ok("1900-02-28")), ("62", ok("1900-03-02")), ("999", ok("1902-09-25")), ("10000", ok("1927-05-18")), ("36526.9999999999", ok("2000-01-02")), ("1987.125", ok("1905-06-09")), ("2958465.5", ok("9999-12-31")), ("2958466", GONE), ("7e9", GONE)],
}


def both(spark, cases, numeric):
    rows = [(i, v, line, want) for i, (line, v, want) in enumerate((line, v, want) for line, some in cases.items() for v, want in some)]
    t = spark.createDataFrame([r[:2] for r in rows], "i int, v string")
    for how in ([None, F.lit(False)] if not numeric else [F.lit(True)]):
        got = {r.i: (tuple(r.d), tuple(r.e)) for r in with_dates(t.withColumn("d", normalize_date(F.col("v"), how)), {"e": {"value": F.col("v"), "numeric": how}}).collect()}
        for i, v, line, want in rows:
            assert got[i] == (want, want), (line, v)


def test_texts(spark):
    both(spark, TEXTS, False)


def test_numbers(spark):
    both(spark, NUMBERS, True)


def test_restored_zeros_and_the_later_epoch(spark):
    cases = [("1987.1", "0.00", False, ok("1987-10-01")), ("1987.1", "0.0", False, ok("1987-01-01")), ("987.1", "0.00", False, ok("1902-09-13")), ("1987.0", "0.00", False, YEAR), ("0.25", "", True, ok("1904-01-01")), ("-0.5", "", True, GONE), ("59", "", True, ok("1904-02-29")), ("366", "", True, ok("1905-01-01"))]
    t = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, v string, f string, e boolean")
    got = {r.i: tuple(r.d) for r in t.select("i", normalize_date(F.col("v"), F.lit(True), F.col("f"), F.col("e")).alias("d")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_booleans_are_cleared(spark):
    t = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [tuple(r.d) for r in t.select(normalize_date(F.col("b")).alias("d")).collect()] == [GONE, GONE, BLANK]


def test_native_dates(spark):
    t = spark.createDataFrame([(datetime.datetime(1987, 6, 5, 23, 59),), (None,)], "t timestamp")
    assert [tuple(r.d) for r in t.select(normalize_native_date(F.col("t")).alias("d")).collect()] == [ok("1987-06-05"), BLANK]


#: Line of the table: (value, numeric, format, what is wrapped).
CODES = {
    "C1": [(None, 0, "", None), ("\n", 0, "", None), ("/", 0, "", None), ("nULL\t", 0, "", None), ("//", 0, "", "//"), ("null0", 0, "", "null0")],
    "C2": [("seven", 1, "", None), ("Infinity", 1, "", None)],
    "C3": [("9.0071992547409931E+16", 1, "", "90071992547409931"), ("5e-4", 1, "", "0.0005")],
    "C4": [("15.00", 1, "", "15"), ("15.250", 1, "", "15.250"), ("-3.0", 1, "", "-3")],
    "C5": [("15", 1, "00000", "00015"), ("-15", 1, "00000", "-0015"), ("123456", 1, "0000", "123456"), ("15", 1, "0#0", "15"), ("1.5", 1, "0000", "1.5"), ("15", 0, "00000", "15")],
    "C6": [('{ "注册代码" : "K-9" }', 0, "", "K-9"), ('{"注册代码":" / "}', 0, "", None), ('{"注册代码":"a","b":1}', 0, "", '{\\"注册代码\\":\\"a\\",\\"b\\":1}'), ('{"代码":"a"}', 0, "", '{\\"代码\\":\\"a\\"}'), ('{"注册代码":["a"]}', 0, "", '{\\"注册代码\\":[\\"a\\"]}')],
    "C7": [("K-9", 0, "", "K-9"), ("  k 9 ", 0, "", "  k 9 "), ("007", 0, "", "007"), ("设\\备\"", 0, "", '设\\\\备\\"'), ("a\tb\x01c", 0, "", "a\\tb\\u0001c"), ("9" * 50, 0, "", "9" * 50)],
}


def test_codes(spark):
    rows = [(i, *c, line) for i, (line, c) in enumerate((line, c) for line, some in CODES.items() for c in some)]
    t = spark.createDataFrame([(i, v, bool(n), f) for i, v, n, f, _, _ in rows], "i int, v string, n boolean, f string")
    got = {r.i: (r.d, r.e) for r in t.select("i", normalize_device_code(F.col("v"), F.col("n"), F.col("f")).alias("d"), normalize_device_code(F.col("v")).alias("e")).collect()}
    for i, v, n, _, want, line in rows:
        want = None if want is None else '{"注册代码":"' + want + '"}'
        assert got[i][0] == want and (n or got[i][1] == want), (line, v)
