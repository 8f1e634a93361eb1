"""Date normalisation as one Column: struct<status, value>, status BLANK, OK, CLEARED or YEAR_ONLY."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ANY_DIGIT, fold_digits, let, plain_decimal, strip

# Clock times of ISO texts as Python 3.13 reads them: separators are all there or all missing, a fraction may follow any
# part, and digits alone may follow six of them. Before a zone, one more character, or anything behind six digits of a
# fraction, is passed over.
_H, _M, _ONE, _REST = r"(?:[01]\d|2[0-3])", r"[0-5]\d", r"[\x00-\x7F&&[^+\-Z]]", r"[^+\-Z]*"
_HMS = rf"{_H}(?::{_M}(?::{_M})?|{_M}(?:{_M})?)?"
_PLAIN = rf"(?:{_HMS}(?:[.,]\d+)?|{_H}{_M}{_M}\d\d+|{_H}:{_M}:{_M}:\d+)"
_BEFORE = rf"(?:{_HMS}(?:{_ONE}|[.,](?:\d{{1,5}}|\d{{6}}{_REST}))?|{_H}{_M}{_M}(?:\d{{2,5}}|\d{{6}}{_REST})|{_H}:{_M}:{_M}:(?:\d{{1,5}}|\d{{6}}{_REST}))"
#: Less than 24 hours, whatever the minutes and seconds.
_H22, _M58 = r"(?:[01]\d|2[0-2])", r"(?:[0-4]\d|5[0-8])"
_FULL, _FULL_DASHED = rf"(?:{_H22}\d{{4}}|23{_M58}\d\d|2359[0-5]\d)", rf"(?:{_H22}:\d\d:\d\d|23:{_M58}:\d\d|23:59:[0-5]\d)"
_OFFSET = rf"(?:{_H22}(?::\d\d(?::\d\d)?|\d\d(?:\d\d)?)?|23(?::{_M58}(?::\d\d)?|{_M58}(?:\d\d)?|:59(?::[0-5]\d)?|59(?:[0-5]\d)?)?)"
_TIME = rf"(?:{_PLAIN}|{_BEFORE}(?:Z|[+-](?:{_OFFSET}(?:[.,]\d+)?|{_FULL}\d\d+|{_FULL_DASHED}:\d+)))"
_DAY = rf"\A\d{{4}}(-?)\d{{2}}\1\d{{2}}(?:(?s:.){_TIME})?\z"
#: Groups: year; week and day with separators; week, and day where one digit or an even number of digits follows it.
_WEEK = rf"\A(\d{{4}})(?:-W(\d\d)(?:-(\d)(?:\z|(?!\d)(?s:.){_TIME})|(?:(?!-)(?s:.)|-(?=.\d)){_TIME})?|W(\d\d)(?:(\d)?(?:(?!\d)(?s:.){_TIME})?|(?=\d(?:\d\d)+(?!\d))\d{_TIME}|(?=(?:\d\d)+(?!\d))(\d)\d{_TIME}))\z"
_YMD = r"\A(\d{4})([-/.])(\d{1,2})(?:\2(\d{1,2}))?\z"


def _tag(status: str, value: Column | None = None) -> Column:
    return F.struct(F.lit(status).alias("status"), (F.lit(None).cast("string") if value is None else value).alias("value"))


def _found(value: Column) -> Column:
    return F.struct(F.when(value.isNull(), "CLEARED").otherwise("OK").alias("status"), value.alias("value"))


def _date(y: Column, m: Column, d: Column) -> Column:
    """ISO text of a calendar date, null if there is none or the year is 0. The months and days that can't be are told first, as a cast that fails is slow."""
    can_be = lambda n: [f"{i:0{width}}" for width in (1, 2) for i in range(1, n + 1)]
    return F.when((y != "0000") & m.isin(can_be(12)) & d.isin(can_be(31)), F.concat_ws("-", y, m, d).try_cast("date").cast("string"))


def _year_month_day(t: Column) -> Column:
    two = F.substring(t, 7, 1).between("0", "9")  # a month of two digits
    month, day = F.when(two, F.substring(t, 6, 2)).otherwise(F.substring(t, 6, 1)), F.when(two, F.substring(t, 9, 2)).otherwise(F.substring(t, 8, 2))
    return _date(F.substring(t, 1, 4), month, F.when(day == "", "1").otherwise(day))


def _by_week(t: Column) -> Column:
    found = F.regexp_extract(t, _WEEK, 1), F.concat(F.regexp_extract(t, _WEEK, 2), F.regexp_extract(t, _WEEK, 4)), F.concat(F.regexp_extract(t, _WEEK, 3), F.regexp_extract(t, _WEEK, 5), F.regexp_extract(t, _WEEK, 6))

    def day(p: Column) -> Column:
        week, nth = p["week"].try_cast("int"), F.when(p["day"] == "", 1).otherwise(p["day"].try_cast("int"))
        fourth = F.concat(p["year"], F.lit("-01-04")).try_cast("date")
        d = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7 + nth - 1)
        inside = (p["year"] >= "0001") & week.between(1, 53) & nth.between(1, 7)
        return F.when(inside, F.when((F.extract(F.lit("YEAROFWEEK"), d) == p["year"].cast("int")) & d.between("0001-01-01", "9999-12-31"), d.cast("string")))

    return let(F.struct(*(c.alias(n) for c, n in zip(found, ("year", "week", "day")))), day)


def _iso(t: Column) -> Column:
    dashed = F.substring(t, 5, 1) == "-"
    at = lambda with_dash, without: F.when(dashed, F.substring(t, with_dash, 2)).otherwise(F.substring(t, without, 2))
    return F.when(t.rlike(_DAY), _date(F.substring(t, 1, 4), at(6, 5), at(9, 7))).when(t.rlike(_WEEK), _by_week(t))


def _serial(x: Column, is_1904: Column) -> Column:
    """A spreadsheet serial's day; the 1900 system counts a 29 February 1900."""
    day = F.floor(x)
    carry = F.floor(F.rint((x - day) * 86_400_000) / 86_400_000)
    start = F.when(is_1904, F.lit("1904-01-01")).otherwise("1899-12-30").cast("date")
    n = day + carry + F.when(~is_1904 & (x > 0) & (x < 60), 1).otherwise(0)
    inside = n <= F.when(is_1904, 2_957_003).otherwise(2_958_465)
    return F.when(inside, F.date_add(start, F.when(inside, n).otherwise(0).cast("int")).cast("string"))


def _restored(value: Column, numeric: Column | None, number_format: Column | None) -> Column:
    """The trailing zero that a number of format 0.00 lost."""
    if numeric is None or number_format is None:
        return value
    lost = F.coalesce(numeric, F.lit(False)) & (number_format == "0.00") & value.rlike(r"\A[^.]{4}\.") & (F.length(value) < 7)
    return F.when(lost, F.rpad(value, 7, "0")).otherwise(value)


def _year_only(c: Column) -> Column:
    """A year of any digits; zeros behind it are ASCII ones."""
    return c.rlike(rf"\A{ANY_DIGIT}{{4}}(\.0+)?\z")


def _by_number(plain: Column, is_1904: Column) -> Column:
    short, x = plain.rlike(r"\A\d{4}\.\d{1,2}\z"), plain.try_cast("double")
    return (
        F.when(plain.isNull(), _tag("CLEARED"))
        .when((x == F.floor(x)) & x.between(1000, 9999), _tag("YEAR_ONLY"))
        .when(short & _year_only(plain), _tag("YEAR_ONLY")).when(short, _found(_year_month_day(plain)))
        .when(is_1904 & (x >= 0) & (x < 1), _tag("OK", F.lit("1904-01-01")))
        .when((x < 1) | (x > 100_000_000), _tag("CLEARED")).otherwise(_found(_serial(x, is_1904)))
    )


def _rules(text: Column, t: Column, numeric: Column | None, by_number: Column | None) -> Column:
    """``t`` is the stripped text with digits folded."""
    rules = F.when(text.isNull() | (t == ""), _tag("BLANK")).when(_year_only(text), _tag("YEAR_ONLY")).when(t.rlike(_YMD), _found(_year_month_day(t)))
    if numeric is None:
        return rules.otherwise(_found(_iso(text)))
    return rules.when(~F.coalesce(numeric, F.lit(False)), _found(_iso(text))).otherwise(by_number)


def _epoch(is_1904: Column | None) -> Column:
    return F.lit(False) if is_1904 is None else F.coalesce(is_1904, F.lit(False))


def normalize_date(value: Column, numeric: Column | None = None, number_format: Column | None = None, is_1904: Column | None = None) -> Column:
    """The rules in order: trailing-zero restore, blank, year only, year-month(-day), ISO text, serials. Without ``numeric`` all values are texts; a value of type boolean is cleared.

    One expression; with_dates() gives the same by steps, which is faster, as each step is computed once.
    """
    truth, value = (F.typeof(value) == "boolean") & value.isNotNull(), value.cast("string")
    text = strip(_restored(value, numeric, number_format))
    by_number = None if numeric is None else let(plain_decimal(fold_digits(text)), lambda plain: _by_number(plain, _epoch(is_1904)))
    return F.when(truth, _tag("CLEARED")).otherwise(_rules(text, fold_digits(text), numeric, by_number))


def with_dates(rows: DataFrame, dates: dict[str, dict]) -> DataFrame:
    """Adds normalised dates: by name, the arguments of normalize_date(). Texts and plain numbers are columns on the way."""
    step = lambda n, kind: f"__{n}_{kind}"
    at = lambda n, kind: F.col(f"`{step(n, kind)}`")
    numbers = [n for n, d in dates.items() if d.get("numeric") is not None]
    rows = rows.withColumns({step(n, "text"): strip(_restored(d["value"], d.get("numeric"), d.get("number_format"))) for n, d in dates.items()})
    rows = rows.withColumns({step(n, "t"): fold_digits(at(n, "text")) for n in dates})
    rows = rows.withColumns({step(n, "plain"): F.when(F.coalesce(dates[n]["numeric"], F.lit(False)), plain_decimal(at(n, "t"))) for n in numbers}) if numbers else rows
    rows = rows.withColumns({n: _rules(at(n, "text"), at(n, "t"), d.get("numeric"), _by_number(at(n, "plain"), _epoch(d.get("is_1904"))) if n in numbers else None) for n, d in dates.items()})
    return rows.drop(*(step(n, kind) for n in dates for kind in ("text", "t", "plain")))


def normalize_native_date(value: Column) -> Column:
    """The same struct for a column of dates or timestamps: the day, whatever the time."""
    return F.when(value.isNull(), _tag("BLANK")).otherwise(_tag("OK", value.cast("date").cast("string")))
