"""Random values against the decision tables, written out here in plain Python: dates D1 to D12, device codes C1 to C7."""

import datetime
import json
import math
import random
import re
from decimal import Decimal, InvalidOperation

from pyspark.sql import functions as F

from quillstone.functions.codes import normalize_device_code
from quillstone.functions.dates import with_dates
from quillstone.functions.text import DIGITS, fold_digits

KEY = "注册代码"
FIRST = {False: datetime.date(1899, 12, 30), True: datetime.date(1904, 1, 1)}


def day(y, m, d):
    try:
        return "OK", datetime.date(int(y), int(m), int(d)).isoformat()
    except ValueError:
        return "CLEARED", None


def short_form(text):
    """D4 and D5, or nothing."""
    if re.fullmatch(r"\d{4}(\.0+)?", text):
        return "YEAR_ONLY", None
    m = re.fullmatch(r"(\d{4})([-/.])(\d{1,2})(?:\2(\d{1,2}))?", text)
    return m and day(m[1], m[3], m[4] or 1)


def serial(x, late):
    whole = math.floor(x)
    n = whole + round((x - whole) * 86_400_000) // 86_400_000 + (not late and 0 < x < 60)
    try:
        return "OK", (FIRST[late] + datetime.timedelta(n)).isoformat()
    except OverflowError:
        return "CLEARED", None


def date_of(text, numeric, late):
    if text is None or not text.strip():
        return "BLANK", None
    text = text.strip()
    if found := short_form(text):
        return found
    if not numeric:
        try:
            return "OK", datetime.datetime.fromisoformat(text).date().isoformat()
        except ValueError:
            return "CLEARED", None
    try:
        x = Decimal(text)
    except InvalidOperation:
        return "CLEARED", None
    if not x.is_finite():
        return "CLEARED", None
    if 1000 <= x <= 9999 and x == int(x):
        return "YEAR_ONLY", None
    if abs(x.adjusted()) < 50 and re.fullmatch(r"\d{4}\.\d{1,2}", plain := format(x, "f")):
        return short_form(plain)
    if late and 0 <= x < 1:
        return "OK", "1904-01-01"
    return ("CLEARED", None) if x < 1 or x > 10**8 else serial(float(x), late)


def code_of(text, numeric, fmt):
    empty = lambda t: t is None or t.strip().lower() in ("", "null", "/")
    if empty(text):
        return None
    if numeric:
        try:
            x = Decimal(text)
        except InvalidOperation:
            return None
        if not x.is_finite():
            return None
        text = format(x, "f")
        if x == x.to_integral_value():
            text = text.split(".")[0]
            text = text.zfill(len(fmt)) if re.fullmatch("0+", fmt) else text
    try:
        found = json.loads(text)
    except ValueError:
        found = None
    if isinstance(found, dict) and list(found) == [KEY] and isinstance(found[KEY], str):
        text = found[KEY]
    return None if empty(text) else json.dumps({KEY: text}, ensure_ascii=False, separators=(",", ":"))


def mutated(rng, text, letters):
    while rng.random() < 0.25 and text:
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", rng.choice(letters), text[i] * 2]) + text[i + 1 :]
    return text


def other_digits(rng, text):
    some = rng.choice([1.0, 0.3]) if rng.random() < 0.2 else 0
    kinds = list(DIGITS)
    return "".join(rng.choice([d for d in rng.sample(kinds, 80) if DIGITS[d] == c] or [c]) if c.isdigit() and c.isascii() and rng.random() < some else c for c in text)


def iso(rng):
    two = lambda *some: rng.choice([*some, f"{rng.randrange(100):02}"])
    y, m, d, w, k = rng.choice(["2024", "2020", "1999", "0001", "9999", f"{rng.randrange(10000):04}"]), two("01", "12", "02"), two("01", "29", "31"), rng.choice(["01", "53", "42", "52", "00"]), rng.choice("12345670")
    date, c = rng.choice([f"{y}-{m}-{d}", f"{y}{m}{d}", f"{y}-W{w}-{k}", f"{y}W{w}{k}", f"{y}-W{w}", f"{y}W{w}", f"{y}/{m}/{d}", f"{y}.{m}"]), rng.choice([":", ""])
    h, n, s = two("00", "23", "09", "24"), rng.choice(["00", "30", "59", "60"]), rng.choice(["00", "59", "15"])
    frac = rng.choice([".", ",", "", ":"]) + "".join(rng.choices("0123456789", k=rng.randint(0, 8)))
    time = rng.choice(["", h, h + c + n, h + c + n + c + s, h + c + n + c + s + frac, h + ":" + n + s])
    zone = rng.choice(["", "", "Z", "z", "+08:00", "-0330", "+23:59:59", "+24:00", "+05", "-1", "+01:99", "+23:60", "+22:99:99.5", "+0530151", " Z", "x+01", "Zx", ":Z", "é+01"])
    return date + (rng.choice(["T", " ", "x", "-", "é", "", "1"]) + time + zone if rng.random() < 0.8 else "")


def number(rng):
    n = rng.choice([str(rng.randrange(10)), str(rng.randrange(1000, 10000)), str(rng.randrange(60)), str(rng.randrange(3_000_000)), "0", "000", "2958465", "59", "60", "61"])
    n = rng.choice(["", "", "", "-", "+"]) + n + rng.choice(["", "", ".", ".0", ".5", ".00", f".{rng.randrange(100)}", f".{rng.randrange(10**6):06}"])
    return n + rng.choice(["", "", "", "E3", "e-2", "E+1", "E+20", "e0", "E", "E+00005", "e-000000"]) + rng.choice(["", "", " ", "_", "%", "\u3000"])


def wrapped(rng):
    key = rng.choice([KEY, KEY, "\\u6ce8册代码", "代码", KEY + " "])
    value = rng.choice(['"K-9"', '""', '" / "', '"nuLL"', '"a\\u00e9\\n\\"b"', "5", "null", "true", '{"a":1}', "[1]", '"\\ud83d\\ude00"', "'x'", '"{}"', "-0.5e3"])
    pair = lambda: f'"{key}"{rng.choice(["", " "])}:{rng.choice(["", chr(9)])}{value}'
    again = f', "{KEY}": "z"' if rng.random() < 0.2 and value[0] not in "[{" else f', "b": {value}' if rng.random() < 0.1 else ""  # a key repeated after an array or object isn't unwrapped
    return rng.choice(["", " ", "\n"]) + "{" + pair() + again + "}" + rng.choice(["", " ", "x", "\u00a0"])


def test_random_dates(spark):
    rng = random.Random(11)
    values = [(mutated(rng, other_digits(rng, iso(rng) if rng.random() < 0.6 else number(rng)), "0123456789-:TWZ+. ,_"), rng.random() < 0.5, rng.random() < 0.3) for _ in range(60_000)]
    values = [v for v in values if not re.search(r"[eE][+-]?0*[1-9]\d{5}", v[0])]  # exponents of over five digits are no decimals here
    t = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, v string, numeric boolean, late boolean")
    got = {r.i: tuple(r.d) for r in with_dates(t, {"d": {"value": F.col("v"), "numeric": F.col("numeric"), "is_1904": F.col("late")}}).select("i", "d").collect()}
    bad = [(v, got[i], date_of(*v)) for i, v in enumerate(values) if got[i] != date_of(*v)]
    assert not bad, (len(bad), bad[:10])
    assert sum(s == "OK" for s, _ in got.values()) > 5_000


def test_random_codes(spark):
    rng = random.Random(12)
    values = [(mutated(rng, other_digits(rng, rng.choice([number, wrapped])(rng)), '0123456789.eE{}":\\u, '), rng.random() < 0.5, rng.choice(["", "0", "00000000", "0.00", "0#"])) for _ in range(40_000)]
    values = [v for v in values if not re.search(r"[eE][+-]?0*[1-9]\d{4}", v[0] or "") and not re.search(r"\\u[dD][89a-fA-F]", (v[0] or "").replace("\\ud83d\\ude00", ""))]  # huge powers, and lone surrogates, which no text holds
    values += [("0e99999999999", True, ""), ("0e-7777777", True, "000"), ('{"' + KEY + '":"' + "a\\n" * 50_000 + '"}', False, ""), ("\u0661\u0662", True, "0000"), ("９0", True, "")]
    t = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, v string, numeric boolean, f string")
    got = {r.i: r.d for r in t.select("i", normalize_device_code(F.col("v"), F.col("numeric"), F.col("f")).alias("d")).collect()}
    bad = [(v[0][:90], v[1:], got[i], (code_of(*v) or "")[:90]) for i, v in enumerate(values) if got[i] != code_of(*v)]
    assert not bad, (len(bad), bad[:10])


def test_digits_of_all_scripts(spark):
    t = spark.createDataFrame([(c, d) for c, d in DIGITS.items()], "c string, d string")
    assert t.filter(fold_digits(F.concat(F.lit("x"), "c", F.lit("1"))) != F.concat(F.lit("x"), "d", F.lit("1"))).count() == 0 and len(DIGITS) > 600
