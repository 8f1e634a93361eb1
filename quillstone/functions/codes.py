"""Device-code normalisation as one Column: compact JSON text, or null for a true empty cell."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_digits, let, plain_decimal, strip

KEY = "注册代码"
# A JSON object of strings and other scalars whose last value is a string; possessive, so that long texts don't nest.
_S, _W = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"', r"[ \t\n\r]*+"
_SCALAR = rf"(?:{_S}|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null|NaN|-?Infinity)"
_OBJECT = rf"\A{_W}\{{{_W}(?:{_S}{_W}:{_W}{_SCALAR}{_W},{_W})*+{_S}{_W}:{_W}{_S}{_W}\}}{_W}\z"

#: The word in capitals and small letters; no other characters become these in lower case.
_NULLS = ["".join(letters) for letters in product(*zip("null", "NULL"))]


def unwrapped(text: Column) -> Column:
    """The string that an object of the key alone holds, the last where the key is repeated, whatever the escapes; else the text itself."""
    found = F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false"})
    only = lambda m: F.when(F.forall(F.map_keys(m), lambda k: k == KEY), F.element_at(F.map_values(m), -1))
    return F.when(text.contains("{") & text.rlike(_OBJECT), F.coalesce(let(found, only), text)).otherwise(text)


def json_escape(text: Column) -> Column:
    c = text
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    for i in set(range(32)) - {8, 9, 10, 12, 13}:
        c = F.replace(c, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return F.when(text.rlike(r'["\\\x00-\x1f]'), c).otherwise(text)


def is_empty(c: Column) -> Column:
    return c.isNull() | strip(c).isin("", "/", *_NULLS)


def normalize_device_code(value: Column, numeric: Column | None = None, number_format: Column | None = None) -> Column:
    only_text = numeric is None
    numeric = F.lit(False) if only_text else F.coalesce(numeric, F.lit(False))
    fmt = F.coalesce(number_format, F.lit("")) if number_format is not None else F.lit("")

    def as_text(plain: Column) -> Column:
        whole = plain.rlike(r"\A-?\d+(\.0*)?\z")
        shown = F.when(whole, F.regexp_replace(plain, r"\.0*\z", "")).otherwise(plain)
        digits, sign = F.regexp_replace(shown, r"\A-", ""), F.when(shown.startswith("-"), "-").otherwise("")
        width = F.length(fmt) - F.length(sign)
        return F.when(whole & fmt.rlike(r"\A0+\z") & (F.length(digits) < width), F.concat(sign, F.repeat(F.lit("0"), width - F.length(digits)), digits)).otherwise(shown)

    wrapped = lambda t: F.when(~is_empty(t), F.concat(F.lit('{"' + KEY + '":"'), json_escape(t), F.lit('"}')))
    number = lambda v: let(let(let(strip(v), fold_digits), plain_decimal), as_text)
    text = unwrapped if only_text else lambda v: F.when(numeric, number(v)).otherwise(unwrapped(v))
    return let(value, lambda v: F.when(~is_empty(v), let(text(v), wrapped)))  # the value may be a long expression itself
