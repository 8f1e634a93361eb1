"""Text helpers as Columns: Unicode strip, digit folding, exact decimal rendering."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a cell (a Java character class).
SPACE = r"[\x{1c}-\x{1f}\x{85}\p{IsWhite_Space}]"
#: Decimal digits of all scripts but ASCII, with the ASCII digit of each.
DIGITS = {c: str(unicodedata.decimal(c)) for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"}


def _ranges(chars) -> str:
    """A Java character class of the characters, by the runs of their codes."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


_OTHER_DIGIT = _ranges(DIGITS)
ANY_DIGIT = _OTHER_DIGIT[:-1] + "0-9]"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once: long expressions over expressions would be repeated in full."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    plain = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")  # most texts: no pattern is tried
    return F.when(plain, c).when(c.rlike(rf"\A{SPACE}|{SPACE}\z"), F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")).otherwise(c)


def fold_digits(c: Column) -> Column:
    """Decimal digits of any script as ASCII ones."""
    return F.when((F.octet_length(c) > F.length(c)) & c.rlike(_OTHER_DIGIT), F.translate(c, "".join(DIGITS), "".join(DIGITS.values()))).otherwise(c)


def is_decimal(c: Column) -> Column:
    return c.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?(0*[0-9]{1,5}|[0-9]+))?\z")


def plain_decimal(c: Column) -> Column:
    """A decimal without exponent, digit by digit; trailing zeros stay. Null where the text is no decimal. Underscores count for nothing. An exponent of over five digits is 0 on zeros, and no decimal else."""
    return let(F.when(c.contains("_"), F.replace(c, F.lit("_"), F.lit(""))).otherwise(c), _plain_decimal)


def _plain_decimal(c: Column) -> Column:
    """``c`` is used several times, so give it as a value that is computed."""
    matched = F.struct(*(F.regexp_extract(c, r"\A([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?\z", n).alias(f"p{n}") for n in (1, 2, 3, 4)))

    def parts(m: Column) -> Column:
        nothing = F.concat(m["p2"], m["p3"]).rlike(r"\A0*\z")
        exponent = F.when((m["p4"] == "") | (nothing & m["p4"].rlike("[1-9][0-9]{5}")), 0).otherwise(F.regexp_replace(m["p4"], r"^\+", "").try_cast("int"))
        sign = F.when(m["p1"] == "-", "-").otherwise("")
        return F.struct(sign.alias("sign"), F.regexp_replace(F.concat(m["p2"], m["p3"]), "^0+", "").alias("digits"), (F.length(m["p3"]) - exponent).alias("scale"))

    def shown(p: Column) -> Column:
        digits, scale = p["digits"], p["scale"]
        whole = F.when(digits == "", "0").otherwise(F.concat(digits, F.repeat(F.lit("0"), F.greatest(-scale, F.lit(0)))))
        long = F.concat(F.repeat(F.lit("0"), F.greatest(scale + 1 - F.length(digits), F.lit(0))), digits)
        point = let(long, lambda x: F.concat(F.substring(x, F.lit(1), F.length(x) - scale), F.lit("."), F.substring(x, F.length(x) - scale + 1, scale)))
        return F.concat(p["sign"], F.when(scale <= 0, whole).otherwise(point))

    as_it_is = c.rlike(r"\A-?[1-9][0-9]*(\.[0-9]+)?\z")
    return F.when(as_it_is, c).when(is_decimal(c), let(let(matched, parts), lambda p: F.when(p["scale"].between(-99_999, 200_000), shown(p))))
