"""Name-to-code mapping: validation of the 1:1 dimension, lookup and unmatched detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MappingError
from ..functions.text import strip
from ..model import MAPPING_MESSAGES
from ..sources.shared import stored


def problems(mapping: DataFrame) -> DataFrame:
    """kind, key of every violation: BLANK rows, names with several codes, codes with several names. Rows without both count for nothing."""
    rows = mapping.select(F.col("name").cast("string"), F.col("code").cast("string")).filter("name IS NOT NULL OR code IS NOT NULL")
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    good = rows.filter(~blank("name") & ~blank("code")).distinct()
    return (
        rows.filter(blank("name") | blank("code")).select(F.lit("BLANK").alias("kind"), F.coalesce("name", "code").alias("key"))
        .unionByName(good.groupBy("name").count().filter("count > 1").select(F.lit("MANY_CODES").alias("kind"), F.col("name").alias("key")))
        .unionByName(good.groupBy("code").count().filter("count > 1").select(F.lit("MANY_NAMES").alias("kind"), F.col("code").alias("key")))
    )


def matching(pairs: DataFrame) -> DataFrame:
    """The pairs that are accepted when they come one by one in order, each unless its name or its code is taken. Needs at (any order), name, code, each pair once.

    By rounds: a pair that is the first of its name and the first of its code among those undecided is accepted whatever
    else happens, and rules out the others of either. Each round is a few joins by name and by code, and its result is a
    table. Each round accepts a pair at least. Rounds are few where order and conflicts are unrelated; at worst they are
    half the longest chain of pairs of which each waits for the one before it.
    """
    left, taken = stored(pairs.select("at", "name", "code"), "undecided"), []
    while True:
        first = left
        for key in ("name", "code"):
            first = first.join(left.groupBy(key).agg(F.min("at").alias("first")), key).filter(F.col("at") == F.col("first")).drop("first")
        taken.append(stored(first.select("at", "name", "code"), "accepted"))
        for key in ("name", "code"):
            left = left.join(taken[-1].select(key), key, "left_anti")
        left = stored(left.select("at", "name", "code"), "undecided")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, taken)


def rejections(mapping: DataFrame, order: list[str] | str) -> tuple[DataFrame, DataFrame]:
    """Accepted pairs (at, name, code), and rejected rows (at, name, code, kind) of the greedy fold over rows in order.

    A row that repeats an accepted pair is neither. A name that was taken before the row says MANY_CODES; else its code
    was, and it says MANY_NAMES. Rows of a null name or code count for nothing; of rows that share their place in the
    order, the smaller name, then code, comes first.
    """
    order = [order] if isinstance(order, str) else order
    # The place in the order, then the pair itself, which makes places distinct.
    rows = mapping.filter("name IS NOT NULL AND code IS NOT NULL").select(F.struct(F.struct(*order).alias("place"), "name", "code").alias("at"), "name", "code")
    pairs = rows.groupBy("name", "code").agg(F.min("at").alias("at"))
    accepted = matching(pairs)
    own = accepted.select("name", "code")
    by_name = accepted.select("name", F.col("at").alias("name_taken"))
    other = rows.join(own, ["name", "code"], "left_anti").join(by_name, "name", "left")
    early = F.coalesce(F.col("name_taken") < F.col("at"), F.lit(False))
    rejected = other.select(F.col("at.place").alias("at"), "name", "code", F.when(early, "MANY_CODES").otherwise("MANY_NAMES").alias("kind"))
    return accepted.select(F.col("at.place").alias("at"), "name", "code"), rejected


def fold(mapping: DataFrame, order: list[str] | str, prefix=None) -> DataFrame:
    """One row: the greedy fold over rows in order, with the number of accepted pairs and all messages of rejected ones, as they make one error text. ``prefix`` is a text column before each message, of ``order``'s columns.

    rejections() gives the same rows by row, where there may be many.
    """
    order = [order] if isinstance(order, str) else order
    accepted, rejected = rejections(mapping, order)
    many_codes = F.col("kind") == "MANY_CODES"
    blank = F.lit(" " * bool(prefix is not None))
    said = F.concat(F.when(many_codes, F.col("name")).otherwise(F.col("code")), blank, F.when(many_codes, MAPPING_MESSAGES["MANY_CODES"]).otherwise(MAPPING_MESSAGES["MANY_NAMES"]))
    rows = rejected.select("at", *(F.col(f"at.{c}").alias(c) for c in order), said.alias("text"))
    rows = rows.select("at", F.concat(prefix, "text").alias("text") if prefix is not None else "text")
    said_type = "array<struct<at:" + rows.schema["at"].dataType.simpleString() + ",text:string>>"
    lines = rows.agg(F.coalesce(F.array_sort(F.collect_list(F.struct("at", "text"))), F.array().cast(said_type)).alias("said"))
    n = accepted.agg(F.count(F.lit(1)).cast("int").alias("n_pairs"))
    both = n.crossJoin(F.broadcast(lines))  # one row each
    return both.select("n_pairs", F.array_join(F.transform("said", lambda x: x["text"]), "；").alias("message"), "said")


def checked(mapping: DataFrame, most: int = 100) -> DataFrame:
    """The mapping, or a MappingError that names up to ``most`` of its violations."""
    if found := problems(mapping).limit(most).collect():
        raise MappingError("；".join(f"{r.key} {MAPPING_MESSAGES[r.kind]}" for r in found))
    return mapping


def lookup(rows: DataFrame, mapping: DataFrame, name: str = "name") -> DataFrame:
    """Exact left lookup: adds mapped_code. Spark broadcasts the mapping if its size allows."""
    m = mapping.select(F.col("name").alias("__name"), F.col("code").alias("mapped_code"))
    return rows.join(m, F.col(name) == F.col("__name"), "left").drop("__name")


def is_blank(c):
    return c.isNull() | (c == "")


def unmatched(mapped: DataFrame, name: str = "name", code: str = "code"):
    """Whether a looked-up row can't be matched: it has a name or a code, and the mapping lacks the name."""
    return ~(is_blank(F.col(name)) & is_blank(F.col(code))) & F.col("mapped_code").isNull()
