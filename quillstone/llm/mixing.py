"""Mixing sources to target weights.

Every source is cut into blocks by a hash of the id, about 512 of its rows each. A source's quota is a number of whole passes over its
blocks and a rest; the rest is a prefix of the source's permuted blocks, of which the last is cut to the word.
A splitting tree deals the block draws among output shards: at every node the draws of the left half are a
multivariate-hypergeometric sample of the node's, so that all quotas stay exact and any leaf can be derived
alone. Each shard owns disjoint stretches of the permuted blocks and orders its documents by a seeded hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, no_null, written

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Beyond so many blocks a source, blocks hold more rows.
MOST_BLOCKS = 1 << 22
#: numpy's samplers draw from fewer than so many.
LARGE = 10**9


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: ``share`` of all sizes by weight, each at most ``most`` times its source.

    Works on one row per source, put in order in one task. What is cut off at a cap is shared by weight among the others, until none is
    above; that is the level at which caps and weighted shares add up, found by sorting by cap over weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    t = totals.withColumn("place", F.row_number().over(one.orderBy(F.asc_nulls_last("source"))) - 1)
    t = t.withColumn("weight", weight.cast("double")).withColumn("cap", most * F.col("source_size"))
    by = one.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(by), F.lit(0.0))).withColumn("left", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(by), F.lit(0.0)))
    t = t.withColumn("all", share * F.sum("source_size").over(one))
    level = (F.col("all") - F.col("capped")) / F.col("left")
    # The level at the first source that stays below its cap; from later ones, a level would be lower.
    t = t.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("cap"), level)).over(one))
    return t.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws are good. Of LARGE counts, by inversion over twelve standard deviations around the mode, beyond which lies less than 10^-30."""
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, n))
    if not good or not bad or not n:
        return 0 if bad else n
    total = good + bad
    spread = 50 + int(12 * np.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1))))
    mode = (n + 1) * (good + 1) // (total + 2)
    low, high = max(0, n - bad, mode - spread), min(n, good, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def draw_of_each(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` draws are of each kind, source after source if there are LARGE counts."""
    left = int(counts.sum())
    if left < LARGE:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out = np.zeros_like(counts)
    for i, c in enumerate(counts.tolist()):
        left -= c
        out[i] = hypergeometric(rng, c, left, n) if left else n
        n -= int(out[i])
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int = 0) -> np.ndarray:
    """(shards, sources) block draws: a multivariate-hypergeometric splitting tree with even leaves."""
    total = int(quotas.sum())
    ends = [total * i // shards for i in range(shards + 1)]
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(lo: int, hi: int, q: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = draw_of_each(rng, q, ends[mid] - ends[lo])
        split(lo, mid, left)
        split(mid, hi, q - left)

    if len(quotas):
        split(0, shards, quotas.astype(np.int64))
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 64, seed: int = 17, block_rows: int = 512, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, draws, source; and row, if ``row_col`` names a column of row numbers.

    size counts words (null text: 0); null is a source of its own, the last. draws is an array of
    (pass, shard, words): the shard that takes the document in that pass, and how many of its words. The number of
    blocks grows with the table, so that no task puts more than some blocks' rows in order. Rows with a null id are
    dealt by their text; repeated rows are in one block, and rows that tie in all but their number are interchangeable.
    Empty tables give empty tables; sources without words take none. A very long text counts whole; it is taken in part
    where a quota ends in it. One row per source comes to the driver, its draws and name. Other columns, whatever their
    names, are not read.
    """
    spark = docs.sparkSession
    luck = F.when(F.col(id_col).isNull(), F.xxhash64(text_col, F.lit(seed))).otherwise(F.xxhash64(id_col, F.lit(seed)))
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(no_null(text_col), F.lit(WORD)).cast("long").alias("size"), luck.alias("luck"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"))
    sizes = written(sizes, "mix-sizes")
    blocks = min(max(64, sizes.count() // block_rows), MOST_BLOCKS)
    sizes = sizes.withColumn("block", F.pmod("luck", F.lit(blocks)).cast("int"))
    in_block = sizes.groupBy("source", "block").agg(F.sum("size").alias("words"))
    shuffled = Window.partitionBy("source").orderBy(F.xxhash64("block", "source", F.lit(seed + 1)), "block")
    place = in_block.withColumn("place", F.row_number().over(shuffled) - 1).withColumn("before", F.sum("words").over(shuffled.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"])
    quota = F.least(F.round("target").cast("long"), 2 * F.col("source_size"))
    goal = source_targets(sizes).withColumn("quota", quota).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(F.lit(0)))
    goal = goal.withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    place = written(place.join(goal, place.source.eqNullSafe(goal.source)).drop(goal.source), "mix-blocks")
    drawn = F.col("before") < F.col("rest")
    per_source = place.groupBy("source").agg((F.first("passes") * F.count(F.lit(1)) + F.count_if(drawn)).alias("draws"), F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_last("source")).collect()
    table = split_quotas(np.array([r.draws for r in per_source], dtype=np.int64), shards, seed)
    ends = table.cumsum(axis=0)
    bounds = spark.createDataFrame([(r.source, r.n, ends[:, i].tolist()) for i, r in enumerate(per_source)], "source string, n long, ends array<long>")
    place = place.join(bounds, place.source.eqNullSafe(bounds.source)).drop(bounds.source)
    # Draw t of a source is pass t div n, place t mod n; the shard is the first whose stretch ends after t.
    shard = lambda t: F.size(F.filter("ends", lambda e: e <= t))
    draw = lambda p, limit: F.struct(p.cast("int").alias("pass"), shard(p * F.col("n") + F.col("place")).alias("shard"), limit.alias("limit"))
    no_limit = F.lit(None).cast("long")
    full = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("passes") - 1, F.lit(0))), lambda p: draw(p, no_limit))).otherwise(F.array().cast("array<struct<pass:int,shard:int,limit:bigint>>"))
    cut = F.when(F.col("before") + F.col("words") > F.col("rest"), F.col("rest") - F.col("before"))
    rest = F.when(drawn, F.array(draw(F.col("passes"), cut))).otherwise(F.array().cast("array<struct<pass:int,shard:int,limit:bigint>>"))
    place = place.select(F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target", F.concat(full, rest).alias("plan"))
    rows = sizes.join(place, sizes.source.eqNullSafe(F.col("s")) & (sizes.block == F.col("b")))
    is_cut = F.exists("plan", lambda d: d["limit"].isNotNull())
    take = lambda words: F.transform("plan", lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.when(d["limit"].isNull(), F.col("size")).otherwise(words(d["limit"])).alias("words")))
    whole = rows.filter(~is_cut).withColumn("draws", take(lambda _: F.col("size")))
    # One block of each source is cut: its rows are put in order to find where the quota ends.
    order = Window.partitionBy("source", "block").orderBy(F.xxhash64("luck", F.lit(seed + 2)), F.asc_nulls_last("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    part = rows.filter(is_cut).withColumn("ahead", F.coalesce(F.sum("size").over(order), F.lit(0)))
    part = part.withColumn("draws", take(lambda limit: F.greatest(F.lit(0), F.least(F.col("size"), limit - F.col("ahead"))))).drop("ahead")
    out = whole.unionByName(part).withColumn("draws", F.filter("draws", lambda d: d["words"] > 0))
    return out.select("doc_id", "size", "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"), "draws", "source", *(["row"] if row_col else []))


def local_order(rows: DataFrame, shard: str = "shard", nth: str = "pass", key: str = "doc_id", seed: int = 17) -> DataFrame:
    """Rows dealt by shard and shuffled inside it: the order is by a seeded hash of the key and the pass."""
    return rows.repartitionByRange(shard, F.xxhash64(key, nth, F.lit(seed + 3))).sortWithinPartitions(shard, F.xxhash64(key, nth, F.lit(seed + 3)), key, nth)
