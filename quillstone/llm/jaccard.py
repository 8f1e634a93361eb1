"""Exact Jaccard join of word-shingle sets, by skipping through set relations.

Sets are ordered by the corpus frequency of their shingles, rare ones first (frequencies come from a sketch of fixed
size; any order gives the same links). Only the first 15 % of a set are posted to index lists: sets that link share
one of these. A list is ordered by set size, and an entry carries its shingle's position, which bounds the overlap.
The sketch also says how many sets a list can hold, and longer ones are dealt over parts of PART entries. Lists of the
same sets, as the shingles of near copies have them, give the same pairs: one of each kind is kept.

The answer looked for is the component a set belongs to, and answers are derived along set relations. First each entry
of a list is compared with the one before it, of most similar size, and with the list's pivot: the entry whose shingle
comes earliest in it, so with fewest shingles of its own. Sets that link take over one another's answer, and a set keeps
how it differs from one similar pivot, that with most sets around it. Of two sets with one pivot the overlap then follows from the differences
alone. What is left are lists, or families of one pivot, with several answers: these are cut into blocks of 256
entries, ordered by pivot, answer, size and position. A block keeps the ranges of its answers, sizes, positions and of
what is left behind the positions; pairs of blocks of one answer, of sizes too far apart, or whose positions leave too
little to share are skipped whole. Pairs are found by these ranges alone, and only then are the entries of two blocks
brought together, by block and not by list. Bitmaps of the sets bound the overlap of single pairs. No link between
different answers is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, byte_slices, written
from .components import brought_together, components
from .shingles import shingle_sets

SLOTS, PIECES, BLOCK, PART = 1 << 22, 64, 256, 1 << 16
SKETCH_BITS = 1024
BITS = 1 << 26


def vertex_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def bits_of(s: np.ndarray) -> bytes:
    """A bitmap of the set: two sets differ in at least as many shingles as their bitmaps in bits."""
    bits = np.zeros(SKETCH_BITS, bool)
    bits[(s & np.uint64(SKETCH_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _each(batches, k: int):
    """(row values, sets, vertices) of slices of the batches, whose last column is the text. Cutting takes some 40 bytes for each byte of a slice."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
        for a, b in byte_slices(texts, 1 << 18):
            sets = shingle_sets(texts[a:b], k)
            yield batch.slice(a, b - a), sets, [vertex_of(s) if len(s) else None for s in sets]


DESCRIBED = ["doc_id", "text_hash", "vertex", "n_shingles", "piece", "counts", "bits"]


def _describe(k: int):
    """A row for each document, and at the end of a task its sketch of shingle frequencies in pieces."""

    def run(batches):
        sketch = np.zeros(SLOTS, np.uint32)
        for batch, sets, vertices in _each(batches, k):
            np.add.at(sketch, (np.concatenate(sets) >> np.uint64(42)).astype(np.int64), 1)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vertices, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(map(bits_of, sets), pa.binary())], DESCRIBED)
        none = pa.nulls(1, pa.int64())
        for piece, counts in enumerate(sketch.reshape(PIECES, -1)):
            if counts.any():
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([piece], pa.int32()), pa.array([counts.tobytes()], pa.binary()), pa.nulls(1, pa.binary())], DESCRIBED)

    return run


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts as eighths of powers of two, a byte each."""
    return np.minimum(255, np.rint(8 * np.log2(np.maximum(1, counts)))).astype(np.uint8)


def _merge(kind, how, last=None):
    def run(table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("counts"):
            x = np.frombuffer(x.as_py(), kind)
            total = x.copy() if total is None else how(total, x, out=total)
        return pa.table({"piece": table.column("piece")[:1], "counts": pa.array([(last(total) if last else total).tobytes()], pa.binary())})

    return run


def merged(pieces: DataFrame, kind, how, size: int, last=None) -> bytes:
    """Pieces (piece, counts) of many tasks put together, in two rounds; ``size`` bytes in the end. ``last`` is done to each piece by the tasks that end it; zeros stay zeros."""
    parts = pieces.groupBy("piece", F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt")).applyInArrow(_merge(kind, how), "piece int, counts binary")
    found = {r.piece: r.counts for r in parts.groupBy("piece").applyInArrow(_merge(kind, how, last), "piece int, counts binary").collect()}
    return b"".join(found.get(i) or bytes(size // PIECES) for i in range(PIECES))


POSTED = "token long, part long, parts long, vertex long, n int, pos int"


def _post(level, k: int, per: int):
    """Postings of the first shingles of each set, in order of frequency and hash. Lists that can hold more than PART sets come in parts."""

    def run(batches):
        seen: set[int] = set()
        deal = np.maximum(1, np.ceil(2 ** (np.arange(256) / 8) / PART)).astype(np.int64)
        rank = np.frombuffer(level.value, np.uint8)
        for _, sets, vertices in _each(batches, k):
            tokens, of, size, place, parts = [], [], [], [], []
            for s, v in zip(sets, vertices):
                if v is None or v in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(v)
                n = len(s)
                first = n - (per * n + 99) // 100 + 1
                r = rank[(s >> np.uint64(42)).astype(np.int64)]
                order = np.lexsort((s, r))[:first]
                tokens.append(s[order].view(np.int64))
                parts.append(deal[r[order]])
                of.append(np.full(first, v))
                size.append(np.full(first, n, np.int32))
                place.append(np.arange(first, dtype=np.int32))
            if tokens:
                tokens, parts, of, size, place = map(np.concatenate, (tokens, parts, of, size, place))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tokens, (of >> 8) % parts, parts, of, size, place)], [f.split()[0] for f in POSTED.split(", ")])

    return run


def _bitmap(batches):
    """Pieces of the bitmap in which the task has bits, one at a time."""
    size = BITS // PIECES
    at = np.unique(np.concatenate([np.zeros(0, np.int64), *(batch.column(0).to_numpy() & (BITS - 1) for batch in batches)]))
    cuts = np.searchsorted(at, np.arange(PIECES + 1) * size)
    for piece in np.flatnonzero(np.diff(cuts)).tolist():
        bits = np.zeros(size, bool)
        bits[at[cuts[piece] : cuts[piece + 1]] - piece * size] = True
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["piece", "counts"])


def _sets(bitmap, k: int):
    """The sets of texts whose hash is in the bitmap, once for each task. Other texts aren't cut into shingles."""

    def wanted(batches):
        bits, seen = np.frombuffer(bitmap.value, np.uint8), set()
        for batch in batches:
            h = batch.column(0).to_numpy()
            hit = np.flatnonzero((bits[(h & (BITS - 1)) >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1)
            some = [i for i, x in zip(hit.tolist(), h[hit].tolist()) if x not in seen]
            if len(seen) < 500_000:
                seen.update(h[some].tolist())
            if some:
                yield batch.take(pa.array(some))

    def run(batches):
        for _, sets, vertices in _each(wanted(batches), k):
            out = list({v: s.tobytes() for v, s in zip(vertices, sets) if v is not None}.items())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], ["vertex", "shingles"])

    return run


PAIR = "u long, v long, both long, links boolean, u_less binary, v_less binary"


def _compare(per: int):
    """Overlaps of full sets and, for similar ones, what each has beyond the other."""

    def run(batches):
        for batch in batches:
            rows = []
            for u, v, a, b in zip(*(batch.column(i) for i in range(4))):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                hit = b[at] == a
                both = int(hit.sum())
                union = len(a) + len(b) - both
                near = 2 * both >= union
                other = np.ones(len(b), bool)
                other[at[hit]] = False
                rows.append((u.as_py(), v.as_py(), both, 100 * both >= per * union, a[~hit].tobytes() if near else None, b[other].tobytes() if near else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], [f.split()[0] for f in PAIR.split(", ")])

    return run


def compared(pairs: DataFrame, docs: DataFrame, hashes: DataFrame, k: int, per: int) -> DataFrame:
    """(u, v) with their overlap, in the columns of PAIR. ``docs``: text_hash, text; ``hashes``: vertex, text_hash of one of its texts.

    A bitmap of fixed size keeps most other texts from being cut, and their sets from being sent.
    """
    spark = pairs.sparkSession
    pairs = written(pairs, "jaccard-pairs")
    if pairs.isEmpty():
        return spark.createDataFrame([], PAIR)
    ends = pairs.select(F.col("u").alias("vertex")).union(pairs.select("v")).distinct()
    texts = ends.join(hashes, "vertex").select("text_hash")
    bitmap = spark.sparkContext.broadcast(merged(texts.mapInArrow(_bitmap, "piece int, counts binary"), np.uint8, np.bitwise_or, BITS // 8))
    sets = docs.mapInArrow(_sets(bitmap, k), "vertex long, shingles binary").join(ends, "vertex", "left_semi").dropDuplicates(["vertex"])
    both = pairs.join(sets.select(F.col("vertex").alias("v"), F.col("shingles").alias("b")), "v").join(sets.select(F.col("vertex").alias("u"), F.col("shingles").alias("a")), "u")
    with batches_of(spark, 500):  # full texts and pairs of full sets
        found = written(both.select("u", "v", "a", "b").mapInArrow(_compare(per), PAIR), "jaccard-compared")
    bitmap.destroy()
    return found


def _incidence(rows: list, columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(columns)), np.float32)
    for i, r in enumerate(rows):
        out[i, np.searchsorted(columns, r)] = 1
    return out


def _shared(xs: list, ys: list, step: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted arrays."""
    columns = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    total = np.zeros((len(xs), len(ys)), np.float32)
    for at in range(0, len(columns), step):
        some = columns[at : at + step]
        cut = lambda rows: [r[np.isin(r, some, assume_unique=True)] for r in rows]
        total += _incidence(cut(xs), some) @ _incidence(cut(ys), some).T
    return total


def _family_links(per: int):
    """Answers that sets of two blocks with one pivot p link, from the sets' differences to it: |x and y| = |p| - |p-x| - |p-y| + |(p-x) and (p-y)| + |(x-p) and (y-p)|."""

    def run(batches):
        for batch in batches:
            us, vs = [], []
            for left, right in zip(batch.column(0), batch.column(1)):
                x, y = _columns(left, "n", "comp", "pivot_n"), _columns(right, "n", "comp", "pivot_n")
                less = [[np.frombuffer(r.as_buffer(), np.uint64) for r in side.values.field("gone")] for side in (left, right)]
                more = [[np.frombuffer(r.as_buffer(), np.uint64) for r in side.values.field("own")] for side in (left, right)]
                both = x["pivot_n"][:, None] - np.array([len(r) for r in less[0]])[:, None] - np.array([len(r) for r in less[1]])[None] + _shared(*less) + _shared(*more)
                ok = (x["comp"][:, None] != y["comp"][None]) & (100 * both >= per * (x["n"][:, None] + y["n"][None] - both))
                a, b = np.nonzero(ok)
                u, v = np.unique(np.stack([x["comp"][a], y["comp"][b]]), axis=1)
                us.append(u)
                vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


def _block_pairs(per: int):
    """Pairs of entries of two blocks that size, position and answer allow."""

    def run(batches):
        for batch in batches:
            us, vs = [], []
            for left, right, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                x, y = (_columns(side, "vertex", "n", "pos", "comp", "pivot") for side in (left, right))
                n, m = x["n"][:, None].astype(np.int64), y["n"][None].astype(np.int64)
                i, j = x["pos"][:, None], y["pos"][None]
                need = -(-per * (n + m) // (100 + per))
                ok = (x["comp"][:, None] != y["comp"][None]) & (x["pivot"][:, None] != y["pivot"][None]) & (np.minimum(i, j) + 1 + np.minimum(n - i - 1, m - j - 1) >= need) & (np.minimum(n, m) >= need)
                if same:
                    ok = np.triu(ok, 1)
                a, b = np.nonzero(ok)
                if not len(a):
                    continue
                maps = [np.frombuffer(b"".join(side.values.field("bits").to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64) for side in (left, right)]
                apart = np.bitwise_count(maps[0][a] ^ maps[1][b]).sum(axis=1, dtype=np.int64)
                near = (n[a, 0] + m[0, b] - apart) // 2 >= need[a, b]
                a, b = a[near], b[near]
                us.append(np.minimum(x["vertex"][a], y["vertex"][b]))
                vs.append(np.maximum(x["vertex"][a], y["vertex"][b]))
            if us:
                us, vs = ([x] for x in np.unique([np.concatenate(us), np.concatenate(vs)], axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


def _columns(block, *names: str) -> dict[str, np.ndarray]:
    return {f: block.values.field(f).to_numpy() for f in names}


def _blocks(rows: DataFrame, key: str, order: list, entry: list[str], ranges: list[str], bits: DataFrame | None = None) -> DataFrame:
    """Rows of a key and part in blocks of BLOCK entries, in order. Keys whose entries have one answer have no blocks."""
    open_ = rows.groupBy(key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select(key)
    rows = rows.join(open_, key, "left_semi")
    if bits is not None:
        rows = rows.join(bits, "vertex")
    rows = rows.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(key, "part").orderBy(*order)) - 1) / BLOCK).cast("int"))
    ends = [f(c).alias(f"{n}_{c}") for c in ranges for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return written(rows.groupBy(key, "part", "block").agg(*ends, F.collect_list(F.struct(*entry)).alias("entries")), f"jaccard-{key}-blocks")


def _block_join(blocks: DataFrame, key: str, rule: str) -> DataFrame:
    """Pairs of blocks of a key that may hold a link, as (a, b, same).

    ``rule`` is a condition on the ranges of two blocks x and y. A key of one block needs no join; the others are
    joined by their ranges, and the entries of the pairs that are left are fetched by block. The parts of a key make a
    grid: ranges meet by key and pair of parts, so that no group of the join holds more than two parts of a long list.
    """
    different = "NOT (x.lo_comp = x.hi_comp AND y.lo_comp = y.hi_comp AND x.lo_comp = y.lo_comp)"
    alone = blocks.filter("lo_comp < hi_comp").select(F.col("entries").alias("a"), F.col("entries").alias("b"), F.lit(True).alias("same"))
    several = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.max("part").alias("top")).filter("k > 1").select(key, "top")
    ends = blocks.drop("entries").join(several, key)
    first = ends.withColumn("xp", F.col("part")).withColumn("yp", F.explode(F.sequence("part", "top")))
    second = ends.withColumn("yp", F.col("part")).withColumn("xp", F.explode(F.sequence(F.lit(0).cast(ends.schema["part"].dataType), "part")))
    cell = f"x.{key} = y.{key} AND x.xp = y.xp AND x.yp = y.yp AND (x.xp < y.yp OR x.block < y.block)"
    pairs = first.alias("x").join(second.alias("y"), F.expr(f"{cell} AND {different} AND {rule}"))
    pairs = pairs.select(F.col(f"x.{key}").alias("key"), "x.xp", F.col("x.block").alias("xb"), "x.yp", F.col("y.block").alias("yb"))
    side = lambda p, b, name: blocks.select(F.col(key).alias("key"), F.col("part").alias(p), F.col("block").alias(b), F.col("entries").alias(name))
    pairs = pairs.join(side("xp", "xb", "a"), ["key", "xp", "xb"]).join(side("yp", "yb", "b"), ["key", "yp", "yb"])
    return alone.unionByName(pairs.select("a", "b", F.lit(False).alias("same")))


def size_rule(per: int) -> str:
    return f"100 * x.hi_n >= {per} * y.lo_n AND 100 * y.hi_n >= {per} * x.lo_n"


def place_rule(per: int) -> str:
    """What two entries of the blocks can share at most: what is before the shingle in both, itself, and what is behind it in both."""
    return f"{100 + per} * (LEAST(x.hi_pos, y.hi_pos) + 1 + LEAST(x.hi_rest, y.hi_rest)) >= {per} * (x.lo_n + y.lo_n)"


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, per: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Sets of k-word shingles link when 100 * intersection >= ``per`` * union. component_id is the smallest id reachable
    by links. A text that is null or has no words has no shingles, links with nothing, and its component is its own
    id. Rows with equal sets are one class from the start, so repeated rows share an answer; null ids take part and are
    smaller than none. Ties can't occur: links are a yes or no, and ids have an order. A very long text is one set,
    cut whole in one task. An empty table gives an empty table. Shingles, sets and lists are compared by 64-bit
    hashes. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    with batches_of(spark, 1000):
        described = written(rows.mapInArrow(_describe(k), "doc_id long, text_hash long, vertex long, n_shingles long, piece int, counts binary, bits binary"), "jaccard-documents")
    level = spark.sparkContext.broadcast(merged(described.filter("piece IS NOT NULL").select("piece", "counts"), np.uint32, np.add, SLOTS, _level))
    described = described.filter("piece IS NULL")
    of_set = described.filter("vertex IS NOT NULL").groupBy("vertex").agg(F.min("text_hash").alias("text_hash"), F.first("bits").alias("bits"))
    hashes, texts = of_set.select("vertex", "text_hash"), rows.select("text_hash", "text")
    posted = rows.select("text").mapInArrow(_post(level, k, per), POSTED)
    line = Window.partitionBy("token", "part").orderBy("n", "vertex")
    early = Window.partitionBy("token", "part").orderBy("pos", "n", "vertex")
    before = F.lag(F.struct("vertex", "n", "pos")).over(line)
    lists = posted.select("*", before.alias("last"), F.lead("vertex").over(line).alias("next"))
    lists = lists.filter("parts > 1 OR last.vertex <> vertex OR next <> vertex").drop("next", "parts")
    with batches_of(spark, 1000):
        lists = written(lists.withColumn("pivot", F.first(F.struct("vertex", "n", "pos")).over(early)), "jaccard-postings")
    level.destroy()
    # Of lists of the same sets, told by 62 bits and their length, that of the smallest shingle.
    h = F.xxhash64("vertex")
    kinds = lists.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.sum(h.bitwiseAND((1 << 31) - 1)).alias("a"), F.sum(F.shiftrightunsigned(h, 33)).alias("b"))
    lists = written(lists.join(kinds.groupBy("k", "a", "b").agg(F.min("token").alias("token")).select("token"), "token", "left_semi"), "jaccard-lists")
    near = lists.select("vertex", "n", "pos", F.explode(F.array("last", "pivot")).alias("o")).select("vertex", "n", "pos", F.col("o.vertex").alias("u"), F.col("o.n").alias("m"), F.col("o.pos").alias("i"))
    need = f"CEIL({per} * (m + n) / {100 + per}D - 1e-9)"
    near = near.filter(f"u <> vertex AND LEAST(m, n) >= {need} AND LEAST(pos, i) + 1 + LEAST(n - pos - 1, m - i - 1) >= {need}")
    known = compared(near.select(F.least("u", "vertex").alias("u"), F.greatest("u", "vertex").alias("v")).distinct(), texts, hashes, k, per)
    answers = written(components(known.filter("links").select("u", "v")).select(F.col("u").alias("vertex"), F.col("v").alias("comp")), "jaccard-answers")
    # Of each set's pivots that with most similar sets, and the differences to it.
    pivots = lists.select(F.col("pivot.vertex").alias("p"), F.col("pivot.n").alias("pivot_n")).distinct()
    ways = known.filter("u_less IS NOT NULL")
    ways = ways.select(F.col("u").alias("p"), F.col("v").alias("vertex"), "both", F.col("u_less").alias("gone"), F.col("v_less").alias("own")).unionByName(ways.select(F.col("v").alias("p"), F.col("u").alias("vertex"), "both", F.col("v_less").alias("gone"), F.col("u_less").alias("own")))
    ways = ways.join(pivots, "p")
    around = ways.groupBy("p").agg(F.count(F.lit(1)).alias("around"))
    best = ways.join(around, "p").groupBy("vertex").agg(F.max(F.struct("around", "both", "p", "pivot_n", "gone", "own")).alias("w"))
    part = F.pmod(F.xxhash64("vertex"), F.ceil(F.col("w.around") / PART)).alias("part")  # a large family is dealt over parts
    family = best.select("vertex", part, F.col("w.p").alias("pivot"), F.col("w.pivot_n").alias("pivot_n"), (F.col("w.both") + F.octet_length("w.own") / 8).cast("int").alias("n"), "w.gone", "w.own")
    family = written(family.join(answers, "vertex", "left").withColumn("comp", F.coalesce("comp", "vertex")), "jaccard-families")
    blocks = _blocks(family, "pivot", ["comp", "n", "vertex"], ["n", "comp", "pivot_n", "gone", "own"], ["n", "comp"])
    with batches_of(spark, 32):
        kin = written(_block_join(blocks, "pivot", size_rule(per)).drop("same").mapInArrow(_family_links(per), "u long, v long").distinct(), "jaccard-kin")
    answers = written(brought_together(answers, kin), "jaccard-answers")
    # Pairs without a common pivot, by the lists.
    lists = lists.select("token", "part", "vertex", "n", "pos", (F.col("n") - F.col("pos") - 1).alias("rest")).join(answers, "vertex", "left").withColumn("comp", F.coalesce("comp", "vertex"))
    lists = lists.join(family.select("vertex", "pivot"), "vertex", "left").withColumn("pivot", F.coalesce("pivot", "vertex")).dropDuplicates(["token", "vertex"])
    blocks = _blocks(lists, "token", ["pivot", "comp", "n", "pos", "vertex"], ["vertex", "n", "pos", "comp", "pivot", "bits"], ["n", "pos", "rest", "comp", "pivot"], of_set.select("vertex", "bits"))
    other = " AND NOT (x.lo_pivot = x.hi_pivot AND y.lo_pivot = y.hi_pivot AND x.lo_pivot = y.lo_pivot)"
    with batches_of(spark, 100):
        pairs = written(_block_join(blocks, "token", size_rule(per) + " AND " + place_rule(per) + other).mapInArrow(_block_pairs(per), "u long, v long").distinct(), "jaccard-open")
    pairs = pairs.join(known.select("u", "v"), ["u", "v"], "left_anti")
    more = compared(pairs, texts, hashes, k, per).filter("links").select("u", "v")
    if not more.isEmpty():
        for end in ("u", "v"):
            more = more.join(answers.select(F.col("vertex").alias(end), "comp"), end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
        answers = brought_together(answers, written(more.distinct(), "jaccard-more"))
    found = described.select("doc_id", "vertex", "n_shingles")
    with_set = found.filter("vertex IS NOT NULL").join(answers, "vertex", "left").withColumn("comp", F.coalesce("comp", "vertex"))
    first = with_set.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = with_set.join(first, "comp").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(found.filter("vertex IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
