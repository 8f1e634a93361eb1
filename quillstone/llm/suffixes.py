"""Removal of repeated byte strings by a distributed merge sort of suffixes.

Sorting every suffix isn't needed: in any string of LENGTH bytes the rarest-hashed of its first SPAN + 1 positions is an
anchor, chosen by content alone, so equal strings have anchors at equal places. An anchor whose first CORE bytes have
a hash that occurs once in the corpus can't be part of a repeat and is left out. Suffixes at the other anchors, cut
after LENGTH bytes, are sorted: tasks sort runs, split them by sampled splitters and exchange them front-coded, each as
the length of the prefix it shares with the one before it and what follows. Loser trees combine the runs and compare
two suffixes only behind the prefix they are known to share.

The common prefixes of neighbours that come out of the trees decide. A string of LENGTH bytes that begins ``a`` bytes
before an anchor occurs again if another suffix shares LENGTH - a bytes with this one, and the bytes before it share a:
so neighbours that share so much form groups, for each ``a``, and those of a group whose SPAN bytes before the anchor,
sorted from behind, share a bytes are repeats. All of this compares bytes; hashes only left candidates out.

Anchors of cores that occur more than HOT times are replaced by two longer cores, one half a span further to the left
and one to the right; any repeat around the anchor contains one of them. They are as rare as repeats themselves.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .shingles import _BYTE, _power, mix

LENGTH, CORE, GRAM = 400, 200, 16
SPAN = LENGTH - CORE
HOT = 20_000


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w neighbours (van Herk's two accumulations)."""
    n, pad = len(x), -len(x) % w
    fill = np.uint64(0xFFFFFFFFFFFFFFFF if op is np.minimum else 0)
    rows = np.concatenate([x, np.full(pad, fill)]).reshape(-1, w)
    ahead = op.accumulate(rows, axis=1).ravel()
    behind = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's anchors, and hashes of their cores."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    b = np.frombuffer(raw, np.uint8)
    up, down = _power(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[:n])])
    last = n - CORE + 1  # places at which a core fits
    h = mix((sums[GRAM : last + GRAM] - sums[:last]) * down[:last])
    least = _sliding(h, SPAN + 1, np.minimum)  # of each string
    edge = np.zeros(SPAN, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), SPAN + 1, np.maximum) == h)
    return at, mix((sums[at + CORE] - sums[at]) * down[at] + np.uint64(CORE))


def _anchor(batches):
    """A row for each document without a core, and one for each of its cores with the places, unless the task has seen its text before."""
    seen: set[int] = set()
    for batch in batches:
        keys, cores, places = [], [], []
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys.append(key)
            cores.append(None)
            places.append(None)
            if key in seen:
                continue
            if len(seen) < 300_000:
                seen.add(key)
            at, core = anchors(raw)
            if len(at):
                core, of = np.unique(core.view(np.int64), return_inverse=True)
                order = np.argsort(of, kind="stable")
                keys += [key] * len(core)
                cores += core.tolist()
                places += np.split(at[order].astype(np.int32), np.cumsum(np.bincount(of))[:-1])
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(cores, pa.int64()), pa.array(places, pa.list_(pa.int32()))], ["key", "core", "at"])


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, known to be at least ``known``."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    k = len(x)
    return known + k - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared prefix lengths, lengths, and the rests of sorted strings put together."""
    shared, last = [], b""
    for s in strings:
        shared.append(shared_prefix(last, s))
        last = s
    return np.array(shared, np.uint16), np.array([len(s) for s in strings], np.uint16), b"".join(s[k:] for s, k in zip(strings, shared))


def front_decode(shared, lengths, rests: bytes):
    """(string, prefix shared with the one before) in order."""
    last, at = b"", 0
    for k, n in zip(shared, lengths):
        last = last[:k] + rests[at : at + n - k]
        at += n - k
        yield last, k


def merge_runs(runs: list):
    """Sorted (string, shared prefix with the one before, run, place) of sorted runs of (string, shared prefix).

    A loser tree. Each waiting string knows the prefix it shares with the last winner; of two, the one that shares
    more is the smaller, and only if both share as much are the bytes behind compared.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list = [None] * size  # [string, shared prefix with the last winner, place]
    sources = [iter(r) for r in runs]
    for i, r in enumerate(sources):
        if (x := next(r, None)) is not None:
            heads[i] = [x[0], 0, 0]

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared prefix is then with the winner."""
        a, b = heads[i], heads[j]
        if b is None:
            return i, j
        if a is None:
            return j, i
        if a[1] != b[1]:
            return (i, j) if a[1] > b[1] else (j, i)
        k = shared_prefix(a[0], b[0], a[1])
        if a[0][k : k + 1] <= b[0][k : k + 1]:
            b[1] = k
            return i, j
        a[1] = k
        return j, i

    losers = [0] * size
    row = list(range(size))
    level = size
    while len(row) > 1:
        level //= 2
        nxt = []
        for n in range(level):
            w, losers[level + n] = play(row[2 * n], row[2 * n + 1])
            nxt.append(w)
        row = nxt
    winner = row[0]
    while (head := heads[winner]) is not None:
        yield head[0], head[1], winner, head[2]
        x = next(sources[winner], None)
        # The next string of the run shares with its predecessor, the winner, what the code says.
        heads[winner] = None if x is None else [x[0], x[1], head[2] + 1]
        n, i = (size + winner) // 2, winner
        while n >= 1:
            i, losers[n] = play(i, losers[n])
            n //= 2
        winner = i


RUN = "part int, suffixes binary, before binary, key array<long>, place array<int>"


def _pack(*parts) -> bytes:
    parts = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return zlib.compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts), 1)


def _unpack(blob: bytes, n: int) -> list[bytes]:
    raw = zlib.decompress(blob)
    ends = np.frombuffer(raw, np.int64, n).cumsum() + 8 * n
    return [raw[a:b] for a, b in zip([8 * n, *ends], ends)]


def core_of(part: int) -> int:
    """Ranges of the longer cores have odd numbers."""
    return CORE + part % 2 * (SPAN // 2)


def _runs(splitters: list[bytes], limit: int = 20_000):
    """Sorted, front-coded runs for each range of suffixes."""

    def emit(held):
        held.sort()
        out, at = [], 0
        while at < len(held):
            end, kind = at, held[at][0]
            cut = bisect_right(splitters, held[at][1][:GRAM])
            while end < len(held) and held[end][0] == kind and (cut == len(splitters) or held[end][1][:GRAM] < splitters[cut]):
                end += 1
            some = held[at:end]
            left = [x[2] for x in some]
            out.append((2 * cut + kind, _pack(*front_code([x[1] for x in some])), _pack(np.array([len(a) for a in left], np.uint16), b"".join(left)), [x[3] for x in some], [x[4] for x in some]))
            at = end
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())))], [f.split()[0] for f in RUN.split(", ")])

    def run(batches):
        held: list = []
        seen: set[int] = set()
        for batch in batches:
            for key, raw, places, hot in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key in seen:  # a copy
                    continue
                if len(seen) < 300_000:
                    seen.add(key)
                for p, is_hot in zip(places, hot):
                    for q, kind in ((p, 1), (p - SPAN // 2, 1)) if is_hot else ((p, 0),):
                        if q >= 0 and q + core_of(kind) <= len(raw):
                            held.append((kind, raw[q : q + LENGTH], raw[max(0, q + core_of(kind) - LENGTH) : q], key, q))
                    if len(held) >= limit:
                        yield emit(held)
                        held = []
        if held:
            yield emit(held)

    return run


def repeats(shared: np.ndarray, size: np.ndarray, left: list[bytes], times: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of sorted suffixes: bytes before it at which the first repeated string begins, and the last; -1 where none does.

    ``shared`` is the prefix that a suffix shares with the one before it, ``size`` its length, ``left`` the bytes before
    it, ``times`` how many places have just these bytes. A string begins ``most`` bytes before a suffix at most.
    """
    n = len(left)
    back = [x[::-1] for x in left]
    order = sorted(range(n), key=back.__getitem__)
    left_shared = np.array([0, *(shared_prefix(back[i], back[j]) for i, j in zip(order, order[1:]))])
    before = np.array([len(x) for x in left])
    low, high, row = np.full(n, -1), np.full(n, -1), np.empty(n, np.int64)
    for a in range(most + 1):
        fits = np.flatnonzero((before >= a) & (size >= LENGTH - a))
        if not len(fits):
            continue
        row[order] = np.cumsum(left_shared < a)
        group = (np.cumsum(shared < LENGTH - a) * (n + 1) + row)[fits]
        by = np.argsort(group)
        same = group[by[1:]] == group[by[:-1]]
        again = times[fits] > 1
        again[by[1:][same]] = again[by[:-1][same]] = True
        hit = fits[again]
        high[hit] = a
        low[hit] = np.where(low[hit] < 0, a, low[hit])
    return low, high


def _combine(table: pa.Table) -> pa.Table:
    """Merge a range's runs, and find repeats by the prefixes that neighbours share: (key, from, to). Copies that came by other tasks count once."""
    runs, members = [], []
    core = core_of(table.column("part")[0].as_py())
    for suffixes, before, keys, places in zip(*(table.column(c) for c in ("suffixes", "before", "key", "place"))):
        shared, lengths, rests = _unpack(suffixes.as_py(), 3)
        runs.append(front_decode(np.frombuffer(shared, np.uint16).tolist(), np.frombuffer(lengths, np.uint16).tolist(), rests))
        members.append((before.as_py(), keys.values.to_pylist(), places.values.to_pylist()))
    found: list = []
    opened: dict[int, tuple] = {}

    def before_of(run: int, place: int) -> bytes:
        if run not in opened:
            lens, text = _unpack(members[run][0], 2)
            opened[run] = np.concatenate([[0], np.frombuffer(lens, np.uint16).cumsum(dtype=np.int64)]), text
        at, text = opened[run]
        return text[int(at[place]) : int(at[place + 1])]

    #: Distinct suffixes of groups that share a core: [shared prefix, length, {bytes before: places}].
    waiting: list = []

    def settle():
        rows = [(k if not i else n, n, left, at) for k, n, lefts in waiting for i, (left, at) in enumerate(lefts.items())]
        if rows:
            shared, size, left, where = zip(*rows)
            low, high = repeats(np.array(shared), np.array(size), left, np.array([len(x) for x in where]), LENGTH - core)
            for places, a, b in zip(where, low, high):
                if b >= 0:
                    for key, q in places:
                        found.append((key, q - int(b), q - int(a) + LENGTH))
        waiting.clear()

    group: list = []
    last = b""

    def close():
        if len(group) > 1 or any(len(at) > 1 for _, _, lefts in group for at in lefts.values()) or (group and len(group[0][2]) > 1):
            waiting.extend(group)
            if len(waiting) >= 4096:
                settle()
        group.clear()

    for s, shared, run, place in merge_runs(runs):
        if shared < core:
            close()
        if not group or not shared == len(s) == len(last):
            group.append((shared if group else 0, len(s), {}))
            last = s
        group[-1][2].setdefault(before_of(run, place), {})[members[run][1][place], members[run][2][place]] = None
    close()
    settle()
    return pa.table([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["key", "from", "to"])


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, n_chars long, spans array<struct<from:long,to:long>>"


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _remove(batches):
    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    for batch in batches:
        out = []
        for raw, copied, spans in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            raw = raw or b""
            runs = [(0, len(raw))] if copied and len(raw) >= LENGTH else joined([(s["from"], s["to"]) for s in spans or ()])
            kept, at = [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            kept = b"".join([*kept, raw[at:]])
            text = kept.decode("utf-8", "replace")
            out.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), text, len(text), [{"from": a, "to": b} for a, b in runs]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), kind)))], ["doc_id", *(f.split()[0] for f in OUT.split(", ")[1:-1]), "spans"])


def splitters_of(docs: DataFrame, parts: int) -> list[bytes]:
    """Sampled splitters: beginnings of strings at hashed places of hashed documents, 32 for each range, however many documents there are."""
    n = F.octet_length("text")
    luck = F.xxhash64("key", F.lit(3))
    at = (1 + F.pmod(luck, F.greatest(F.lit(1), n - GRAM))).cast("int")
    rows = docs.filter(n > GRAM).select(F.substring("text", at, GRAM).alias("s"), luck.alias("luck"))
    found = sorted(bytes(r.s) for r in rows.orderBy("luck").limit(32 * parts).collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, n_chars, spans.

    A byte goes if a string of 400 bytes that covers it also starts anywhere else, in the same text or another; spans
    are the runs of bytes that went. text is what remains, a character that was cut in two shown as U+FFFD, and
    n_chars its code points; n_bytes is of the text before. A null text is empty; texts under 400 bytes keep all.
    Repeated rows count as copies of each other; null ids pass through. A very long text is read whole in one task. An
    empty table gives an empty table. Equal whole texts are told by 64-bit hashes, all other strings are compared byte
    by byte. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).withColumn("key", F.xxhash64("text"))
    found = written(rows.select("key", "text").mapInArrow(_anchor, "key long, core long, at array<int>"), "suffix-anchors")
    # A copy of a whole text is no second place: places are told apart by text and offset.
    texts = found.filter("core IS NULL").groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    each = found.filter("core IS NOT NULL")
    again = each.groupBy("core").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.max(F.size("at")).alias("most"), F.sum(F.size("at")).alias("k"))
    again = again.filter("lo <> hi OR most > 1").select("core", (F.col("k") > HOT).alias("hot"))
    places = each.join(again, "core").groupBy("key").agg(F.collect_set(F.struct("hot", "at")).alias("x"))
    places = places.select("key", F.flatten(F.transform("x", lambda x: F.transform(x["at"], lambda p: F.struct(p.alias("at"), x["hot"].alias("hot"))))).alias("x"))
    places = places.select("key", F.col("x.at").alias("at"), F.col("x.hot").alias("hot"))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = rows.select("key", "text").join(places, "key").mapInArrow(_runs(splitters_of(rows, parts)), RUN)
    spans = runs.groupBy("part").applyInArrow(lambda t: _combine(t), "key long, from long, to long")
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    copied = texts.filter("copies > 1").select("key", F.lit(True).alias("copied"))
    return rows.join(spans, "key", "left").join(copied, "key", "left").select("doc_id", "text", "copied", "spans").mapInArrow(_remove, OUT)
