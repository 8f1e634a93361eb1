"""Cross-tokenizer alignment: groups where two tokenizers' tokens end together, and links between tokens that overlap.

mapInPandas encodes each text with both tokenizers and merges the cumulative byte ends of their tokens with two
pointers: all ends of a batch stand in one line, text after text, and each pointer is an array, the place of every end
in the other side's ends. Between two neighbouring ends of either side lies one token of each: a link. An end of both
closes a group. Spark then counts by id pair in how many documents it is linked, takes the largest count of each id on
either side, and joins counts and maxima back to the documents' links.

Pairs go through the join once for each document. Those that hold more than 1/HOT_PAIRS of all such rows, at most
HOT_PAIRS in number, are broadcast; all others are shuffled by pair, so that no task gets more than that share of a pair.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, byte_slices, work_path

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how byte-level BPE cuts a text before it merges.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HOT_PAIRS = 50_000
#: Texts of a batch, and about so many bytes at once.
ROWS, BYTES = 512, 1 << 20
#: A pair is its A id, shifted by so many bits, and its B id.
BITS = 20
SCHEMA = "row long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def byte_letters() -> dict[str, int]:
    """Bytes by the letters that byte-level BPE writes them with: printable Latin-1 as itself, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


def load_bytes(path: str = BYTE_BPE) -> dict[bytes, int]:
    """Bytes of each entry with its id, which must be its rank among the merges. Special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    model, special, letters = content["model"], {t["id"] for t in content.get("added_tokens", [])}, byte_letters()
    vocab = {e: i for e, i in model["vocab"].items() if i not in special}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != list(range(256, 256 + len(merged))):
        raise ValueError("ids aren't the ranks of the merges")
    return {bytes(map(letters.__getitem__, e)): i for e, i in vocab.items()}


class Tokenizers:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, ranks: dict[bytes, int], model: bytes):
        import sentencepiece
        import tiktoken

        self.a = tiktoken.Encoding("a", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.b, n = pieces.encode, pieces.vocab_size()
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for entry, i in ranks.items():
            self.a_bytes[i] = entry
        self.b_bytes = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in range(n) for p in [pieces.id_to_piece(i)]]
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.size = (len(self.a_bytes), n)
        # An id as text with what follows it: another of its side, the other side, the next group.
        self.shown = [[np.array([f"{i}{end}" for i in range(k)], object) for end in (",", last)] for k, last in zip(self.size, "|;")]

    def ids(self, text: bytes) -> tuple[np.ndarray, list[int]]:
        """Ids of a blank and the text on both sides; none where B doesn't give them back. A does, as each byte is an entry."""
        try:
            plain = text.decode()
        except UnicodeDecodeError:
            plain = ""
        b = self.b(plain) if plain else []
        return (self.a(" " + plain), b) if b and b"".join(map(self.b_bytes.__getitem__, b)) == b" " + text else (np.zeros(0, np.uint32), [])


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of two increasing lists of ends that finish alike: the tokens (a, b), and the ends that both have.

    The pointer into B of an A token is the number of B ends before its own end, and the other way round; each end of
    either side closes one link.
    """
    at_b, at_a = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    both = ends_b[np.minimum(at_b, len(ends_b) - 1)] == ends_a if len(ends_b) else np.zeros(0, bool)
    only_b = ends_a[np.minimum(at_a, len(ends_a) - 1)] != ends_b if len(ends_a) else np.zeros(0, bool)
    a = np.concatenate([np.arange(len(ends_a)), at_a[only_b]])
    b = np.concatenate([at_b, np.flatnonzero(only_b)])
    return a, b, ends_a[both]


def _aligned(tok: Tokenizers, texts: list[bytes]) -> dict[str, list]:
    """Columns of SCHEMA from n_a on, of consecutive texts."""
    found = [tok.ids(t) for t in texts]
    n_a, n_b = (np.array([len(f[side]) for f in found], np.int64) for side in (0, 1))
    a = np.concatenate([f[0] for f in found]).astype(np.int64)
    b = np.array(list(chain.from_iterable([f[1] for f in found])), np.int64)
    ends_a, ends_b = np.cumsum(tok.a_length[a]), np.cumsum(tok.b_length[b])  # a text has as many bytes on both sides
    of_a, of_b, closed = merge(ends_a, ends_b)
    doc = np.repeat(np.arange(len(texts)), n_a)
    count = lambda docs: np.bincount(docs, minlength=len(texts))
    # The groups as text: tokens in the order group, side, place.
    group_a, group_b = np.searchsorted(closed, ends_a), np.searchsorted(closed, ends_b)
    line = np.empty(len(a) + len(b), object)
    for ids, group, other, shown, late in ((a, group_a, group_b, tok.shown[0], "left"), (b, group_b, group_a, tok.shown[1], "right")):
        last = np.append(group[1:] != group[:-1], np.ones(min(1, len(group)), bool))
        line[np.arange(len(ids)) + np.searchsorted(other, group, late)] = np.where(last, shown[1][ids], shown[0][ids])
    stops = np.cumsum(n_a + n_b)
    groups = ["".join(line[i:j])[:-1] for i, j in zip(stops - n_a - n_b, stops)]
    # Each document's pairs once, with how often they are linked.
    keys, times = np.unique(doc[of_a] << 2 * BITS | a[of_a] << BITS | b[of_b], return_counts=True)
    cuts = np.searchsorted(keys, np.arange(1, len(texts)) << 2 * BITS)
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": count(doc[np.searchsorted(ends_a, closed)]), "n_links": count(doc[of_a]),
        "groups": groups, "pairs": np.split(keys & (1 << 2 * BITS) - 1, cuts), "times": np.split(times.astype(np.int32), cuts),
    }


@lru_cache(1)
def _tokenizers(shipped) -> Tokenizers:
    return Tokenizers(*shipped.value)


def _runner(shipped):
    def run(frames):
        for frame in frames:
            tok = _tokenizers(shipped)
            texts = [t or b"" for t in frame["text"]]
            for i, j in byte_slices(texts, BYTES):
                yield pd.DataFrame({"row": frame["row"].iloc[i:j].array, "doc_id": frame["doc_id"].iloc[i:j].array, **_aligned(tok, texts[i:j])})

    return run


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, n (rows that link it), best_a and best_b: whether n is the highest of its A id, of its B id. Needs row-wise distinct pairs."""
    spark, path = linked.sparkSession, work_path(linked.sparkSession, "pair-counts")
    linked.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    counts = spark.read.schema("pair long, n long").parquet(path)
    a, b = F.shiftright("pair", BITS), F.col("pair").bitwiseAND((1 << BITS) - 1)
    sides = counts.withColumns({"a": a, "b": b})
    most = lambda side: sides.groupBy(side).agg(F.max("n").alias(f"most_{side}"))
    both = sides.join(most("a"), "a").join(most("b"), "b")
    return both.select("pair", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups (text), groups_sha256 (empty if they are), n_best, n_mutual, count_sum.

    A pair's count is the number of rows of ``docs`` that link it. n_best are a document's links whose count is the
    highest of their A id, ties included; n_mutual those that are highest of their B id too; count_sum adds the counts of
    all links. Null and empty texts, texts that aren't UTF-8, and texts that one of the tokenizers doesn't give back byte
    by byte have zeros and empty groups. Rows that repeat, and rows of null or repeated ids, count as documents of their
    own. Texts are encoded whole, however long. An empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    with open(pieces, "rb") as f:
        shipped = spark.sparkContext.broadcast((load_bytes(byte_bpe), f.read()))  # the vocabularies, whatever the corpus
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    path, table = work_path(spark, "aligned"), work_path(spark, "pairs")
    with batches_of(spark, ROWS):  # row numbers are written once, so that what reads them agrees
        rows.mapInPandas(_runner(shipped), SCHEMA).write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(SCHEMA).parquet(path).withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    linked = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    pair_counts(linked).write.parquet(table)
    counts = spark.read.schema("pair long, n long, best_a boolean, best_b boolean").parquet(table)
    least = (counts.agg(F.sum("n")).first()[0] or 0) / hot_pairs
    hot = F.broadcast(counts.filter(F.col("n") > least))  # each over 1/hot_pairs of all rows: at most hot_pairs
    known = linked.join(hot, "pair", "left")
    sums = [F.sum(F.when(c, F.col("times")).otherwise(0)).alias(n) for n, c in (("n_best", F.col("best_a")), ("n_mutual", F.col("best_a") & F.col("best_b")))]
    added = lambda rows: rows.groupBy("row").agg(*sums, F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    rest = known.filter("n IS NULL").select("row", "pair", "times").join(counts.filter(F.col("n") <= least), "pair")
    both = added(known.filter("n IS NOT NULL")).unionByName(added(rest)).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_best", "n_mutual", "count_sum")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.join(both, "row", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", *map(zero, ("n_best", "n_mutual", "count_sum")))
