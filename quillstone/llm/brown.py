"""Language-model scoring by Brown class-based n-grams.

Words are counted over all training texts. Exchange clustering moves words between classes where that raises the
likelihood of the class bigrams. The most frequent words are clustered first, in sweeps: each round, tasks count every
such word's left and right neighbour classes over the whole corpus and the sums (words times classes, whatever the
corpus) decide the moves. Meanwhile all other words stay in the class that a hash of their endings gives them. From
there each of them, down to those that occur once, then moves by its own contexts in one distributed sweep against the
class bigrams: up to LEXICON words by sums of fixed size, the rest in a table grouped by word. A word's probability is
its class's transition probability times its share of the class, mixed with the unigram base.

Both are a factor of (count + 0.1) times something that doesn't depend on the count. So a task that reads texts looks
up counts and classes of frequent words, and sends the rest, each document's rare words with their places, to a join
with the counted vocabulary. That fills in the documents' classes; transitions are counted from these, and scored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bucket_of, byte_slices, written

ADD, END = 0.1, b" "  # no word holds a blank
OWN, ENDINGS, CLASSES = 8192, 1024, 32
N_UNITS = OWN + ENDINGS  # unit 0 is the end; words beyond OWN start in the class of their ending
LEXICON = 200_000
MIX, TRANSITION_ADD = 0.9, 0.5


def words(text: bytes | None) -> list[bytes]:
    """bytes.lower() maps A-Z alone, and bytes.split() parts at blank and tab to carriage return alone."""
    return text.lower().split() if text else []


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def units(lexicon: list[bytes]) -> np.ndarray:
    """The unit of each id."""
    own = min(OWN, len(lexicon) + 1)
    return np.concatenate([np.arange(own), [OWN + ending(w) for w in lexicon[own - 1 :]], OWN + np.arange(ENDINGS)]).astype(np.int64)


class Ids(dict):
    """Word to id: 0 is the end, then the lexicon, then endings. Other words are kept up to a bound."""

    def __init__(self, lexicon: list[bytes]):
        super().__init__({END: 0} | {w: i + 1 for i, w in enumerate(lexicon)})
        self.first = len(lexicon) + 1

    def __missing__(self, word: bytes) -> int:
        i = self.first + ending(word)
        if len(self) < self.first + 200_000:
            self[word] = i
        return i


def _count(batches):
    def rows(c):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(words(text))
            counts[END] += 1
            if len(counts) > 300_000:
                yield rows(counts)
                counts.clear()
    if counts:
        yield rows(counts)


ENCODED = "ids binary, word binary, l int, r int"


def _encode(lexicon):
    """Texts as ids, and a row for each word out of the lexicon with the ids beside it."""

    def run(batches):
        ids_of = Ids(lexicon.value)
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            for a, b in byte_slices(texts):
                flat = [END]
                for t in texts[a:b]:
                    flat += words(t)
                    flat.append(END)
                ids = np.fromiter(map(ids_of.__getitem__, flat), np.int32, len(flat))
                rare = np.flatnonzero(ids >= ids_of.first)
                k = len(rare)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids.tobytes()] + [None] * k, pa.binary()), pa.array([None] + [flat[i] for i in rare.tolist()], pa.binary()),
                    pa.array(np.append(-1, ids[rare - 1]), pa.int32()), pa.array(np.append(-1, ids[rare + 1] if k else rare), pa.int32()),
                ], ["ids", "word", "l", "r"])

    return run


SUMS = "piece int, at binary, sums binary"


def _sums(piece: int, x: np.ndarray) -> pa.RecordBatch:
    """A piece's sums other than 0 and their places: most words meet few classes in one task."""
    at = np.flatnonzero(x)
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([x[at].astype(np.int64).tobytes()], pa.binary())], [f.split()[0] for f in SUMS.split(", ")])


def _contexts(row_of: np.ndarray, class_of: np.ndarray, size: int):
    """Sums of (row, left or right, neighbour class) in 64 pieces of rows that are added up apart. row_of: row of each id, or -1."""

    def run(batches):
        sums = np.zeros(size * 2 * CLASSES, np.int32)
        for batch in batches:
            for raw in batch.column(0):
                ids = np.frombuffer(raw.as_buffer(), np.int32)
                u, g = row_of[ids], class_of[ids]
                for side, (x, y) in enumerate(((u[1:], g[:-1]), (u[:-1], g[1:]))):
                    hit = x >= 0
                    np.add.at(sums, (x[hit] * 2 + side) * CLASSES + y[hit], np.int32(1))
        for i, x in enumerate(sums.reshape(64, -1)):
            if x.any():
                yield _sums(i, x)

    return run


def _add(width: int, last=None):
    """Sums of a piece added up as they come; ``last`` makes something else of the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, piece = np.zeros(width, np.int64), None
        for batch in batches:
            for piece, at, x in zip(*(batch.column(f.split()[0]) for f in SUMS.split(", "))):
                total[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(x.as_buffer(), np.int64)
        i = piece.as_py()
        yield _sums(i, last(i, total) if last else total)

    return run


def contexts(encoded: DataFrame, row_of: np.ndarray, class_of: np.ndarray, size: int, last=None) -> dict[int, np.ndarray]:
    """Over the whole corpus how often each class is left and right of each row, by piece, or what ``last`` makes of a piece's sums."""
    width = size * 2 * CLASSES // 64
    parts = encoded.filter("ids IS NOT NULL").select("ids").mapInArrow(_contexts(row_of, class_of, size), SUMS)
    # Two rounds: the sums of 32 tasks are added up first, in 64 groups a piece at most, and read a few at a time.
    salt = F.pmod(F.shiftright(F.spark_partition_id(), 5), F.lit(64)).alias("salt")
    parts = parts.groupBy("piece", salt).applyInArrow(_add(width), SUMS)
    out = {}
    with batches_of(encoded.sparkSession, 8):
        for r in parts.groupBy("piece").applyInArrow(_add(width, last), SUMS).collect():
            x = np.zeros(width, np.int64)
            x[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["sums"], np.int64)
            out[r["piece"]] = x
    return out


def unit_contexts(encoded: DataFrame, unit_of: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """(2, N_UNITS, CLASSES)."""
    out = np.zeros((64, 2 * N_UNITS * CLASSES // 64), np.int64)
    for i, x in contexts(encoded, unit_of, classes[unit_of], N_UNITS).items():
        out[i] = x
    return out.reshape(N_UNITS, 2, CLASSES).transpose(1, 0, 2)


def decide(left: np.ndarray, right: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The exchange step for words (rows) apart from one another: the class that raises the likelihood most against bigrams n, which count the word in its own class. Of equal classes the own, then the first."""
    at = np.arange(CLASSES)[None] == own[:, None]
    l, r = left.astype(np.float64), right.astype(np.float64)
    ls, rs = l.sum(1, keepdims=True), r.sum(1, keepdims=True)
    grow = lambda base, more: _xlogx(np.maximum(base, 0) + more) - _xlogx(np.maximum(base, 0))
    gain = -grow(n.sum(1)[None] - at * rs, rs) - grow(n.sum(0)[None] - at * ls, ls)
    within = n.diagonal()[None] - at * (l + r)  # where a class meets itself, both sides add up
    gain += grow(within + r, l) - grow(within, l)
    for g in range(CLASSES):
        mine = (own == g)[:, None]
        hit = np.flatnonzero(r[:, g])
        gain[hit] += grow(n[None, :, g] - at[hit] * r[hit, g, None] - mine[hit] * l[hit], r[hit, g, None])
        hit = np.flatnonzero(l[:, g])
        gain[hit] += grow(n[None, g] - at[hit] * l[hit, g, None] - mine[hit] * r[hit], l[hit, g, None])
    top = gain.max(1)
    best = (gain >= top[:, None] - 1e-6).argmax(1)
    return np.where(top > gain[np.arange(len(own)), own] + 1e-6, best, own)


def lexicon_classes(encoded: DataFrame, lexicon: list[bytes], unit_of: np.ndarray, classes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class of each id: words of the lexicon beyond OWN are decided in tasks; one byte for each comes back."""
    class_of = classes[unit_of]
    tail = len(lexicon) + 1 - OWN
    if tail <= 0:
        return class_of
    per = -(-tail // 64)
    row_of = np.full(len(unit_of), -1)
    row_of[OWN : OWN + tail] = np.arange(tail)
    own = np.zeros(64 * per, np.int64)
    own[:tail] = class_of[OWN : OWN + tail]

    def last(i: int, total: np.ndarray) -> np.ndarray:
        sums = total.reshape(per, 2, CLASSES)
        return decide(sums[:, 0], sums[:, 1], n, own[i * per : (i + 1) * per])

    for i, x in contexts(encoded, row_of, class_of, 64 * per, last).items():
        own[i * per : (i + 1) * per] = x[:per]
    class_of[OWN : OWN + tail] = own[:tail]
    return class_of


def _sides(class_of: np.ndarray):
    def run(batches):
        for batch in batches:
            l, r = (class_of[batch.column(i).to_numpy()] for i in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((l * CLASSES + r).astype(np.int16))], ["word", "lr"])

    return run


def _decide_rare(classes: np.ndarray, n: np.ndarray):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found, (lr, times), k = part.column(0), part.column(1).flatten().flatten(), part.column(1).value_lengths().to_numpy()
                w = np.repeat(np.arange(part.num_rows), k)
                lr, times = lr.to_numpy().astype(np.int64), times.to_numpy()
                left, right = np.zeros((2, part.num_rows, CLASSES), np.int64)
                np.add.at(left, (w, lr // CLASSES), times)
                np.add.at(right, (w, lr % CLASSES), times)
                own = classes[[OWN + ending(x) for x in found.to_pylist()]]
                yield pa.RecordBatch.from_arrays([found, pa.array(decide(left, right, n, own), pa.int32())], ["word", "g"])

    return run


def rare_classes(encoded: DataFrame, class_of: np.ndarray, classes: np.ndarray, n: np.ndarray) -> DataFrame:
    """(word, g) of all words out of the lexicon. A word has at most CLASSES squared rows of neighbours."""
    sides = encoded.filter("word IS NOT NULL").select("word", "l", "r").mapInArrow(_sides(class_of), "word binary, lr short")
    sides = sides.repartition("word").groupBy("word", "lr").agg(F.count(F.lit(1)).alias("n"))
    return sides.groupBy("word").agg(F.collect_list(F.struct("lr", "n")).alias("sides")).mapInArrow(_decide_rare(classes, n), "word binary, g int")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def bigrams(context: np.ndarray, classes: np.ndarray) -> np.ndarray:
    out = np.zeros((CLASSES, CLASSES))
    np.add.at(out, classes, context[1])
    return out


def likelihood(n: np.ndarray) -> float:
    return float(_xlogx(n).sum() - _xlogx(n.sum(1)).sum() - _xlogx(n.sum(0)).sum())


def exchange(context: np.ndarray, classes: np.ndarray, part: int, parts: int = 2) -> np.ndarray:
    """One sweep: units of one part, most frequent first, each move to the class with the highest likelihood.

    Class bigrams follow every move; neighbours' classes stay as counted until the next pass over the corpus.
    """
    left, right = context.astype(np.float64)
    n, classes, all_ = bigrams(context, classes), classes.copy(), np.arange(CLASSES)
    count = right.sum(1)
    for w in np.argsort(-count, kind="stable"):
        if w % parts != part or count[w] == 0:
            continue
        own, l, r = classes[w], left[w], right[w]
        n[own] -= r
        n[:, own] -= l
        np.maximum(n, 0, out=n)
        rows, cols = n.sum(1), n.sum(0)
        gain = (_xlogx(n + r) - _xlogx(n)).sum(1) + (_xlogx(n + l[:, None]) - _xlogx(n)).sum(0)
        gain -= _xlogx(rows + r.sum()) - _xlogx(rows) + _xlogx(cols + l.sum()) - _xlogx(cols)
        best = int(gain.argmax()) if gain.max() > gain[own] + 1e-9 else own
        classes[w] = best
        n[best] += r
        n[:, best] += l
    return classes


def cluster(encoded: DataFrame, unit_of: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the units and counts of class bigrams; the best classes seen at any pass are returned.

    At first the most frequent words lead a class each, and the others follow in turn.
    """
    classes = np.arange(N_UNITS) % CLASSES
    best = (-math.inf, None, None)
    for i in range(rounds + 1):
        context = unit_contexts(encoded, unit_of, classes)
        n = bigrams(context, classes)
        if (now := likelihood(n)) > best[0]:
            best = (now, classes, n)
        if i < rounds:
            classes = exchange(context, best[1] if i == rounds - 1 and now < best[0] else classes, i % 2)
    return best[1], best[2]


def _class_sizes(lexicon, class_of: np.ndarray):
    def run(batches):
        ids_of, sums = Ids(lexicon.value), np.zeros((2, CLASSES), np.int64)
        for batch in batches:
            g = class_of[np.array([ids_of[w] for w in batch.column(0).to_pylist()], np.int64)]
            rare = batch.column(2)
            g = np.where(rare.is_valid().to_numpy(zero_copy_only=False), rare.fill_null(0).to_numpy(), g)
            sums[0] += np.bincount(g, minlength=CLASSES)
            sums[1] += np.bincount(g, batch.column(1).to_numpy(), minlength=CLASSES).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(sums[0]), pa.array(sums[1])], ["g", "types", "tokens"])

    return run


PART = "row long, place int, word binary, doc_id long, held_out boolean, n_tokens long, n long, base double, classes binary"
PART_TYPES = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary())


def _look_up(lexicon, class_of: np.ndarray, log_of: np.ndarray):
    """Per document: classes of its tokens and the sum of known log counts; and a row for each token whose count isn't known here, with its place."""
    names = [f.split()[0] for f in PART.split(", ")]

    def run(batches):
        ids_of = Ids(lexicon.value)
        for batch in batches:
            doc_ids, texts = batch.column(1).to_pylist(), [t or b"" for t in batch.column(3).to_pylist()]
            rows, held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b in byte_slices(texts, 1 << 20):
                own, of, place, rare_words = [], [], [], []
                for i in range(a, b):
                    w = words(texts[i])
                    w.append(END)
                    ids = np.fromiter(map(ids_of.__getitem__, w), np.int64, len(w))
                    logs = log_of[ids]
                    rare = np.flatnonzero(np.isnan(logs))
                    of.append(np.full(len(rare), rows[i]))
                    place.append(rare)
                    rare_words += [w[at] for at in rare.tolist()]
                    # The document's own row has a key that no word has.
                    own.append((rows[i], None, b" %d" % rows[i], doc_ids[i], held[i], len(w), len(w) - len(rare), math.fsum(np.delete(logs, rare)), class_of[ids].astype(np.uint8).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own), PART_TYPES)], names)
                if rare_words:
                    known = [pa.array(np.concatenate(of)), pa.array(np.concatenate(place).astype(np.int32)), pa.array(rare_words, pa.binary())]
                    yield pa.RecordBatch.from_arrays(known + [pa.nulls(len(rare_words), t) for t in PART_TYPES[3:]], names)

    return run


FILLED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, classes binary"


def _whole_documents(batches):
    """The same rows, cut where a document ends. Rows come sorted by document."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column("row").to_numpy()
        cut = int(np.searchsorted(rows, rows[-1]))  # the last document may go on
        if held and held[0].column("row")[0].as_py() != rows[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif not held and cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut) if not held else batch)
    if held:
        yield pa.Table.from_batches(held)


def _fill(batches):
    """Classes of the end before, and of each token, with those of rare words put in place, and sums of log counts."""
    for table in _whole_documents(batches):
        table = table.combine_chunks()
        doc = table.column("n_tokens").is_valid().to_numpy()
        own, rare = table.filter(pa.array(doc)), table.filter(pa.array(~doc))
        classes = own.column("classes").to_pylist()
        flat = np.frombuffer(b"".join(g[-1:] + g for g in classes), np.uint8).copy()
        starts = np.concatenate([[0], np.cumsum([len(g) + 1 for g in classes])])
        of = (np.cumsum(doc) - 1)[~doc]  # a document's own row comes first
        g = rare.column("g")
        moved = g.is_valid().to_numpy()
        flat[(starts[of] + rare.column("place").to_numpy() + 1)[moved]] = g.drop_null().to_numpy()
        c = rare.column("c").fill_null(0).to_numpy()
        logs = own.column("base").to_numpy() + np.bincount(of, np.log10(c + ADD), minlength=len(classes))
        known = own.column("n").to_numpy() + np.bincount(of, c > 0, minlength=len(classes)).astype(np.int64)
        filled = [flat[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        first = [own.column(x).combine_chunks() for x in ("doc_id", "held_out", "n_tokens")]
        yield pa.RecordBatch.from_arrays(first + [pa.array(known), pa.array(logs, pa.float64()), pa.array(filled, pa.binary())], [f.split()[0] for f in FILLED.split(", ")])


def _transitions(batches):
    sums = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            g = np.frombuffer(raw, np.uint8).astype(np.int64)
            sums += np.bincount(g[:-1] * CLASSES + g[1:], minlength=len(sums))
    yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], ["pair", "k"])


def _score(step: np.ndarray):
    """step: log10 of the factor beside (count + 0.1), by class before and class."""

    def run(batches):
        for batch in batches:
            total = [float(step[g[:-1], g[1:]].sum()) for g in (np.frombuffer(x, np.uint8) for x in batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:5] + [pa.array(total, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "logs", "steps"])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 6) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Rows whose crc32(id as text) mod 10 is 0 are held out of all counts; a null id counts for training. A null
    text is empty: one end token. Where nothing can be learned all counts are 0 and both scores are 0 apart from
    rounding: V is 0, and the only class holds the unknown word alone. Repeated ids are rows of their own. A very long
    text is scored whole in one task. Words of equal counts are ordered by their bytes. perplexity is that of the text's
    tokens, at least one. One row per distinct count comes to the driver. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    held = F.coalesce(bucket_of(F.col("doc_id")) % 10 == 0, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).withColumn("held_out", held)
    train = rows.filter("NOT held_out").select("text")
    vocabulary = written(train.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "brown-vocabulary")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # The least count that leaves at most LEXICON words; a histogram of counts is short.
    per = sorted(((r.c, r["count"]) for r in vocabulary.groupBy("c").count().collect()), reverse=True)
    least, held_words = math.inf, 0
    for c, k in per:
        if held_words + k > LEXICON:
            break
        least, held_words = c, held_words + k
    frequent = [] if least == math.inf else sorted(((r.c, bytes(r.word)) for r in vocabulary.filter(F.col("c") >= least).collect()), key=lambda x: (-x[0], x[1]))
    words_of = [w for _, w in frequent if w != END]
    lexicon = spark.sparkContext.broadcast(words_of)  # LEXICON words at most
    unit_of = units(words_of)
    log_of = np.full(len(unit_of), np.nan)
    ids_of = Ids(words_of)
    log_of[np.array([ids_of[w] for _, w in frequent], np.int64)] = [math.log10(c + ADD) for c, _ in frequent]
    encoded = written(train.mapInArrow(_encode(lexicon), ENCODED), "brown-ids")
    classes, pairs = cluster(encoded, unit_of, rounds)
    class_of = lexicon_classes(encoded, words_of, unit_of, classes, pairs)
    vocabulary = written(vocabulary.join(rare_classes(encoded, classes[unit_of], classes, pairs), "word", "left"), "brown-classes")

    parts = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(_look_up(lexicon, class_of, log_of), PART)
    parts = parts.join(vocabulary, "word", "left").drop("word").repartition("row").sortWithinPartitions("row", "place")
    filled = written(parts.mapInArrow(_fill, FILLED), "brown-documents")
    pairs = np.zeros(CLASSES * CLASSES)
    for r in filled.filter("NOT held_out").select("classes").mapInArrow(_transitions, "pair int, k long").groupBy("pair").agg(F.sum("k").alias("k")).collect():
        pairs[r.pair] = r.k
    pairs = pairs.reshape(CLASSES, CLASSES)
    sizes = np.zeros((2, CLASSES))
    for r in vocabulary.mapInArrow(_class_sizes(lexicon, class_of), "g int, types long, tokens long").groupBy("g").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect():
        sizes[:, r.g] = r.types, r.tokens
    base = n + ADD * (v + 1)
    step = (pairs + TRANSITION_ADD) / (pairs.sum(1, keepdims=True) + TRANSITION_ADD * CLASSES)
    step = np.log10(MIX * step / (sizes[1] + ADD * (sizes[0] + 1)) + (1 - MIX) / base)
    out = filled.mapInArrow(_score(step), "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, steps double")
    score = F.col("logs") + F.col("steps")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(math.log10(base))).alias("base_score"),
        score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
