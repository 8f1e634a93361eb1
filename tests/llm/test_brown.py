import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import brown as B

from .data import SF, docs


def base(texts):
    """Counts and base scores by the definition."""
    tokens = [[w for w in (t or "").encode().lower().split()] + [b" "] for t in texts]
    c = Counter(w for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(c.values()), len(c)
    return [(zlib.crc32(str(i).encode()) % 10 == 0, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in enumerate(tokens)], c


def moved(tokens, c, classes, n, own):
    """Class of each word, from full likelihoods: words that aren't units move by their own contexts, apart from one another."""
    start = {w: int(classes[0 if w == b" " else own[w] if w in own else B.OWN + B.ending(w)]) for w in c}
    left, right = ({w: np.zeros(B.CLASSES) for w in c} for _ in range(2))
    for t in tokens:
        for a, b in zip([b" "] + t, t):
            right[a][start[b]] += 1
            left[b][start[a]] += 1
    out = dict(start)
    for w in c.keys() - own.keys() - {b" "}:
        rest = n.copy()
        rest[start[w]] -= right[w]
        rest[:, start[w]] -= left[w]
        gain = []
        for g in range(B.CLASSES):
            m = rest.copy()
            m[g] += right[w]
            m[:, g] += left[w]
            gain.append(B.likelihood(m))
        best = next(g for g, x in enumerate(gain) if x >= max(gain) - 1e-6)
        out[w] = best if max(gain) > gain[start[w]] + 1e-6 else start[w]
    return out, start


def full_model(texts, c, classes, n, own):
    """Scores by the definition of the model, word by word."""
    tokens = [(t or "").encode().lower().split() + [b" "] for t in texts]
    train = [t for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 10]
    g_of, start = moved(train, c, classes, n, own)
    types, mass, pairs = Counter(), Counter(), np.zeros((B.CLASSES, B.CLASSES))
    for w, k in c.items():
        types[g_of[w]] += 1
        mass[g_of[w]] += k
    for t in train:
        for a, b in zip([b" "] + t, t):
            pairs[g_of[a], g_of[b]] += 1
    total, v, out = sum(c.values()), len(c), []
    for t in tokens:
        g, log = classes[0], 0.0
        for w in t:
            h = g_of[w] if w in g_of else classes[B.OWN + B.ending(w)]
            step = (pairs[g, h] + 0.5) / (pairs[g].sum() + 0.5 * B.CLASSES)
            log += math.log10(0.9 * step * (c[w] + 0.1) / (mass[h] + 0.1 * (types[h] + 1)) + 0.1 * (c[w] + 0.1) / (total + 0.1 * (v + 1)))
            g = h
        out.append(log)
    return out, sum(g_of[w] != start[w] for w in c)


def run(spark, texts, monkeypatch, lexicon, own_units):
    monkeypatch.setattr(B, "LEXICON", lexicon)
    monkeypatch.setattr(B, "OWN", own_units)
    monkeypatch.setattr(B, "N_UNITS", own_units + B.ENDINGS)
    seen = {}
    real = B.cluster
    monkeypatch.setattr(B, "cluster", lambda *a: seen.setdefault("c", real(*a)))
    got = sorted(map(tuple, B.score_documents(docs(spark, texts), rounds=2).collect()))
    want, c = base(texts)
    assert [r[:5] for r in got] == [(i, *w[:4]) for i, w in enumerate(want)]
    assert [r[5] for r in got] == pytest.approx([w[4] for w in want], rel=1e-9)
    frequent = sorted(((-k, w) for w, k in c.items()))
    counts = sorted(c.values(), reverse=True)
    least = min((k for k in set(counts) if sum(x >= k for x in counts) <= lexicon), default=math.inf)
    own = {w: i + 1 for i, w in enumerate([w for k, w in frequent if w != b" " and -k >= least][: own_units - 1])}
    scores, moves = full_model(texts, c, *seen["c"], own)
    assert [r[6] for r in got] == pytest.approx(scores, rel=1e-9)
    assert moves > 0 or len(own) == len(c) - 1


@pytest.mark.parametrize("lexicon, own_units", [(200_000, 8192), (200_000, 64), (60, 8192), (60, 16), (0, 8192)])
def test_equals_brute_force(spark, monkeypatch, lexicon, own_units):
    """All words are units; the rest is decided by sums of fixed size, by the table of rare words, or by both."""
    texts = [None, "", "  ", "É é A b", "the cat\tsat\non the mat", "THE cat", "x y " * 10_000] + [f"the {chr(97 + i % 20)}{i % 7} cat of w{i}" for i in range(60)]
    run(spark, texts, monkeypatch, lexicon, own_units)


def test_exchange_raises_the_likelihood(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(40):  # two alternating kinds of units
        u = np.empty(200, np.int32)
        u[::2], u[1::2] = rng.integers(1, 100, 100), rng.integers(100, 200, 100)
        rows.append((bytearray(u.tobytes()), None, None, None))
    encoded = spark.createDataFrame(rows, B.ENCODED)
    unit_of = np.arange(B.N_UNITS)
    start = np.random.default_rng(1).integers(0, B.CLASSES, B.N_UNITS)
    before = B.likelihood(B.bigrams(B.unit_contexts(encoded, unit_of, start), start))
    classes, n = B.cluster(encoded, unit_of, rounds=4)
    assert B.likelihood(n) > before and n.sum() == 40 * 199
    c = B.unit_contexts(encoded, unit_of, classes)
    assert c[1].sum() == 40 * 199 and np.allclose(B.bigrams(c, classes), n)


def test_words_out_of_the_lexicon_are_told_apart_by_their_contexts(spark, monkeypatch):
    """Words of one ending join the frequent words of their contexts: the hash of the ending only starts them."""
    monkeypatch.setattr(B, "LEXICON", 16)
    texts = [f"{'red blue green'.split()[i % 3]} {'mid' if i % 2 else f'a{i}ing'} {'sky sea sun'.split()[i % 3]} one {'new' if i % 2 else f'b{i}ing'} two" for i in range(800)]
    kept = {}
    real = B.rare_classes
    monkeypatch.setattr(B, "rare_classes", lambda *a: kept.setdefault("g", real(*a)))
    B.score_documents(docs(spark, texts), rounds=4).count()
    g = {bytes(r.word): r.g for r in kept["g"].collect()}
    kinds = [Counter(v for w, v in g.items() if w[:1] == x).most_common(1)[0] for x in (b"a", b"b")]
    assert kinds[0][0] != kinds[1][0] and min(k for _, k in kinds) > 100


def test_held_out_text_is_less_surprising_than_the_base(spark):
    got = B.score_documents(spark.read.parquet(f"{SF}/documents.parquet")).filter("held_out").groupBy().sum("score", "base_score", "n_tokens").first()
    assert got[0] > got[1] + 0.05 * got[2]


def test_edges(spark):
    assert B.score_documents(docs(spark, ["a"]).limit(0)).count() == 0
    got = B.score_documents(docs(spark, ["a b"] * 3, ids=[4, 4, None])).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1
    only_held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = B.score_documents(docs(spark, ["a b"], ids=[only_held])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and abs(r.base_score) < 1e-9


def test_documents_are_whole_however_batches_are_cut():
    rng = np.random.default_rng(0)
    for _ in range(200):
        rows = np.sort(rng.integers(0, rng.integers(1, 30), rng.integers(0, 60)))
        cuts = np.sort(rng.integers(0, len(rows) + 1, rng.integers(0, 12)))
        batches = [pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64))], ["row"]) for x in np.split(rows, cuts)]
        out = [t.column("row").to_pylist() for t in B._whole_documents(iter(batches))]
        assert sum(out, []) == rows.tolist() and sum(len(set(x)) for x in out) == len(set(rows.tolist()))
