import random

import numpy as np
import pytest

from quillstone.llm import jaccard as J
from quillstone.llm.components import components

from .data import SF, docs


def brute(texts, ids=None, k=4, per=85):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= per * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return sorted((i, len(sets[i]), root(i)) for i in range(len(texts)))


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("block", "part"), [(256, 1 << 16), (3, 5)])
def test_equals_brute_force(spark, monkeypatch, block, part):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "PART", part)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    texts = [None, "", " \t", "one", "One", "a b c", "A  b\nc", "a b c d", "é É a b", "long " * 20_000, "w1 " * 5]
    for _ in range(6):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(10, 120))]
        texts += family(rng, base + passage * rng.randint(0, 1), 14, 4)
    texts += [" ".join(f"u{rng.randint(0, 4)}" for _ in range(rng.randint(1, 8))) for _ in range(60)]
    got = sorted(map(tuple, J.jaccard_components(docs(spark, texts)).collect()))
    assert got == brute(texts)


def test_a_shingle_in_every_set(spark, monkeypatch):
    """Lists of all sets, in several parts and blocks, with many answers in each."""
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "PART", 7)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(50)]
    texts = ["k l m n " + t for t in family(rng, base, 70, 9)] + ["k l m n"] * 3 + ["k l m n o"]
    assert sorted(map(tuple, J.jaccard_components(docs(spark, texts), k=4, per=80).collect())) == brute(texts, per=80)


def test_a_pair_comes_once_for_all_equal_lists(spark, monkeypatch):
    """Shingles that the same sets have are one list."""
    kept = {}
    plain = J.written
    monkeypatch.setattr(J, "written", lambda df, name: kept.setdefault(name, plain(df, name)))
    base = [f"w{i}" for i in range(400)]
    J.jaccard_components(docs(spark, [" ".join(base), " ".join(base[:395] + ["x"]), " ".join(f"y{i}" for i in range(30))])).collect()
    assert kept["jaccard-postings"].count() > 50 and kept["jaccard-lists"].count() == 2


def test_small_table_equals_brute_force(spark):
    t = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in t.select("doc_id", "text").collect())
    got = sorted(map(tuple, J.jaccard_components(t).collect()))
    ids = [i for i, _ in rows]
    assert got == [(ids[i], n, ids[c]) for i, n, c in brute([x for _, x in rows])]


def test_edges(spark):
    assert J.jaccard_components(docs(spark, ["a"]).limit(0)).count() == 0
    got = sorted(map(str, J.jaccard_components(docs(spark, ["a b c d e"] * 3, ids=[7, 7, None])).collect()))
    assert len(got) == 3 and all("component_id=7" in r for r in got)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 540)] + [(7, 7), (3, 2), (900, 901)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{i: 500 for i in range(500, 540)}, 900: 900, 901: 900}


def test_a_task_holds_no_whole_bitmap():
    import tracemalloc

    import pyarrow as pa

    h = np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 1000)
    tracemalloc.start()
    got = np.zeros((J.PIECES, J.BITS // J.PIECES // 8), np.uint8)
    base = tracemalloc.get_traced_memory()[0]
    for b in J._bitmap([pa.RecordBatch.from_arrays([pa.array(x)], ["h"]) for x in (h[:500], h[400:])]):
        for r in b.to_pylist():
            got[r["piece"]] |= np.frombuffer(r["counts"], np.uint8)
    peak = tracemalloc.get_traced_memory()[1] - base
    tracemalloc.stop()
    want = np.zeros(J.BITS, bool)
    want[h & (J.BITS - 1)] = True
    assert (got.reshape(-1) == np.packbits(want)).all() and peak < 16e6
    assert list(J._bitmap([])) == []


def test_stars_are_done_without_a_round(spark, monkeypatch):
    """A round costs eight exchanges; its end is seen without another one."""
    from quillstone.llm import components as C

    made, plain = [], C.written
    monkeypatch.setattr(C, "written", lambda df, name: made.append(name) or plain(df, name))
    stars = spark.createDataFrame([(9, 1), (1, 8), (5, 2), (5, 5)], "u long, v long")
    assert {r.u: r.v for r in C.components(stars).collect()} == {1: 1, 8: 1, 9: 1, 2: 2, 5: 2} and len(made) == 1
    made.clear()
    assert {r.u: r.v for r in C.components(spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")).collect()} == {1: 1, 2: 1, 3: 1} and len(made) == 2


def test_answers_are_brought_together(spark):
    from quillstone.llm.components import brought_together

    answers = spark.createDataFrame([(1, 1), (4, 1), (2, 2), (5, 2), (3, 3), (6, 3)], "vertex long, comp long")
    of = lambda links: {r.vertex: r.comp for r in brought_together(answers, spark.createDataFrame(links, "u long, v long")).collect()}
    assert of([]) == {1: 1, 4: 1, 2: 2, 5: 2, 3: 3, 6: 3}
    assert of([(3, 2), (7, 3), (9, 8)]) == {1: 1, 4: 1, 2: 2, 5: 2, 3: 2, 6: 2, 7: 2, 8: 8, 9: 8}


def test_a_task_sends_its_sketch_by_pieces():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 5000, 600)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(range(1500)), pa.array([t.encode() for t in texts])], ["doc_id", "text_hash", "text"])
    tracemalloc.start()
    rows = got = 0
    for b in J._describe(4)([batch]):
        rows += b.num_rows if b.column("counts").null_count else 0
        got += sum(int(np.frombuffer(x, np.uint32).sum()) for x in b.column("counts").to_pylist() if x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1500 and got == sum(len(s) for s in J.shingle_sets([t.encode() for t in texts]))
    assert peak < 45e6


def test_levels_come_to_the_driver_as_bytes(spark):
    counts = np.zeros((J.PIECES, J.SLOTS // J.PIECES), np.uint32)
    counts[3, :4] = 1, 2, 9, 1 << 31
    pieces = spark.createDataFrame([(3, counts[3].tobytes()), (3, counts[3].tobytes())], "piece int, counts binary")
    got = np.frombuffer(J.merged(pieces, np.uint32, lambda a, b, out: np.minimum(a.astype(np.uint64) + b, (1 << 32) - 1, out=out, casting="unsafe"), J.SLOTS, J._level), np.uint8)
    assert len(got) == J.SLOTS and got.reshape(J.PIECES, -1)[3, :5].tolist() == [8, 16, 33, 255, 0] and np.count_nonzero(got) == 4
