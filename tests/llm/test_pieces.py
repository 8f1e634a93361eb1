import itertools
import math
import random
from pathlib import Path

import pytest

from quillstone.llm import pieces as P

from .data import SF, by_id, docs

PIECES = ["a", "b", "ab", "aba", "bb", " ", " a", " ab", "  ", "é", "bé", "c"]
rng = random.Random(4)
NORMAL = [(p, -float(rng.randint(0, 9)), i) for i, p in enumerate(PIECES)]
BYTES = list(range(100, 356))
SHOWN = [p.encode() for p in PIECES] + [b""] * (100 - len(PIECES)) + [bytes([i]) for i in range(256)]


def all_segmentations(text):
    """(score, ids) of every way to cut the text, by recursion."""
    of = {p: (s, i) for p, s, i in NORMAL}
    low = min(s for _, s, _ in NORMAL) - 10

    def go(rest):
        if not rest:
            yield 0.0, ()
        for n in range(1, len(rest) + 1):
            head = rest[:n]
            if head in of:
                s, ids = of[head][0], (of[head][1],)
            elif n == 1:
                s, ids = low, tuple(BYTES[b] for b in head.encode())
            else:
                continue
            for t, more in go(rest[n:]):
                yield s + t, ids + more

    return list(go(" " + text)) if text else [(0.0, ())]


def merges(text):
    """Ids by merges, one pass over all neighbours for each."""
    of = {p: (s, i) for p, s, i in NORMAL}
    parts = list(" " + text) if text else []
    while True:
        able = [(-of[a + b][0], n) for n, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in of]
        if not able:
            return [k for p in parts for k in ([of[p][1]] if p in of else [BYTES[x] for x in p.encode()])]
        n = min(able)[1]
        parts[n : n + 2] = [parts[n] + parts[n + 1]]


@pytest.mark.parametrize("nbest", [1, 2, 5, 9])
def test_n_best_equals_enumeration(nbest):
    seg = P.Segmenter(NORMAL, BYTES, SHOWN, nbest)
    texts = ["", "a", "ab", "abab ba", "  ab", "é\nbéz ", "▁ a", "\n"] + ["".join(rng.choice("ab cé\n") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    for t in texts:
        every = all_segmentations(t)
        want = sorted((s for s, _ in every), reverse=True)[:nbest]
        ids, score, scores, second, merged, by_merges = seg.encode(t)
        assert scores == pytest.approx(want) and score == pytest.approx(want[0])
        as_scores = {i: s for s, i in every}
        assert as_scores[tuple(merged)] == pytest.approx(by_merges) and merged == merges(t)
        assert as_scores[tuple(ids)] == pytest.approx(want[0]) and seg.decode(ids) == t
        if len(want) > 1:
            assert as_scores[tuple(second)] == pytest.approx(want[1]) and tuple(second) != tuple(ids) and seg.decode(second) == t


def test_a_star_alone_equals_enumeration():
    seg = P.Segmenter(NORMAL, BYTES, SHOWN, 6)
    for t in ("abab", "aba b", "bb", "éé"):
        every = sorted(all_segmentations(t), reverse=True)
        got = seg.best_of(" " + t)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in every[:6]]) and len({i for _, i in got}) == len(got)
        assert all((s, i) in every for s, i in got)


def test_documents_round_trip_with_the_public_model(spark):
    t = spark.read.parquet(f"{SF}/documents.parquet")
    got = P.encode(t, merges=True)
    plain = P.encode(t)
    assert got.select(plain.columns).exceptAll(plain).count() == 0 and len(got.columns) == len(plain.columns) + 3
    assert got.count() == t.count() and got.filter("NOT round_trip OR n_pieces <> size(ids)").count() == 0
    assert got.filter("nbest_scores[0] <> score OR nbest_scores[1] > score").count() == 0


def test_probabilities_by_rank_and_the_models_own_encoding(spark):
    import sentencepiece

    normal, of_byte, shown = P.load()
    assert sum(math.exp(s) for _, s, _ in normal) == pytest.approx(1) and len({s for _, s, _ in normal}) == len(normal)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    seg, alone = P.Segmenter(normal, of_byte, shown, proto=Path(P.MODEL).read_bytes()), P.Segmenter(normal, of_byte, shown)
    texts = ["Hello world again", "", "  a  b", "<s> </s>", "漢字 é\n\n\tx", "日本語 123,456.78 (x)", "z" * 300, "\U0001f600 ok"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("text NOT LIKE '%▁%'").select("text").collect() if r.text]
    best = own = 0
    for t in texts:
        ids, score, _, _, merged, by_merges = seg.encode(t)
        assert merged == sp.encode(t) and by_merges <= score + 1e-6
        assert len(t) > 5000 or alone.encode(t)[4] == merged
        best, own = best + len(ids), own + len(merged)
    assert abs(best - own) < 0.02 * own
    assert [sp.id_to_piece(i) for i in seg.encode("Hello world again")[0]] == sp.encode("Hello world again", out_type=str)
    got = by_id(P.encode(docs(spark, ["Hello world again", None]), own=True))
    assert got[0].ids == sp.encode("Hello world again") and (got[1].ids, got[1].n_merged) == ([], 0)


def test_edges(spark):
    texts = [None, "", " ", "\n\n", "漢字 ▁ \x00", "a" * 50_000, "ab " * 30_000, "same", "same"]
    got = by_id(P.encode(docs(spark, texts)))
    assert all(r.round_trip for r in got.values()) and got[0][1:] == got[1][1:] and got[0].n_pieces == 0
    assert got[0].nbest_scores == [0.0] and got[0].second_ids_sha256 is None and got[7][1:] == got[8][1:]
    assert P.encode(docs(spark, ["a"]).limit(0)).count() == 0
    assert len(P.encode(docs(spark, ["a", "b"], ids=[None, None])).collect()) == 2
    assert list(itertools.islice(got[4].nbest_scores, 1)) == [got[4].score]


def test_stretches_searched_together_equal_each_alone():
    seg = P.Segmenter(NORMAL, BYTES, SHOWN, 3)
    every = {"".join(rng.choice("abcé\nz" if n % 5 else "abc") for _ in range(rng.randint(1, 2 * P.SHORT))) for n in range(300)} | {" a", "  ", " ", "a" * P.SHORT}
    some = sorted(every)
    seg.learn(some)
    ids, begin = seg._of(seg.ids, P.np.array([seg.number[t] for t in some]))
    for n, t in enumerate(some):
        k = seg.number[t]
        assert (ids[begin[n] : begin[n + 1]].tolist(), seg.score[k], seg.loss[k]) == seg.one_best(t)
    texts = ["", "ab ab", " ".join(some), "", "é\nz"]
    assert [r[0].tolist() for r in seg.encode_all(texts)] == [seg.encode(t)[0] for t in texts]


def test_a_worker_keeps_no_segmentations_between_tasks():
    import pyarrow as pa

    proto = Path(P.MODEL).read_bytes()
    shipped = type("Shipped", (), {"value": proto})
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([b"Hello world again", None])], ["doc_id", "text"])
    out = list(P._runner(shipped, True, 4, True, False, f"{P.SCHEMA}, {P.MERGED}")([batch]))
    seg = P._segmenter(proto, True, 4, True)
    assert [x["n_pieces"] > 0 for x in out[0].to_pylist()] == [True, False]
    assert not seg.number and not len(seg.score) and not seg.lists.cache_info().currsize


def test_texts_are_searched_a_small_slice_at_a_time(monkeypatch):
    from pathlib import Path
    from types import SimpleNamespace

    import pyarrow as pa

    from quillstone.llm import pieces

    seen, plain = [], pieces.Segmenter.encode_all
    monkeypatch.setattr(pieces.Segmenter, "encode_all", lambda self, texts: seen.append(sum(map(len, texts))) or plain(self, texts))
    texts = [f"word{i} and another " * 100 for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([t.encode() for t in texts])], ["doc_id", "text"])
    run = pieces._runner(SimpleNamespace(value=Path(pieces.MODEL).read_bytes()), True, 4, False, False, pieces.SCHEMA)
    assert sum(b.num_rows for b in run([batch])) == 400
    assert sum(seen) == sum(map(len, texts)) and max(seen) <= 1 << 18


@pytest.mark.parametrize("mixed", [False, True])
def test_cuts_equal_a_pattern(mixed):
    import re

    letters, marks = "A-Za-zÀ-ÖØ-öø-ɏ", re.escape("".join(chr(i) for i in range(128) if i != 32 and not chr(i).isalpha()))
    whole = " +[^ ]*|[^ ]+"
    find = re.compile(whole if mixed else f" *[{letters}]+(?=[ {marks}]|\\Z)| *[{marks}]+(?=[ {letters}]|\\Z)|{whole}").findall
    kind = P.kinds(["ab", " a", "."] + ["b."] * mixed)
    texts = ["x"] + ["".join(rng.choice("ab,.1\n ÷Zéɏɐ漢ª\x00") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    joined = "".join(texts)
    first = P.np.cumsum([0, *map(len, texts)])
    starts = P.cut(kind[[ord(c) for c in joined]], first[:-1]).tolist()
    assert [joined[a:b] for a, b in itertools.pairwise([*starts, len(joined)])] == [w for t in texts for w in find(t)]


def test_each_different_stretch_is_looked_up_once_and_merged_by_the_library(monkeypatch):
    import sentencepiece

    seg = P.Segmenter(*P.load(), proto=Path(P.MODEL).read_bytes())
    asked = []

    class Counted(dict):
        def get(self, *x):
            asked.append(x[0])
            return super().get(*x)

    texts = ["ab, ab, ab 12.5 漢字 é (x)", "", "ab, 12.5"] * 50
    want = list(map(sentencepiece.SentencePieceProcessor(model_file=P.MODEL).encode, texts))
    monkeypatch.setattr(seg, "merged", None)
    list(seg.encode_all(texts))
    seg.number = Counted(seg.number)
    assert [r[4].tolist() for r in seg.encode_all(texts)] == want
    assert sorted(asked) == sorted({" ab", ",", " 12.5", " 漢字", " é", " (", "x", ")"})
    ids = [r[0] for r in seg.encode_all(texts)]
    assert [seg.raw(i) for i in ids] == [t.encode() for t in texts]
