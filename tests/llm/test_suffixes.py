import hashlib
import random
from collections import Counter

import pytest

from quillstone.llm import suffixes as S

from .data import SF, docs


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.md5(b[i : i + 400]).digest() for b in raw for i in range(len(b) - 399))
    out = []
    for n, b in enumerate(raw):
        spans = S.joined([(i, i + 400) for i in range(len(b) - 399) if seen[hashlib.md5(b[i : i + 400]).digest()] > 1])
        kept, at = b"", 0
        for x, y in spans:
            kept, at = kept + b[at:x], y
        kept += b[at:]
        text = kept.decode("utf-8", "replace")
        out.append((n, len(b), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept).hexdigest(), text, len(text)))
    return out


def prose(rng, n):
    return "".join(rng.choice("abcdé ") for _ in range(n))


@pytest.mark.parametrize("hot", [20_000, 2])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rng = random.Random(6)
    shared = [prose(rng, n) for n in (330, 342, 345, 350, 400, 700, 1500)]
    texts = [None, "", "short", "a" * 1200, "ab" * 700, prose(rng, 390), prose(rng, 3000)]
    for _ in range(40):
        parts = [prose(rng, rng.randint(0, 600)) + rng.choice(shared) for _ in range(rng.randint(1, 3))]
        texts.append("".join(parts) + prose(rng, rng.randint(0, 300)))
    texts += [texts[6], texts[7], texts[7][:-1], texts[8] + "x", "y" + texts[8], texts[9][5:-5]]
    got = sorted(tuple(r)[:7] for r in S.remove_repeats(docs(spark, texts)).collect())
    assert got == brute(texts)


def test_small_table_equals_brute_force(spark):
    t = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in t.select("doc_id", "text").collect())
    got = sorted(tuple(r)[:7] for r in S.remove_repeats(t).collect())
    assert got == [(rows[b[0]][0], *b[1:]) for b in brute([x for _, x in rows])]


def test_merge_of_front_coded_runs():
    rng = random.Random(2)
    runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 60))) for _ in range(11)]
    coded = [list(S.front_decode(*S.front_code(r))) for r in runs]
    assert [[s for s, _ in r] for r in coded] == runs
    got = list(S.merge_runs(coded))
    assert [s for s, *_ in got] == sorted(s for r in runs for s in r)
    for (a, *_), (b, k, run, place) in zip(got, got[1:]):
        assert k == S.shared_prefix(a, b) and runs[run][place] == b
    assert list(S.merge_runs([])) == []


def test_edges(spark):
    assert S.remove_repeats(docs(spark, ["a"]).limit(0)).count() == 0
    got = S.remove_repeats(docs(spark, ["x" * 399, "q" * 400, "z y" * 200, "z y" * 200], ids=[None, 1, 2, 2])).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(399, 0, 0), (400, 0, 0), (600, 600, 1), (600, 600, 1)]
