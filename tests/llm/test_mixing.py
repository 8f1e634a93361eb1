import random

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import mixing
from quillstone.llm.mixing import local_order, mix, split_quotas

from .data import docs


def targets(sizes, weights=(3, 1, 2)):
    """By hand: share by weight, cut at the caps, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
            free.remove(s)
        left = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


def test_targets_and_quotas(spark):
    rng = random.Random(1)
    names = ["b", "a", "é", None, "z", "ab", "empty"]
    sources = [rng.choice(names[:6] + ["a"] * 5) for _ in range(400)] + ["empty"]
    texts = [" w\t" * rng.randint(0, 60) for _ in range(398)] + [None, "one " * 5000, ""]
    rows = mix(docs(spark, texts, sources), shards=8)
    got = rows.collect()
    assert sorted(r.doc_id for r in got) == list(range(401))
    sizes = {}
    for r in got:
        assert r.size == len((texts[r.doc_id] or "").split()) and 0 <= r.taken <= 2 * r.size
        assert sum(d.words for d in r.draws) == r.taken and all(0 <= d.shard < 8 for d in r.draws)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = targets(sizes)
    for s, target in want.items():
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target) < 1e-6 * (1 + target) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 1
    assert sorted(map(tuple, mix(docs(spark, texts, sources).repartition(5), shards=8).collect()), key=str) == sorted(map(tuple, got), key=str)
    dealt = rows.select("doc_id", F.explode("draws").alias("d")).select("d.shard", "doc_id", "d.pass", "d.words")
    order = local_order(dealt).groupBy("shard").agg(F.sum("words").alias("n")).collect()
    assert sum(r.n for r in order) == sum(r.taken for r in got)


def test_tree_is_exact_and_spread():
    q = np.array([1000, 0, 37, 500])
    table = split_quotas(q, 16, seed=3)
    assert (table.sum(axis=0) == q).all() and table.min() >= 0
    assert table.sum(axis=1).max() - table.sum(axis=1).min() <= 1
    assert abs(table[:, 0] - 62.5).max() < 25 and (split_quotas(q, 16, seed=3) == table).all()


def test_draws_of_over_a_billion():
    q = np.array([3_000_000_000, 0, 7, 1_500_000_000, 1])
    table = split_quotas(q, 8, seed=1)
    assert (table.sum(axis=0) == q).all() and table.min() >= 0 and table.sum(axis=1).max() - table.sum(axis=1).min() <= 1
    assert abs(table[:, 0] / (q[0] / 8) - 1).max() < 1e-3


def test_large_draws_are_hypergeometric(monkeypatch):
    """Inversion has the mean and the variance of numpy's sampler, and stays within its bounds."""
    rng = np.random.default_rng(5)
    for good, bad, n in ((60, 40, 30), (5, 1000, 900), (1, 0, 1), (0, 9, 4), (7, 3, 10), (3, 7, 0)):
        want = rng.hypergeometric(good, bad, n, 4000)
        monkeypatch.setattr(mixing, "LARGE", 0)
        got = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(4000)])
        monkeypatch.undo()
        assert max(0, n - bad) <= got.min() and got.max() <= min(n, good)
        assert abs(got.mean() - want.mean()) < 0.2 and abs(got.var() - want.var()) < 0.1 * want.var() + 0.05
    monkeypatch.setattr(mixing, "LARGE", 0)
    parts = mixing.draw_of_each(rng, np.array([4, 0, 9, 2]), 7)
    assert parts.sum() == 7 and (parts <= [4, 0, 9, 2]).all() and (mixing.draw_of_each(rng, np.array([4, 1]), 5) == [4, 1]).all()


def test_draws_follow_the_tree(spark, monkeypatch):
    """Blocks drawn by each shard are what the tree dealt; another tree gives other draws."""
    texts, sources = ["w " * 10] * 300, ["a", "b", "c"] * 100
    words = lambda: sorted((r.shard, r.source, r.n) for r in mix(docs(spark, texts, sources), shards=4, block_rows=1).select("source", F.explode("draws").alias("d")).groupBy("source", "d.shard").agg(F.sum("d.words").alias("n")).collect())
    spread = words()
    assert len({s for s, _, _ in spread}) == 4
    seen = []

    def to_first(quotas, shards, seed=0):
        seen.append(split_quotas(quotas, shards, seed))
        out = np.zeros((shards, len(quotas)), np.int64)
        out[0] = quotas
        return out

    monkeypatch.setattr("quillstone.llm.mixing.split_quotas", to_first)
    assert {s for s, _, _ in words()} == {0} and sum(n for *_, n in words()) == sum(n for *_, n in spread)
    drawn = {(s, "abc"[i]) for s in range(4) for i in range(3) if seen[0][s, i]}
    assert {(s, name) for s, name, _ in spread} == drawn


def test_edges(spark):
    assert mix(docs(spark, ["a"]).limit(0)).count() == 0
    assert [r.taken for r in mix(docs(spark, [None, ""], ["a", None])).collect()] == [0, 0]
    got = mix(docs(spark, ["a b c"] * 4, ["s"] * 4, ids=[1, 1, None, None])).collect()
    assert len(got) == 4 and sum(r.taken for r in got) == 18
