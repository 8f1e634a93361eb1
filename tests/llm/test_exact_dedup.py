import hashlib
import random
import re

from quillstone.llm.exact_dedup import content_sort_dedup

from .data import by_id, docs


def brute(texts):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    out = {}
    for i, n in enumerate(norm):
        group = [j for j, m in enumerate(norm) if m == n]
        keep = min(group, key=lambda j: (-len(texts[j] or ""), j))
        out[i] = (keep, len(group), keep == i, hashlib.sha256(n.encode()).hexdigest())
    return out


def held(spark, texts, **more):
    got = {k: tuple(r[1:]) for k, r in by_id(content_sort_dedup(docs(spark, texts), **more)).items()}
    assert got == brute(texts)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "  \t", "é e", "ée", "É e", "a b", "a b", "ab ", "long " * 30_000, "long" * 30_000]
    texts += ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 6))) for _ in range(200)]
    held(spark, texts)


def test_hot_groups_are_salted_and_merged(spark):
    texts = ["the same text", "the  same text"] * 150 + [f"text {i % 40}" for i in range(80)]
    held(spark, texts, hot_least=20)


def test_repeated_rows_keep_one(spark):
    got = content_sort_dedup(docs(spark, ["a b", "a b", "ab"], ids=[4, 4, 9])).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept, r.group_size) for r in got) == [(4, 4, False, 3), (4, 4, True, 3), (9, 4, False, 3)]


def test_null_id_and_empty_table(spark):
    got = content_sort_dedup(docs(spark, ["a", "a"], ids=[None, 3])).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.kept) for r in got) == [(False, 3, True), (True, 3, False)]
    assert content_sort_dedup(docs(spark, ["a"]).limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = content_sort_dedup(docs(spark, ["a", "b"])).select("doc_id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
