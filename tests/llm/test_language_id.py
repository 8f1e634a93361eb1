import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import language_id as L

from .data import SF, by_id, docs


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, size, y = rng.integers(0, 256, (3, L.STRETCH)).astype(np.uint8), np.array([128, 50, 3]), np.array([0, 1, 3])
    m = {k: v.astype(np.float64) for k, v in L.init(4).items()}
    _, g = L.gradients(m, x, size, y)
    for k in m:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = ({**m, k: m[k].copy()} for _ in range(2))
        up[k][i] += 1e-3
        down[k][i] -= 1e-3
        slope = (L.gradients(up, x, size, y)[0] - L.gradients(down, x, size, y)[0]) / 2e-3
        assert abs(slope - g[k][i]) < 1e-4 * max(1e-3, abs(slope))


def test_batches_and_padding_do_not_matter():
    m, texts = L.init(3), [b"abc " * n for n in (1, 0, 33, 400)]
    p = L.document_probabilities(m, texts)
    assert np.allclose(p, L.document_probabilities(m, texts, chunk=1), atol=1e-6) and np.allclose(p.sum(1), [1, 0, 1, 1], atol=1e-5)
    by_byte = L.forward(m, np.frombuffer(texts[0].ljust(L.STRETCH, b"\0"), np.uint8)[None])[:, :, :, 0]
    assert np.allclose(p[0], by_byte[:, :, 0].mean(axis=0), atol=1e-6)


def test_held_out_accuracy(spark):
    t = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.identify(t).join(t.select("doc_id", "lang"), "doc_id").cache()
    assert got.count() == t.count() and got.filter("score < 0 OR score > 1").count() == 0
    held = got.filter("held_out AND lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held >= 0.97


def test_edges(spark):
    texts = ["hello world again"] * 6 + ["hola mundo"] * 6 + [None, "", "12 34 !!", "é", "x" * 300_000, "hola mundo"]
    langs = ["en"] * 6 + ["es"] * 6 + ["en", "en", "en", None, None, None]
    got = by_id(L.identify(docs(spark, texts, langs=langs)))
    assert len(got) == len(texts) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (12, 13, 14))
    assert got[15].lang_pred in ("en", "es") and got[17][2:] == got[6][2:]
    assert L.identify(docs(spark, ["a"]).limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(docs(spark, ["a", "b"])).collect()} == {"und"}
    assert L.identify(docs(spark, ["a", "b"], ids=[None, None], langs=["en", "en"])).filter("NOT held_out AND lang_pred = 'en'").count() == 2


def test_copies_do_not_displace_a_language(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "train", lambda x, size, y, n: seen.extend(zip(map(bytes, x), y.tolist())))
    luck = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30))
    some = [r.text for r in spark.range(200).select(F.format_string("text %d", "id").alias("text")).orderBy(luck).collect()]
    texts, langs = some[:1] * 100 + some[1:12] + some[-3:], ["en"] * 111 + ["es"] * 3
    L.fit(docs(spark, texts, langs=langs).select("text", "lang", F.lit(True).alias("train")), per_lang=4)
    count = lambda i: len([x for x, y in seen if y == i])
    assert count(1) == 3 and 1 < count(0) <= 6 and len(set(seen)) == len(seen)
