import importlib

import pytest

from quillstone.llm.jaccard import jaccard_components

from .data import SF, docs
from .test_jaccard import brute

pipeline = pytest.importorskip("corpus_pipeline")


def held(spark, docs_, tmp_path, name, stage):
    out = stage(spark, docs_, SF)
    out.write.parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


def test_stages_one_by_one(spark, tmp_path):
    importlib.reload(pipeline)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "mixing", "sentencepiece"]
    for name, stage in pipeline.STAGES:
        before = sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
        out = held(spark, d, tmp_path, name, stage)
        after = sorted((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()) if "text" in out.columns else None
        if name != "sentencepiece":
            assert out.columns == d.columns and set(after) <= set(before)
        if name == "language_id":
            assert {i for i, t in before if any(c.isalpha() for c in t or "")} == {i for i, _ in after}
        elif name == "exact_dedup":
            assert len(after) == len({"".join(t.split()) for _, t in before}) == len({"".join(t.split()) for _, t in after})
        elif name == "ngram_jaccard_join":
            roots = {c for _, _, c in brute([t for _, t in before], k=5, per=80)}
            assert [i for i, _ in after] == [before[c][0] for c in sorted(roots)]
        elif name == "mixing":
            words = lambda rows: sum(len(t.split()) for _, t in rows)
            assert abs(words(after) / words(before) - 1.5) < 0.2
        else:
            assert out.count() == len(before) and out.filter("round_trip").count() == len(before)
        d = out


def test_run_and_edges(spark):
    got = pipeline.run(spark, SF)
    assert got.count() > 0 and "ids" in got.columns
    odd = docs(spark, [None, "", "12 34", "hello there", "hello  there"], langs=["en"] * 5, ids=[0, 1, None, None, 4])
    assert sorted(r.text for r in pipeline.language_id(spark, odd, SF).collect())[-2:] == ["hello  there", "hello there"]
    assert [r.doc_id for r in pipeline.exact_dedup(spark, odd.filter("n_chars IS NULL AND text LIKE 'h%'"), SF).collect()] == [4]
    assert [s(spark, odd.limit(0), SF).count() for _, s in pipeline.STAGES] == [0] * 5


def test_repeated_rows_null_ids_and_clashing_columns(spark, tmp_path):
    """Each row has its own fate, and columns named like a stage's own are carried along."""
    text = "some words of a text that is long enough to be cut into several shingles"
    rows = [(7, text, 1), (7, text, 1), (None, text, 2), (None, "another text without any copy in here at all, really", 3), (None, "and one more that is alone, with a null id as well", 4)]
    docs_ = spark.createDataFrame([(i, t, "en", "s", n, 5, 6, 7, "x", 8) for i, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long, shard int, pass int, taken long, row string, component_id long")
    docs_.write.parquet(f"{tmp_path}/odd")
    docs_ = spark.read.parquet(f"{tmp_path}/odd")
    left = {n: sorted(r.n_chars for r in s(spark, docs_, SF).collect()) for n, s in pipeline.STAGES[:4]}
    assert left["language_id"] == [1, 1, 2, 3, 4]
    assert left["exact_dedup"] == left["ngram_jaccard_join"] == [1, 3, 4]
    assert set(left["mixing"]) <= {1, 2, 3, 4} and len(left["mixing"]) >= 5
    assert pipeline.mixing(spark, docs_, SF).columns == docs_.columns


def test_results_of_others_keep_their_tables(spark):
    """A stage removes the tables of its own pipeline's stages alone."""
    mine = jaccard_components(docs(spark, ["a b c d e"] * 2))
    pipeline.exact_dedup(spark, docs(spark, ["x"]), SF)
    other = pipeline.mixing(spark, docs(spark, ["a b", "c"], ["s", "s"]), "another folder")
    pipeline.sentencepiece(spark, docs(spark, ["x"]), SF)
    assert mine.count() == 2 and other.count() > 0


def test_languages_are_found_in_small_batches(spark, monkeypatch):
    seen, plain = [], pipeline.written
    monkeypatch.setattr(pipeline, "written", lambda df, name: seen.append((name, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))) or plain(df, name))
    texts = ["the cat sat on the mat and then it ran away", "der Hund lief durch den Wald und kam nicht heim", None, "12 34"] * 5
    assert pipeline.language_id(spark, docs(spark, texts, langs=["en", "de", None, None] * 5), "x").count() == 10
    assert seen == [("languages", "1000")]
