"""Small tables for the corpus operators: nulls, empty and long texts, ties, repeats, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, block int, norm string"
SF = "/root/testdata/sf0.001"


def docs(spark, texts, sources=None, ids=None, langs=None):
    rows = []
    for i, t in enumerate(texts):
        rows.append((i if ids is None else ids[i], t, langs[i] if langs else None, sources[i] if sources else None, None, 7, "x", None, "y"))
    return spark.createDataFrame(rows, DOCS).repartition(3)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
