"""Fill-in-middle against a plain Python version."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillstone.llm.infill import fill_in_middle, restored

from .data import SF, by_id, docs

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, h = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def check(spark, table):
    got = fill_in_middle(table).withColumn("back", restored(F.col("output"), F.col("form")))
    texts = [(r.doc_id, r.text) for r in table.collect()]
    want = sorted(str((i, *plain(i, t), t or "")) for i, t in texts)
    assert sorted(str(tuple(r)) for r in got.collect()) == want


TEXTS = [
    None, "", " ", "\t\n \x0b\x0c\r", "one", " one", "one ", "one two  three\n\nfour ", "a\x01b \x02c \x02\x01 \x01\x02 \x01", "\x02e \x02c", "<P> marker", "x <S>", "<M>", "< P>", "a < b <", "<P <S <M",
    "no\u00a0break is a word", "日本語 テキスト\u3000全角", "👩‍👩‍👧 emoji", "nul\x00nul x", "same same same", "word " * 5000, "x" * 200_000, " " * 50_000, "a  b\t\tc\n\nd",
]


@pytest.mark.parametrize("first", [0, 40, 80, 120])
def test_infill_equals_plain_python(spark, first):
    check(spark, docs(spark, TEXTS, ids=range(first, first + len(TEXTS))))


def test_nulls_repeats_and_empty_table(spark):
    check(spark, docs(spark, ["one two three"] * 4 + ["x y", None], ids=[None, None, 7, 7, -3, None]))
    assert fill_in_middle(docs(spark, [])).count() == 0


def test_all_forms_occur(spark):
    rows = by_id(fill_in_middle(spark.read.parquet(f"{SF}/documents.parquet")))
    assert {r.form for r in rows.values()} == {"plain", "psm", "spm"}


def test_rates(spark):
    t = docs(spark, ["one two three"] * 60)
    assert {r.form for r in fill_in_middle(t, rate=100, spm=100).collect()} == {"spm"}
    assert {r.form for r in fill_in_middle(t, rate=0).collect()} == {"plain"}
