"""Personal data: base spans against plain Python regular expressions, added spans on planted forms."""

import random
import re

from pyspark.sql import functions as F

from quillstone.llm import pii as P

from .data import SF, docs

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c >= "5") for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    found = []
    for nth, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), nth, kind, m.end()))
    return sorted(found)


def check(spark, texts):
    """Base spans of the table, and by text the spans added to them."""
    rows = P.find_personal_data(docs(spark, texts)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    added = {}
    for r in rows:
        want = base(texts[r.doc_id])
        assert [tuple(s) for s in r.base] == want, texts[r.doc_id][:300]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[2] == k for w in want) for k in P.KINDS]
        assert set(map(tuple, r.spans)) >= set(want) and [tuple(s) for s in r.spans] == sorted(map(tuple, r.spans))
        added[r.doc_id] = [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans if tuple(s) not in want]
    return added


def number(rng, good=True):
    while True:
        d = "".join(rng.choices("0123456789", k=16))
        if luhn(d) == good:
            return d


def planted(rng, n=400):
    """Texts with plain personal data, and numbers that only look like it."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    some = lambda k: " ".join(word() for _ in range(k))
    made = [
        lambda: f"{word()}.{rng.randint(10, 99)}@{word()}.example.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: number(rng), lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
        lambda: number(rng, False), lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)), lambda: f"+{rng.randint(1, 9)} 55", lambda: f"{rng.randint(10, 99)}-{rng.randint(100, 999)}-{rng.randint(100, 999)}", lambda: f"{word()} at {word()}.{word()}",
    ]
    return [f"{some(6)} {made[i % len(made)]()} {some(6)}" for i in range(n)]


ODD = [
    None, "", "x", "a@b.c@d.e_x@f.g", "x@y@z.com", "a@b..c", "@a.b", "a@-.-", "1.2.3.4.5.6.7.8", "1.2.3..4.5.6.7", "256.1.1.1 255.255.255.255 0000255.01.1.1 99999999999.1.1.1", "+1 ((((", "+1 (555) 555-5555-", "++49 30 1234567",
    "4111111111111111", "4111-1111-1111-1111", "4111 1111  1111 1111", "4111111111111111 4111111111111111", "x4111111111111111y", "1 4111111111111111", "+4111111111111111", "a." * 20_000 + "@" + "b." * 20_000, "1 " * 30_000, "1." * 30_000, "9" * 50_000,
    "+1" + "(" * 50_000, "a" * 100_000, "\U0001f600 é x@y.zz \U0001f600 1.2.3.4", "x@y.zz\n+1 171 555 2028\t1.1.1.1", "nul\x00 a@b.cc",
]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(5)
    strings = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for letters in ("a@.", "a1@.-_ ", "12. ", "1234567890 -", "+1 ().-2", "a1@.+- ()%_é\n") for _ in range(250)]
    cards = [re.sub(r"(....)", r"\1 ", number(rng)) + rng.choice(["", "7", "-", " 1"]) for _ in range(100)]
    check(spark, ODD + strings + cards)


def test_planted_forms_are_added_and_clean_texts_left_alone(spark):
    rng = random.Random(6)
    plain = planted(rng)
    clean = [" ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(30)) + f". {i}. at {i % 7}.5 am" for i in range(50)]
    a, b = number(rng), number(rng)
    hidden = [f"some words {a} {b} and more", f"word {a}-{b} word"]
    added = check(spark, [*plain, *clean, *hidden])
    n = len(plain) + len(clean)
    assert added[n] == [("card", a), ("card", b)] and added[n + 1] == [("card", a), ("card", b)]
    assert not any(added[i] for i in range(n))


def test_trees_find_held_out_spans(spark):
    """Trained on one half of the planted texts, thresholds keep nearly all personal data of the other half, and nothing else."""
    rng = random.Random(7)
    spans = P.labelled(P.placed(P.proposals(docs(spark, planted(rng, 900)))))
    judge = P.Judge(spans.cache())
    assert set(judge.least) == set(P.KINDS)
    other = P.labelled(P.placed(P.proposals(docs(spark, planted(rng, 900)))))
    reached = {(r.kind, r.label): (r.share, r.n) for r in judge.scored(other).groupBy("kind", "label").agg(F.avg((F.col("score") >= F.coalesce(*(F.when(F.col("kind") == k, s) for k, s in judge.least.items()))).cast("int")).alias("share"), F.count("*").alias("n")).collect()}
    assert all(reached[k, 1][0] >= 0.95 for k in P.KINDS)
    assert all(share <= 0.05 for (_, label), (share, _) in reached.items() if label == 0)


def test_nulls_repeats_and_empty_table(spark):
    rows = P.find_personal_data(docs(spark, ["x@y.zz 1.2.3.4", "x@y.zz 1.2.3.4", None, None], ids=[None, 3, 3, None])).withColumn("t", P.spans_text("spans")).collect()
    assert sorted((r.doc_id or 0, r.t) for r in rows) == [(0, ""), (0, "email:0:6,ip:7:14"), (3, ""), (3, "email:0:6,ip:7:14")]
    assert P.find_personal_data(docs(spark, [])).count() == 0


def test_no_python_in_plans(spark):
    plan = P.find_personal_data(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_all_labelled_proposals_are_learned_from(spark, monkeypatch):
    """Every proposal of either fold counts: the weights of the rows written for training sum to the labelled spans."""
    rng = random.Random(8)
    spans = P.labelled(P.placed(P.proposals(docs(spark, planted(rng, 300))))).filter("label IS NOT NULL").cache()
    many = spans.crossJoin(spark.range(250).withColumnRenamed("id", "k")).withColumn("digits_around", F.col("k").cast("int")).withColumn("chars", (F.col("chars") + F.col("row") % 20).cast("int")).drop("k")
    paths, real = [], P.work_path
    monkeypatch.setattr(P, "work_path", lambda s, name: paths.append(real(s, name)) or paths[-1])
    P.Judge(many, trees=1)
    kept = spark.read.parquet(paths[0])
    assert kept.filter("NOT held").count() > 20_000  # distinct ones
    assert kept.agg(F.sum("n")).first()[0] == many.count()
