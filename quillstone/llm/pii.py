"""Personal data by candidate gradient boosting, in DataFrame functions and Spark ML.

High-recall generators, each a pattern, propose spans that may overlap: the four base patterns, and wider ones (numbers
inside longer runs, obfuscated addresses, telephone numbers without a plus). Gradient-boosted trees judge the proposals
by their format and the characters around them. They learn from the corpus itself: what a base pattern finds and its
check passes is personal data, what overlaps none of that isn't, unless a checksum or range speaks for it, which leaves
it unlabelled. Thresholds are calibrated for each kind on proposals held out from training: the lowest score from which
on the labelled ones are of the wanted precision. Base spans stay whatever their score; of other proposals that reach the
threshold, that with the highest score in each run of overlapping ones is added, if no base span touches it.

No text leaves its partition: proposals are short rows of their own, places are sums of lengths before them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import no_null, work_path

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: kind, whether base, pattern, and what a text must hold for it. Repetitions are possessive and begin where their run of
#: characters does (or the match before ended), so that a long run is read once; matches are those of the plain pattern.
#: Of base card runs, only those of 14 to 19 digits are taken, as others fail anyway.
GENERATORS = (
    ("email", True, rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@"),
    ("ip", True, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", r"[0-9]\.[0-9]"),
    ("card", True, r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", "[0-9][0-9 -]{12}"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    ("email", False, rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:@| ?[\[(](?:at|AT)[\])] ?| at ){_LABEL}{{1,63}}+(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?| dot ){_LABEL}{{1,63}}+){{1,8}}+", r"@|[\[(](?:at|AT)[\])]| at "),
    ("ip", False, r"(?<![0-9])[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}+){3}+(?![0-9])", r"[0-9][\[(]?\."),
    ("card", False, r"(?<![0-9])[0-9]{14,19}+(?![0-9])", "[0-9]{14}"),
    ("card", False, r"(?<![0-9])[0-9]{4}(?:[ .-][0-9]{4}){2}(?:[ .-][0-9]{2,4}){1,2}+(?![0-9])", "[0-9]{4}[ .-][0-9]{4}"),
    ("phone", False, r"(?<![0-9+])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])", "[0-9][ .-][0-9]{3}"),
)
#: Characters of context on each side, and words in it that speak for a kind.
AROUND = 40
SPEAKS = {"email": "mail|contact|kontakt|correo|courriel", "ip": r"\bip\b|server|host|addr|adress", "card": "card|visa|master|karte|tarjeta|carte|pay", "phone": "tel|phone|call|fax|mobil|ruf|llam|appel"}
#: Precision that thresholds keep.
PRECISION = 0.95


def luhn(digits: Column) -> Column:
    """Whether the digits pass the checksum: every other one from the right but one doubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: Column, found: Column) -> Column:
    """Whether a match of a kind's base pattern passes its check."""
    digits = F.regexp_replace(found, "[^0-9]+", "")
    part, plain = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})", F.regexp_replace(F.regexp_replace(found, r"[^0-9]+", "."), r"(?<![0-9])0+(?=[0-9])", "")
    inside = plain.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    return F.when(kind == "ip", inside).when(kind == "card", F.length(digits).between(14, 19) & luhn(digits)).when(kind == "phone", F.length(digits).between(10, 15)).otherwise(True)


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, and each row's proposals as an array of (g, i, found, gap, left, right): generator, number, match, characters since the match before, context."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), no_null(text_col).alias("text"))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"m{g}": F.when(F.col("text").rlike(quick), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for g, (_, _, p, quick) in enumerate(GENERATORS)})
    rows = rows.withColumns({f"s{g}": F.when(F.size(f"m{g}") > 0, F.split("text", p, -1)).otherwise(none) for g, (_, _, p, _) in enumerate(GENERATORS)})

    def of(g: int) -> Column:
        gaps = F.col(f"s{g}")
        return F.transform(f"m{g}", lambda m, i: F.struct(
            F.lit(g).alias("g"), i.alias("i"), m.alias("found"), F.length(gaps[i]).cast("long").alias("gap"), F.substring(gaps[i], -AROUND, AROUND).alias("left"), F.substring(gaps[i + 1], 1, AROUND).alias("right")))

    return rows.select("row", "doc_id", F.concat(*map(of, range(len(GENERATORS)))).alias("proposed"))


def placed(found: DataFrame) -> DataFrame:
    """A row for each span that some generator proposes: row, kind, start, end (code points), found, left, right, base (passes as a base match), touched (overlaps one that does)."""
    each = found.select("row", F.explode("proposed").alias("p")).select("row", "p.*")
    length = F.length("found").cast("long")
    before = Window.partitionBy("row", "g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + length).over(before)).withColumn("start", F.col("end") - length)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("g") + 1)
    each = each.withColumns({"kind": of([k for k, *_ in GENERATORS]), "base": of([b for _, b, *_ in GENERATORS])})
    spans = each.groupBy("row", "kind", "start", "end").agg(F.min(F.struct("g", "found", "left", "right")).alias("x"), F.max("base").alias("base"))
    spans = spans.select("row", "kind", "start", "end", "x.found", "x.left", "x.right", (F.col("base") & passes(F.col("kind"), F.col("x.found"))).alias("base"))
    w = Window.partitionBy("row").orderBy("start")
    back, on = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    ends, starts = F.max(F.when(F.col("base"), F.col("end"))).over(back), F.min(F.when(F.col("base"), F.col("start"))).over(on)
    return spans.withColumn("touched", F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("end"), F.lit(False)))


def features() -> dict[str, Column]:
    """Format and context of a proposal as whole numbers."""
    c, around = F.col("found"), F.lower(F.concat("left", F.lit(" | "), "right"))
    n = lambda pattern, of=c: F.length(of) - F.length(F.regexp_replace(of, pattern, ""))
    yes = lambda b: b.cast("int")
    groups = F.filter(F.split(c, "[^0-9]+"), lambda x: x != "")
    edge = lambda x: F.when(x == "", 0).when(x.rlike(r"\A[ \n\t\r]"), 1).when(x.rlike(r"\A[0-9]"), 2).when(x.rlike(r"\A\p{L}"), 3).otherwise(4)
    return {f"is_{k}": yes(F.col("kind") == k) for k in KINDS} | {
        "chars": F.least(F.length(c), F.lit(99)), "digits": F.least(n("[0-9]"), F.lit(40)), "letters": F.least(n("[A-Za-z]"), F.lit(40)), "blanks": n(" "), "dots": n(r"\."), "dashes": n("-"), "brackets": n(r"[()\[\]]"), "ats": n("@"),
        "plus": yes(c.startswith("+")), "groups": F.least(F.size(groups), F.lit(20)), "longest": F.least(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), F.lit(40)),
        "passes": yes(F.coalesce(passes(F.col("kind"), c), F.lit(False))), "domain": yes(c.rlike(r"\.[A-Za-z]{2,24}\z")),
        "before": edge(F.substring("left", -1, 1)), "after": edge(F.substring("right", 1, 1)), "digits_around": n("[0-9]", around),
        "speaks": yes(reduce(lambda a, b: a | b, [(F.col("kind") == k) & around.rlike(p) for k, p in SPEAKS.items()])),
    }


def labelled(spans: DataFrame) -> DataFrame:
    """Spans with features; label 1 for base spans, 0 for what touches none, null for what touches one or passes a checksum or range."""
    names = features()
    spans = spans.withColumns(names)
    vouched = (F.col("passes") == 1) & F.col("kind").isin("card", "ip")
    return spans.withColumn("label", F.when(F.col("base"), 1).when(~F.col("touched") & ~vouched, 0))


class Judge:
    """Boosted trees with a threshold for each kind; without labels of both values in each of two folds, nothing is judged."""

    def __init__(self, spans: DataFrame, precision: float = PRECISION, trees: int = 12, depth: int = 4, seed: int = 7):
        names = list(features())
        self.assembler = VectorAssembler(inputCols=names, outputCol="features")
        fold = F.pmod(F.xxhash64("found"), F.lit(4)) == 0  # by content, so that copies are on one side
        known = spans.filter("label IS NOT NULL").groupBy("kind", "label", fold.alias("held"), *names).agg(F.count(F.lit(1)).alias("n"))
        path = work_path(spans.sparkSession, "labelled")
        known.sortWithinPartitions("kind", "label", *names).write.parquet(path)  # all of them, equal ones as one row of weight n
        known = spans.sparkSession.read.schema(known.schema).parquet(path)
        kinds = {(r.held, r.label) for r in known.select("held", "label").distinct().collect()}  # four rows at most
        self.model, self.least = None, {}
        if len(kinds) < 4:
            return
        trained = self.assembler.transform(known.filter("NOT held").withColumn("label", F.col("label").cast("double")))
        self.model = GBTClassifier(weightCol="n", maxIter=trees, maxDepth=depth, seed=seed).fit(trained)
        by_score = self.scored(known.filter("held")).groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("good"))
        w = Window.partitionBy("kind").orderBy(F.desc("score"))
        kept = by_score.withColumn("right", F.sum("good").over(w) / F.sum("n").over(w)).filter((F.col("right") >= precision) & (F.col("good") > 0))
        self.least = {r.kind: r.least for r in kept.groupBy("kind").agg(F.min("score").alias("least")).collect()}  # four rows at most

    def scored(self, spans: DataFrame) -> DataFrame:
        """Adds score: the trees' probability that a span is personal data."""
        return self.model.transform(self.assembler.transform(spans)).withColumn("score", F.round(vector_to_array("probability")[1], 6)).drop("features", "rawPrediction", "probability", "prediction")

    def added(self, spans: DataFrame) -> DataFrame:
        """row, kind, start, end of spans besides the base ones: the best of each run of overlapping ones that reach their thresholds."""
        if not self.least:
            return spans.filter("false").select("row", "kind", "start", "end")
        reaches = reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.col("score") >= s) for k, s in sorted(self.least.items())])
        good = self.scored(spans.filter("NOT touched AND NOT base")).filter(reaches)
        w = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
        begins = F.coalesce(F.col("start") >= F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
        runs = good.withColumn("begins", begins.cast("long")).withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        best = F.max(F.struct("score", (F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("first"), "kind", "start", "end"))
        return runs.groupBy("row", "run").agg(best.alias("x")).select("row", "x.kind", "x.start", "x.end")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans: arrays of (start, nth, kind, end) by start, then kind.

    Places are code points, the end exclusive. A null text is empty and has no spans. Each row is judged by its own text:
    null and repeated ids, and rows that repeat, come back as they are, and equal texts have equal spans, of whatever
    place in the table. Proposals that tie in score go to the longer one, then to the first. Texts are read whole, however
    long. All labelled proposals train or calibrate, and all proposals are judged. Where there is too little to
    learn from, spans are the base ones; an empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    path, table = work_path(spark, "proposals"), work_path(spark, "spans")
    rows = proposals(docs, id_col, text_col)
    rows.write.parquet(path)  # row numbers are written once, so that what reads them agrees
    found = spark.read.schema(rows.schema).parquet(path)
    spans = labelled(placed(found))
    spans.write.parquet(table)
    spans = spark.read.schema(spans.schema).parquet(table)
    judge = Judge(spans, precision)
    base = spans.filter("base").select("row", "kind", "start", "end", F.lit(True).alias("base"))
    both = base.unionByName(judge.added(spans).withColumn("base", F.lit(False)))
    nth = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F.when(F.lit(False), -1))
    one = F.struct("start", nth.alias("nth"), "kind", "end")
    sums = both.groupBy("row").agg(
        *(F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS),
        F.array_sort(F.collect_list(F.when(F.col("base"), one))).alias("base"), F.array_sort(F.collect_list(one)).alias("spans"),
    )
    none = F.array().cast(sums.schema["spans"].dataType)
    return found.select("row", "doc_id").join(sums, "row", "left").select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS), F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def spans_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
