"""Fill-in-middle transformation by escaped marker injection, in DataFrame functions only.

The text's own delimiters are escaped, so that regexp_replace can append a delimiter to each unit (a word with the white
space before it, or the white space at the end). The delimiters are counted, substring_index cuts between them by rank,
and the three parts are freed of delimiters, unescaped and assembled. The cuts and the form follow a hash of the seed
and the document's id, so that reruns agree whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, no_null

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Possessive, as neither alternative can succeed by giving back what it took.
UNIT = rf"{SPACE}*+{WORD}+|{SPACE}++"
#: Delimiter, and the character that escapes both; neither is white space, so units of escaped texts are the text's.
CUT, ESCAPE = "\x01", "\x02"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(CUT), F.lit(ESCAPE + "c"))


def _unescaped(part: Column) -> Column:
    plain = F.replace(part, F.lit(CUT), F.lit(""))
    return F.replace(F.replace(plain, F.lit(ESCAPE + "c"), F.lit(CUT)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle() made an output of. No marker is in a text that it rearranges, so the first of each is its own."""
    body = F.substring(output, 4, 2_147_483_647)
    between = lambda first, second: (F.substring_index(body, first, 1), F.substring_index(F.substring_index(body, first, -1), second, 1), F.substring_index(body, second, -1))
    p, s, m = between(SUFFIX, MIDDLE)
    s2, p2, m2 = between(PREFIX, MIDDLE)
    return F.when(form == "plain", output).when(form == "psm", F.concat(p, m, s)).otherwise(F.concat(p2, m2, s2))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    ``rate`` of 100 texts are rearranged, of these ``spm`` of 100 with the suffix first. A null text is empty; an empty
    text, and one that holds a marker, stays plain. A null id hashes as the seed alone; rows that repeat, or share an
    id, get the same cuts for the same text. Texts are taken whole, however long; no row leaves its partition, and an
    empty table gives an empty one. Other columns of ``docs``, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), no_null(text_col).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    # Steps are columns of their own, so that each is computed once.
    rows = rows.withColumn("digest", digest).withColumns({f"h{i}": F.conv(F.substring("digest", 8 * i - 7, 8), 16, 10).cast("long") for i in (1, 2, 3, 4)})
    rows = rows.withColumn("marked", F.regexp_replace(_escaped(F.col("text")), UNIT, F.lit("$0" + CUT)))
    rows = rows.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(CUT), F.lit("")))).cast("long"))
    rows = rows.withColumns({"x": F.expr("h1 % (n + 1)"), "y": F.expr("h2 % (n + 1)")}).withColumns({"a": F.least("x", "y").cast("int"), "b": F.greatest("x", "y").cast("int")})
    kept = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE) | (F.col("h3") % 100 >= rate)
    rows = rows.withColumn("form", F.when(kept, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm"))
    moved, cut = F.col("form") != "plain", f"'{CUT}'"
    middle = F.expr(f"CASE WHEN b > a THEN substring_index(substring_index(marked, {cut}, b), {cut}, a - b) ELSE '' END")
    parts = {"prefix": F.expr(f"substring_index(marked, {cut}, a)"), "middle": middle, "suffix": F.expr(f"substring_index(marked, {cut}, CAST(b - n - 1 AS INT))")}
    rows = rows.withColumns({c: F.when(moved, _unescaped(p)) for c, p in parts.items()})
    psm, spm_ = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"), F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(~moved, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_)
    chars = lambda c: F.when(moved, F.length(c).cast("long")).alias(f"{c}_chars")
    return rows.select("doc_id", "n", "form", chars("prefix"), chars("middle"), output.alias("output"))
