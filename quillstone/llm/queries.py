"""Queries of this package for the driver, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .brown import score_documents
from .common import work_path
from .exact_dedup import content_sort_dedup
from .infill import fill_in_middle, restored
from .jaccard import jaccard_components
from .language_id import identify
from .media import media_columns
from .mixing import mix
from .pii import find_personal_data, spans_text
from .pieces import encode, ids_digest
from .suffixes import remove_repeats
from .warc import read_warc, write_warc
from .wrappers import extract


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return read_warc(spark, root)


def op3_brown_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), merges=True).withColumn("ids_sha256", ids_digest()).drop("ids")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "n_mutual", "count_sum", "groups_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


QUERIES = {"op1_jaccard_join": op1_jaccard_join, "op2_warc": op2_warc, "op3_brown_scoring": op3_brown_scoring, "op4_language_id": op4_language_id, "op5_suffix_dedup": op5_suffix_dedup, "op6_pieces": op6_pieces, "op7_media_columns": op7_media_columns, "op8_exact_dedup": op8_exact_dedup, "op9_html_extraction": op9_html_extraction, "op10_mixing": op10_mixing, "op11_cross_tokenizer": op11_cross_tokenizer, "op12_fill_in_middle": op12_fill_in_middle, "op13_personal_data": op13_personal_data}

ORACLE_SQL = {
    "op2_warc": r"""
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) < 100 OR page_id = min(page_id) OVER d THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER d THEN min(page_id) OVER d END AS refers_to
FROM pages WINDOW d AS (PARTITION BY coalesce(html, ''))
""",
    "op8_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
""",
    "op12_fill_in_middle": r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us, sha256(concat('42:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
k AS (SELECT *, CAST(len(us) AS BIGINT) AS n, CAST(concat('0x', h[1:8]) AS BIGINT) AS h1, CAST(concat('0x', h[9:16]) AS BIGINT) AS h2, CAST(concat('0x', h[17:24]) AS BIGINT) AS h3, CAST(concat('0x', h[25:32]) AS BIGINT) AS h4 FROM u),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a + 1:b], '') AS middle, array_to_string(us[b + 1:n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
""",
}
