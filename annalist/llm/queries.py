"""Queries of the operators that prepare text for language models (p4, p6, p7, p8, p9), with their SQL."""

from __future__ import annotations

import secrets
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import boilerplate, chunking, leakage, mixing, pii
from annalist.sources.shared import table



@lru_cache(maxsize=1)
def _random_key() -> bytes:
    return secrets.token_bytes(32)


def key_of(spark: SparkSession) -> bytes:
    """The secret in the setting spark.annalist.key; without one, a random key, whose pseudonyms link within this session only."""
    given = spark.conf.get("spark.annalist.key", None)
    return given.encode()[:64] if given else _random_key()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_texts(table(spark, d, "chunks"), "text", ["chunk_id"], only_oversized=True).select("chunk_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all chunks, each with its chunk's heading and paragraph."""
    keep = ["chunk_id", "document_id", "heading_path", "paragraph_ref"]
    return chunking.split_texts(table(spark, d, "chunks").select(*keep, "text").dropDuplicates(), "text", keep)


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each text its tokens, whether its pieces cover it in order within the limit, and whether all but the first share the overlap with the one before."""
    rows = table(spark, d, "chunks").filter("chunk_id is not null").select("chunk_id", "text").dropDuplicates().withColumn("h", F.sha2("text", 256))
    pieces = chunking.split_texts(rows, "text", ["chunk_id", "h"])
    own, first = F.col("token_count") - F.col("overlap_tokens"), F.col("piece_no") == 0
    return pieces.groupBy("chunk_id", "h").agg(
        F.sum(own).alias("n_tokens"), F.every(F.col("token_count") <= chunking.LIMIT).alias("within_limit"),
        F.every(F.col("overlap_tokens") == F.when(first, 0).otherwise(chunking.OVERLAP)).alias("overlaps"), (F.max("piece_no") + 1 == F.count(F.lit(1))).alias("numbered"),
    )


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_versions").select("version_id", F.col("source_id").alias("source"), F.col("canonical_url").alias("page"), F.col("text_snapshot").alias("text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d)
    return boilerplate.repeated_places(v, boilerplate.repeated_lines(v), ["version_id"]).distinct()


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every text without its source's repeated lines."""
    v = _versions(spark, d)
    return boilerplate.without_repeated(v, boilerplate.repeated_lines(v)).select("version_id", "clean_text", "n_removed").distinct()


def p6_lines(spark: SparkSession, d: str) -> DataFrame:
    """The repeated lines of each source with the number of pages they stand on."""
    return boilerplate.repeated_lines(_versions(spark, d)).select(F.col("source").alias("source_id"), "line", "n_pages")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), ["question", "passage"])


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation item in how many documents it leaked."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc_id"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per wanted source whether it is reported, no text is used too often, and the share is reached where it can be (within one text)."""
    mixed, plan = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most"), F.max("n_tokens").alias("longest"), F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))
    r = plan.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    full = F.when(F.col("reachable"), F.col("tokens").between(F.col("target_tokens"), F.col("target_tokens") + F.col("longest"))).otherwise(F.col("tokens") == F.col("supply_tokens") * F.col("max_repeats"))
    return r.select("source", "target_share", "max_repeats", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), (F.coalesce("n", F.lit(0)) == F.coalesce("n_docs", F.lit(0))).alias("each_once"), full.alias("as_planned"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(table(spark, d, "documents"), key_of(spark)).drop("placeholder")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), key_of(spark))


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    return pii.pii_counts(p9_found(spark, d))


QUERIES = {f.__name__: f for f in (p4_found, p4_pieces, p4_checks, p6_found, p6_clean, p6_lines, p7_found, p7_items, p8_mix, p8_shares, p8_checks, p9_found, p9_redacted, p9_counts)}

_P6 = r"""
WITH v AS (SELECT DISTINCT version_id, source_id, canonical_url, text_snapshot FROM doc_versions),
p AS (SELECT source_id, greatest(5, ceil(count(DISTINCT canonical_url) * 0.2)) AS least FROM v WHERE source_id IS NOT NULL AND canonical_url IS NOT NULL GROUP BY 1),
s AS (SELECT version_id, source_id, canonical_url, string_split(text_snapshot, chr(10)) AS ls FROM v WHERE text_snapshot IS NOT NULL),
u AS (SELECT version_id, source_id, canonical_url, unnest(ls) AS raw, unnest(range(len(ls))) AS line_no FROM s),
l AS (SELECT *, trim(regexp_replace(lower(raw), '[^a-z]+', ' ', 'g')) AS line FROM u),
r AS (SELECT source_id, line, count(DISTINCT canonical_url) AS n_pages FROM l JOIN p USING (source_id) WHERE length(line) >= 12 GROUP BY source_id, line, least HAVING count(DISTINCT canonical_url) >= least)
"""

SQL = {
    "p4_found": r"SELECT DISTINCT chunk_id FROM chunks WHERE len(list_filter(regexp_split_to_array(text, '[ \t\n\r\x{00A0}]+'), lambda x: x <> '')) > 320",
    "p4_checks": r"""SELECT chunk_id, sha256(text) AS h, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\x{00A0}]+'), lambda x: x <> '')) AS n_tokens, true AS within_limit, true AS overlaps, true AS numbered
      FROM (SELECT DISTINCT chunk_id, text FROM chunks) WHERE chunk_id IS NOT NULL AND regexp_matches(text, '[^ \t\n\r\x{00A0}]')""",
    "p8_checks": "SELECT source, max(target_share) AS target_share, coalesce(max(max_repeats), 1) AS max_repeats, true AS within_cap, true AS each_once, true AS as_planned FROM mix_targets WHERE source IS NOT NULL AND target_share IS NOT NULL GROUP BY 1",
    "p6_found": _P6 + "SELECT DISTINCT version_id, CAST(line_no AS INT) AS line_no FROM l JOIN r USING (source_id, line)",
    "p6_lines": _P6 + "SELECT source_id, line, n_pages FROM r",
    "p6_clean": _P6 + """
      , m AS (SELECT l.version_id, l.source_id, l.raw, l.line_no, r.line IS NOT NULL AS gone FROM l LEFT JOIN r ON r.source_id = l.source_id AND r.line = l.line),
      c AS (SELECT version_id, source_id, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS clean_text, count(*) FILTER (gone) AS n_removed FROM m GROUP BY 1, 2)
      SELECT v.version_id, clean_text, CAST(coalesce(n_removed, 0) AS INT) AS n_removed FROM v LEFT JOIN c ON c.version_id = v.version_id AND c.source_id IS NOT DISTINCT FROM v.source_id""",
}
