"""Queries on snapshots, references, histories and attributes in time (p1, p2, p3, p5), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators.asof import asof_answers
from annalist.operators.history import History, leaves_for, observations
from annalist.operators.orphans import orphan_references, orphan_report, plain_id, references
from annalist.operators.skew import hot_keys
from annalist.operators.snapshots import snapshot_changes, with_old_values
from annalist.sources.shared import scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    c = snapshot_changes(table(spark, d, "page_snapshots"))
    return c.select("url_key", F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "yyyy-MM-dd").alias("snapshot_on"), "change_kind")


def p1_changes_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Per source and snapshot the number of each kind of change; of changed pages, how many have another title."""
    s = table(spark, d, "page_snapshots")
    c = snapshot_changes(s)
    titles = with_old_values(c, s, ["title"]).filter(~F.col("new_title").eqNullSafe(F.col("old_title"))).groupBy("source_id", "day").agg(F.count(F.lit(1)).alias("n_retitled"))
    kinds = c.groupBy("source_id", "day").agg(*[F.count_if(F.col("change_kind") == k).alias(f"n_{k}") for k in ("added", "removed", "changed")])
    out = kinds.join(titles, ["source_id", "day"], "left")
    return out.select("source_id", F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "yyyy-MM-dd").alias("snapshot_on"), "n_added", "n_removed", "n_changed", F.coalesce("n_retitled", F.lit(0)).alias("n_retitled"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    links, chunks, register, removed = (table(spark, d, t) for t in ("doc_links", "chunks", "reg_documents", "removed_documents"))
    doc, chunk = F.lit("document").alias("parent_table"), F.lit("chunk").alias("parent_table")
    children = references(links, "doc_links", "link_id", "created_at", {"old_document_id": "document", "new_document_id": "document"}).unionByName(
        references(chunks, "chunks", "chunk_id", "valid_from", {"document_id": "document", "parent_id": "chunk"})
    )
    parents = register.select(doc, plain_id(F.col("document_id")).alias("ref_key"), F.col("ingested_at").alias("known_at")).unionByName(
        chunks.select(chunk, plain_id(F.col("chunk_id")).alias("ref_key"), F.col("valid_from").alias("known_at"))
    )
    removals = removed.select(doc, plain_id(F.col("document_id")).alias("ref_key"), "removed_at")
    return orphan_references(children, parents.dropna(subset=["ref_key"]), removals.dropna(subset=["ref_key"]), 2 * (links.count() + chunks.count()))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p2_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


#: Snapshots of the log that the history is built from, at equal shares of its entries.
SNAPSHOTS = 10


def _history(spark: SparkSession, d: str) -> History:
    """The log as it was known at ten moments, the last of which is its end."""
    log = table(spark, d, "doc_versions")
    state = F.upper(F.trim("lifecycle"))
    facts = log.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("canonical_url").alias("keys"), F.percentile_approx("recorded_at", [i / SNAPSHOTS for i in range(1, SNAPSHOTS)]).alias("at")).first()
    at = sorted(set(facts["at"] or []))
    place = sum((F.when(F.coalesce(F.col("recorded_at") > t, F.lit(True)), 1).otherwise(0) for t in at), F.lit(0))
    path = scratch(spark, "log")
    log.select("canonical_url", "valid_from", "recorded_at", "lifecycle", "normalized_text_hash", place.alias("part")).write.partitionBy("part").parquet(path)
    slim, h = spark.read.parquet(path), History(spark, leaves_for(facts["keys"]))
    hot = hot_keys(slim.select(F.col("canonical_url").alias("key")), ["key"], facts["n"])
    for n in range(len(at) + 1):
        h.apply(observations(slim.filter(F.col("part") <= n), "canonical_url", state, "normalized_text_hash"), hot)
    return h


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    seconds = lambda c: F.unix_seconds(F.col(c))
    return _history(spark, d).table().select(F.col("key").alias("canonical_url"), seconds("valid_from").alias("valid_from_s"), F.coalesce(seconds("valid_to"), F.lit(-1)).alias("valid_to_s"), F.col("state").alias("lifecycle"))


def p3_states_by_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Per lifecycle how many states there are, how many are open, and for how many whole days the others held in all."""
    t = _history(spark, d).table()
    days = F.floor((F.unix_seconds("valid_to") - F.unix_seconds("valid_from")) / 86400)
    return t.groupBy(F.col("state").alias("lifecycle")).agg(F.count(F.lit(1)).alias("n_states"), F.count_if(F.col("valid_to").isNull()).alias("n_open"), F.coalesce(F.sum(days), F.lit(0)).alias("days_held"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    asked, chunks = table(spark, d, "query_requests"), table(spark, d, "chunks")
    day = lambda c: F.datediff(c, F.lit("1970-01-01"))
    entity = [F.col("source_url").alias("entity_a"), F.col("paragraph_ref").alias("entity_b")]
    requests = asked.select(*entity, "request_id", F.unix_micros("asked_at").alias("asked"), day(F.coalesce("as_of", F.to_date("asked_at"))).alias("day"))
    versions = chunks.select(*entity, F.col("chunk_id").alias("version_id"), F.col("document_version").alias("rank"), F.unix_micros("valid_from").alias("known_from"), F.unix_micros("valid_to").alias("known_to"), day("in_force_from").alias("holds_from"), day("in_force_to").alias("holds_to"))
    return asof_answers(requests, versions, asked.count(), chunks.count()).select("request_id", F.col("version_id").alias("chunk_id"))


QUERIES = {f.__name__: f for f in (p1_found, p1_changes_by_source, p2_found, p2_orphans_by_month, p3_found, p3_states_by_lifecycle, p5_found)}

_KEY = r"""CASE WHEN q = '' THEN base ELSE base || '?' || q END AS url_key"""
_P1 = r"""
WITH u AS (
  SELECT *, regexp_replace(regexp_replace(canonical_url, '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS bare FROM page_snapshots
  WHERE canonical_url IS NOT NULL AND source_id IS NOT NULL AND snapshot_date IS NOT NULL
), b AS (
  SELECT *, regexp_replace(regexp_replace(lower(split_part(bare, '?', 1)), '^www\.', ''), '/+$', '') AS base,
    array_to_string(list_transform(list_sort(list_transform(
      list_filter(string_split(CASE WHEN contains(bare, '?') THEN substr(bare, instr(bare, '?') + 1) ELSE '' END, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_')),
      lambda p: {'n': split_part(p, '=', 1), 'p': p})), lambda s: s.p), '&') AS q
  FROM u
), k AS (
  SELECT source_id, snapshot_date AS d, """ + _KEY + r""", title, normalized_text_hash AS h, metadata_hash AS m, delivered_at AS t FROM b
), r AS (
  SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY source_id, url_key, d ORDER BY t DESC NULLS LAST, h DESC NULLS LAST, m DESC NULLS LAST) = 1
), f AS (
  SELECT source_id, url_key, d, title, m, last_value(h IGNORE NULLS) OVER (PARTITION BY source_id, url_key ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM r
), dl AS (
  SELECT source_id, d, lag(d) OVER w AS pd, lead(d) OVER w AS nd FROM (SELECT DISTINCT source_id, d FROM k) WINDOW w AS (PARTITION BY source_id ORDER BY d)
), l AS (
  SELECT f.*, dl.pd, dl.nd, lag(f.d) OVER w AS od, lag(h) OVER w AS oh, lag(m) OVER w AS om, lag(title) OVER w AS ot, lead(f.d) OVER w AS fd
  FROM f JOIN dl USING (source_id, d) WINDOW w AS (PARTITION BY source_id, url_key ORDER BY f.d)
), c AS (
  SELECT source_id, url_key, d, 'added' AS change_kind, false AS retitled FROM l WHERE pd IS NOT NULL AND od IS DISTINCT FROM pd
  UNION ALL SELECT source_id, url_key, d, 'changed', title IS DISTINCT FROM ot FROM l WHERE od = pd AND (h IS DISTINCT FROM oh OR m IS DISTINCT FROM om)
  UNION ALL SELECT source_id, url_key, nd, 'removed', false FROM l WHERE nd IS NOT NULL AND fd IS DISTINCT FROM nd
)
"""

_P2 = r"""
WITH docs AS (
  SELECT lower(trim(document_id)) AS k, min(ingested_at) AS first_at, max(ingested_at) AS last_at FROM reg_documents WHERE document_id IS NOT NULL GROUP BY 1
), gone AS (
  SELECT lower(trim(document_id)) AS k, max(removed_at) AS removed_at FROM removed_documents WHERE document_id IS NOT NULL GROUP BY 1
), parts AS (
  SELECT lower(trim(chunk_id)) AS k, min(valid_from) AS first_at FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1
), refs AS (
  SELECT 'doc_links' AS from_table, link_id AS row_key, 'old_document_id' AS ref_field, lower(trim(old_document_id)) AS ref_key, created_at AS t FROM doc_links
  UNION ALL SELECT 'doc_links', link_id, 'new_document_id', lower(trim(new_document_id)), created_at FROM doc_links
  UNION ALL SELECT 'chunks', chunk_id, 'document_id', lower(trim(document_id)), valid_from FROM chunks
  UNION ALL SELECT 'chunks', chunk_id, 'parent_id', lower(trim(parent_id)), valid_from FROM chunks
), judged AS (
  SELECT r.*, CASE WHEN ref_field = 'parent_id' THEN CASE WHEN p.k IS NULL THEN 'missing' WHEN p.first_at > t THEN 'late' END
    ELSE CASE WHEN g.k IS NOT NULL AND NOT coalesce(x.last_at > g.removed_at, false) THEN 'deleted' WHEN x.k IS NULL THEN 'missing' WHEN x.first_at > t THEN 'late' END END AS orphan_kind
  FROM refs r LEFT JOIN docs x ON x.k = ref_key LEFT JOIN gone g ON g.k = ref_key LEFT JOIN parts p ON p.k = ref_key WHERE ref_key IS NOT NULL
), found AS (
  SELECT DISTINCT from_table, row_key, ref_field, ref_key, orphan_kind, coalesce(strftime(t, '%Y-%m'), 'unknown') AS ref_month FROM judged WHERE orphan_kind IS NOT NULL
)
"""

_P3 = r"""
WITH o AS (
  SELECT canonical_url, valid_from, upper(trim(lifecycle)) AS lc, normalized_text_hash AS h FROM doc_versions WHERE canonical_url IS NOT NULL AND valid_from IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY canonical_url, valid_from ORDER BY recorded_at DESC NULLS LAST, lc DESC NULLS LAST, h DESC NULLS LAST) = 1
), f AS (
  SELECT canonical_url, valid_from, h, last_value(lc IGNORE NULLS) OVER (PARTITION BY canonical_url ORDER BY valid_from ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lc FROM o
), g AS (
  SELECT *, row_number() OVER w AS n, lag(lc) OVER w AS plc, lag(h) OVER w AS ph FROM f WINDOW w AS (PARTITION BY canonical_url ORDER BY valid_from)
), s AS (
  SELECT canonical_url, valid_from, lead(valid_from) OVER (PARTITION BY canonical_url ORDER BY valid_from) AS valid_to, lc AS lifecycle FROM g WHERE n = 1 OR lc IS DISTINCT FROM plc OR h IS DISTINCT FROM ph
)
"""

SQL = {
    "p1_found": _P1 + "SELECT url_key, strftime(d, '%Y-%m-%d') AS snapshot_on, change_kind FROM c",
    "p1_changes_by_source": _P1 + """SELECT source_id, strftime(d, '%Y-%m-%d') AS snapshot_on, count(*) FILTER (change_kind = 'added') AS n_added, count(*) FILTER (change_kind = 'removed') AS n_removed,
      count(*) FILTER (change_kind = 'changed') AS n_changed, count(*) FILTER (retitled) AS n_retitled FROM c GROUP BY ALL""",
    "p2_found": _P2 + "SELECT * FROM found",
    "p2_orphans_by_month": _P2 + "SELECT from_table, ref_field, orphan_kind, ref_month, count(*) AS n_refs FROM found GROUP BY ALL",
    "p3_found": _P3 + "SELECT canonical_url, CAST(floor(epoch(valid_from)) AS BIGINT) AS valid_from_s, coalesce(CAST(floor(epoch(valid_to)) AS BIGINT), -1) AS valid_to_s, lifecycle FROM s",
    "p3_states_by_lifecycle": _P3 + """SELECT lifecycle, count(*) AS n_states, count(*) FILTER (valid_to IS NULL) AS n_open,
      CAST(coalesce(sum(floor((floor(epoch(valid_to)) - floor(epoch(valid_from))) / 86400)), 0) AS BIGINT) AS days_held FROM s GROUP BY 1""",
    "p5_found": r"""
      WITH r AS (SELECT DISTINCT request_id, asked_at, coalesce(as_of, CAST(asked_at AS DATE)) AS day, source_url, paragraph_ref FROM query_requests)
      SELECT request_id, chunk_id FROM r JOIN (SELECT DISTINCT chunk_id, document_version, valid_from, valid_to, in_force_from, in_force_to, source_url, paragraph_ref FROM chunks WHERE chunk_id IS NOT NULL) c USING (source_url, paragraph_ref)
      WHERE (valid_from IS NULL OR valid_from <= asked_at) AND (valid_to IS NULL OR valid_to > asked_at)
        AND (in_force_from IS NULL OR in_force_from <= day) AND (in_force_to IS NULL OR in_force_to > day)
      QUALIFY row_number() OVER (PARTITION BY request_id, asked_at, day, source_url, paragraph_ref ORDER BY valid_from DESC NULLS LAST, document_version DESC NULLS LAST, chunk_id) = 1""",
}
