"""Queries on rules, documents, links and versions: filters, joins, aggregates, windows and set operations, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import eligibility as E
from annalist.operators import metrics as M
from annalist.operators import versions as V
from annalist.sources.shared import table

TODAY, PAST = datetime.date(2024, 7, 1), datetime.date(2022, 6, 30)
DOMAIN = "norvale.example"
ENTITIES = ["bank", "lender", "credit union", "credit house", "dealer"]
TOPICS = ["microloan", "mortgage", "gold loan", "overdraft", "credit line", "working capital"]
# Words that a question within the scope has.
SCOPE = ["advance", "asset classification", "bank", "borrower", "co-lend", "colend", "collateral", "credit", "default", "digital lending", "emi", "interest", "kfs", "lend", "loan", "mortgage", "nbfc", "penal", "property document", "provision", "repayment", "settlement"]
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("$TODAY", f"DATE '{TODAY}'").replace("$PAST", f"DATE '{PAST}'").replace("$REG", REG).replace("$LOG", LOG).replace("$LINKS", LINKS)
        return f

    return add


REG = """(SELECT *, lower(trim(document_id)) AS id, upper(trim(lifecycle)) AS st FROM reg_documents
  QUALIFY row_number() OVER (PARTITION BY lower(trim(document_id)) ORDER BY ingested_at DESC NULLS LAST, content_hash NULLS FIRST, source_url NULLS FIRST, title NULLS FIRST) = 1)"""
LOG = "(SELECT DISTINCT version_id, source_id, canonical_url, title, document_identifier, normalized_text_hash AS h, text_snapshot AS txt, lifecycle, valid_from, recorded_at FROM doc_versions)"
LINKS = """(SELECT DISTINCT link_id, upper(trim(relation)) AS relation, upper(trim(scope)) AS scope, lower(trim(old_document_id)) AS old_id, lower(trim(new_document_id)) AS new_id,
  method, evidence_quote, upper(trim(trust)) AS trust, created_at FROM doc_links)"""


def register(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: the one ingested last."""
    r = table(spark, d, "reg_documents").withColumn("id", F.lower(F.trim("document_id"))).withColumn("st", E.status(F.col("lifecycle")))
    return E.latest_by(r, ["id"], F.col("ingested_at").desc_nulls_last(), F.col("content_hash").asc_nulls_first(), F.col("source_url").asc_nulls_first(), F.col("title").asc_nulls_first())


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_versions").select("version_id", "source_id", "canonical_url", "title", "document_identifier", F.col("normalized_text_hash").alias("h"), F.col("text_snapshot").alias("txt"), "lifecycle", "valid_from", "recorded_at").distinct()


def links(spark: SparkSession, d: str) -> DataFrame:
    up, low = (lambda c: F.upper(F.trim(c)).alias(c)), (lambda c, a: F.lower(F.trim(c)).alias(a))
    return table(spark, d, "doc_links").select("link_id", up("relation"), up("scope"), low("old_document_id", "old_id"), low("new_document_id", "new_id"), "method", "evidence_quote", up("trust"), "created_at").distinct()


_IN = "coalesce(in_force_from <= $D, true) AND coalesce($D < in_force_to, true)"
_OP = "coalesce(authority_current, false) AND coalesce(is_current, true)"


@query("SELECT DISTINCT chunk_id FROM chunks WHERE " + _IN.replace("$D", "$TODAY"))
def f1_in_force(spark, d):
    return table(spark, d, "chunks").filter(E.in_force_on(TODAY)).select("chunk_id").distinct()


@query(f"SELECT DISTINCT chunk_id FROM chunks WHERE {_OP} AND " + _IN.replace("$D", "$TODAY"))
def f2_current_guidance(spark, d):
    return table(spark, d, "chunks").filter(E.is_current_guidance(TODAY, TODAY)).select("chunk_id").distinct()


@query("SELECT DISTINCT chunk_id FROM chunks WHERE coalesce(upper(trim(lifecycle)), '') NOT IN ('REVIEW_REQUIRED', 'UNKNOWN') AND coalesce($PAST < CAST(valid_to AS DATE), true) AND " + _IN.replace("$D", "$PAST"))
def f2_past_guidance(spark, d):
    return table(spark, d, "chunks").filter(E.is_current_guidance(PAST, TODAY)).select("chunk_id").distinct()


@query(f"SELECT DISTINCT chunk_id FROM chunks WHERE {_OP} AND in_force_from > $PAST")
def f4_upcoming(spark, d):
    return table(spark, d, "chunks").filter(E.is_upcoming(PAST)).select("chunk_id").distinct()


@query("SELECT id FROM $REG WHERE st IN ('ACTIVE', 'AMENDED') AND " + _IN.replace("$D", "$TODAY"))
def f5_documents_in_force(spark, d):
    return register(spark, d).filter(E.document_in_force(TODAY)).select("id")


@query("""SELECT DISTINCT chunk_id, CASE WHEN coalesce(upper(trim(lifecycle)), 'UNKNOWN') IN ('REVIEW_REQUIRED', 'UNKNOWN') THEN 'unsettled' WHEN in_force_from > $TODAY THEN 'starts ' || in_force_from::VARCHAR
  WHEN in_force_to <= $TODAY THEN 'ended ' || in_force_to::VARCHAR WHEN NOT coalesce(is_current, true) THEN 'older version' ELSE lower(upper(trim(lifecycle))) END AS reason
  FROM chunks WHERE NOT (coalesce(authority_current, false) AND coalesce(is_current, true) AND coalesce(in_force_from <= $TODAY, true) AND coalesce($TODAY < in_force_to, true))""")
def f6_exclusion_reasons(spark, d):
    c = table(spark, d, "chunks")
    return c.filter(~E.is_current_guidance(TODAY, TODAY)).select("chunk_id", E.why_excluded(TODAY).alias("reason")).distinct()


@query("SELECT DISTINCT chunk_id FROM chunks WHERE lower(trim(document_id)) IN (SELECT id FROM $REG WHERE st = 'SUPERSEDED')")
def f7_document_subset(spark, d):
    old = register(spark, d).filter("st = 'SUPERSEDED'").select("id")
    return table(spark, d, "chunks").withColumn("id", F.lower(F.trim("document_id"))).join(old, "id", "left_semi").select("chunk_id").distinct()


@query("SELECT id, title, st FROM $REG WHERE st IN ('UNKNOWN', 'REVIEW_REQUIRED')")
def f8_review_queue(spark, d):
    return register(spark, d).filter(F.col("st").isin(*E.UNSETTLED)).select("id", "title", "st")


@query("SELECT DISTINCT link_id, relation, old_id, new_id FROM $LINKS WHERE trust = 'REVIEW_REQUIRED'")
def f9_pending_links(spark, d):
    return links(spark, d).filter("trust = 'REVIEW_REQUIRED'").select("link_id", "relation", "old_id", "new_id").distinct()


@query("SELECT DISTINCT version_id, title FROM doc_versions WHERE contains(lower(title), 'micro')")
def f10_updates_by_topic(spark, d):
    return table(spark, d, "doc_versions").filter(F.lower("title").contains("micro")).select("version_id", "title").distinct()


@query("SELECT len(list_filter(['" + "', '".join(SCOPE) + "'], lambda w: contains(lower(query), w))) > 0 AS in_scope, count(DISTINCT request_id) AS n FROM query_requests WHERE query IS NOT NULL GROUP BY 1")
def f12_scope_guard(spark, d):
    q = table(spark, d, "query_requests").filter("query is not null")
    return q.groupBy(F.lower("query").rlike("|".join(SCOPE)).alias("in_scope")).agg(F.count_distinct("request_id").alias("n"))


def _first(words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(title), '{w}') THEN '{w}'" for w in words) + " END"


@query(f"""WITH t AS (SELECT title, {_first(ENTITIES)} AS e, {_first(TOPICS)} AS p FROM $REG WHERE title IS NOT NULL)
  SELECT e IS NOT NULL AND p IS NOT NULL AS included, CASE WHEN e IS NULL THEN 'no regulated entity' WHEN p IS NULL THEN 'no topic' ELSE e || ' / ' || p END AS reason, count(*) AS n FROM t GROUP BY 1, 2""")
def f13_inclusion(spark, d):
    r = register(spark, d).filter("title is not null").select(E.included(F.col("title"), ENTITIES, TOPICS).alias("x"))
    return r.groupBy("x.included", "x.reason").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT issuing_authority, count(*) FILTER (h = 'norvale.example' OR ends_with(h, '.norvale.example')) AS n_owned, count(*) AS n
  FROM (SELECT issuing_authority, lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h FROM $REG) GROUP BY 1""")
def f15_owned_addresses(spark, d):
    return register(spark, d).groupBy("issuing_authority").agg(F.count_if(T.owned_by(F.col("source_url"), DOMAIN)).alias("n_owned"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT chunk_id FROM chunks WHERE regexp_matches(lower(substr(text, 1, 300)), 'means|shall mean|in these directions')")
def f16_definition_guard(spark, d):
    return table(spark, d, "chunks").filter(F.lower(F.substring("text", 1, 300)).rlike("means|shall mean|in these directions")).select("chunk_id").distinct()


@query("SELECT r.id, r.title, s.id AS successor_id, s.title AS successor_title, s.st AS successor_status, s.in_force_from AS starts FROM $REG r LEFT JOIN $REG s ON s.id = lower(trim(r.successor_document_id)) WHERE r.st IN ('SUPERSEDED', 'WITHDRAWN', 'REPEALED')")
def j2_successors(spark, d):
    r = register(spark, d)
    old = r.filter(F.col("st").isin(*V.NON_OPERATIVE)).select("id", "title", F.lower(F.trim("successor_document_id")).alias("sid"))
    new = r.select(F.col("id").alias("successor_id"), F.col("title").alias("successor_title"), F.col("st").alias("successor_status"), F.col("in_force_from").alias("starts"))
    return old.join(new, F.col("sid") == F.col("successor_id"), "left").drop("sid")


@query("SELECT lower(trim(successor_document_id)) AS id, min(id) AS predecessor_id, count(*) AS n FROM $REG WHERE successor_document_id IS NOT NULL GROUP BY 1")
def j3_predecessors(spark, d):
    return register(spark, d).filter("successor_document_id is not null").groupBy(F.lower(F.trim("successor_document_id")).alias("id")).agg(F.min(F.struct(F.col("id").alias("p"))).alias("m"), F.count(F.lit(1)).alias("n")).select("id", F.col("m.p").alias("predecessor_id"), "n")


@query("SELECT version_id, first_id FROM (SELECT version_id, min(version_id) OVER (PARTITION BY content_hash) AS first_id FROM (SELECT DISTINCT version_id, content_hash FROM doc_versions WHERE content_hash IS NOT NULL)) WHERE version_id <> first_id")
def j5_same_content(spark, d):
    """Versions whose content another version had, by the checksum."""
    v = table(spark, d, "doc_versions").filter("content_hash is not null").select("version_id", "content_hash").distinct()
    firsts = v.groupBy("content_hash").agg(F.min("version_id").alias("first_id"))
    return v.join(firsts, "content_hash").filter("version_id <> first_id").select("version_id", "first_id")


@query("""WITH u AS (SELECT source_url, max_by(st, id) AS st FROM $REG WHERE source_url IS NOT NULL AND st IS NOT NULL GROUP BY 1)
  SELECT version_id, coalesce(st, 'UNKNOWN') AS lifecycle FROM (SELECT DISTINCT version_id, canonical_url FROM $LOG) LEFT JOIN u ON source_url = canonical_url""")
def j6_updates_with_status(spark, d):
    by_url = register(spark, d).filter("source_url is not null and st is not null").groupBy(F.col("source_url").alias("canonical_url")).agg(F.max_by("st", "id").alias("st"))
    return log(spark, d).select("version_id", "canonical_url").distinct().join(by_url, "canonical_url", "left").select("version_id", F.coalesce("st", F.lit("UNKNOWN")).alias("lifecycle"))


@query("""SELECT DISTINCT a.id AS id, b.id AS other FROM (SELECT id, unnest(circular_numbers) AS n FROM $REG) a JOIN $REG b ON b.document_identifier = a.n WHERE a.id <> b.id""")
def j7_shared_numbers(spark, d):
    r = register(spark, d)
    a = r.select("id", F.explode("circular_numbers").alias("n"))
    b = r.filter("document_identifier is not null").select(F.col("id").alias("other"), F.col("document_identifier").alias("n"))
    return a.join(b, "n").filter("id <> other").select("id", "other").distinct()


@query("""WITH t AS (SELECT id, array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') AS k FROM $REG WHERE title IS NOT NULL)
  SELECT k AS title_key, count(*) AS n, min(id) AS first_id FROM t GROUP BY 1 HAVING count(*) > 1""")
def j8_equal_titles(spark, d):
    k = F.array_join(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), F.lit(0)), " ")
    return register(spark, d).filter("title is not null").groupBy(k.alias("title_key")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("n > 1")


@query("""WITH p AS (SELECT canonical_url, max(document_identifier) AS num FROM $LOG GROUP BY 1),
  n AS (SELECT document_identifier AS num, min(id) AS by_number FROM $REG WHERE document_identifier IS NOT NULL GROUP BY 1), u AS (SELECT source_url AS canonical_url, min(id) AS by_url FROM $REG WHERE source_url IS NOT NULL GROUP BY 1)
  SELECT p.canonical_url, coalesce(by_number, by_url) AS id, CASE WHEN by_number IS NOT NULL THEN 'number' WHEN by_url IS NOT NULL THEN 'address' ELSE 'none' END AS matched_by
  FROM p LEFT JOIN n ON n.num = p.num LEFT JOIN u ON u.canonical_url = p.canonical_url""")
def j9_by_number_then_address(spark, d):
    r = register(spark, d)
    pages = log(spark, d).groupBy("canonical_url").agg(F.max("document_identifier").alias("num"))
    number = r.filter("document_identifier is not null").groupBy(F.col("document_identifier").alias("num")).agg(F.min("id").alias("by_number"))
    address = r.filter("source_url is not null").groupBy(F.col("source_url").alias("canonical_url")).agg(F.min("id").alias("by_url"))
    kind = F.when(F.col("by_number").isNotNull(), "number").when(F.col("by_url").isNotNull(), "address").otherwise("none")
    return pages.join(number, "num", "left").join(address, "canonical_url", "left").select("canonical_url", F.coalesce("by_number", "by_url").alias("id"), kind.alias("matched_by"))


@query(r"""WITH t AS (SELECT id, publication_date, trim(regexp_replace(translate(regexp_replace(lower(title), '\([^)]*\)|\d{4}(-\d{2,4})?', ' ', 'g'), '–—-', '   '), '\s+', ' ', 'g')) AS stem FROM $REG WHERE title IS NOT NULL)
  SELECT id FROM (SELECT id, publication_date, max(publication_date) OVER (PARTITION BY stem) AS last FROM t) WHERE publication_date < last""")
def j16_reissued(spark, d):
    t = register(spark, d).filter("title is not null").select("id", "publication_date", T.title_stem(F.col("title")).alias("stem"))
    last = t.groupBy("stem").agg(F.max("publication_date").alias("last"))
    return t.join(last, "stem").filter("publication_date < last").select("id")


@query("""SELECT CASE WHEN r.id IS NULL THEN 'removed only' WHEN g.k IS NULL THEN 'register only' ELSE 'both' END AS found_in, count(*) AS n
  FROM (SELECT id FROM $REG) r FULL OUTER JOIN (SELECT DISTINCT lower(trim(document_id)) AS k FROM removed_documents WHERE document_id IS NOT NULL) g ON g.k = r.id GROUP BY 1""")
def j21_register_against_removed(spark, d):
    gone = table(spark, d, "removed_documents").filter("document_id is not null").select(F.lower(F.trim("document_id")).alias("k")).distinct()
    both = register(spark, d).select("id").join(gone, F.col("id") == F.col("k"), "full_outer")
    return both.groupBy(F.when(F.col("id").isNull(), "removed only").when(F.col("k").isNull(), "register only").otherwise("both").alias("found_in")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS cost, CAST(sum(l_quantity) AS BIGINT) AS units, max(l_shipdate) AS last_at FROM lineitem")
def a1_cost_summary(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("cost"), F.sum("l_quantity").cast("long").alias("units"), F.max("l_shipdate").alias("last_at"))


@query("SELECT o_orderpriority AS phase, round(sum(coalesce(o_totalprice, 0)), 2) AS spend, count(*) AS n FROM orders GROUP BY 1")
def a2_spend_by_phase(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("phase")).agg(F.round(F.sum(F.coalesce("o_totalprice", F.lit(0.0))), 2).alias("spend"), F.count(F.lit(1)).alias("n"))


@query("SELECT k AS lifecycle, count(id) AS n FROM unnest(['ACTIVE', 'AMENDED', 'SUPERSEDED', 'WITHDRAWN', 'REPEALED', 'REVIEW_REQUIRED', 'UNKNOWN']) t(k) LEFT JOIN $REG ON st = k GROUP BY 1")
def a3_lifecycle_counts(spark, d):
    every = spark.createDataFrame([(x,) for x in T.LIFECYCLES], "lifecycle string")
    counts = register(spark, d).groupBy(F.col("st").alias("lifecycle")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "lifecycle", "left").select("lifecycle", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT source_id, count(*) FILTER (normalized_text_hash IS NULL) AS n_unread, count(*) AS n, CASE WHEN count(*) FILTER (normalized_text_hash IS NULL) > 0 THEN 'attention' ELSE 'healthy' END AS health FROM (SELECT DISTINCT * FROM page_snapshots) GROUP BY 1")
def a4_source_health(spark, d):
    unread = F.count_if(F.col("normalized_text_hash").isNull())
    return table(spark, d, "page_snapshots").distinct().groupBy("source_id").agg(unread.alias("n_unread"), F.count(F.lit(1)).alias("n"), F.when(unread > 0, "attention").otherwise("healthy").alias("health"))


@query("SELECT topic, count(*) AS n_sources FROM (SELECT DISTINCT source_id, unnest(regulatory_topics) AS topic FROM reg_sources WHERE enabled) GROUP BY 1")
def a5_topics(spark, d):
    return table(spark, d, "reg_sources").filter("enabled").select("source_id", F.explode("regulatory_topics").alias("topic")).distinct().groupBy("topic").agg(F.count(F.lit(1)).alias("n_sources"))


@query("""WITH e AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1), j AS (SELECT *, greatest(1, least(CAST(floor(0.95 * (n + 1)) AS BIGINT), n - 1)) AS j FROM e)
  SELECT event_type, n, round(v[j] + (0.95 * (n + 1) - j) * (v[j + 1] - v[j]), 6) AS p95_exclusive, v[least(CAST(floor(0.95 * n) AS BIGINT) + 1, n)] AS p95_nearest, v[CAST(floor(n / 2.0) AS BIGINT) + 1] AS upper_median FROM j""")
def a13_latency_quantiles(spark, d):
    q = M.quantiles(table(spark, d, "events"), "event_type", "value")
    return q.select("event_type", "n", F.round("exclusive", 6).alias("p95_exclusive"), F.col("nearest").alias("p95_nearest"), "upper_median")


@query("SELECT event_type, round(median(value), 6) AS median, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a12_median_latency(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.avg("value"), 6).alias("mean"))


_STEPS = [50_000.0 * i for i in range(1, 10)]
_SWEEP = f"""WITH s AS (SELECT t AS threshold, count(*) FILTER (o_totalprice >= t AND f) AS tp, count(*) FILTER (f) AS p, count(*) FILTER (o_totalprice < t AND NOT f) AS tn, count(*) FILTER (NOT f) AS n
  FROM (SELECT o_totalprice, o_orderstatus = 'F' AS f FROM orders), unnest({_STEPS}) u(t) GROUP BY 1), b AS (SELECT threshold, tp, tn, round((tp / p + tn / n) / 2, 6) AS balanced_accuracy FROM s)"""


def _swept(spark, d):
    return M.sweep(table(spark, d, "orders").withColumn("f", F.col("o_orderstatus") == "F"), "o_totalprice", "f", _STEPS)


@query(_SWEEP + " SELECT CAST(threshold AS DOUBLE) AS threshold, tp, tn, balanced_accuracy FROM b")
def a21_threshold_sweep(spark, d):
    return _swept(spark, d)


@query(_SWEEP + " SELECT CAST(threshold AS DOUBLE) AS threshold, balanced_accuracy FROM b ORDER BY balanced_accuracy DESC, threshold LIMIT 1")
def a21_best_threshold(spark, d):
    return M.best_threshold(_swept(spark, d))


@query("SELECT old_st AS was, new_st AS is_now, count(*) AS n FROM (SELECT l.link_id, o.st AS old_st, w.st AS new_st FROM $LINKS l JOIN $REG o ON o.id = old_id JOIN $REG w ON w.id = new_id) GROUP BY 1, 2")
def a19_confusion(spark, d):
    r = register(spark, d)
    both = links(spark, d).join(r.select(F.col("id").alias("old_id"), F.col("st").alias("was")), "old_id").join(r.select(F.col("id").alias("new_id"), F.col("st").alias("is_now")), "new_id")
    return both.groupBy("was", "is_now").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT md5(concat_ws(':', chunk_id, sha256(text))) AS h FROM (SELECT DISTINCT chunk_id, text FROM chunks)) SELECT CAST(sum(CAST(('0x' || substr(h, 1, 15)) AS BIGINT)) AS VARCHAR) || '-' || CAST(sum(CAST(('0x' || substr(h, 17, 15)) AS BIGINT)) AS VARCHAR) AS fingerprint, count(*) AS n_rows FROM p""")
def a23_fingerprint(spark, d):
    return M.fingerprint(table(spark, d, "chunks").select("chunk_id", F.sha2("text", 256).alias("h")).distinct(), "chunk_id", "h")


@query(r"""SELECT chunker, count(*) AS n, median(t) AS median_words, max(t) AS most_words FROM (SELECT DISTINCT chunk_id, chunker, len(regexp_extract_all(text, '\S+')) AS t FROM chunks) GROUP BY 1""")
def a25_chunk_sizes(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "chunker", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("t")).distinct()
    return c.groupBy("chunker").agg(F.count(F.lit(1)).alias("n"), F.percentile("t", 0.5).alias("median_words"), F.max("t").alias("most_words"))


@query("SELECT issuing_authority, CAST(min(year(publication_date)) AS INT) AS first_year FROM $REG WHERE year(publication_date) > 1900 GROUP BY 1")
def a27_first_year(spark, d):
    return register(spark, d).filter(F.year("publication_date") > 1900).groupBy("issuing_authority").agg(F.min(F.year("publication_date")).alias("first_year"))


@query("SELECT canonical_url, version_id, CAST(floor(epoch(recorded_at)) AS BIGINT) AS recorded_s FROM $LOG QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY recorded_at DESC NULLS LAST, version_id DESC) = 1")
def w1_latest_versions(spark, d):
    return E.latest_by(log(spark, d).select("canonical_url", "version_id", "recorded_at"), ["canonical_url"], F.col("recorded_at").desc_nulls_last(), F.desc("version_id")).select("canonical_url", "version_id", F.unix_seconds("recorded_at").alias("recorded_s"))


_OBS = """WITH o AS (SELECT *, lag(struct_pack(c := h)) OVER w AS prev FROM $LOG WINDOW w AS (PARTITION BY canonical_url ORDER BY recorded_at, version_id)),
  c AS (SELECT *, CASE WHEN prev IS NULL THEN 'NEW' WHEN prev.c IS NOT DISTINCT FROM h THEN 'UNCHANGED' ELSE 'MODIFIED' END AS change FROM o)"""


def _observed(spark, d):
    return V.observed(log(spark, d), "canonical_url", [F.asc("recorded_at"), F.asc("version_id")], "h")


@query(_OBS + """ SELECT version_id, change, CASE WHEN change <> 'UNCHANGED' THEN CAST(sum(CASE WHEN change <> 'UNCHANGED' THEN 1 ELSE 0 END) OVER (PARTITION BY canonical_url ORDER BY recorded_at, version_id) AS BIGINT) END AS version_no FROM c""")
def w6_observed_changes(spark, d):
    return _observed(spark, d).select("version_id", "change", "version_no")


@query(_OBS + " SELECT version_id, CAST(floor(epoch(lead(recorded_at) OVER (PARTITION BY canonical_url ORDER BY recorded_at, version_id))) AS BIGINT) AS closed_s FROM c WHERE change <> 'UNCHANGED'")
def w4_closed_versions(spark, d):
    o = _observed(spark, d).filter("change <> 'UNCHANGED'")
    return o.select("version_id", F.unix_seconds(F.lead("recorded_at").over(Window.partitionBy("canonical_url").orderBy("recorded_at", "version_id"))).alias("closed_s"))


_DIFF = r"""WITH t AS (SELECT version_id, h, txt, lag(h) OVER w AS ph, lag(txt) OVER w AS ptxt FROM $LOG WINDOW w AS (PARTITION BY canonical_url ORDER BY recorded_at, version_id)),
  l AS (SELECT version_id, list_distinct(list_filter(list_transform(string_split(ptxt, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS ol, list_distinct(list_filter(list_transform(string_split(txt, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS nl,
    list_distinct(regexp_extract_all(ptxt, '\b\d+(?:\.\d+)?%?\b')) AS o1, list_distinct(regexp_extract_all(txt, '\b\d+(?:\.\d+)?%?\b')) AS n1,
    list_distinct(regexp_extract_all(ptxt, '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\w+ \d{1,2},? \d{4}\b')) AS o2, list_distinct(regexp_extract_all(txt, '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\w+ \d{1,2},? \d{4}\b')) AS n2
    FROM t WHERE ptxt IS NOT NULL AND txt IS NOT NULL AND h IS DISTINCT FROM ph),
  r AS (SELECT version_id, len(list_filter(nl, lambda x: NOT list_contains(ol, x))) AS n_added, len(list_filter(ol, lambda x: NOT list_contains(nl, x))) AS n_removed,
    list_sort(list_concat(list_filter(o1, lambda x: NOT list_contains(n1, x)), list_filter(n1, lambda x: NOT list_contains(o1, x)))) AS nums, list_sort(list_concat(list_filter(o2, lambda x: NOT list_contains(n2, x)), list_filter(n2, lambda x: NOT list_contains(o2, x)))) AS dats FROM l)
"""


@query(_DIFF + "SELECT version_id, CAST(n_added AS INT) AS n_added, CAST(n_removed AS INT) AS n_removed, array_to_string(nums, ' ') AS numbers, array_to_string(dats, '; ') AS dates, CASE WHEN len(nums) + len(dats) > 0 THEN 'HIGH' ELSE 'MEDIUM' END AS materiality FROM r")
def m2_diff(spark, d):
    w = Window.partitionBy("canonical_url").orderBy("recorded_at", "version_id")
    t = log(spark, d).withColumn("ph", F.lag("h").over(w)).withColumn("ptxt", F.lag("txt").over(w)).filter("ptxt is not null and txt is not null and not (h <=> ph)")
    x = t.select("version_id", V.diff(F.col("ptxt"), F.col("txt")).alias("x"))
    return x.select("version_id", F.size("x.added").alias("n_added"), F.size("x.removed").alias("n_removed"), F.array_join("x.changed_numbers", " ").alias("numbers"), F.array_join("x.changed_dates", "; ").alias("dates"), V.materiality(F.col("x")).alias("materiality"))


@query("SELECT found, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in V.STATED) + " ELSE 'REVIEW_REQUIRED' END AS found FROM (SELECT lower(text) AS t FROM (SELECT DISTINCT chunk_id, text FROM chunks) WHERE text IS NOT NULL)) GROUP BY 1")
def m4_stated_lifecycle(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "text").distinct().filter("text is not null")
    return c.groupBy(V.stated_lifecycle(F.col("text")).alias("found")).agg(F.count(F.lit(1)).alias("n"))


_TRUST = """WITH k AS (SELECT l.*, o.source_url AS old_url, w.source_url AS new_url, o.publication_date AS old_day, w.publication_date AS new_day, w.st AS new_status, (SELECT count(*) FROM $REG q WHERE q.id = l.old_id) AS n_matched
  FROM $LINKS l LEFT JOIN $REG o ON o.id = l.old_id LEFT JOIN $REG w ON w.id = l.new_id),
  h AS (SELECT *, lower(regexp_extract(old_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS oh, lower(regexp_extract(new_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS nh FROM k),
  r AS (SELECT link_id, relation, old_id, new_id, list_filter([CASE WHEN relation IS DISTINCT FROM 'SUPERSEDES' THEN 'not replaces' END, CASE WHEN scope IS DISTINCT FROM 'WHOLE' THEN 'not whole' END,
   CASE WHEN NOT coalesce(method IN ('repeal_annex', 'repeal_sentence', 'supersession_sentence', 'superseded_by_statement'), false) THEN 'not explicit' END,
   CASE WHEN coalesce(trim(evidence_quote), '') = '' THEN 'not quoted' END, CASE WHEN n_matched <> 1 THEN 'not one_match' END,
   CASE WHEN NOT (coalesce(nh = 'norvale.example' OR ends_with(nh, '.norvale.example'), false) AND coalesce(oh = 'norvale.example' OR ends_with(oh, '.norvale.example'), false)) THEN 'not official' END,
   CASE WHEN new_day IS NULL OR old_day IS NULL THEN 'not dated' END, CASE WHEN new_day <= old_day THEN 'not later' END,
   CASE WHEN new_status IN ('WITHDRAWN', 'REPEALED', 'SUPERSEDED') THEN 'not operative' END, CASE WHEN new_id IS NOT DISTINCT FROM old_id THEN 'not another' END], lambda x: x IS NOT NULL) AS reasons FROM h)
"""


@query(_TRUST + "SELECT DISTINCT link_id, relation, old_id, new_id, CASE WHEN len(reasons) = 0 THEN 'AUTO_TRUSTED' ELSE 'REVIEW_REQUIRED' END AS decision, array_to_string(reasons, ', ') AS reasons FROM r")
def m10_trust(spark, d):
    r = register(spark, d)
    side = lambda p: r.select(F.col("id").alias(f"{p}_id"), F.col("source_url").alias(f"{p}_url"), F.col("publication_date").alias(f"{p}_day"), F.col("st").alias(f"{p}_status"))
    k = links(spark, d).join(side("old").withColumn("one", F.lit(1)), "old_id", "left").join(side("new"), "new_id", "left").withColumn("n_matched", F.coalesce("one", F.lit(0)))
    k = k.withColumn("why", V.trust_reasons(DOMAIN))
    return k.select("link_id", "relation", "old_id", "new_id", F.when(F.size("why") == 0, "AUTO_TRUSTED").otherwise("REVIEW_REQUIRED").alias("decision"), F.array_join("why", ", ").alias("reasons")).distinct()


@query("""WITH s AS (SELECT old_id AS id, min(w.in_force_from) AS starts FROM $LINKS l JOIN $REG w ON w.id = new_id WHERE relation = 'SUPERSEDES' AND trust IN ('APPROVED', 'AUTO_TRUSTED') AND w.in_force_from IS NOT NULL GROUP BY 1)
  SELECT r.id, r.in_force_to AS old_end, s.starts, CASE WHEN s.starts <= $TODAY THEN least(r.in_force_to, s.starts) ELSE r.in_force_to END AS new_end FROM $REG r JOIN s USING (id)""")
def m12_switch_over(spark, d):
    r = register(spark, d)
    due = links(spark, d).filter("relation = 'SUPERSEDES' and trust in ('APPROVED', 'AUTO_TRUSTED')").select(F.col("old_id"), "new_id")
    starts = due.join(r.filter("in_force_from is not null").select(F.col("id").alias("new_id"), "in_force_from"), "new_id").groupBy(F.col("old_id").alias("id")).agg(F.min("in_force_from").alias("starts"))
    return r.select("id", F.col("in_force_to").alias("old_end")).join(starts, "id").select("id", "old_end", "starts", V.switch_over(F.col("old_end"), F.col("starts"), F.lit(TODAY)).alias("new_end"))


_SPLIT = "TIMESTAMP '2022-07-01'"


def _halves(spark, d):
    r = table(spark, d, "reg_documents").filter("ingested_at is not null and document_id is not null").groupBy(F.lower(F.trim("document_id")).alias("id"), (F.col("ingested_at") < F.expr(_SPLIT)).alias("early")).agg(F.unix_seconds(F.max("ingested_at")).alias("ingested_s"))
    return r.filter("early").drop("early"), r.filter("not early").drop("early")


_HALVES = f"WITH r AS (SELECT lower(trim(document_id)) AS id, ingested_at < {_SPLIT} AS early, CAST(floor(epoch(max(ingested_at))) AS BIGINT) AS ingested_s FROM reg_documents WHERE ingested_at IS NOT NULL AND document_id IS NOT NULL GROUP BY 1, 2)"


@query(_HALVES + " SELECT id, ingested_s FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY early) = 1")
def s3_upsert(spark, d):
    old, new = _halves(spark, d)
    return V.upsert(new, old, "id")


@query(_HALVES + " SELECT id, ingested_s FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY early DESC) = 1")
def s5_insert_if_absent(spark, d):
    old, new = _halves(spark, d)
    return V.insert_if_absent(new, old, "id")


@query("SELECT DISTINCT chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM removed_documents g WHERE lower(trim(g.document_id)) = lower(trim(c.document_id)))")
def s8_delete_by_document(spark, d):
    gone = table(spark, d, "removed_documents").select(F.lower(F.trim("document_id")).alias("id"))
    return V.delete(table(spark, d, "chunks").withColumn("id", F.lower(F.trim("document_id"))), gone, "id").select("chunk_id").distinct()


@query(r"""WITH u AS (SELECT DISTINCT canonical_url AS url FROM page_snapshots WHERE canonical_url IS NOT NULL), b AS (SELECT url, regexp_replace(url, '#.*$', '') AS bare FROM u),
  k AS (SELECT url, regexp_replace(lower(split_part(bare, '?', 1)), '://www\.', '://') AS base, array_to_string(list_sort(list_filter(string_split(CASE WHEN contains(bare, '?') THEN substr(bare, instr(bare, '?') + 1) ELSE '' END, '&'), lambda p: p <> '')), '&') AS q,
    lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1)) || regexp_replace(regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*', ''), '/$', '') AS canonical FROM b)
  SELECT url, CASE WHEN q = '' THEN base ELSE base || '?' || q END AS source_key, canonical FROM k""")
def c20_addresses(spark, d):
    u = table(spark, d, "page_snapshots").filter("canonical_url is not null").select(F.col("canonical_url").alias("url")).distinct()
    return u.select("url", T.source_key(F.col("url")).alias("source_key"), T.canonical_url(F.col("url")).alias("canonical"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN t = '' THEN NULL " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for p, k in T.DOCUMENT_TYPES) + " ELSE 'circular' END AS kind FROM (SELECT lower(title) AS t FROM $REG WHERE title IS NOT NULL)) GROUP BY 1")
def c16_document_types(spark, d):
    return register(spark, d).filter("title is not null").groupBy(T.document_type(F.col("title")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, in_force_from + CAST(floor((in_force_to - in_force_from) / 2.0) AS INT) AS middle, 'rule_' || substr(sha256(concat_ws(':', id, in_force_from::VARCHAR)), 1, 20) AS rule_id
  FROM $REG WHERE in_force_from <= in_force_to""")
def c26_midpoints(spark, d):
    r = register(spark, d).filter("in_force_from <= in_force_to")
    return r.select("id", T.midpoint(F.col("in_force_from"), F.col("in_force_to")).alias("middle"), T.stable_id("rule_", 20, F.col("id"), F.col("in_force_from").cast("string")).alias("rule_id"))


@query(r"""WITH f AS (SELECT request_id, query, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS q FROM (SELECT DISTINCT request_id, query FROM query_requests WHERE query IS NOT NULL)),
  t AS (SELECT source_url, list_distinct(regexp_extract_all(lower(max(title)), '[a-z0-9]+')) AS w FROM $REG WHERE source_url IS NOT NULL AND title IS NOT NULL GROUP BY 1)
  SELECT request_id, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, w)) / len(q), 3) ELSE 0 END AS overlap FROM f JOIN (SELECT DISTINCT request_id, source_url FROM query_requests) s USING (request_id) JOIN t USING (source_url)""")
def c5_word_overlap(spark, d):
    q = table(spark, d, "query_requests").filter("query is not null").select("request_id", "query", "source_url").distinct()
    t = register(spark, d).filter("source_url is not null and title is not null").groupBy("source_url").agg(F.max("title").alias("title"))
    return q.join(t, "source_url").select("request_id", T.word_overlap(F.col("query"), F.col("title")).alias("overlap"))


@query("SELECT id, title FROM $REG ORDER BY ingested_at DESC NULLS LAST, id LIMIT 20")
def t7_latest_documents(spark, d):
    return register(spark, d).orderBy(F.col("ingested_at").desc_nulls_last(), "id").limit(20).select("id", "title")


@query("SELECT k AS term FROM (SELECT id, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{3,}'))) AS k FROM $REG WHERE title IS NOT NULL AND issuing_authority = 'Central Credit Authority') GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM $REG WHERE title IS NOT NULL AND issuing_authority = 'Central Credit Authority')")
def u8_common_title_terms(spark, d):
    r = register(spark, d).filter("title is not null and issuing_authority = 'Central Credit Authority'").select("id", T.terms(F.col("title")).alias("k"))
    n = r.agg(F.count(F.lit(1)).alias("n_all"))
    return r.select(F.explode("k").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n), F.col("n") == F.col("n_all")).select("term")
