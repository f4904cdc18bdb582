"""Queries from stated changes to links and periods, on header facts, mentions and caches, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import graph as G
from annalist.operators import linking as L
from annalist.operators import segmentation as S
from annalist.operators import versions as V
from annalist.plans import ranking, rules
from annalist.plans.rules import links, log, register
from annalist.sources.shared import table

QUERIES, SQL = {}, {}
# Entities and how texts name them.
ALIASES = [("agent", "recovery agent"), ("agent", "debt collection agent"), ("bank", "cooperative bank"), ("bank", "regional bank"), ("bank", "rural credit union"), ("officer", "nodal officer"), ("officer", "loan officer"), ("bureau", "credit bureau")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("$REG", rules.REG).replace("$LOG", rules.LOG).replace("$LINKS", rules.LINKS).replace("$PASS", ranking._PASS)
        return f

    return add


_KEY = r"regexp_replace(regexp_replace(upper(regexp_replace(regexp_replace($R, '(?i)[.\s]*\bNo\.\s*', '.', 'g'), '\s+', '', 'g')), '\.{2,}', '.', 'g'), '\b(\d{4})-\d{2}(\d{2})\b', '\1-\2', 'g')"
_REFS = f"list_concat(regexp_extract_all($T, '{S.DEPARTMENT}'), regexp_extract_all($T, '{S.SERIES}'))"


@query(
    rf"""WITH a AS (SELECT doc_id, text, regexp_extract(text, '(?s)^(.*?)({L._NUMBER}(?:\s*{L._NUMBER})*)', 1) AS b, regexp_extract(text, '(?s)^(.*?)({L._NUMBER}(?:\s*{L._NUMBER})*)', 2) AS o FROM documents WHERE text IS NOT NULL),
  c AS (SELECT doc_id, text, b, CASE WHEN length(b) < 3000 THEN o ELSE '' END AS o FROM a), e AS (SELECT *, string_split(substr(text, length(b) + length(o) + 1), chr(10))[1:5] AS after FROM c),
  g AS (SELECT *, list_filter(after, lambda x: regexp_matches(x, '{L.DATE_LINE}'))[1] AS l, list_filter(after, lambda x: trim(x) <> '' AND NOT regexp_matches(x, '{L.DATE_LINE}'))[1] AS t FROM e)
  SELECT doc_id, array_to_string(list_transform(regexp_extract_all(o, '{L._NUMBER}'), lambda r: {_KEY.replace('$R', 'r')}), ' ') AS numbers,
    CASE WHEN o <> '' THEN coalesce(CAST(try_strptime(regexp_replace(regexp_replace(trim(l), ',', '', 'g'), ' +', ' ', 'g'), '%B %d %Y') AS DATE), CAST(try_strptime(replace(trim(l), '/', '.'), '%d.%m.%Y') AS DATE)) END AS issued,
    CASE WHEN o <> '' AND regexp_matches(b, '(?:^|\n)[ \t]*\z') AND trim(after[1]) = '' THEN trim(t) END AS title, split_part(text, chr(10), 1) AS first_line FROM g"""
)
def x11_header_facts(spark, d):
    f = table(spark, d, "documents").filter("text is not null").select("doc_id", L.header_facts(F.col("text")).alias("f"))
    return f.select("doc_id", F.array_join("f.numbers", " ").alias("numbers"), "f.issued", "f.title", "f.first_line")


_STATED = rf"""own AS (SELECT doc_id, list_transform(regexp_extract_all(CASE WHEN length(b) < 3000 THEN o ELSE '' END, '{L._NUMBER}'), lambda r: {_KEY.replace('$R', 'r')}) AS own
    FROM (SELECT doc_id, regexp_extract(text, '(?s)^(.*?)({L._NUMBER}(?:\s*{L._NUMBER})*)', 1) AS b, regexp_extract(text, '(?s)^(.*?)({L._NUMBER}(?:\s*{L._NUMBER})*)', 2) AS o FROM documents WHERE text IS NOT NULL)),
  s AS (SELECT doc_id, unnest(q) AS quote, unnest(range(len(q))) AS place FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS q FROM documents WHERE text IS NOT NULL)),
  r AS (SELECT *, CASE WHEN regexp_matches(lower(quote), '{L.RELATIONS[0][1]}') THEN 'SUPERSEDES' WHEN regexp_matches(lower(quote), '{L.RELATIONS[1][1]}') THEN 'AMENDS' END AS relation FROM s),
  g AS (SELECT doc_id, place, relation, quote, regexp_extract_all(quote, '{L._GROUP}') AS gs, regexp_split_to_array(quote, '{L._GROUP}') AS bs FROM r WHERE relation IS NOT NULL AND regexp_matches(quote, '{L._NUMBER}')),
  e AS (SELECT doc_id, place, relation, quote, unnest(gs) AS g, unnest(bs[1:len(gs)]) AS before, unnest(bs[2:len(gs) + 1]) AS after FROM g),
  stated AS (SELECT DISTINCT doc_id, place, relation, CASE WHEN regexp_matches(right(before, 120), '{L.PART}') THEN 'PARTIAL' ELSE 'WHOLE' END AS scope, {_KEY.replace('$R', f"regexp_extract(g, '{L._NUMBER}')")} AS target,
    coalesce(CAST(try_strptime(regexp_replace(regexp_replace(regexp_extract(after, '{L.DATED}', 1), ',', '', 'g'), '\s+', ' ', 'g'), '%B %d %Y') AS DATE), CAST(try_strptime(replace(regexp_extract(after, '{L.DATED}', 1), '/', '.'), '%d.%m.%Y') AS DATE)) AS dated
    FROM e JOIN own USING (doc_id) WHERE NOT list_contains(own, {_KEY.replace('$R', f"regexp_extract(g, '{L._NUMBER}')")}) AND NOT regexp_matches(before, '{L.MESSENGER}'))"""


def _stated(spark, d):
    return L.statements(table(spark, d, "documents").filter("text is not null"), "doc_id", "text")


@query(f"WITH {_STATED} SELECT doc_id, CAST(place AS INT) AS place, relation, scope, target, dated FROM stated")
def x14_statements(spark, d):
    return _stated(spark, d).select("doc_id", "place", "relation", "scope", "target", "dated")


@query(
    f"""WITH {_STATED}, nums AS (SELECT DISTINCT id, {_KEY.replace('$R', 'n')} AS target FROM (SELECT id, unnest(list_append(coalesce(circular_numbers, []), document_identifier)) AS n FROM $REG) WHERE n IS NOT NULL),
  fits AS (SELECT target, count(*) AS n_matched, min(id) AS old_id FROM nums GROUP BY 1)
  SELECT DISTINCT doc_id, relation, target, old_id, n_matched, 'link_' || substr(sha256(concat_ws('|', relation, old_id, doc_id::VARCHAR, 'sentence')), 1, 20) AS link_id FROM stated JOIN fits USING (target)"""
)
def m11_proposals(spark, d):
    numbers = F.filter(F.array_append(F.coalesce("circular_numbers", F.array().cast("array<string>")), F.col("document_identifier")), lambda n: n.isNotNull())
    r = register(spark, d).select("id", F.transform(numbers, T.department_reference).alias("numbers"))
    return L.proposals(_stated(spark, d), "doc_id", r).select("doc_id", "relation", "target", "old_id", "n_matched", "link_id")


@query(
    """WITH s AS (SELECT l.old_id AS id, min(w.in_force_from) AS replaced_at FROM $LINKS l JOIN $REG w ON w.id = l.new_id WHERE relation = 'SUPERSEDES' AND trust IN ('APPROVED', 'AUTO_TRUSTED') GROUP BY 1),
  g AS (SELECT lower(trim(document_id)) AS id, CAST(min(removed_at) AS DATE) AS removed_at FROM removed_documents WHERE document_id IS NOT NULL GROUP BY 1),
  p AS (SELECT r.id, r.in_force_from AS starts, least(in_force_to, replaced_at, removed_at) AS ends, replaced_at, removed_at FROM $REG r LEFT JOIN s ON s.id = r.id LEFT JOIN g ON g.id = r.id)
  SELECT id, starts, ends, CASE WHEN ends IS NULL THEN 'open' WHEN ends = replaced_at THEN 'successor' WHEN ends = removed_at THEN 'removal' ELSE 'own end' END AS ended_by FROM p"""
)
def m21_periods(spark, d):
    r = register(spark, d)
    successors = links(spark, d).filter("relation = 'SUPERSEDES' and trust in ('APPROVED', 'AUTO_TRUSTED')").join(r.select(F.col("id").alias("new_id"), F.col("in_force_from").alias("at")), "new_id").select(F.col("old_id").alias("id"), "at")
    gone = table(spark, d, "removed_documents").filter("document_id is not null").select(F.lower(F.trim("document_id")).alias("id"), F.to_date("removed_at").alias("at"))
    return L.in_force_periods(r.select("id", F.col("in_force_from").alias("starts"), F.col("in_force_to").alias("ends")), successors, gone)


_KW = "list_filter(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{3,}')), lambda x: NOT list_contains(['" + "', '".join(T.KEYWORD_STOPS) + "'], x))"


@query(
    f"""WITH w AS (SELECT id, issuing_department AS dep, publication_date AS day, coalesce(st IN ('WITHDRAWN', 'REPEALED', 'SUPERSEDED'), false) AS retired, unnest({_KW}) AS w FROM $REG WHERE issuing_department IS NOT NULL AND publication_date IS NOT NULL),
  s AS (SELECT a.id AS old_id, b.id AS new_id, count(*) AS shared, min(b.day) AS new_day FROM w a JOIN w b ON a.dep = b.dep AND a.w = b.w AND a.retired AND NOT b.retired AND b.day > a.day GROUP BY 1, 2)
  SELECT old_id, new_id, shared FROM s QUALIFY row_number() OVER (PARTITION BY old_id ORDER BY shared DESC, new_day, new_id) = 1"""
)
def j15_candidate_successors(spark, d):
    r = register(spark, d).select("id", F.col("issuing_department").alias("department"), F.col("publication_date").alias("issued"), "title", F.coalesce(F.col("st").isin(*V.NON_OPERATIVE), F.lit(False)).alias("retired"))
    return L.candidate_successors(r)


@query(
    rf"""WITH $PASS, p AS (SELECT lower(trim(document_id)) AS id, {ranking._NORM.replace('$X', 'text')} AS t FROM passages), q AS (SELECT DISTINCT link_id, new_id AS id, {ranking._NORM.replace('$X', 'evidence_quote')} AS q FROM $LINKS WHERE length(trim(evidence_quote)) >= 12)
  SELECT link_id, coalesce(bool_or(contains(t, q)), false) AS found FROM q LEFT JOIN p USING (id) GROUP BY 1"""
)
def g6_quotes_found(spark, d):
    p = ranking.passages(spark, d).select(F.lower(F.trim("document_id")).alias("id"), "text")
    return L.quotes_found(links(spark, d).select("link_id", F.col("new_id").alias("id"), F.col("evidence_quote").alias("quote")), p)


@query(
    """WITH e AS (SELECT * FROM $LINKS WHERE old_id IS NOT NULL AND new_id IS NOT NULL), g AS (SELECT DISTINCT lower(trim(document_id)) AS id FROM removed_documents WHERE document_id IS NOT NULL),
  k AS (SELECT * FROM e WHERE old_id NOT IN (SELECT id FROM g) AND new_id NOT IN (SELECT id FROM g)) SELECT id FROM $REG WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM g) AND id NOT IN (SELECT old_id FROM k) AND id NOT IN (SELECT new_id FROM k)"""
)
def g12_isolated_after_removal(spark, d):
    gone = table(spark, d, "removed_documents").filter("document_id is not null").select(F.lower(F.trim("document_id")).alias("id")).distinct()
    e = links(spark, d).filter("old_id is not null and new_id is not null").select(F.col("new_id").alias("source"), F.col("old_id").alias("target"))
    for end in ("source", "target"):
        e = V.delete(e, gone.withColumnRenamed("id", end), end)
    return G.isolated(V.delete(register(spark, d).filter("id is not null"), gone, "id"), e).select("id")


@query(
    """WITH $PASS, t AS (SELECT chunk_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM passages), a(entity, alias) AS (VALUES """
    + ", ".join(f"('{e}', '{a}')" for e, a in ALIASES)
    + """) SELECT entity, count(DISTINCT chunk_id) AS n_chunks FROM t JOIN a ON contains(t, ' ' || alias || ' ') GROUP BY 1"""
)
def c9_mentions(spark, d):
    aliases = spark.createDataFrame(ALIASES, "entity string, alias string")
    return L.mentions(ranking.passages(spark, d), "chunk_id", "text", aliases).groupBy("entity").agg(F.count(F.lit(1)).alias("n_chunks"))


@query("SELECT day, count(*) AS n_kinds FROM (SELECT CAST(recorded_at AS DATE) AS day, 'check' AS k FROM doc_versions UNION SELECT CAST(created_at AS DATE), 'link' FROM doc_links UNION SELECT CAST(removed_at AS DATE), 'removal' FROM removed_documents) WHERE day IS NOT NULL GROUP BY 1")
def u9_event_days(spark, d):
    one = lambda t, c, k: table(spark, d, t).select(F.to_date(c).alias("day"), F.lit(k).alias("k")).distinct()
    days = one("doc_versions", "recorded_at", "check").unionByName(one("doc_links", "created_at", "link")).unionByName(one("removed_documents", "removed_at", "removal"))
    return days.filter("day is not null").groupBy("day").agg(F.count(F.lit(1)).alias("n_kinds"))


@query(
    """WITH r AS (SELECT DISTINCT lower(trim(document_id)) AS id, ingested_at, content_hash FROM reg_documents WHERE document_id IS NOT NULL AND ingested_at IS NOT NULL AND content_hash IS NOT NULL),
  l AS (SELECT id, content_hash, lag(content_hash) OVER (PARTITION BY id ORDER BY ingested_at, content_hash) AS before FROM r) SELECT count(*) FILTER (before IS NULL) AS n_new, count(*) FILTER (before = content_hash) AS n_same, count(*) FILTER (before <> content_hash) AS n_changed FROM l"""
)
def s15_changed_uploads(spark, d):
    """Of the files that were ingested again, which have another checksum and must be stored."""
    r = table(spark, d, "reg_documents").filter("document_id is not null and ingested_at is not null and content_hash is not null").select(F.lower(F.trim("document_id")).alias("id"), "ingested_at", "content_hash").distinct()
    l = r.withColumn("before", F.lag("content_hash").over(Window.partitionBy("id").orderBy("ingested_at", "content_hash")))
    return l.agg(F.count_if(F.col("before").isNull()).alias("n_new"), F.count_if(F.col("before") == F.col("content_hash")).alias("n_same"), F.count_if(F.col("before") != F.col("content_hash")).alias("n_changed"))


@query(
    """WITH p AS (SELECT canonical_url, bool_or(contains(lower(title), 'repeal')) AS detected, bool_or(upper(trim(lifecycle)) IN ('WITHDRAWN', 'REPEALED', 'SUPERSEDED')) AS registered FROM $LOG GROUP BY 1)
  SELECT count(*) FILTER (detected AND registered) AS n_both, count(*) FILTER (detected AND NOT coalesce(registered, false)) AS n_false_alarms, count(*) FILTER (NOT coalesce(detected, false) AND registered) AS n_missed FROM p"""
)
def e9_detection(spark, d):
    low = lambda c: F.coalesce(c, F.lit(False))
    p = log(spark, d).groupBy("canonical_url").agg(low(F.bool_or(F.lower("title").contains("repeal"))).alias("a"), low(F.bool_or(F.upper(F.trim("lifecycle")).isin(*V.NON_OPERATIVE))).alias("b"))
    return p.agg(F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if(F.col("a") & ~F.col("b")).alias("n_false_alarms"), F.count_if(~F.col("a") & F.col("b")).alias("n_missed"))
