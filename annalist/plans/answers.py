"""Queries of evidence, notices, citations, graph building, replay and evaluation, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import eligibility as E
from annalist.operators import evidence as V
from annalist.operators import linking as L
from annalist.operators import metrics as M
from annalist.operators import segmentation as S
from annalist.operators import versions
from annalist.plans import ranking, rules
from annalist.plans.rules import PAST, TODAY, links, log, register
from annalist.sources.shared import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("$TODAY", f"DATE '{TODAY}'").replace("$PAST", f"DATE '{PAST}'").replace("$REG", rules.REG).replace("$LOG", rules.LOG).replace("$LINKS", rules.LINKS)
        return f

    return add


_NOTICE = """n AS (SELECT r.id, r.title, CASE WHEN r.st IN ('WITHDRAWN', 'REPEALED', 'SUPERSEDED') AND coalesce(s.in_force_from <= $TODAY, false) THEN 'replaced' WHEN r.st IN ('WITHDRAWN', 'REPEALED', 'SUPERSEDED') THEN 'withdrawn'
  WHEN r.in_force_from > $TODAY THEN 'upcoming' END AS kind, s.id AS successor_id FROM $REG r LEFT JOIN $REG s ON s.id = lower(trim(r.successor_document_id)))"""


@query(f"WITH {_NOTICE} SELECT id, kind, successor_id FROM n WHERE kind IS NOT NULL")
def r12_notices(spark, d):
    r = register(spark, d)
    s = r.select(F.col("id").alias("successor_id"), F.col("in_force_from").alias("successor_starts"))
    n = r.join(s, F.lower(F.trim("successor_document_id")) == F.col("successor_id"), "left")
    return n.select("id", V.notice(F.col("st"), F.col("in_force_from"), F.col("successor_starts"), F.lit(TODAY)).alias("kind"), "successor_id").filter("kind is not null")


@query("""WITH a AS (SELECT request_id, 'see [' || c.chunk_id || ']' || CASE WHEN request_id % 3 = 0 THEN ' and [chunk_' || substr(md5(request_id::VARCHAR), 1, 20) || ']' ELSE '' END AS answer, c.source_url FROM (SELECT DISTINCT request_id, source_url, paragraph_ref FROM query_requests) q
    JOIN (SELECT source_url, paragraph_ref, min(chunk_id) AS chunk_id FROM chunks GROUP BY 1, 2) c USING (source_url, paragraph_ref)),
  v AS (SELECT source_url, list(DISTINCT chunk_id) AS available FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1)
  SELECT request_id, len(regexp_extract_all(answer, '\\[(chunk_[a-f0-9]{20})\\]', 1)) > 0 AND len(list_filter(regexp_extract_all(answer, '\\[(chunk_[a-f0-9]{20})\\]', 1), lambda x: NOT list_contains(available, x))) = 0 AS valid FROM a JOIN v USING (source_url)""".replace("\\\\", "\\"))
def r15_citation_validity(spark, d):
    """Answers made from the requests (every third cites something that was not retrieved) against the chunks of their page."""
    c = table(spark, d, "chunks").filter("chunk_id is not null and source_url is not null")
    first = c.filter("paragraph_ref is not null").groupBy("source_url", "paragraph_ref").agg(F.min("chunk_id").alias("chunk_id"))
    extra = F.when(F.col("request_id") % 3 == 0, F.concat(F.lit(" and [chunk_"), F.substring(F.md5(F.col("request_id").cast("string")), 1, 20), F.lit("]"))).otherwise("")
    a = table(spark, d, "query_requests").select("request_id", "source_url", "paragraph_ref").distinct().join(first, ["source_url", "paragraph_ref"]).withColumn("answer", F.concat(F.lit("see ["), "chunk_id", F.lit("]"), extra))
    cited = a.select("request_id", "source_url", F.explode(T.citation_ids(F.col("answer"))).alias("chunk_id"))
    known = cited.join(c.select("source_url", "chunk_id").distinct().withColumn("known", F.lit(True)), ["source_url", "chunk_id"], "left")
    return known.groupBy("request_id").agg(F.every(F.coalesce("known", F.lit(False))).alias("valid"))


_BOTH = "merge AS (SELECT query_id, chunk_id, min(part * 1000 + rank) AS pos, max_by(part, part * 1000 + rank) AS value FROM (SELECT query_id, chunk_id, rank, 0 AS part FROM br WHERE rank <= 3 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM bm WHERE rank <= 5) GROUP BY 1, 2)"


@query(ranking._BM25 + ", " + ranking._BLEND.split(ranking._PASS + ",", 1)[1] + f", {_BOTH} SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos, chunk_id) AS INT) AS place, value FROM merge QUALIFY place <= 6")
def u1_merged_evidence(spark, d):
    """Three passages of one ranking before five of another, each once, cut to six."""
    side = lambda r, n: r.select("query_id", "chunk_id", F.col("rank").alias("place"), F.lit(n).alias("value"))
    return V.merged(side(ranking._blended(spark, d, 3), 0), side(ranking._bm25(spark, d, 5), 1), "chunk_id", 6)


@query("""WITH l AS (SELECT r.source_url AS page, array_to_string(list_sort(r.topics), ',') AS a, r.topics, s.regulatory_topics AS t FROM $REG r JOIN reg_sources s ON s.authority = r.issuing_authority WHERE r.topics IS NOT NULL)
  SELECT CAST(sum(len(list_intersect(list_distinct(topics), list_distinct(t)))) AS BIGINT) AS n_hit, CAST(sum(len(list_distinct(topics))) AS BIGINT) AS n_found, CAST(sum(len(list_distinct(t))) AS BIGINT) AS n_gold,
    round(sum(len(list_intersect(list_distinct(topics), list_distinct(t)))) / sum(len(list_distinct(topics))), 6) AS precision, round(sum(len(list_intersect(list_distinct(topics), list_distinct(t)))) / sum(len(list_distinct(t))), 6) AS recall FROM l""")
def a18_micro_precision_recall(spark, d):
    s = table(spark, d, "reg_sources").select(F.col("authority").alias("issuing_authority"), F.array_distinct("regulatory_topics").alias("gold"))
    r = register(spark, d).filter("topics is not null").select("issuing_authority", F.array_distinct("topics").alias("found"))
    return M.micro(r.join(s, "issuing_authority"), "found", "gold")


@query(r"""WITH v AS (SELECT canonical_url, txt, row_number() OVER (PARTITION BY canonical_url ORDER BY recorded_at, version_id) AS n, count(*) OVER (PARTITION BY canonical_url) AS m FROM $LOG WHERE txt IS NOT NULL AND canonical_url IS NOT NULL),
  p AS (SELECT canonical_url, n, m, k, line, list_distinct(regexp_extract_all(lower(line), '[a-z0-9]{3,}')) AS w FROM (SELECT canonical_url, n, m, unnest(string_split(txt, chr(10))) AS line, unnest(range(len(string_split(txt, chr(10))))) AS k FROM v) WHERE trim(line, ' ') <> ''),
  s AS (SELECT a.canonical_url, a.n, a.k, b.k AS new_key, round(len(list_intersect(a.w, b.w)) / sqrt(len(a.w) * len(b.w)::DOUBLE), 6) AS score FROM p a JOIN p b ON a.canonical_url = b.canonical_url AND b.n = a.n + 1 WHERE len(list_intersect(a.w, b.w)) > 0),
  t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY canonical_url, n, k ORDER BY score DESC, new_key) = 1)
  SELECT p.canonical_url, CAST(p.n AS INT) AS step, CAST(p.k AS INT) AS old_key, CAST(CASE WHEN score >= 0.3 THEN new_key END AS INT) AS new_key, coalesce(score, 0.0) AS score FROM p LEFT JOIN t USING (canonical_url, n, k) WHERE p.n < p.m""")
def j14_paragraph_map(spark, d):
    """Each paragraph of a version of a page with the most similar one of the next version, or none; step counts the page's versions."""
    w = Window.partitionBy("canonical_url").orderBy("recorded_at", "version_id")
    v = log(spark, d).filter("txt is not null and canonical_url is not null").select("canonical_url", "txt", F.row_number().over(w).alias("step"), F.lead("txt").over(w).alias("next"))
    return V.best_match(v.filter("next is not null"), ["canonical_url", "step"], "txt", "next")


_WITHIN = """nm AS (SELECT chunk_id, document_id, list_filter(regexp_extract_all(text, '(?i:\\b(?:paragraphs?|paras?)\\s+\\d{1,3}\\b(?:\\s*(?:,|and|to)\\s*\\d{1,3}\\b)*)(?:$ELSE)?'), lambda x: NOT regexp_matches(x, '$ELSE$')) AS ms
    FROM passages_all WHERE NOT coalesce(regexp_matches(lower(document_title), '\\bamendment\\b'), false)),
  lb AS (SELECT chunk_id, document_id, unnest(flatten(list_transform(ms, lambda x: regexp_extract_all(x, '\\d+')))) AS label FROM nm),
  fp AS (SELECT document_id, paragraph_ref AS label, min_by(chunk_id, struct_pack(i := chunk_index, c := chunk_id)) AS target FROM passages_all WHERE document_id IS NOT NULL AND paragraph_ref IS NOT NULL GROUP BY 1, 2),
  wi AS (SELECT chunk_id, target FROM lb JOIN fp USING (document_id, label) WHERE target <> chunk_id)""".replace("$ELSE", S.ELSEWHERE)
_REFS = f"list_concat(regexp_extract_all(text, '{S.DEPARTMENT}'), regexp_extract_all(text, '{S.SERIES}'))"
_KEY = r"regexp_replace(regexp_replace(upper(regexp_replace(regexp_replace($R, '(?i)[.\s]*\bNo\.\s*', '.', 'g'), '\s+', '', 'g')), '\.{2,}', '.', 'g'), '\b(\d{4})-\d{2}(\d{2})\b', '\1-\2', 'g')"
_ACROSS = f"""bn AS (SELECT {_KEY.replace('$R', 'n')} AS k, min(id) AS target FROM (SELECT id, unnest(list_append(coalesce(circular_numbers, []), document_identifier)) AS n FROM $REG) WHERE n IS NOT NULL GROUP BY 1),
  pr AS (SELECT chunk_id, lower(trim(document_id)) AS own, {_KEY.replace('$R', 'r')} AS k FROM (SELECT chunk_id, document_id, unnest({_REFS}) AS r FROM passages_all)),
  ac AS (SELECT chunk_id, target FROM pr JOIN bn USING (k) WHERE target IS DISTINCT FROM own)"""
_CHUNKS = "passages_all AS (SELECT DISTINCT chunk_id, document_id, document_title, paragraph_ref, chunk_index, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL)"


@query(rf"""WITH {_CHUNKS}, {_WITHIN}, {_ACROSS}, p AS (SELECT DISTINCT chunk_id, document_id, text FROM chunks WHERE text IS NOT NULL), d AS (SELECT unnest(regexp_extract_all(text, '{V.MEANS}', 1)) AS term FROM p)
  SELECT 'DEFINES' AS type, count(*) AS n FROM d UNION ALL SELECT 'ISSUED_BY', count(*) FILTER (issuing_authority IS NOT NULL) FROM $REG UNION ALL SELECT 'PART_OF', count(DISTINCT chunk_id) FROM p
  UNION ALL SELECT 'REFERS_TO', (SELECT count(*) FROM wi) + (SELECT count(*) FROM ac) UNION ALL SELECT 'WITHDRAWS', count(DISTINCT lower(trim(document_id))) FROM removed_documents WHERE lower(trim(document_id)) IN (SELECT id FROM $REG)
  UNION ALL SELECT relation, count(*) FROM $LINKS WHERE coalesce(trust <> 'REJECTED', true) AND relation IN ('SUPERSEDES', 'AMENDS') GROUP BY relation""")
def g1_graph_edges(spark, d):
    """Edges of the provenance graph by type; candidates and rejected links are none. What APPLIES_TO and REQUIRES are is read by a hosted model."""
    p = table(spark, d, "chunks").filter("text is not null").select("chunk_id", "document_id", "text").distinct()
    one = lambda df, t: df.agg(F.lit(t).alias("type"), F.count(F.lit(1)).alias("n"))
    r = register(spark, d)
    defines = one(p.select(F.explode(V.definitions(F.col("text")))), "DEFINES")
    issued = one(r.filter("issuing_authority is not null"), "ISSUED_BY")
    part = one(p.select("chunk_id").distinct(), "PART_OF")
    numbers = F.array_compact(F.array_append(F.coalesce("circular_numbers", F.array().cast("array<string>")), F.col("document_identifier")))
    passages, printed = ranking.passages(spark, d), r.select("id", F.transform(numbers, T.department_reference).alias("numbers"))
    refers = one(L.references_within(passages).unionByName(L.references_across(passages, printed)), "REFERS_TO")
    removed = table(spark, d, "removed_documents").select(F.lower(F.trim("document_id")).alias("id")).distinct()
    withdraws = one(removed.join(r.select("id"), "id"), "WITHDRAWS")
    linked = links(spark, d).filter("relation in ('SUPERSEDES', 'AMENDS') and coalesce(trust <> 'REJECTED', true)").groupBy(F.col("relation").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return defines.unionByName(issued).unionByName(part).unionByName(refers).unionByName(withdraws).unionByName(linked)


@query("""WITH e AS (SELECT l.link_id, l.old_id, l.new_id, CASE WHEN l.old_id IS NULL OR l.new_id IS NULL THEN 'end is null' WHEN o.id IS NULL AND w.id IS NULL THEN 'both outside' WHEN o.id IS NULL THEN 'old outside' WHEN w.id IS NULL THEN 'new outside' WHEN l.old_id = l.new_id THEN 'self' ELSE 'admitted' END AS outcome
  FROM $LINKS l LEFT JOIN $REG o ON o.id = l.old_id LEFT JOIN $REG w ON w.id = l.new_id) SELECT outcome, count(*) AS n FROM e GROUP BY 1""")
def a7_admission_counts(spark, d):
    """Why links are admitted to the graph or dropped."""
    ids = register(spark, d).filter("id is not null").select("id")
    l = links(spark, d).join(ids.select(F.col("id").alias("old_id"), F.lit(1).alias("o")), "old_id", "left").join(ids.select(F.col("id").alias("new_id"), F.lit(1).alias("w")), "new_id", "left")
    why = F.when(F.col("old_id").isNull() | F.col("new_id").isNull(), "end is null").when(F.col("o").isNull() & F.col("w").isNull(), "both outside").when(F.col("o").isNull(), "old outside").when(F.col("w").isNull(), "new outside").when(F.col("old_id") == F.col("new_id"), "self").otherwise("admitted")
    return l.groupBy(why.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT lower(trim(document_id)) AS id, CAST(min(removed_at) AS DATE) AS gone FROM removed_documents WHERE document_id IS NOT NULL AND removed_at IS NOT NULL GROUP BY 1)
  SELECT id, in_force_to AS old_end, least(in_force_to, gone) AS new_end, 'WITHDRAWN' AS lifecycle FROM $REG JOIN g USING (id)""")
def m15_register_applied(spark, d):
    gone = table(spark, d, "removed_documents").filter("document_id is not null and removed_at is not null").groupBy(F.lower(F.trim("document_id")).alias("id")).agg(F.to_date(F.min("removed_at")).alias("gone"))
    return register(spark, d).join(gone, "id").select("id", F.col("in_force_to").alias("old_end"), V.applied(F.col("in_force_to"), F.col("gone")).alias("new_end"), F.lit("WITHDRAWN").alias("lifecycle"))


@query("""SELECT source_url, count(*) AS n_rows, max_by(id, struct_pack(a := epoch_us(ingested_at), b := id)) AS kept FROM $REG WHERE source_url IS NOT NULL AND ingested_at IS NOT NULL GROUP BY 1""")
def m16_duplicates_cleaned(spark, d):
    r = register(spark, d).filter("source_url is not null and ingested_at is not null")
    return r.groupBy("source_url").agg(F.count(F.lit(1)).alias("n_rows"), F.max_by("id", F.struct(F.unix_micros("ingested_at"), "id")).alias("kept"))


@query("""SELECT version_id, CASE WHEN f IN ('WITHDRAWN', 'REPEALED', 'SUPERSEDED') THEN f WHEN l IS NOT NULL AND l NOT IN ('REVIEW_REQUIRED', 'UNKNOWN') THEN l WHEN a IS NOT NULL AND a NOT IN ('REVIEW_REQUIRED', 'UNKNOWN') THEN a ELSE 'REVIEW_REQUIRED' END AS lifecycle
  FROM (SELECT DISTINCT version_id, CASE WHEN contains(lower(title), 'repeal') THEN 'REPEALED' END AS f, upper(trim(lifecycle)) AS l, s.approved_lifecycle AS a FROM doc_versions v LEFT JOIN reg_sources s USING (source_id))""")
def m7_settled_lifecycle(spark, d):
    """An official finding (here: repeal in the title) before the stored status before the source's curated one."""
    v = table(spark, d, "doc_versions").join(table(spark, d, "reg_sources").select("source_id", "approved_lifecycle"), "source_id", "left")
    found = F.when(F.lower("title").contains("repeal"), "REPEALED")
    return v.select("version_id", versions.settled(found, E.status(F.col("lifecycle")), F.col("approved_lifecycle")).alias("lifecycle")).distinct()


_REPLAY = """WITH q AS (SELECT DISTINCT request_id, source_url, paragraph_ref, CAST(asked_at AS DATE) AS day FROM query_requests), h AS (SELECT request_id, day, c.chunk_id, coalesce(in_force_from <= day, true) AND coalesce(day < in_force_to, true) AS live
  FROM q JOIN (SELECT DISTINCT chunk_id, source_url, paragraph_ref, in_force_from, in_force_to FROM chunks) c USING (source_url, paragraph_ref))"""


@query(_REPLAY + " SELECT year(day) AS year, count(*) AS n_evidence, count(*) FILTER (NOT live) AS n_stale, round(count(*) FILTER (NOT live) / count(*), 6) AS stale_share FROM h GROUP BY 1")
def a24_replay_stale_share(spark, d):
    """Of the passages of the provisions asked about, how many did not hold on the day of the question."""
    q = table(spark, d, "query_requests").select("request_id", "source_url", "paragraph_ref", F.to_date("asked_at").alias("day")).distinct()
    c = table(spark, d, "chunks").select("chunk_id", "source_url", "paragraph_ref", "in_force_from", "in_force_to").distinct()
    h = q.join(c, ["source_url", "paragraph_ref"]).withColumn("live", E.in_force_on(F.col("day")))
    stale = F.count_if(~F.col("live"))
    return h.groupBy(F.year("day").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n_evidence"), stale.alias("n_stale"), F.round(stale / F.count(F.lit(1)), 6).alias("stale_share"))


@query("SELECT relation, old_id, new_id, CAST(min(created_at) AS DATE) AS first_day, count(*) AS n FROM $LINKS WHERE created_at IS NOT NULL GROUP BY 1, 2, 3")
def w17_first_seen(spark, d):
    return links(spark, d).filter("created_at is not null").groupBy("relation", "old_id", "new_id").agg(F.to_date(F.min("created_at")).alias("first_day"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, doc_type FROM documents ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id LIMIT 50")
def t10_seeded_sample(spark, d):
    return V.sample_by_hash(table(spark, d, "documents").select("doc_id", "doc_type"), "doc_id", 50)


@query("SELECT item_kind, count(*) AS n, round(avg(length(question)), 6) AS mean_length, round(avg(CASE WHEN as_of IS NULL THEN 0.0 ELSE 1.0 END), 6) AS dated_share FROM (SELECT DISTINCT * FROM eval_items) GROUP BY 1")
def a10_by_kind(spark, d):
    return table(spark, d, "eval_items").distinct().groupBy("item_kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("question")), 6).alias("mean_length"), F.round(F.avg(F.when(F.col("as_of").isNull(), 0.0).otherwise(1.0)), 6).alias("dated_share"))


@query("SELECT l_returnflag AS operation, round(sum(round((l_quantity * 0.15 + l_quantity * 2 * 0.6) / 1000000, 8)), 6) AS cost FROM lineitem GROUP BY 1")
def c24_model_cost(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("operation")).agg(F.round(F.sum(T.model_cost(q, q * 2, 0.15, 0.6)), 6).alias("cost"))


@query("SELECT id, coalesce(day(in_force_from) || ' ' || strftime(in_force_from, '%B %Y'), 'an unknown date') AS starts FROM $REG")
def c25_written_days(spark, d):
    return register(spark, d).select("id", T.written_day(F.col("in_force_from")).alias("starts"))


@query("""WITH f AS (SELECT id, title, publication_date, CASE WHEN publication_date < DATE '2020-01-01' THEN 'too old' WHEN contains(lower(title), 'amendment') THEN 'excluded word' WHEN topics IS NULL OR len(topics) = 0 THEN 'no topic' WHEN source_url IS NULL THEN 'no page' ELSE 'included' END AS outcome FROM $REG)
  SELECT outcome, count(*) AS n FROM f GROUP BY 1""")
def f14_predecessor_selection(spark, d):
    """The first rule that fits decides."""
    why = (
        F.when(F.col("publication_date") < F.lit(datetime.date(2020, 1, 1)), "too old").when(F.lower("title").contains("amendment"), "excluded word")
        .when(F.col("topics").isNull() | (F.size("topics") == 0), "no topic").when(F.col("source_url").isNull(), "no page").otherwise("included")
    )
    return register(spark, d).groupBy(why.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT doc_id, list_filter(['branch manager', 'nodal officer', 'recovery agent', 'credit bureau', 'loan officer'], lambda w: contains(lower(text), w)) AS e FROM documents WHERE text IS NOT NULL) SELECT unnest(e) AS entity, count(*) AS n_docs FROM c GROUP BY 1""")
def c33_entity_tags(spark, d):
    names = F.array(*[F.lit(w) for w in ("branch manager", "nodal officer", "recovery agent", "credit bureau", "loan officer")])
    docs = table(spark, d, "documents").filter("text is not null").withColumn("low", F.lower("text"))
    return docs.select(F.explode(F.filter(names, lambda w: F.contains(F.col("low"), w))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_docs"))
