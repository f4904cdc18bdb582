"""Queries on answers, the built graph, the change service and replays, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import answers as A
from annalist.operators import eligibility as E
from annalist.operators import evidence as V
from annalist.operators import graph as G
from annalist.operators import linking as L
from annalist.operators import segmentation as S
from annalist.operators import versions
from annalist.plans import answers as plans_answers
from annalist.plans import monitoring, ranking, rules
from annalist.plans.rules import links, log, register
from annalist.sources.shared import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("$REG", rules.REG).replace("$LOG", rules.LOG).replace("$LINKS", rules.LINKS).replace("$PASS", ranking._PASS)
        return f

    return add


@query(plans_answers.SQL["r15_citation_validity"].replace("SELECT request_id, len(", "SELECT request_id, CASE WHEN len(", 1).replace(" AS valid FROM a JOIN v", " THEN 'answer' ELSE 'sentences' END AS shown FROM a JOIN v"))
def r16_fallback(spark, d):
    """An answer that cites what was not retrieved gives way to sentences of the evidence; it is no refusal."""
    return plans_answers.r15_citation_validity(spark, d).select("request_id", F.when(F.col("valid"), "answer").otherwise("sentences").alias("shown"))


_SUBJECT = "list_distinct(list_transform(list_filter(regexp_extract_all(lower($X), '[a-z0-9]+'), lambda w: NOT list_contains(['" + "', '".join(A.PLAIN) + "'], w)), lambda w: regexp_replace(w, 's+$', '')))"


@query(f"""WITH $PASS, x AS (SELECT chunk_id, document_title AS h, {_SUBJECT.replace('$X', 'document_title')} AS a, {_SUBJECT.replace('$X', 'text')} AS b FROM passages WHERE document_title IS NOT NULL)
  SELECT chunk_id, CASE WHEN len(list_filter(a, lambda w: NOT list_contains(b, w))) = 0 THEN h ELSE 'Supporting provisions' END AS heading FROM x""")
def r17_headings(spark, d):
    """Titles as headings over their passages: kept where the passage bears them out."""
    p = ranking.passages(spark, d).filter("document_title is not null")
    return p.select("chunk_id", A.aligned_heading(F.col("document_title"), F.col("text"), F.col("text")).alias("heading"))


@query(rf"""WITH $PASS, p AS (SELECT lower(trim(document_id)) AS id, {ranking._NORM.replace('$X', 'text')} AS t FROM passages), c AS (SELECT DISTINCT link_id, new_id, CASE WHEN trust IN ('APPROVED', 'AUTO_TRUSTED') THEN 'supported' WHEN trust = 'REJECTED' THEN 'not_supported' END AS verdict, {ranking._NORM.replace('$X', 'evidence_quote')} AS q FROM $LINKS),
  f AS (SELECT link_id, verdict, new_id, coalesce(bool_or(length(q) >= 12 AND contains(t, q)), false) AS found FROM c LEFT JOIN p ON p.id = new_id GROUP BY 1, 2, 3)
  SELECT link_id, CASE WHEN new_id IS NULL OR verdict IS NULL THEN 'not_supported' WHEN verdict = 'supported' AND NOT found THEN 'partially_supported' ELSE verdict END AS verdict FROM f""")
def r18_checked_claims(spark, d):
    """Links as claims that cite the new document: what is left of the recorded verdict after the rules."""
    l = links(spark, d).select("link_id", "new_id", "trust", "evidence_quote").distinct()
    l = l.withColumn("verdict", F.when(F.col("trust").isin("APPROVED", "AUTO_TRUSTED"), "supported").when(F.col("trust") == "REJECTED", "not_supported")).withColumn("n_cited", F.col("new_id").isNotNull().cast("int"))
    p = ranking.passages(spark, d).select(F.lower(F.trim("document_id")).alias("id"), "text")
    found = L.quotes_found(l.select("link_id", F.col("new_id").alias("id"), F.col("evidence_quote").alias("quote")), p)
    return l.join(found, "link_id", "left").select("link_id", A.checked(l).alias("verdict"))


@query(r"""WITH $PASS, c AS (SELECT source_url, paragraph_ref, chunk_id, regexp_extract(text, '(?s)^(.*?[.!?])(?:\s|$)', 1) AS s, upper(trim(lifecycle)) AS st, row_number() OVER (PARTITION BY source_url, paragraph_ref ORDER BY chunk_index, chunk_id) AS n FROM passages WHERE source_url IS NOT NULL AND paragraph_ref IS NOT NULL),
  t AS (SELECT source_url, paragraph_ref, n, s || ' [' || chunk_id || ']' || CASE WHEN st = 'AMENDED' THEN ' _(only partly supported by the cited text)_' WHEN st IN ('WITHDRAWN', 'REPEALED', 'SUPERSEDED') THEN ' _(not supported by the cited text)_' ELSE '' END AS l FROM c WHERE n <= 3)
  SELECT source_url, paragraph_ref, '### Direct answer' || chr(10) || chr(10) || max(l) FILTER (n = 1) || coalesce(chr(10) || chr(10) || '### Supporting provisions' || chr(10) || chr(10) || string_agg('- ' || l, chr(10) || chr(10) ORDER BY n) FILTER (n > 1), '') AS markdown FROM t GROUP BY 1, 2""")
def r19_markdown(spark, d):
    """The first three passages of each provision as an answer: their first sentences, with citations, flagged by status."""
    by = Window.partitionBy("source_url", "paragraph_ref").orderBy("chunk_index", "chunk_id")
    p = ranking.passages(spark, d).filter("source_url is not null and paragraph_ref is not null").withColumn("place", F.row_number().over(by)).filter("place <= 3")
    support = F.when(E.status(F.col("lifecycle")) == "AMENDED", "partially_supported").when(E.status(F.col("lifecycle")).isin(*versions.NON_OPERATIVE), "not_supported")
    c = p.select("source_url", "paragraph_ref", "place", F.regexp_extract("text", r"(?s)^(.*?[.!?])(?:\s|$)", 1).alias("text"), F.array("chunk_id").alias("citations"), support.alias("support"))
    return A.markdown(c, ["source_url", "paragraph_ref"])


@query("""SELECT doc_id, substr(title, 1, 20) AS said FROM documents WHERE title IS NOT NULL AND NOT contains(title, '"') AND NOT contains(title, chr(92)) AND length(title) > 20""")
def c29_partial_answers(spark, d):
    """Titles as direct answers whose writing has come to the twentieth character."""
    t = table(spark, d, "documents").filter("title is not null and not contains(title, '\"') and not contains(title, char(92)) and length(title) > 20")
    said = F.concat(F.lit('{"status": "grounded", "direct_answer": {"title": "A \\"B\\"", "text": "'), F.substring("title", 1, 20), F.lit("\\u00"))
    return t.select("doc_id", A.partial_answer(said).alias("said"))


@query(r"SELECT CAST(doc_id AS VARCHAR) AS document_id, array_to_string(regexp_extract_all(text, '\S+'), ' ') AS text FROM documents WHERE regexp_matches(text, '\S')")
def x21_reassembled(spark, d):
    """Texts put together again from their overlapping windows."""
    pages = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), "text")
    return A.reassembled(S.window_chunks(pages, 120, 20), "document_id", "chunk_index", "text", 20)[0]


_ALIASES = "(VALUES " + ", ".join(f"({i}, '{e}', '{a}')" for i, (e, a) in enumerate([*monitoring.ALIASES, ("depositor", "bank"), ("bank", "bank")])) + ") a(place, entity, alias)"


@query(rf"""WITH n AS (SELECT DISTINCT unnest(applicable_entities) AS name FROM $REG), k AS (SELECT trim(regexp_replace(lower(alias), '[^a-z0-9-]+', ' ', 'g')) AS k, min_by(entity, place) AS entity FROM {_ALIASES} GROUP BY 1)
  SELECT name, entity FROM n LEFT JOIN k ON k = trim(regexp_replace(lower(name), '[^a-z0-9-]+', ' ', 'g'))""")
def c8_resolved(spark, d):
    """The entities that names stand for, by the first alias in the list."""
    a = spark.createDataFrame([(e, x, i) for i, (e, x) in enumerate([*monitoring.ALIASES, ("depositor", "bank"), ("bank", "bank")])], "entity string, alias string, place int")
    return A.resolved(register(spark, d).select(F.explode("applicable_entities").alias("name")).distinct(), "name", a)


@query(rf"""WITH $PASS, e(entity, alias) AS (VALUES {", ".join(f"('{e}', '{a}')" for e, a in monitoring.ALIASES)}), t AS (SELECT chunk_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t, ' ' || trim(regexp_replace(lower(document_title), '[^a-z0-9]+', ' ', 'g')) || ' ' AS h FROM passages),
  p AS (SELECT chunk_id, entity, bool_or(contains(t, ' ' || alias || ' ')) AS in_text, coalesce(bool_or(contains(h, ' ' || alias || ' ')), false) AS in_title FROM t CROSS JOIN e GROUP BY 1, 2)
  SELECT entity, CASE WHEN in_text THEN 'named in the passage' WHEN in_title THEN 'named in the title' ELSE 'not named' END AS outcome, count(*) AS n FROM p GROUP BY 1, 2""")
def g5_admission(spark, d):
    """Proposed edges from every passage to every entity of the list: admitted if the passage or its document's title names the entity."""
    aliases = spark.createDataFrame(monitoring.ALIASES, "entity string, alias string")
    p = ranking.passages(spark, d)
    hit = lambda c, n: L.mentions(p.filter(F.col(c).isNotNull()), "chunk_id", c, aliases).withColumn(n, F.lit(True))
    both = hit("text", "in_text").join(hit("document_title", "in_title"), ["chunk_id", "entity"], "full_outer")
    named = both.groupBy("entity", F.when(F.col("in_text"), "named in the passage").otherwise("named in the title").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    n = p.agg(F.count(F.lit(1)).alias("n_all"))
    rest = aliases.select("entity").distinct().join(named.groupBy("entity").agg(F.sum("n").alias("n")), "entity", "left").crossJoin(F.broadcast(n))  # one row
    rest = rest.select("entity", F.lit("not named").alias("outcome"), (F.col("n_all") - F.coalesce("n", F.lit(0))).alias("n")).filter("n > 0")
    return named.unionByName(rest)


@query(rf"""WITH $PASS, d AS (SELECT unnest(regexp_extract_all(text, '{V.MEANS}', 1)) AS term FROM passages)
  SELECT 'Document' AS type, count(*) AS n FROM $REG WHERE id IS NOT NULL UNION ALL SELECT 'Authority', count(DISTINCT issuing_authority) FROM $REG UNION ALL SELECT 'Provision', count(*) FROM passages WHERE regexp_matches(paragraph_ref, '^\d{{1,3}}$')
  UNION ALL SELECT 'DefinedTerm', count(DISTINCT trim(regexp_replace(lower(term), '[^a-z0-9]+', ' ', 'g'))) FROM d""")
def g1_graph_nodes(spark, d):
    """Nodes of the provenance graph by type."""
    r, p = register(spark, d), ranking.passages(spark, d)
    one = lambda df, t: df.agg(F.lit(t).alias("type"), F.count(F.lit(1)).alias("n"))
    parts = [one(r.filter("id is not null"), "Document"), one(r.select("issuing_authority").dropna().distinct(), "Authority"), one(p.filter(F.col("paragraph_ref").rlike(r"^\d{1,3}$")), "Provision"), one(p.select(F.explode(V.definitions(F.col("text"))).alias("t")).distinct(), "DefinedTerm")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""WITH RECURSIVE {ranking._EDGE}, b AS (SELECT DISTINCT source AS a, target AS b FROM e UNION SELECT DISTINCT target, source FROM e), r AS (SELECT DISTINCT a AS id, a AS root FROM b UNION SELECT b.b, r.root FROM r JOIN b ON b.a = r.id)
  SELECT component, count(*) AS n_nodes FROM (SELECT id, min(root) AS component FROM r GROUP BY 1) GROUP BY 1""")
def g10_components(spark, d):
    return G.components(ranking.edges(spark, d).select("source", "target")).groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


_M1 = rules._DIFF.replace("WITH t AS", rules._OBS + ", oo AS (SELECT *, CAST(sum(CASE WHEN change <> 'UNCHANGED' THEN 1 ELSE 0 END) OVER (PARTITION BY canonical_url ORDER BY recorded_at, version_id) AS BIGINT) AS version_no FROM c), t AS", 1)


@query(_M1 + """ SELECT oo.version_id, change, version_no, CASE WHEN change = 'MODIFIED' AND len(nums) + len(dats) > 0 THEN 'HIGH' ELSE 'MEDIUM' END AS materiality, coalesce(CAST(n_added AS INT), 0) AS n_added, coalesce(CAST(n_removed AS INT), 0) AS n_removed,
    'update_' || substr(sha256(concat_ws(':', canonical_url, version_no::VARCHAR, coalesce(oo.h, ''))), 1, 20) AS update_id FROM oo LEFT JOIN r USING (version_id) WHERE change <> 'UNCHANGED'""")
def m1_updates(spark, d):
    """The change service over the whole log: what each check found new, as versions with their differences and updates."""
    w = Window.partitionBy("canonical_url").orderBy("recorded_at", "version_id")
    t = log(spark, d).withColumn("ph", F.lag("h").over(w)).withColumn("ptxt", F.lag("txt").over(w))
    o = versions.observed(t, "canonical_url", [F.asc("recorded_at"), F.asc("version_id")], "h").filter("change <> 'UNCHANGED'")
    x = o.withColumn("x", F.when(F.col("ptxt").isNotNull() & F.col("txt").isNotNull() & ~F.col("h").eqNullSafe(F.col("ph")), versions.diff(F.col("ptxt"), F.col("txt"))))
    size = lambda c: F.coalesce(F.when(F.col("x").isNotNull(), F.size(c)), F.lit(0))
    big = (F.col("change") == "MODIFIED") & F.coalesce(versions.materiality(F.col("x")) == "HIGH", F.lit(False)) & F.col("x").isNotNull()
    ident = T.stable_id("update_", 20, F.col("canonical_url"), F.col("version_no").cast("string"), F.coalesce("h", F.lit("")))
    return x.select("version_id", "change", "version_no", F.when(big, "HIGH").otherwise("MEDIUM").alias("materiality"), size("x.added").alias("n_added"), size("x.removed").alias("n_removed"), ident.alias("update_id"))


@query("""WITH m AS (SELECT date_trunc('month', created_at)::DATE AS month, count(*) AS n, count(*) FILTER (trust = 'AUTO_TRUSTED') AS n_auto, count(*) FILTER (relation = 'CANDIDATE') AS n_candidates FROM $LINKS WHERE created_at IS NOT NULL GROUP BY 1)
  SELECT month, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(n_auto) OVER w AS BIGINT) AS n_auto, CAST(sum(n_candidates) OVER w AS BIGINT) AS n_candidates, round(sum(n_auto) OVER w / sum(n) OVER w, 6) AS auto_share FROM m WINDOW w AS (ORDER BY month)""")
def m20_replay(spark, d):
    """The links known at the end of each month of the replay, with what was trusted by rule and what was only guessed."""
    m = links(spark, d).filter("created_at is not null").groupBy(F.trunc(F.to_date("created_at"), "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("trust") == "AUTO_TRUSTED").alias("n_auto"), F.count_if(F.col("relation") == "CANDIDATE").alias("n_candidates"))
    w = Window.orderBy("month")  # a row per month
    upto = lambda c: F.sum(c).over(w)
    return m.select("month", upto("n").alias("n"), upto("n_auto").alias("n_auto"), upto("n_candidates").alias("n_candidates"), F.round(upto("n_auto") / upto("n"), 6).alias("auto_share"))


@query(r"""WITH $PASS, q AS (SELECT chunk_id, document_id, paragraph_ref, text FROM passages WHERE regexp_matches(paragraph_ref, '^\d{1,3}$') AND length(text) > 200 AND length(text) < 4000 AND upper(trim(lifecycle)) = 'ACTIVE' AND document_id IS NOT NULL)
  SELECT a.chunk_id AS source, b.chunk_id AS target FROM (SELECT DISTINCT chunk_id, document_id, unnest(regexp_extract_all(text, '(?i:paragraph)\s+(\d{1,3})\b', 1)) AS label FROM q) a JOIN q b ON b.document_id = a.document_id AND b.paragraph_ref = a.label AND a.chunk_id <> b.chunk_id""")
def x20_question_pairs(spark, d):
    """Pairs of current paragraphs of a fit size of which one names the other: what two-step questions are drafted from."""
    q = ranking.passages(spark, d).filter(F.col("paragraph_ref").rlike(r"^\d{1,3}$") & (F.length("text") > 200) & (F.length("text") < 4000) & (E.status(F.col("lifecycle")) == "ACTIVE") & F.col("document_id").isNotNull())
    a = q.select(F.col("chunk_id").alias("source"), "document_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?i:paragraph)\s+(\d{1,3})\b"), F.lit(1))).alias("label")).distinct()
    return a.join(q.select(F.col("chunk_id").alias("target"), "document_id", F.col("paragraph_ref").alias("label")), ["document_id", "label"]).filter("source <> target").select("source", "target")


@query("""SELECT count(*) AS n, round(count(*) FILTER (trust = 'AUTO_TRUSTED') / count(*), 6) AS auto_share, round(count(*) FILTER (relation = 'CANDIDATE') / count(*), 6) AS candidate_share, CAST(max(greatest(0, w.in_force_from - CAST(l.created_at AS DATE))) AS INT) AS most_days
  FROM $LINKS l LEFT JOIN $REG w ON w.id = l.new_id""")
def e10_replay_report(spark, d):
    w = register(spark, d).filter("id is not null").select(F.col("id").alias("new_id"), "in_force_from")
    l = links(spark, d).join(w, "new_id", "left")
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 6)
    days = F.max(F.when(F.col("in_force_from").isNotNull() & F.col("created_at").isNotNull(), F.greatest(F.lit(0), F.datediff("in_force_from", F.to_date("created_at")))))
    return l.agg(F.count(F.lit(1)).alias("n"), share(F.col("trust") == "AUTO_TRUSTED").alias("auto_share"), share(F.col("relation") == "CANDIDATE").alias("candidate_share"), days.alias("most_days"))


@query(r"""WITH $PASS, s AS (SELECT chunk_id, unnest(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(lower(x), '\b(?:must|shall|requires|required to|is required to)\b'))) AS s, text FROM passages),
  n AS (SELECT chunk_id, s, CAST(regexp_matches(lower(text), '\bnbfc\b') AS INT) + CAST(regexp_matches(lower(text), '\bbank\b') AS INT) + CAST(regexp_matches(lower(text), '\bregulated entities\b') AS INT) AS k FROM s)
  SELECT 'REQUIRES' AS type, 0.72::DOUBLE AS confidence, count(*) AS n, count(DISTINCT chunk_id) AS n_chunks FROM n UNION ALL SELECT 'APPLIES_TO', 0.66, CAST(sum(k) AS BIGINT), count(DISTINCT chunk_id) FILTER (k > 0) FROM n
  UNION ALL SELECT 'ISSUED_BY', 0.95, count(*), count(DISTINCT chunk_id) FROM passages WHERE regexp_matches(lower(text), '\bdepartment\b')""")
def g21_extracted(spark, d):
    """Edges that fixed words give, by type (the authority being called 'department' in these texts)."""
    from annalist.operators.extensions import extension

    p = ranking.passages(spark, d).select("chunk_id", F.coalesce("document_title", F.lit("")).alias("title"), "text")
    return extension("extractor", "words")(p, ["department"]).groupBy("type", "confidence").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("n_chunks"))


@query("""SELECT 'updates' AS step, 'done' AS status, (SELECT count(*) FROM (""" + SQL["m1_updates"] + """)) AS n UNION ALL SELECT 'register', 'done', (SELECT count(*) FROM $REG WHERE id IN (SELECT lower(trim(document_id)) FROM removed_documents WHERE removed_at IS NOT NULL)) UNION ALL SELECT 'broken', 'failed', NULL""")
def m18_runner(spark, d):
    """The steps of a run in order; one that fails does not stop the others."""
    from annalist.operators.extensions import run_steps

    steps = {"updates": lambda: m1_updates(spark, d), "register": lambda: plans_answers.m15_register_applied(spark, d), "broken": lambda: table(spark, d, "no_such_table")}
    return run_steps(spark, steps).drop("error")
