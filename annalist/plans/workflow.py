"""Queries on states and their changes, statements of documents, listings, projections and reports, with their SQL.

Where the tables print no statement of a kind, its text is made from the register's columns, so the columns themselves say what must be read.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import eligibility as E
from annalist.operators import evidence as V
from annalist.operators import linking as L
from annalist.operators import pages as P
from annalist.operators import segmentation as S
from annalist.operators import statements as ST
from annalist.operators import versions
from annalist.operators import workflow as W
from annalist.plans import ranking, rules
from annalist.plans.rules import TODAY, links, log, register
from annalist.sources.shared import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("$TODAY", f"DATE '{TODAY}'").replace("$REG", rules.REG).replace("$LOG", rules.LOG).replace("$LINKS", rules.LINKS).replace("$PASS", ranking._PASS)
        return f

    return add


def _gone(spark, d):
    return table(spark, d, "removed_documents").filter("document_id is not null").groupBy(F.lower(F.trim("document_id")).alias("document_id")).agg(F.max("removed_at").alias("valid_to"))


_GONE = "(SELECT lower(trim(document_id)) AS gid, max(removed_at) AS gone_at FROM removed_documents WHERE document_id IS NOT NULL GROUP BY 1)"


# states


@query(f"""SELECT chunk_id, CASE WHEN gid IS NOT NULL THEN false ELSE is_current END AS is_current, CASE WHEN gid IS NOT NULL THEN 'WITHDRAWN' ELSE lifecycle END AS lifecycle, CASE WHEN gid IS NOT NULL THEN false ELSE authority_current END AS authority_current,
  CAST(floor(epoch(coalesce(gone_at, valid_to))) AS BIGINT) AS valid_to_s FROM (SELECT DISTINCT * FROM chunks) LEFT JOIN {_GONE} ON gid = lower(trim(document_id))""")
def s7_patch_by_document(spark, d):
    """Chunks of removed documents are no longer current, and end when the document went."""
    c = table(spark, d, "chunks").distinct().select("chunk_id", F.lower(F.trim("document_id")).alias("document_id"), "is_current", "lifecycle", "authority_current", "valid_to")
    p = _gone(spark, d).select("document_id", F.lit(False).alias("is_current"), F.lit("WITHDRAWN").alias("lifecycle"), F.lit(False).alias("authority_current"), "valid_to")
    out = W.patch_by(c, p, "document_id", ["is_current", "lifecycle", "authority_current", "valid_to"])
    return out.select("chunk_id", "is_current", "lifecycle", "authority_current", F.unix_seconds("valid_to").alias("valid_to_s"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE WHEN value > 50 THEN 'high' END AS level, 1 AS v FROM events")
def s14_json_patch(spark, d):
    """Objects with some values set anew; a null changes nothing."""
    e = table(spark, d, "events").withColumn("p", W.patch_json(F.col("props"), {"level": F.when(F.col("value") > 50, "high"), "v": F.lit(1)}))
    get = lambda k: F.get_json_object("p", f"$.{k}")
    return e.select("event_id", get("k").cast("int").alias("k"), get("level").alias("level"), get("v").cast("int").alias("v"))


@query("""WITH x AS (SELECT id, st, CAST(last_checked_at AS DATE) AS seen FROM $REG), j AS (SELECT c.*, x.st, x.seen FROM (SELECT DISTINCT * FROM chunks) c LEFT JOIN x ON x.id = lower(trim(c.document_id)) AND x.st IS NOT NULL)
  SELECT chunk_id, coalesce(st, lifecycle) AS lifecycle, CASE WHEN st IS NOT NULL THEN st IN ('ACTIVE', 'AMENDED') ELSE authority_current END AS authority_current, CASE WHEN st IN ('WITHDRAWN', 'REPEALED', 'SUPERSEDED') THEN coalesce(in_force_to, seen) ELSE in_force_to END AS in_force_to FROM j""")
def m8_propagated(spark, d):
    """Each chunk with the status of its document, and the end that a status without rule brings."""
    c = table(spark, d, "chunks").distinct().select("chunk_id", F.lower(F.trim("document_id")).alias("document_id"), "lifecycle", "authority_current", "in_force_to")
    r = register(spark, d).filter("st is not null").select(F.col("id").alias("document_id"), F.col("st").alias("status"), F.to_date("last_checked_at").alias("checked_on"))
    return W.propagated(c, r).drop("document_id")


@query("""SELECT id, wanted, CASE WHEN r IS NULL THEN 'unknown document' WHEN st IN ('WITHDRAWN', 'REPEALED', 'SUPERSEDED') THEN 'official status stands' ELSE 'approved' END AS outcome
  FROM (SELECT DISTINCT old_id AS id, 'ACTIVE' AS wanted FROM $LINKS WHERE trust = 'REVIEW_REQUIRED' AND old_id IS NOT NULL) LEFT JOIN (SELECT id AS r, st FROM $REG WHERE id IS NOT NULL) ON r = id""")
def m9_approvals(spark, d):
    """Approving every document under review: what official evidence allows."""
    asked = links(spark, d).filter("trust = 'REVIEW_REQUIRED' and old_id is not null").select(F.col("old_id").alias("id"), F.lit("ACTIVE").alias("wanted")).distinct()
    return W.approvals(asked, register(spark, d).filter("id is not null").select("id", F.col("st").alias("status")))


@query("""SELECT link_id, old_id, new_id, CASE WHEN dead OR relation IS DISTINCT FROM 'CANDIDATE' THEN relation ELSE 'SUPERSEDES' END AS relation, CASE WHEN dead OR relation IS DISTINCT FROM 'CANDIDATE' THEN scope ELSE 'WHOLE' END AS scope, CASE WHEN dead THEN trust ELSE 'APPROVED' END AS trust
  FROM (SELECT DISTINCT link_id, old_id, new_id, relation, scope, trust, coalesce(st IN ('WITHDRAWN', 'REPEALED', 'SUPERSEDED'), false) AS dead FROM $LINKS LEFT JOIN (SELECT id AS r, st FROM $REG WHERE id IS NOT NULL) ON r = new_id WHERE trust = 'REVIEW_REQUIRED')""")
def m14_approved_links(spark, d):
    r = register(spark, d).filter("id is not null").select(F.col("id").alias("new_id"), "st")
    l = links(spark, d).filter("trust = 'REVIEW_REQUIRED'").select("link_id", "old_id", "new_id", "relation", "scope", "trust").distinct().join(r, "new_id", "left")
    return W.approved_links(l, "st").drop("st")


@query("""WITH q AS (SELECT old_id AS qid, list(DISTINCT evidence_quote) AS qs FROM $LINKS WHERE trust = 'REJECTED' AND evidence_quote IS NOT NULL AND old_id IS NOT NULL GROUP BY 1)
  SELECT id, CASE WHEN st = 'SUPERSEDED' AND coalesce(list_contains(qs, status_evidence_excerpt), false) THEN 'REVIEW_REQUIRED' ELSE st END AS status, CASE WHEN qid IS NULL THEN in_force_to END AS in_force_to, qid IS NOT NULL AS reopened FROM $REG LEFT JOIN q ON qid = id""")
def m13_reverted(spark, d):
    """Documents after all rejected links were undone."""
    r = register(spark, d).select("id", F.col("st").alias("status"), F.col("status_evidence_excerpt").alias("evidence"), "in_force_to")
    l = links(spark, d).filter("trust = 'REJECTED' and evidence_quote is not null and old_id is not null")
    return W.reverted(r, l.select(F.col("old_id").alias("id"), F.col("evidence_quote").alias("quote")))


@query("SELECT canonical_url, version_id, 1 AS version FROM $LOG QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY valid_from DESC NULLS LAST, version_id DESC) = 1")
def m17_reset(spark, d):
    """The newest version of each page becomes its first."""
    return W.reset(log(spark, d).select("canonical_url", "version_id", "valid_from"), "canonical_url", F.col("valid_from").desc_nulls_last(), F.desc("version_id")).select("canonical_url", "version_id", "version")


@query("SELECT source_id, version_id FROM $LOG QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY recorded_at DESC NULLS LAST, version_id DESC) = 1")
def w2_latest_check(spark, d):
    """Per source the check that was written last, whatever time it speaks of."""
    return E.latest_by(log(spark, d).select("source_id", "version_id", "recorded_at"), ["source_id"], F.col("recorded_at").desc_nulls_last(), F.desc("version_id")).select("source_id", "version_id")


@query("SELECT canonical_url, version_id FROM (SELECT DISTINCT canonical_url, version_id, recorded_at FROM doc_versions WHERE is_current) QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY recorded_at DESC NULLS LAST, version_id DESC) = 1")
def w3_current_version(spark, d):
    """The last version of each page that was written as current."""
    v = table(spark, d, "doc_versions").filter("is_current").select("canonical_url", "version_id", "recorded_at").distinct()
    return E.latest_by(v, ["canonical_url"], F.col("recorded_at").desc_nulls_last(), F.desc("version_id")).select("canonical_url", "version_id")


@query("WITH $PASS SELECT chunk_id, paragraph_ref || CASE WHEN n > 1 THEN '~' || n ELSE '' END AS label FROM (SELECT chunk_id, paragraph_ref, row_number() OVER (PARTITION BY document_id, paragraph_ref ORDER BY chunk_index, chunk_id) AS n FROM passages WHERE paragraph_ref IS NOT NULL)")
def w8_label_occurrences(spark, d):
    """Repeated labels of a document are told apart by their occurrence."""
    n = F.row_number().over(Window.partitionBy("document_id", "paragraph_ref").orderBy("chunk_index", "chunk_id"))
    p = ranking.passages(spark, d).filter("paragraph_ref is not null").select("chunk_id", "paragraph_ref", n.alias("n"))
    return p.select("chunk_id", F.concat("paragraph_ref", F.when(F.col("n") > 1, F.concat(F.lit("~"), F.col("n").cast("string"))).otherwise("")).alias("label"))


_NOTICE = """n AS (SELECT r.id, CASE WHEN r.st IN ('WITHDRAWN', 'REPEALED', 'SUPERSEDED') AND coalesce(s.in_force_from <= $TODAY, false) THEN 'replaced' WHEN r.st IN ('WITHDRAWN', 'REPEALED', 'SUPERSEDED') THEN 'withdrawn'
  WHEN r.in_force_from > $TODAY THEN 'upcoming' END AS kind FROM $REG r LEFT JOIN $REG s ON s.id = lower(trim(r.successor_document_id)))"""


@query(f"""WITH {_NOTICE}, a AS (SELECT DISTINCT request_id, lower(trim(document_id)) AS id FROM query_requests q JOIN (SELECT DISTINCT source_url, paragraph_ref, document_id FROM chunks) c USING (source_url, paragraph_ref))
  SELECT request_id, id, kind FROM a JOIN n USING (id) WHERE kind IS NOT NULL QUALIFY kind <> 'withdrawn' OR row_number() OVER (PARTITION BY request_id, kind ORDER BY id) = 1""")
def w16_notices_per_answer(spark, d):
    """The notices on the documents behind an answer, a withdrawal at most once."""
    r = register(spark, d)
    s = r.select(F.col("id").alias("sid"), F.col("in_force_from").alias("starts"))
    n = r.join(s, F.lower(F.trim("successor_document_id")) == F.col("sid"), "left").select("id", V.notice(F.col("st"), F.col("in_force_from"), F.col("starts"), F.lit(TODAY)).alias("kind")).filter("kind is not null")
    c = table(spark, d, "chunks").select("source_url", "paragraph_ref", "document_id").distinct()
    a = table(spark, d, "query_requests").join(c, ["source_url", "paragraph_ref"]).select("request_id", F.lower(F.trim("document_id")).alias("id")).distinct().join(n, "id")
    k = F.row_number().over(Window.partitionBy("request_id", "kind").orderBy("id"))
    return a.withColumn("k", k).filter("kind <> 'withdrawn' or k = 1").select("request_id", "id", "kind")


# statements


@query("SELECT id, in_force_from AS starts FROM $REG WHERE in_force_from IS NOT NULL")
def x12_commencement(spark, d):
    """The day that a clause on the document as a whole states; a paragraph's own day before it and one at once after it are not it."""
    r = register(spark, d).filter("in_force_from is not null")
    said = F.concat(F.lit("Paragraph 6 is effective from May 1, 1999. These Directions shall come into\nforce from "), F.date_format("in_force_from", "MMMM d, yyyy"), F.lit(" for all banks. This circular shall be applicable with immediate effect."))
    return r.select("id", ST.commencement(said).alias("starts"))


_KEY = r"regexp_replace(regexp_replace(upper(regexp_replace(regexp_replace($R, '(?i)[.\s]*\bNo\.\s*', '.', 'g'), '\s+', '', 'g')), '\.{2,}', '.', 'g'), '\b(\d{4})-\d{2}(\d{2})\b', '\1-\2', 'g')"
_PRINTED = f"regexp_full_match(document_identifier, '{S.SERIES}') OR regexp_full_match(document_identifier, '{S.DEPARTMENT}')"


def _printed(spark, d):
    number = F.col("document_identifier")
    return register(spark, d).filter(number.rlike(f"^(?:{S.SERIES})$") | number.rlike(f"^(?:{S.DEPARTMENT})$"))


@query(f"""SELECT id, t.n AS row_no, {_KEY.replace('$R', 'document_identifier')} AS target, publication_date AS dated, trim(title) AS title FROM $REG, (VALUES (1), (2)) t(n)
  WHERE ({_PRINTED}) AND publication_date IS NOT NULL AND trim(title) <> '' AND NOT contains(title, chr(10)) AND NOT regexp_matches(title, '^\\s*\\d+\\.\\s*$')""")
def x13_repealed_rows(spark, d):
    """Annexes that list a document twice, and a note after the table that is no row."""
    r = _printed(spark, d).filter(r"publication_date is not null and trim(title) <> '' and not contains(title, '\n') and not title rlike '^\\s*\\d+\\.\\s*$'")
    row = lambda n: F.concat(F.lit(f"{n}.\n"), "document_identifier", F.lit("\n"), F.date_format("publication_date", "dd.MM.yyyy"), F.lit("\n"), "title", F.lit("\n\n"))
    body = F.concat(F.lit("1. Repeal\nAnnex I: List of circulars repealed\nS.No.\nCircular No.\nDate\nSubject\n"), row(1), row(2), F.lit("See also CCA/1999-00/1 dated 01.01.1999.\n"))
    return ST.repealed_rows(r.select("id", body.alias("text")), "id", "text").select("id", "row_no", F.get("targets", F.lit(0)).alias("target"), "dated", "title")


@query(f"""SELECT r.id, {_KEY.replace('$R', 's.document_identifier')} AS target FROM $REG r JOIN (SELECT * FROM $REG WHERE {_PRINTED}) s ON s.id = lower(trim(r.successor_document_id))""")
def x15_replacements(spark, d):
    """What old documents say replaced them, by number."""
    s = _printed(spark, d).select(F.col("id").alias("sid"), F.col("document_identifier").alias("number"))
    r = register(spark, d).join(s, F.lower(F.trim("successor_document_id")) == F.col("sid"))
    said = F.concat(F.lit("Circular CCA/1999-00/1 is cited here.\nThis Master Circular on lending stands superseded by "), "number", F.lit(" dated May 8, 2025. See the site."))
    return ST.replacements(r.select("id", said.alias("text")), "id", "text").select("id", F.get("targets", F.lit(0)).alias("target"))


@query("SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS base FROM $REG WHERE length(title) >= 10 AND length(title) < 200 AND NOT contains(title, chr(10)) AND NOT starts_with(lower(title), 'the ')")
def x16_amendment_base(spark, d):
    r = register(spark, d).filter(r"length(title) >= 10 and length(title) < 200 and not contains(title, '\n') and not startswith(lower(title), 'the ')")
    said = F.concat(F.lit("Amendment Directions\nPlease refer to the "), "title", F.lit(" (Updated as on May 1, 2024) (hereinafter 'the Directions'). The Directions are amended."))
    return r.select("id", F.regexp_replace(ST.amendment_base(said), r"\s+", " ").alias("base"))


@query("SELECT id, CAST(1 AS INT) AS row_no, trim(regexp_replace(document_identifier, '\\s+', ' ', 'g')) AS number, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, publication_date AS issued, split_part(source_url, '#', 1) AS url FROM $REG WHERE document_identifier IS NOT NULL AND title IS NOT NULL AND publication_date IS NOT NULL AND source_url <> ''")
def x17_register_rows(spark, d):
    """A register's page: only rows of four cells are entries."""
    r = register(spark, d).filter("document_identifier is not null and title is not null and publication_date is not null and source_url <> ''")
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    page = F.concat(F.lit("<table><tr><th>No</th></tr><TR class=x><td>1</td><td><a href='"), esc("source_url"), F.lit("#top'>"), esc("document_identifier"), F.lit("</a></td><td><b>"), esc("title"), F.lit("</b></td><td> "), F.date_format("publication_date", "MMMM d, yyyy"), F.lit("</td></TR><tr><td>end</td></tr></table>"))
    rows = ST.register_rows(r.select("id", page.alias("page")), "id", "page")
    return rows.select("id", F.lit(1).alias("row_no"), "number", "title", "issued", "url")


@query("SELECT source_url AS page_id, id FROM $REG WHERE source_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY title NULLS FIRST, id) = 1")
def x18_index_entries(spark, d):
    r = register(spark, d).filter("source_url is not null").select(F.col("source_url").alias("page_id"), "id", "title")
    return ST.index_entries(r, F.col("title").asc_nulls_first(), F.col("id")).select("page_id", "id")


_CORE = r"lower(trim(regexp_replace(translate($X, '–—', '--'), '\s+', ' ', 'g')))"


@query(f"""WITH e AS (SELECT id AS page_id, {_CORE.replace('$X', 'title')} AS core, page_count * 100.0 AS kb, publication_date AS day FROM $REG WHERE title IS NOT NULL AND page_count IS NOT NULL),
  f AS (SELECT id AS file_id, 'directions of ' || {_CORE.replace('$X', 'title')} || ' for all' AS printed, page_count * 101.0 AS kb, publication_date AS day FROM $REG WHERE title IS NOT NULL AND page_count IS NOT NULL),
  m AS (SELECT file_id, page_id, core FROM f JOIN e ON f.day IS NOT DISTINCT FROM e.day AND contains(printed, core) AND e.kb > 0 AND abs(f.kb - e.kb) <= e.kb * 0.03),
  b AS (SELECT *, max(length(core)) OVER (PARTITION BY file_id) AS longest FROM m) SELECT file_id, min(page_id) AS page_id FROM b WHERE length(core) = longest GROUP BY 1 HAVING count(DISTINCT page_id) = 1""")
def x19_matched_files(spark, d):
    """Files whose title, size and date fit exactly one entry of the index."""
    r = register(spark, d).filter("title is not null and page_count is not null")
    files = r.select(F.col("id").alias("file_id"), F.concat(F.lit("Directions of "), "title", F.lit(" for all")).alias("title_text"), (F.col("page_count") * 101.0).alias("size_kb"), F.col("publication_date").alias("updated_on"))
    return ST.matched_files(files, r.select(F.col("id").alias("page_id"), "title", (F.col("page_count") * 100.0).alias("size_kb"), F.col("publication_date").alias("updated_on")))


@query(f"SELECT id, {_CORE.replace('$X', 'title')} AS core FROM $REG WHERE title IS NOT NULL")
def c15_core_titles(spark, d):
    return register(spark, d).filter("title is not null").select("id", ST.core_title(F.concat("title", F.lit(" (Updated as on May 1, 2024)"))).alias("core"))


@query(r"""WITH $PASS, p AS (SELECT chunk_id, text, instr(text, 'shall') - 1 AS pos FROM passages WHERE contains(text, 'shall')), s AS (SELECT chunk_id, regexp_extract(substr(text, 1, pos), '(?s)^(?:.*(?:\n|\. ))?(.*)$', 1) AS b, substr(text, pos + 1) AS a FROM p),
  c AS (SELECT chunk_id, b, a, CASE WHEN instr(a, chr(10)) = 0 THEN 100000000 ELSE instr(a, chr(10)) END AS nl, CASE WHEN instr(a, '. ') = 0 THEN 100000000 ELSE instr(a, '. ') END AS dot FROM s)
  SELECT chunk_id, regexp_replace(b || substr(a, 1, least(nl, dot)), '^\s+|\s+$', '', 'g') AS sentence FROM c""")
def c10_sentence_around(spark, d):
    """The sentence around the first 'shall' of each passage."""
    p = ranking.passages(spark, d).filter(F.contains("text", F.lit("shall")))
    return p.select("chunk_id", ST.sentence_at(F.col("text"), F.instr("text", "shall") - 1).alias("sentence"))


_KW = "list_filter(list_distinct(regexp_extract_all(lower($X), '[a-z0-9]{3,}')), lambda x: NOT list_contains(['" + "', '".join(T.KEYWORD_STOPS) + "'], x))"


@query(rf"""WITH $PASS, s AS (SELECT chunk_id, document_title, text, list_filter(list_transform(string_split(regexp_replace(text, '([.;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM passages WHERE document_title IS NOT NULL),
  u AS (SELECT chunk_id, document_title, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM s)
  SELECT chunk_id, substr(s, 1, 400) AS sentence FROM u QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY len(list_intersect({_KW.replace('$X', 'document_title')}, {_KW.replace('$X', 's')})) DESC, i) = 1""")
def c13_matching_sentence(spark, d):
    p = ranking.passages(spark, d).filter("document_title is not null")
    return p.select("chunk_id", ST.matching_sentence(F.col("text"), F.col("document_title")).alias("sentence"))


@query("SELECT source_id, array_to_string(list_transform(string_split(source_id, '_'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS title FROM reg_sources")
def c22_titles_from_names(spark, d):
    return table(spark, d, "reg_sources").select("source_id", ST.title_from_name(F.concat("source_id", F.lit(".pdf"))).alias("title"))


@query("""SELECT version_id, CASE WHEN change = 'NEW' THEN 'A document that was not known before' ELSE 'Change ' || version_no || ' of a known document' END || ': ' || coalesce(title, 'untitled') AS summary FROM ("""
  + rules._OBS + """ SELECT version_id, title, change, CAST(sum(CASE WHEN change <> 'UNCHANGED' THEN 1 ELSE 0 END) OVER (PARTITION BY canonical_url ORDER BY recorded_at, version_id) AS BIGINT) AS version_no FROM c) WHERE change <> 'UNCHANGED'""")
def c32_summaries(spark, d):
    o = rules._observed(spark, d).filter("change <> 'UNCHANGED'")
    said = F.when(F.col("change") == "NEW", F.lit("A document that was not known before")).otherwise(F.format_string("Change %d of a known document", "version_no"))
    return o.select("version_id", F.concat_ws(": ", said, F.coalesce("title", F.lit("untitled"))).alias("summary"))


# pages and lists

_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]+"


@query(rf"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '{_SPACE}', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def x1_page_text(spark, d):
    """Each document as a web page with navigation, scripts and struck-out wording, and its text read from that."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("</p>"))), "<del>old wording</del>")
    page = F.concat(F.lit("<html><head><style>p {color: red}</style></head><body><nav>Home</nav><div id='Content'>"), lines, F.lit("<span style='text-decoration:line-through'>gone</span></div><script>if (1 < 2) run()</script><footer>Contact</footer>"))
    return P.pages_to_text(table(spark, d, "documents").filter("text is not null").select("doc_id", page.alias("page")), "doc_id", "page")


@query("SELECT id, source_url AS url, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, CAST(0 AS INT) AS place FROM $REG WHERE regexp_matches(source_url, '^[a-z]+://[^''\"<>&]+$') AND trim(title) <> '' AND NOT regexp_matches(title, '[<>&]')")
def s24_listed_links(spark, d):
    """Listings that name a page twice, and something else."""
    r = register(spark, d).filter(F.col("source_url").rlike("^[a-z]+://[^'\"<>&]+$") & (F.trim("title") != "") & ~F.col("title").rlike("[<>&]"))
    page = F.concat(F.lit("<ul><li><a href='"), "source_url", F.lit("'>First title</a><li><a href='#x'>Top</a><a class=b href='"), "source_url", F.lit("'> <b>"), "title", F.lit("</b></a></ul>"))
    return P.listed_links(r.select("id", page.alias("page"), F.lit("https://a.example/").alias("base")), "id", "page", "base")


@query("SELECT source_id, kind, topic FROM (SELECT source_id, source_type AS kind, unnest(regulatory_topics) AS topic FROM reg_sources WHERE enabled)")
def s26_source_topics(spark, d):
    """The registry's nested entries as rows of their kind."""
    return table(spark, d, "reg_sources").filter("enabled").select("source_id", F.col("source_type").alias("kind"), F.explode("regulatory_topics").alias("topic"))


@query("""SELECT mime_type, CASE WHEN regexp_matches(lower(mime_type), 'pdf') THEN 'pdf' WHEN regexp_matches(lower(mime_type), 'html?') THEN 'html' WHEN regexp_matches(lower(mime_type), 'text|txt|md') THEN 'text'
  WHEN regexp_matches(lower(regexp_extract(file_name, '\\.([A-Za-z0-9]{2,5})$', 1)), 'pdf') THEN 'pdf' WHEN regexp_matches(lower(regexp_extract(file_name, '\\.([A-Za-z0-9]{2,5})$', 1)), 'html?') THEN 'html'
  WHEN regexp_matches(lower(regexp_extract(file_name, '\\.([A-Za-z0-9]{2,5})$', 1)), 'text|txt|md') THEN 'text' ELSE 'pdf' END AS kind, count(*) AS n FROM $REG GROUP BY 1, 2""")
def s23_media_types(spark, d):
    return register(spark, d).groupBy("mime_type", P.media_type(F.col("mime_type"), F.col("file_name")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH l AS (SELECT DISTINCT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, CASE WHEN regexp_matches(ls[1], '^\s*\d{1,3}\s*$') THEN ls[2:] ELSE ls END AS ls FROM l)
  SELECT doc_id, len(ls) AS n_lines, ls[1] AS first_line FROM k WHERE len(ls) > 0""")
def x3_page_lines(spark, d):
    """The lines of each text as a page, without a printed page number at its top."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.lit(1).alias("page"), "text")
    n = S.page_lines(docs, "doc_id", "page", "text")
    return n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.min_by("line", "line_no").alias("first_line"))


@query(r"""WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, regexp_extract_all(text, '\S+') AS w FROM documents WHERE text IS NOT NULL), x AS (SELECT document_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 500) / 450.0)) AS BIGINT) + 1)) AS i FROM w WHERE len(w) > 0)
  SELECT document_id, CAST(i AS INT) AS chunk_index, len(w[i * 450 + 1 : i * 450 + 500]) AS n_words FROM x""")
def w15_token_windows(spark, d):
    """Windows of 500 tokens over whole documents that share 50."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), "text")
    return S.window_chunks(docs, 500, 50).select("document_id", "chunk_index", F.size(F.split("text", " ")).cast("long").alias("n_words"))


# projections, filters and paging


@query(r"""WITH x AS (SELECT id, lower(title) AS t, source_id FROM $REG r JOIN reg_sources s ON s.authority = r.issuing_authority WHERE title IS NOT NULL)
  SELECT DISTINCT id, regexp_matches(t, 'loan|lending|credit|nbfc|borrower|penal') OR bool_or(contains(t, lower(topic))) AS relevant FROM x JOIN (SELECT source_id, unnest(regulatory_topics) AS topic FROM reg_sources) USING (source_id) GROUP BY id, t""")
def f11_relevant(spark, d):
    """Titles with a topic of their authority's sources, or a fixed word."""
    s = table(spark, d, "reg_sources").groupBy(F.col("authority").alias("issuing_authority")).agg(F.flatten(F.collect_list("regulatory_topics")).alias("topics"))
    r = register(spark, d).filter("title is not null").select("id", "issuing_authority", F.lower("title").alias("t")).join(s.filter(F.size("topics") > 0), "issuing_authority")
    return r.select("id", (F.col("t").rlike("loan|lending|credit|nbfc|borrower|penal") | F.exists("topics", lambda x: F.contains(F.col("t"), F.lower(x)))).alias("relevant")).distinct()


@query("SELECT version_id, sha256(txt) IS DISTINCT FROM lag(sha256(txt)) OVER (PARTITION BY canonical_url ORDER BY recorded_at, version_id) AS stale FROM $LOG")
def f18_stale_labels(spark, d):
    """Whether a label made on the text of the version before is still on the text that stands there."""
    w = Window.partitionBy("canonical_url").orderBy("recorded_at", "version_id")
    v = log(spark, d).withColumn("h", F.sha2("txt", 256))
    return v.select("version_id", (~F.col("h").eqNullSafe(F.lag("h").over(w))).alias("stale"))


PUBLIC = ["chunk_id", "document_id", "document_title", "source_url", "paragraph_ref", "chunk_index", "text", "lifecycle", "in_force_from", "in_force_to"]


@query("WITH $PASS SELECT " + ", ".join(PUBLIC) + " FROM passages")
def f19_public_passages(spark, d):
    """Only the fields that may be shown."""
    return ranking.passages(spark, d).select(*PUBLIC)


@query("WITH $PASS SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS INT) AS place, chunk_id FROM passages WHERE document_id IS NOT NULL")
def f20_document_chunks(spark, d):
    """The chunks of each document in reading order."""
    p = ranking.passages(spark, d).filter("document_id is not null")
    return p.select("document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")).alias("place"), "chunk_id")


@query("SELECT id, title FROM $REG WHERE st = 'ACTIVE' AND contains(lower(title), 'loan') ORDER BY title, id LIMIT 10 OFFSET 10")
def t9_second_page(spark, d):
    """F21 and T9: filtered by status and words of the title, the second page of ten."""
    r = register(spark, d).filter((F.col("st") == "ACTIVE") & F.lower("title").contains("loan")).select("id", "title")
    return W.paged(r, [F.col("title"), F.col("id")], 1)


@query("WITH $PASS, i AS (SELECT chunk_id FROM passages WHERE chunk_index = 0) SELECT CAST(row_number() OVER (ORDER BY chunk_id) AS INT) AS place, chunk_id, chunk_index FROM passages WHERE chunk_id IN (SELECT chunk_id FROM i)")
def j1_chunks_by_id(spark, d):
    """Chunks by a set of ids, in the order of the store."""
    p = ranking.passages(spark, d)
    got = p.join(p.filter("chunk_index = 0").select("chunk_id"), "chunk_id", "left_semi")
    return got.select(F.row_number().over(Window.orderBy("chunk_id")).alias("place"), "chunk_id", "chunk_index")


@query("""SELECT title_key, count(*) AS n_links, count(DISTINCT id) AS n_documents FROM (SELECT id, array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') AS title_key FROM $REG WHERE title IS NOT NULL) r
  JOIN (SELECT DISTINCT document_id, array_to_string(regexp_extract_all(lower(document_title), '[a-z0-9]+'), ' ') AS title_key FROM chunks WHERE document_title IS NOT NULL AND document_id IS NOT NULL) v USING (title_key) GROUP BY 1""")
def j8_by_title(spark, d):
    """The documents of chunks meet the registered ones whose titles have the same words in the same order."""
    key = lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ").alias("title_key")
    r = register(spark, d).filter("title is not null").select("id", key("title"))
    v = table(spark, d, "chunks").filter("document_title is not null and document_id is not null").select("document_id", key("document_title")).distinct()
    n = v.groupBy("title_key").agg(F.count(F.lit(1)).alias("n"))  # per title, so that equal titles don't multiply
    m = r.groupBy("title_key").agg(F.count(F.lit(1)).alias("m"), F.count_distinct("id").alias("n_documents"))
    return n.join(m, "title_key").select("title_key", (F.col("n") * F.col("m")).alias("n_links"), "n_documents")


@query("SELECT DISTINCT request_id, c.chunk_id, upper(trim(c.lifecycle)) AS label FROM query_requests q JOIN (SELECT DISTINCT chunk_id, source_url, paragraph_ref, lifecycle FROM chunks) c USING (source_url, paragraph_ref)")
def j18_labels(spark, d):
    """Claims (requests) with the passages they rest on, and each passage's label."""
    c = table(spark, d, "chunks").select("chunk_id", "source_url", "paragraph_ref", E.status(F.col("lifecycle")).alias("label"))
    return table(spark, d, "query_requests").select("request_id", "source_url", "paragraph_ref").distinct().join(c, ["source_url", "paragraph_ref"]).select("request_id", "chunk_id", "label").distinct()


# reports


@query("""SELECT count(*) AS n, round(count(*) FILTER (as_of IS NOT NULL) / count(*), 6) AS dated_share, round(count(*) FILTER (as_of > CAST(asked_at AS DATE)) / nullif(count(*) FILTER (as_of IS NOT NULL), 0), 6) AS ahead_share,
  count(*) FILTER (source_url IS NULL OR paragraph_ref IS NULL) AS n_unplaced, round(median(top_k), 6) AS median_k FROM (SELECT DISTINCT * FROM query_requests)""")
def a11_report(spark, d):
    """Ratios over subsets, each with its own denominator."""
    q, c = table(spark, d, "query_requests").distinct(), F.count_if
    dated = F.col("as_of").isNotNull()
    return q.agg(F.count(F.lit(1)).alias("n"), F.round(c(dated) / F.count(F.lit(1)), 6).alias("dated_share"), F.round(c(F.col("as_of") > F.to_date("asked_at")) / F.nullif(c(dated), F.lit(0)), 6).alias("ahead_share"), c(F.col("source_url").isNull() | F.col("paragraph_ref").isNull()).alias("n_unplaced"), F.round(F.percentile("top_k", 0.5), 6).alias("median_k"))


@query(ranking._BM25 + """, f AS (SELECT query_id, list(DISTINCT p.source_url) AS found FROM bm JOIN passages p USING (chunk_id) WHERE rank <= 5 AND p.source_url IS NOT NULL GROUP BY 1)
  SELECT query_id, coalesce(list_contains(found, source_url), false) AS found, coalesce(len(found), 0) AS n_found FROM asked LEFT JOIN f USING (query_id) WHERE source_url IS NOT NULL""")
def u7_expected_found(spark, d):
    """Whether the expected page is among those of the best five passages."""
    p = ranking.passages(spark, d).filter("source_url is not null").select("chunk_id", "source_url")
    f = ranking._bm25(spark, d, 5).join(p, "chunk_id").groupBy("query_id").agg(F.collect_set("source_url").alias("urls"))
    q = ranking.asked(spark, d).filter("source_url is not null").join(f, "query_id", "left")
    return q.select("query_id", F.coalesce(F.array_contains("urls", F.col("source_url")), F.lit(False)).alias("found"), F.coalesce(F.when(F.col("urls").isNotNull(), F.size("urls")), F.lit(0)).cast("long").alias("n_found"))


@query(SQL["u7_expected_found"].replace("SELECT query_id, coalesce(list_contains(found, source_url), false) AS found, coalesce(len(found), 0) AS n_found FROM asked", "SELECT query_id, query, coalesce(list_contains(found, source_url), false) AS found FROM asked") + " ORDER BY found, query_id LIMIT 12")
def t8_failures(spark, d):
    """The gallery of twelve, misses first."""
    q = ranking.asked(spark, d).select("query_id", "query")
    return u7_expected_found(spark, d).select("query_id", "found").join(q, "query_id").orderBy("found", "query_id").limit(12).select("query_id", "query", "found")


@query("""SELECT upper(trim(method)) AS source, count(*) AS n, count(*) FILTER (trust IN ('APPROVED', 'AUTO_TRUSTED')) AS n_right, round(count(*) FILTER (trust IN ('APPROVED', 'AUTO_TRUSTED')) / count(*), 6) AS precision FROM $LINKS WHERE trust IN ('APPROVED', 'AUTO_TRUSTED', 'REJECTED') GROUP BY 1""")
def e7_precision_by_source(spark, d):
    """Precision of the graph's links per way they were found, never pooled."""
    l = links(spark, d).filter("trust in ('APPROVED', 'AUTO_TRUSTED', 'REJECTED')")
    right = F.count_if(F.col("trust") != "REJECTED")
    return l.groupBy(F.upper(F.trim("method")).alias("source")).agg(F.count(F.lit(1)).alias("n"), right.alias("n_right"), F.round(right / F.count(F.lit(1)), 6).alias("precision"))


@query(rules._TRUST + ", a AS (SELECT DISTINCT r.link_id, CASE WHEN len(reasons) = 0 THEN 'AUTO_TRUSTED' ELSE 'REVIEW_REQUIRED' END AS checker, l.trust AS person FROM r JOIN $LINKS l USING (link_id) WHERE l.trust IS NOT NULL) SELECT checker, person, count(*) AS n FROM a GROUP BY 1, 2")
def e8_agreement(spark, d):
    """How the rule's decisions on links agree with the recorded ones."""
    made = rules.m10_trust(spark, d).select("link_id", F.col("decision").alias("checker")).distinct()
    return made.join(links(spark, d).filter("trust is not null").select("link_id", F.col("trust").alias("person")).distinct(), "link_id").groupBy("checker", "person").agg(F.count(F.lit(1)).alias("n"))


_BOARD = [("documents", "reg_documents"), ("links", "doc_links"), ("requests", "query_requests"), ("removals", "removed_documents")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS part, 'measured' AS status, count(*) AS n FROM (SELECT DISTINCT * FROM {t})" for a, t in _BOARD) + " UNION ALL SELECT 'answers', 'not yet measured', 0")
def e11_dashboard(spark, d):
    """The parts of the quality report; one whose table is not there is not yet measured."""
    from annalist.sources.files import exists

    out = None
    for part, name in [*_BOARD, ("answers", "answer_records")]:
        n = table(spark, d, name).distinct().agg(F.count(F.lit(1)).alias("n")) if exists(spark, f"{d}/{name}.parquet") else None
        row = spark.createDataFrame([(part, "not yet measured", 0)], "part string, status string, n long") if n is None else n.select(F.lit(part).alias("part"), F.lit("measured").alias("status"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT issuing_authority, st, count(*) AS n, count(*) FILTER (source_url IS NULL) AS n_without_page, count(*) FILTER (document_identifier IS NULL) AS n_without_number, CAST(sum(page_count) AS BIGINT) AS pages FROM $REG GROUP BY 1, 2""")
def e12_build_report(spark, d):
    r = register(spark, d).groupBy("issuing_authority", "st")
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source_url").isNull()).alias("n_without_page"), F.count_if(F.col("document_identifier").isNull()).alias("n_without_number"), F.sum("page_count").alias("pages"))


@query("""WITH e AS (SELECT item_id, item_kind, as_of, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS p FROM (SELECT DISTINCT * FROM eval_items)),
  r AS (SELECT item_id, item_kind, len(q) > 0 AND round(len(list_intersect(q, p)) / len(q), 3) >= 0.34 AS answered, item_kind NOT IN ('false_premise', 'unanswerable') AS expected FROM e WHERE p IS NOT NULL AND q IS NOT NULL)
  SELECT item_kind, count(*) AS n, count(*) FILTER (answered = expected) AS n_pass, count(*) FILTER (NOT expected) AS n_to_refuse, round(avg(CASE WHEN answered = expected THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM r GROUP BY 1""")
def e1_cases(spark, d):
    """Every case with what was expected and what came (answered: enough of the question's words in its passage), by kind."""
    e = table(spark, d, "eval_items").distinct().filter("question is not null and passage is not null")
    e = e.withColumn("answered", T.word_overlap(F.col("question"), F.col("passage")) >= 0.34).withColumn("expected", ~F.col("item_kind").isin("false_premise", "unanswerable"))
    good = F.col("answered") == F.col("expected")
    return e.groupBy("item_kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_pass"), F.count_if(~F.col("expected")).alias("n_to_refuse"), F.round(F.avg(F.when(good, 1.0).otherwise(0.0)), 6).alias("pass_rate"))


# graph


_EDGE = ranking._EDGE


@query(f"WITH {_EDGE} SELECT e.source, e.target, e.type, s.st AS source_status, t.st AS target_status FROM e LEFT JOIN $REG s ON s.id = e.source LEFT JOIN $REG t ON t.id = e.target")
def g13_statuses_on_edges(spark, d):
    """The links with the status of the document at each end."""
    r = register(spark, d).filter("id is not null")
    e = ranking.edges(spark, d).select("source", "target", "type")
    return e.join(r.select(F.col("id").alias("source"), F.col("st").alias("source_status")), "source", "left").join(r.select(F.col("id").alias("target"), F.col("st").alias("target_status")), "target", "left")


def _typed(name, types, reverse=False):
    here, there = ("target", "source") if reverse else ("source", "target")
    sql = ranking._MATCH + f" SELECT DISTINCT query_id, {there} AS id FROM m JOIN e ON {here} = m.id WHERE type IN ('{"', '".join(types)}')"

    def run(spark, d):
        from annalist.operators import graph as G

        return G.neighbours(ranking.edges(spark, d), ranking._matched(spark, d).select("query_id", "id"), list(types), reverse)

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql.replace("$REG", rules.REG).replace("$LINKS", rules.LINKS)


_typed("g15_replaced", ("SUPERSEDES", "REPLACES"))
_typed("g16_amended", ("AMENDS",))
_typed("g17_candidates_for", ("CANDIDATE",), True)


@query(f"""WITH $PASS, bn AS (SELECT {_KEY.replace('$R', 'n')} AS k, min(id) AS target FROM (SELECT id, unnest(list_append(coalesce(circular_numbers, []), document_identifier)) AS n FROM $REG) WHERE n IS NOT NULL GROUP BY 1),
  pr AS (SELECT chunk_id, lower(trim(document_id)) AS own, {_KEY.replace('$R', 'r')} AS k FROM (SELECT chunk_id, document_id, unnest(list_concat(regexp_extract_all(text, '{S.DEPARTMENT}'), regexp_extract_all(text, '{S.SERIES}'))) AS r FROM passages))
  SELECT chunk_id AS source, target, count(*) AS n FROM pr JOIN bn USING (k) WHERE target IS DISTINCT FROM own GROUP BY 1, 2""")
def g4_document_references(spark, d):
    """Passages and the registered documents whose numbers they print."""
    numbers = F.array_compact(F.array_append(F.coalesce("circular_numbers", F.array().cast("array<string>")), F.col("document_identifier")))
    r = register(spark, d).select("id", F.transform(numbers, T.department_reference).alias("numbers"))
    return L.references_across(ranking.passages(spark, d), r).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT version_id, title, materiality FROM (SELECT version_id, materiality, title, nl FROM (""" + rules._DIFF + """ SELECT r.version_id, CASE WHEN len(nums) + len(dats) > 0 THEN 'HIGH' ELSE 'MEDIUM' END AS materiality, g.title, array_to_string(list_sort(list_filter(l.nl, lambda x: NOT list_contains(l.ol, x)))[1:3], ' ') AS nl
  FROM r JOIN l USING (version_id) JOIN $LOG g USING (version_id))) WHERE materiality = 'HIGH' AND contains(lower(concat_ws(' ', title, nl)), 'loan')""")
def f10_material_updates(spark, d):
    """Updates of high materiality with a word in the title or in the first three added lines."""
    w = Window.partitionBy("canonical_url").orderBy("recorded_at", "version_id")
    t = log(spark, d).withColumn("ph", F.lag("h").over(w)).withColumn("ptxt", F.lag("txt").over(w)).filter("ptxt is not null and txt is not null and not (h <=> ph)")
    x = t.select("version_id", "title", versions.diff(F.col("ptxt"), F.col("txt")).alias("x")).withColumn("materiality", versions.materiality(F.col("x")))
    return x.filter((F.col("materiality") == "HIGH") & F.lower(F.concat_ws(" ", "title", F.array_join(F.slice("x.added", 1, 3), " "))).contains("loan")).select("version_id", "title", "materiality")


@query("""WITH h AS (SELECT sha256(text) AS h, lang, coalesce(published_on < DATE '2022-01-01', false) AS old FROM documents WHERE text IS NOT NULL), c AS (SELECT DISTINCT h FROM h WHERE old)
  SELECT lang, count(DISTINCT h.h) FILTER (c.h IS NOT NULL) AS n_cached, count(DISTINCT h.h) FILTER (c.h IS NULL) AS n_made FROM h LEFT JOIN c USING (h) WHERE NOT old GROUP BY 1""")
def s28_embedding_cache(spark, d):
    """Vectors by the hash of their text: those of documents from before 2022 are there, only the other texts are embedded, and both are one table."""
    docs = table(spark, d, "documents").filter("text is not null").select("lang", "text", F.sha2("text", 256).alias("h"), F.coalesce(F.col("published_on") < F.lit("2022-01-01").cast("date"), F.lit(False)).alias("old"))
    cache = docs.filter("old").select("h").distinct().withColumn("cached", F.lit(True))
    new = docs.filter("not old").join(cache, "h", "left")
    return new.groupBy("lang").agg(F.count_distinct(F.when(F.col("cached"), F.col("h"))).alias("n_cached"), F.count_distinct(F.when(F.col("cached").isNull(), F.col("h"))).alias("n_made"))
