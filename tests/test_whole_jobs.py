"""Queries that once did a part of their job: what the part left out."""

import numpy as np

from annalist.operators import evidence as V
from annalist.operators import linking as L
from annalist.operators import metrics as M
from annalist.plans import answers, monitoring, ranking, rules
from helpers import rows
from oracle import database, same


def test_header_facts_beyond_the_first_lines(spark):
    far = "Skip to main content\n" * 60
    docs = [
        (1, far + "CCA/2022-23/182\nSUP.MIC.66/13.07.005/2024-2025\nJanuary 18, 2024\n\nIncome recognition\nSee CCA/2020-21/11 dated 01.02.2020."),
        (2, "A heading\nAs stated on 28.03.2022, see CCA/2020-21/38, then CCA/2020-21/39."),
        (3, "x" * 5000 + "\nCCA/2020-21/38"),
        (4, "x" * 2990 + " CCA/2020-21/38\n28.10.2023\nRestructuring"),
        (5, "No number\nJanuary 18, 2024"),
    ]
    f = spark.createDataFrame(docs, "i long, text string").select("i", L.header_facts(L.F.col("text")).alias("f"))
    got = rows(f.selectExpr("i", "array_join(f.numbers, ' ')", "cast(f.issued as string)", "f.title", "length(f.first_line)"))
    assert got == [
        (1, "CCA/2022-23/182 SUP.MIC.66/13.07.005/2024-25", "2024-01-18", "Income recognition", 20),
        (2, "CCA/2020-21/38", None, None, 9),
        (3, "", None, None, 5000),
        (4, "CCA/2020-21/38", "2023-10-28", None, 3005),
        (5, "", None, None, 9),
    ]


def test_header_facts_on_whole_table(spark, data):
    number, line = L._NUMBER, L.DATE_LINE
    key = monitoring._KEY.replace("$R", "r")
    day = f"""coalesce(CAST(try_strptime(regexp_replace(regexp_replace(trim(l), ',', '', 'g'), ' +', ' ', 'g'), '%B %d %Y') AS DATE), CAST(try_strptime(replace(trim(l), '/', '.'), '%d.%m.%Y') AS DATE))"""
    same(
        monitoring.x11_header_facts(spark, data),
        database(data),
        rf"""WITH a AS (SELECT doc_id, text, regexp_extract(text, '(?s)^(.*?)({number}(?:\s*{number})*)', 1) AS b, regexp_extract(text, '(?s)^(.*?)({number}(?:\s*{number})*)', 2) AS o FROM documents WHERE text IS NOT NULL),
  c AS (SELECT doc_id, text, b, CASE WHEN length(b) < 3000 THEN o ELSE '' END AS o FROM a), e AS (SELECT *, string_split(substr(text, length(b) + length(o) + 1), chr(10))[1:5] AS after FROM c),
  g AS (SELECT *, list_filter(after, lambda x: regexp_matches(x, '{line}'))[1] AS l, list_filter(after, lambda x: trim(x) <> '' AND NOT regexp_matches(x, '{line}'))[1] AS t FROM e)
  SELECT doc_id, array_to_string(list_transform(regexp_extract_all(o, '{number}'), lambda r: {key}), ' ') AS numbers, CASE WHEN o <> '' THEN {day} END AS issued,
    CASE WHEN o <> '' AND regexp_matches(b, '(?:^|\n)[ \t]*\z') AND trim(after[1]) = '' THEN trim(t) END AS title, split_part(text, chr(10), 1) AS first_line FROM g""",
    )


def test_bootstrap_draws_all_resamples(spark, data):
    events = spark.read.parquet(data + "/events.parquet")
    got = ranking.a22_bootstrap(spark, data).first()
    assert got == M.bootstrap_mean(events, "value", ["event_id"], resamples=2000).first()
    assert got != M.bootstrap_mean(events, "value", ["event_id"], resamples=200).first()
    h = np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64)
    w = M._weights(h, np.arange(2000, dtype=np.uint64)).astype(float)
    assert abs(w.mean() - 1) < 0.002 and abs(w.var() - 1) < 0.005
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1 and abs(w.mean(axis=0).std() * 3000**0.5 - 1) < 0.1


def test_references_of_the_graph(spark):
    cols = "chunk_id string, document_id string, document_title string, paragraph_ref string, chunk_index int, text string"
    chunks = [
        ("a1", "d1", "Directions", "1", 0, "See paragraphs 2 and 9, and paragraph 1. CCA/2020-21/11 and CCA/2020-2021/11 apply, CCA/1999-00/1 is unknown."),
        ("a2", "d1", "Directions", "2", 1, "Paragraph 1 of the Master Directions is another's; CCA/2022-23/5 is this one."),
        ("a3", "d1", "Directions", "2", 2, "paragraph 2 is the first with that number."),
        ("b1", "d2", "Amendment Directions", "1", 0, "Paragraph 2 shall go."),
        ("b2", "d2", "Amendment Directions", "2", 1, "None."),
    ]
    p = spark.createDataFrame(chunks, cols)
    register = spark.createDataFrame([("d1", ["CCA/2022-23/5"]), ("d2", ["CCA/2020-21/11"]), ("d3", ["CCA/2020-21/11"])], "id string, numbers array<string>")
    assert rows(L.references_within(p)) == [("a1", "a2"), ("a3", "a2")]
    assert rows(L.references_across(p, register)) == [("a1", "d2"), ("a1", "d2")]


def test_graph_edges_of_all_types(spark, data):
    got = dict(rows(answers.g1_graph_edges(spark, data), "type", "n"))
    db = database(data)
    kept = f"SELECT relation, count(*) FROM {rules.LINKS} WHERE relation IN ('SUPERSEDES', 'AMENDS') AND trust IN ('APPROVED', 'AUTO_TRUSTED', 'REVIEW_REQUIRED') GROUP BY 1"
    gone = f"SELECT 'WITHDRAWS', count(DISTINCT lower(trim(document_id))) FROM removed_documents WHERE lower(trim(document_id)) IN (SELECT id FROM {rules.REG})"
    key = monitoring._KEY
    refs = monitoring._REFS.replace("$T", "text")
    across = f"""WITH n AS (SELECT {key.replace('$R', 'n')} AS k, min(id) AS target FROM (SELECT id, unnest(list_append(coalesce(circular_numbers, []), document_identifier)) AS n FROM {rules.REG}) WHERE n IS NOT NULL GROUP BY 1),
      m AS (SELECT document_id, {key.replace('$R', 'r')} AS k FROM (SELECT document_id, unnest({refs}) AS r FROM (SELECT DISTINCT chunk_id, document_id, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL)))
      SELECT count(*) FROM m JOIN n USING (k) WHERE target IS DISTINCT FROM lower(trim(document_id))"""
    assert {t: got[t] for t in ("AMENDS", "SUPERSEDES", "WITHDRAWS")} == dict(db.execute(kept).fetchall() + db.execute(gone).fetchall())
    within = L.references_within(ranking.passages(spark, data)).count()
    assert got["REFERS_TO"] == db.execute(across).fetchone()[0] + within
    assert set(got) == {"DEFINES", "ISSUED_BY", "PART_OF", "REFERS_TO", "WITHDRAWS", "SUPERSEDES", "AMENDS"}


def test_deleted_paragraphs_stay(spark):
    old, new = "every bank shall keep records\nalpha beta gamma delta bank\n1. a\n ", "every bank shall keep the records\n\nevery bank shall keep the records"
    pairs = spark.createDataFrame([("u", old, new), ("v", "alpha beta", "")], "g string, a string, b string")
    assert rows(V.best_match(pairs, ["g"], "a", "b")) == [("u", 0, 0, 0.912871), ("u", 1, None, 0.182574), ("u", 2, None, 0.0), ("v", 0, None, 0.0)]


def test_paragraphs_of_every_version(spark, data):
    same(
        answers.j14_paragraph_map(spark, data),
        database(data),
        rf"""WITH v AS (SELECT canonical_url, txt, row_number() OVER (PARTITION BY canonical_url ORDER BY recorded_at, version_id) AS n, count(*) OVER (PARTITION BY canonical_url) AS m FROM {rules.LOG} WHERE txt IS NOT NULL AND canonical_url IS NOT NULL),
  p AS (SELECT canonical_url, n, m, k, line, list_distinct(regexp_extract_all(lower(line), '[a-z0-9]{{3,}}')) AS w FROM (SELECT canonical_url, n, m, unnest(string_split(txt, chr(10))) AS line, unnest(range(len(string_split(txt, chr(10))))) AS k FROM v) WHERE trim(line, ' ') <> ''),
  s AS (SELECT a.canonical_url, a.n, a.k, b.k AS new_key, round(len(list_intersect(a.w, b.w)) / sqrt(len(a.w) * len(b.w)::DOUBLE), 6) AS score FROM p a JOIN p b ON a.canonical_url = b.canonical_url AND b.n = a.n + 1 WHERE len(list_intersect(a.w, b.w)) > 0),
  t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY canonical_url, n, k ORDER BY score DESC, new_key) = 1)
  SELECT p.canonical_url, CAST(p.n AS INT) AS step, CAST(p.k AS INT) AS old_key, CAST(CASE WHEN score >= 0.3 THEN new_key END AS INT) AS new_key, coalesce(score, 0.0) AS score FROM p LEFT JOIN t USING (canonical_url, n, k) WHERE p.n < p.m""",
    )
