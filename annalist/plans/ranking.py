"""Queries of ranked retrieval, the graph, passages and evaluation, with their SQL.

The searches take as queries every request (or vector) whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import graph as G
from annalist.operators import eligibility as E
from annalist.operators import evidence as V
from annalist.operators import metrics as M
from annalist.operators import pipeline as P
from annalist.operators import retrieval as R
from annalist.operators import scan
from annalist.operators import segmentation as S
from annalist.plans.rules import LINKS, REG, TODAY, links, register
from annalist.sources.shared import materialize, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("$REG", REG).replace("$LINKS", LINKS)
        return f

    return add


def asked(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_requests").filter("request_id % 20 = 0 and query is not null")
    return q.groupBy(F.col("request_id").alias("query_id")).agg(F.max(F.struct("query", "source_url", "paragraph_ref", F.coalesce("as_of", F.to_date("asked_at")).alias("day"))).alias("q")).select("query_id", "q.*")


_WRITTEN: dict[tuple, object] = {}


def written(spark: SparkSession, d: str, what: str, make):
    """What ``make`` gives, made once per session and state of the file ``what`` (its parts' names, sizes and times)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{what}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    state = tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))
    at = (spark.sparkContext.applicationId, make.__name__, d, what)
    if at not in _WRITTEN or _WRITTEN[at][0] != state:
        _WRITTEN[at] = (state, make(spark, d))
    return _WRITTEN[at][1]


def _passages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").filter("chunk_id is not null and text is not null")
    cols = ["text", "document_title", "document_id", "source_url", "paragraph_ref", "parent_id", "chunk_index", "in_force_from", "in_force_to", "lifecycle", "authority_current", "is_current", "valid_to"]
    return materialize(c.groupBy("chunk_id").agg(F.max(F.struct(*cols)).alias("c")).select("chunk_id", "c.*"), "passages")


def passages(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk with what ranking needs; written once."""
    return written(spark, d, "chunks", _passages)


def _index(spark: SparkSession, d: str) -> scan.TextIndex:
    return scan.TextIndex.build(passages(spark, d), "chunk_id", "text", "document_title", ["in_force_from", "in_force_to"])


def _blake_index(spark: SparkSession, d: str) -> scan.TextIndex:
    return scan.TextIndex.build(passages(spark, d), "chunk_id", "text", "document_title", hashing="blake2b")


_ASK = """q AS (SELECT request_id AS query_id, max(struct_pack(query := query, source_url := source_url, paragraph_ref := paragraph_ref, day := coalesce(as_of, CAST(asked_at AS DATE)))) AS q
    FROM query_requests WHERE request_id % 20 = 0 AND query IS NOT NULL GROUP BY 1),
  asked AS (SELECT query_id, q.query, q.source_url, q.paragraph_ref, q.day FROM q)"""
_PASS = """passages AS (SELECT DISTINCT chunk_id, text, document_title, document_id, source_url, paragraph_ref, parent_id, chunk_index, in_force_from, in_force_to, lifecycle, authority_current, is_current, valid_to FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL)"""
_NORM = r"lower(trim(regexp_replace(regexp_replace($X, '\[\^\d{1,3}\]', '', 'g'), '\s+', ' ', 'g')))"
_BM25 = (
    f"WITH {_ASK}, {_PASS},\n  w AS (SELECT chunk_id, regexp_extract_all({_NORM.replace('$X', 'text')}, '[a-z0-9]+') AS w FROM passages),\n"
    + f"""  g AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM w), tf AS (SELECT chunk_id, term, count(*) AS tf, any_value(ln) AS ln FROM (SELECT chunk_id, len(w) AS ln, unnest(w) AS term FROM w) GROUP BY 1, 2),
  idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, g GROUP BY 1),
  qt AS (SELECT query_id, unnest(list_distinct(regexp_extract_all({_NORM.replace('$X', 'query')}, '[a-z0-9]+'))) AS term FROM asked),
  s AS (SELECT query_id, chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * ln / avg_len))), 6) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term), g GROUP BY 1, 2),
  bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)"""
)


def _bm25(spark, d, k):
    return scan.bm25_top_k(written(spark, d, "chunks", _index), asked(spark, d), k)


@query(_BM25 + " SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM bm WHERE rank <= 5")
def r2_bm25_topk(spark, d):
    return _bm25(spark, d, 5)


@query(_BM25 + """, e AS (SELECT s.* FROM s JOIN asked USING (query_id) JOIN passages USING (chunk_id) WHERE coalesce(in_force_from <= day, true) AND coalesce(day < in_force_to, true))
  SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM e QUALIFY rank <= 5""")
def r7_bm25_asof_topk(spark, d):
    """The filter comes before the cut."""
    return scan.bm25_top_k(written(spark, d, "chunks", _index), asked(spark, d), 5, ("in_force_from", "in_force_to"))


@query(f"WITH {_PASS}, w AS (SELECT chunk_id, unnest(regexp_extract_all({_NORM.replace('$X', 'text')}, '[a-z0-9]+')) AS term FROM passages) SELECT term, count(*) AS cf, count(DISTINCT chunk_id) AS df FROM w GROUP BY 1")
def a9_term_statistics(spark, d):
    t = R.term_counts(passages(spark, d), "chunk_id", "text")
    return t.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


_VEC = """WITH q AS (SELECT vec_id AS query_id, embedding AS e, label AS ql FROM embeddings WHERE vec_id % 20 = 0),
  s AS (SELECT query_id, vec_id, ql, label, round(list_dot_product(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings WHERE vec_id <> query_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10)"""


def _dense(spark, d):
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return scan.dense_top_k(v, "vec_id", "embedding", q, 10)


@query(_VEC + " SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM k")
def r3_dense_knn(spark, d):
    return _dense(spark, d)


@query(_VEC + " SELECT round(avg(CASE WHEN ql = label THEN 1.0 ELSE 0.0 END), 6) AS precision_at_10, round(avg(f), 6) AS mrr, count(DISTINCT query_id) AS n FROM k JOIN (SELECT query_id, coalesce(1.0 / min(rank) FILTER (ql = label), 0) AS f FROM k GROUP BY 1) USING (query_id)")
def a16_dense_quality(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    k = _dense(spark, d).join(v, "vec_id").join(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    per = k.groupBy("query_id").agg(F.avg(F.when(F.col("ql") == F.col("label"), 1.0).otherwise(0.0)).alias("p"), F.coalesce(1.0 / F.min(F.when(F.col("ql") == F.col("label"), F.col("rank"))), F.lit(0.0)).alias("f"))
    return per.agg(F.round(F.avg("p"), 6).alias("precision_at_10"), F.round(F.avg("f"), 6).alias("mrr"), F.count(F.lit(1)).alias("n"))


_STOP = "['" + "', '".join(T.KEYWORD_STOPS) + "']"
_BLEND = f"""WITH {_ASK}, {_PASS},
  ht AS (SELECT 'd' AS side, chunk_id AS k, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS t FROM passages UNION ALL SELECT 'q', query_id::VARCHAR, unnest(regexp_extract_all(lower(query), '[a-z0-9]{{2,}}')) FROM asked WHERE trim(query) <> ''),
  hp AS (SELECT side, k, CAST(('0x' || substr(md5(t), 1, 15)) AS BIGINT) % 384 AS pos, count(*)::DOUBLE AS n FROM ht GROUP BY 1, 2, 3),
  hv AS (SELECT side, k, pos, n / sqrt(sum(n * n) OVER (PARTITION BY side, k)) AS w FROM hp),
  cs AS (SELECT CAST(b.k AS BIGINT) AS query_id, a.k AS chunk_id, sum(a.w * b.w) AS cos FROM hv a JOIN hv b USING (pos) WHERE a.side = 'd' AND b.side = 'q' GROUP BY 1, 2),
  qk AS (SELECT query_id, list_filter(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]{{3,}}')), lambda x: NOT list_contains({_STOP}, x)) AS k FROM asked WHERE trim(query) <> ''),
  qe AS (SELECT query_id, len(k) AS n, unnest(k) AS t FROM qk),
  dk AS (SELECT chunk_id, 0.55 AS f, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'))) AS t FROM passages UNION ALL SELECT chunk_id, 0.45, unnest(list_distinct(regexp_extract_all(lower(document_title), '[a-z0-9]{{3,}}'))) FROM passages),
  lx AS (SELECT query_id, chunk_id, sum(f / n) AS lex FROM qe JOIN dk USING (t) GROUP BY 1, 2),
  bl AS (SELECT query_id, chunk_id, round(0.55 * greatest(0, coalesce(cos, 0)) + 0.45 * coalesce(lex, 0), 6) AS score FROM cs FULL OUTER JOIN lx USING (query_id, chunk_id)),
  br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bl)"""


def _blended(spark, d, k):
    return scan.blended_top_k(written(spark, d, "chunks", _index), asked(spark, d), k)


@query(_BLEND + " SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM br WHERE rank <= 5")
def r5_blended_topk(spark, d):
    return _blended(spark, d, 5)


@query()
def r5_blended_blake2b_topk(spark, d):
    """The same with vectors hashed by blake2b, which SQL lacks."""
    return scan.blended_top_k(written(spark, d, "chunks", _blake_index), asked(spark, d), 5, "blake2b")


@query(_BM25 + ", " + _BLEND.split(_PASS + ",", 1)[1] + """,
  f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) FILTER (n = 0) AS r0, min(rank) FILTER (n = 1) AS r1 FROM (SELECT query_id, chunk_id, rank, 0 AS n FROM bm WHERE rank <= 100 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM br WHERE rank <= 100) GROUP BY 1, 2)
  SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0 NULLS LAST, r1 NULLS LAST, chunk_id) AS INT) AS rank FROM f QUALIFY rank <= 10""")
def r4_hybrid_rrf(spark, d):
    fused = R.rrf([_bm25(spark, d, R.DEPTH), _blended(spark, d, R.DEPTH)], "chunk_id")
    return fused.filter("rank <= 10").select("query_id", "chunk_id", "score", "rank")


_GOLD = _BM25 + """, gold AS (SELECT query_id, count(*) AS n_gold FROM asked JOIN passages USING (source_url, paragraph_ref) GROUP BY 1),
  hit AS (SELECT query_id, chunk_id, rank FROM bm JOIN asked USING (query_id) JOIN passages p USING (chunk_id) WHERE rank <= 10 AND p.source_url = asked.source_url AND p.paragraph_ref = asked.paragraph_ref)"""


def _gold(spark, d):
    q, p = asked(spark, d).select("query_id", "source_url", "paragraph_ref"), passages(spark, d).select("chunk_id", "source_url", "paragraph_ref")
    own = q.join(p, ["source_url", "paragraph_ref"])
    hits = _bm25(spark, d, 10).join(own.select("query_id", "chunk_id"), ["query_id", "chunk_id"])
    return own.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold")), hits


@query(_GOLD + """, f AS (SELECT query_id, min(rank) AS r FROM hit GROUP BY 1) SELECT round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 4) AS recall_10,
  round(sum(coalesce(1.0 / r, 0)) / count(*), 4) AS mrr, count(*) AS n FROM gold LEFT JOIN f USING (query_id)""")
def a16_recall_mrr(spark, d):
    gold, hits = _gold(spark, d)
    r = gold.join(hits.groupBy("query_id").agg(F.min("rank").alias("r")), "query_id", "left")
    return r.agg(M.recall_at(F.col("r"), 5).alias("recall_5"), M.recall_at(F.col("r"), 10).alias("recall_10"), M.mrr(F.col("r")).alias("mrr"), F.count(F.lit(1)).alias("n"))


@query(_GOLD + """, i AS (SELECT query_id, list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda r: 1.0 / log2(r + 1.0))) AS ideal FROM gold), g1 AS (SELECT query_id, sum(1.0 / log2(rank + 1.0)) AS dcg FROM hit GROUP BY 1)
  SELECT query_id, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM i LEFT JOIN g1 USING (query_id)""")
def a17_ndcg10(spark, d):
    gold, hits = _gold(spark, d)
    return M.ndcg(hits.select("query_id", F.col("chunk_id").alias("gold"), "rank"), gold)


def _cites(p: DataFrame) -> DataFrame:
    """chunk_id, target, place: from each passage to the first passage with a paragraph number that it names."""
    first = p.filter("paragraph_ref is not null").groupBy("document_id", F.col("paragraph_ref").alias("label")).agg(F.min(F.struct("chunk_index", "chunk_id")).alias("t"))
    cites = S.paragraph_references(p).join(first, ["document_id", "label"]).select("chunk_id", F.col("t.chunk_id").alias("target"), "place")
    return cites.filter("chunk_id <> target").groupBy("chunk_id", "target").agg(F.min("place").alias("place"))


def _pipeline(spark, d):
    """All stages of the approved retrieval; the cross references lead to the first passage with a paragraph's number."""
    p = passages(spark, d)
    rows = p.select("chunk_id", "text", "lifecycle", "authority_current", "is_current", "in_force_from", "in_force_to", "valid_to")
    q = asked(spark, d).select("query_id", "query", "day")
    return P.retrieve(q, rows, "chunk_id", "text", _bm25(spark, d, R.DEPTH), _blended(spark, d, R.DEPTH), _cites(p), E.is_current_guidance(F.col("day"), TODAY), E.why_excluded(F.col("day")), P.overlap_reranker), q


_STAGES = (
    _BM25 + ", " + _BLEND.split(_PASS + ",", 1)[1] + r""",
  f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) FILTER (n = 0) AS r0, min(rank) FILTER (n = 1) AS r1 FROM (SELECT query_id, chunk_id, rank, 0 AS n FROM bm WHERE rank <= 100 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM br WHERE rank <= 100) GROUP BY 1, 2),
  fused AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0 NULLS LAST, r1 NULLS LAST, chunk_id) AS rank FROM f),
  nm AS (SELECT chunk_id, document_id, list_filter(regexp_extract_all(text, '(?i:\b(?:paragraphs?|paras?)\s+\d{1,3}\b(?:\s*(?:,|and|to)\s*\d{1,3}\b)*)(?:$ELSE)?'), lambda x: NOT regexp_matches(x, '$ELSE$')) AS ms FROM passages),
  ll AS (SELECT chunk_id, document_id, flatten(list_transform(ms, lambda x: regexp_extract_all(x, '\d+'))) AS ls FROM nm),
  lb AS (SELECT chunk_id, document_id, unnest(ls) AS label, unnest(range(len(ls))) AS place FROM ll),
  fp AS (SELECT document_id, paragraph_ref AS label, min_by(chunk_id, struct_pack(i := chunk_index, c := chunk_id)) AS target FROM passages WHERE document_id IS NOT NULL AND paragraph_ref IS NOT NULL GROUP BY 1, 2),
  cites AS (SELECT chunk_id, target, min(place) AS place FROM lb JOIN fp USING (document_id, label) WHERE target <> chunk_id GROUP BY 1, 2),
  ex0 AS (SELECT query_id, chunk_id, 0 AS part, rank AS a, 0 AS b FROM fused WHERE rank <= 5 UNION ALL SELECT query_id, chunk_id, 2, rank, 0 FROM fused WHERE rank > 5
    UNION ALL SELECT query_id, target, 1, rank, place FROM fused JOIN cites USING (chunk_id) WHERE rank <= 5 AND (query_id, target) NOT IN (SELECT (query_id, chunk_id) FROM fused WHERE rank <= 5)),
  ex1 AS (SELECT query_id, chunk_id, min(struct_pack(part := part, a := a, b := b)) AS spot FROM ex0 GROUP BY 1, 2),
  expanded AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY spot, chunk_id) AS rank FROM ex1),
  judged AS (SELECT e.*, q.query, q.day, p.text, coalesce(upper(trim(lifecycle)), 'UNKNOWN') AS st, p.* EXCLUDE (chunk_id, text),
    CASE WHEN q.day >= $TODAY THEN coalesce(authority_current, false) AND coalesce(is_current, true) AND coalesce(in_force_from <= q.day, true) AND coalesce(q.day < in_force_to, true)
      ELSE coalesce(upper(trim(lifecycle)), '') NOT IN ('REVIEW_REQUIRED', 'UNKNOWN') AND coalesce(in_force_from <= q.day, true) AND coalesce(q.day < in_force_to, true) AND coalesce(q.day < CAST(valid_to AS DATE), true) END AS holds
    FROM expanded e JOIN asked q USING (query_id) JOIN passages p USING (chunk_id)),
  held AS (SELECT query_id, chunk_id, query, text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS before FROM judged WHERE holds QUALIFY before <= 30),
  wd AS (SELECT *, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS qw, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tw FROM held),
  rr AS (SELECT query_id, chunk_id, before, CASE WHEN len(qw) > 0 THEN round(len(list_intersect(qw, tw)) / len(qw), 3) ELSE 0 END AS score FROM wd),
  reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, chunk_id) AS rank FROM rr)""".replace("$ELSE", S.ELSEWHERE)
).replace("$TODAY", f"DATE '{TODAY}'")


@query(_STAGES + " SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, round(1.0 / rank, 6) AS position_score FROM reranked WHERE rank <= 5")
def r10_pipeline(spark, d):
    return _pipeline(spark, d)[0].results


@query(_STAGES + " SELECT query_id, chunk_id, CAST(before AS INT) AS before, CAST(rank AS INT) AS rank, CAST(score AS DOUBLE) AS score FROM reranked")
def r8_reranked(spark, d):
    """Ranks before and after re-ranking, of the candidates in force."""
    return _pipeline(spark, d)[0].reranked


@query(_STAGES + """ SELECT query_id, chunk_id, CASE WHEN st IN ('REVIEW_REQUIRED', 'UNKNOWN') THEN 'unsettled' WHEN in_force_from > day THEN 'starts ' || in_force_from::VARCHAR WHEN in_force_to <= day THEN 'ended ' || in_force_to::VARCHAR
  WHEN NOT coalesce(is_current, true) THEN 'older version' ELSE lower(st) END AS reason FROM judged WHERE rank <= 30 AND NOT holds""")
def r7_removed(spark, d):
    """What the in-force filter removed among the first candidates, and why."""
    return _pipeline(spark, d)[0].removed


@query(_STAGES + """, n AS (SELECT query_id, 'lexical' AS stage, chunk_id, rank FROM bm WHERE rank <= 100 UNION ALL SELECT query_id, 'dense', chunk_id, rank FROM br WHERE rank <= 100 UNION ALL SELECT query_id, 'fused', chunk_id, rank FROM fused
    UNION ALL SELECT query_id, 'expanded', chunk_id, rank FROM expanded UNION ALL SELECT query_id, 'in_force', chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) FROM judged WHERE holds
    UNION ALL SELECT query_id, 'reranked', chunk_id, rank FROM reranked UNION ALL SELECT query_id, 'cut', chunk_id, rank FROM reranked WHERE rank <= 5),
  gg AS (SELECT query_id, stage, count(*) AS n, string_agg(chunk_id, ' ' ORDER BY rank) FILTER (rank <= 10) AS best FROM n GROUP BY 1, 2)
  SELECT query_id, stage, 'done' AS status, coalesce(n, 0) AS n, coalesce(best, '') AS best FROM asked CROSS JOIN unnest(['lexical', 'dense', 'fused', 'expanded', 'in_force', 'reranked', 'cut']) t(stage) LEFT JOIN gg USING (query_id, stage)""")
def r20_stage_trace(spark, d):
    """Per request a row for each stage: how many it left of the ranking's first hundred, and the best ids."""
    return _pipeline(spark, d)[0].stages.withColumn("best", F.array_join("best", " "))


@query(_STAGES + ", t AS (SELECT query_id, max(score) AS top FROM reranked GROUP BY 1) SELECT query_id, CASE WHEN coalesce(top, 0) < 0.34 THEN 'out_of_scope' ELSE 'grounded' END AS status, CAST(coalesce(top, 0) AS DOUBLE) AS top FROM asked LEFT JOIN t USING (query_id)")
def r9_grounded(spark, d):
    got, q = _pipeline(spark, d)
    return P.grounded(q, got.reranked)


@query(_STAGES + """, hit AS (SELECT query_id, min(rank) AS r, min(before) AS b FROM reranked JOIN asked USING (query_id) JOIN passages p USING (chunk_id) WHERE p.source_url = asked.source_url AND p.paragraph_ref = asked.paragraph_ref GROUP BY 1)
  SELECT count(*) AS n, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_5, round(sum(coalesce(1.0 / r, 0)) / count(*), 4) AS mrr, round(avg(CASE WHEN b <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_5_before, round(sum(coalesce(1.0 / b, 0)) / count(*), 4) AS mrr_before FROM asked LEFT JOIN hit USING (query_id)""")
def e3_ladder(spark, d):
    """Recall and MRR of two rungs, without and with the re-ranker, on the same requests."""
    got, _ = _pipeline(spark, d)
    q, p = asked(spark, d).select("query_id", "source_url", "paragraph_ref"), passages(spark, d).select("chunk_id", "source_url", "paragraph_ref")
    hits = got.reranked.join(q.join(p, ["source_url", "paragraph_ref"]).select("query_id", "chunk_id"), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("r"), F.min("before").alias("b"))
    r = q.join(hits, "query_id", "left")
    return r.agg(F.count(F.lit(1)).alias("n"), M.recall_at(F.col("r"), 5).alias("recall_5"), M.mrr(F.col("r")).alias("mrr"), M.recall_at(F.col("b"), 5).alias("recall_5_before"), M.mrr(F.col("b")).alias("mrr_before"))


_FUSED = "fused AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0 NULLS LAST, r1 NULLS LAST, chunk_id) AS rank FROM f)"


@query(_STAGES.replace(_FUSED, "fused AS (SELECT query_id, chunk_id, rank FROM bm WHERE rank <= 30)") + " SELECT query_id, chunk_id, CAST(rank AS INT) AS rank FROM expanded")
def r6_expanded_ranking(spark, d):
    """BM25 with the paragraphs that the best passages name put after them."""
    return R.expand(_bm25(spark, d, 30), "chunk_id", _cites(passages(spark, d)))


_SECT = rf"""WITH {_PASS}, c AS (SELECT *, len(regexp_extract_all(text, '\S+')) AS cost, count(*) OVER (PARTITION BY parent_id) AS n FROM passages WHERE parent_id IS NOT NULL),
  u AS (SELECT *, sum(cost) OVER (PARTITION BY parent_id ORDER BY chunk_index, chunk_id ROWS UNBOUNDED PRECEDING) AS used FROM c WHERE n > 1)"""


@query(_SECT + " SELECT parent_id, string_agg(text, chr(10) ORDER BY chunk_index, chunk_id) AS section_text, CAST(count(*) AS INT) AS n_parts, CAST(max(used) AS BIGINT) AS n_words FROM u WHERE used <= 1500 GROUP BY 1")
def r11_section_context(spark, d):
    return R.section_context(passages(spark, d))


_HAS = lambda words: "len(list_filter(['" + "', '".join(words) + "'], lambda w: contains(q, w))) > 0"


@query(
    r"WITH t AS (SELECT DISTINCT request_id, trim(regexp_replace(lower(query), '\s+', ' ', 'g')) AS q FROM query_requests WHERE query IS NOT NULL), f AS (SELECT "
    + f"{_HAS(R.GRAPH_SIGNALS)} AS g, {_HAS(R.PASSAGE_SIGNALS)} AS v, len(regexp_extract_all(q, '\\b(?:{'|'.join(R.ACTORS)})\\w*\\b')) AS m FROM t) SELECT CASE WHEN g AND (v OR m >= 2) THEN 'HYBRID' WHEN g THEN 'GRAPH' ELSE 'VECTOR' END AS route, count(*) AS n FROM f GROUP BY 1"
)
def r13_routes(spark, d):
    return table(spark, d, "query_requests").filter("query is not null").select("request_id", "query").distinct().groupBy(R.route(F.col("query")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


_T3 = "list_distinct(regexp_extract_all(lower($X), '[a-z0-9]{3,}'))"


@query(
    (
        _BM25
        + rf""", ev AS (SELECT query_id, rank, query, coalesce(document_title, '') AS title, p.text FROM bm JOIN asked USING (query_id) JOIN passages p USING (chunk_id) WHERE rank <= 5),
  qt0 AS (SELECT query_id, rank, text, list_filter({_T3.replace('$X', 'query')}, lambda x: NOT list_contains(['{"', '".join(T.ANSWER_STOPS)}'], x)) AS qw, {_T3.replace('$X', 'title')} AS tw FROM ev),
  cm AS (SELECT query_id, list(w) AS common FROM (SELECT query_id, w, count(*) AS n FROM (SELECT query_id, unnest(tw) AS w FROM qt0) GROUP BY 1, 2) JOIN (SELECT query_id, count(*) AS m FROM qt0 GROUP BY 1) USING (query_id) WHERE n = m GROUP BY 1),
  fo AS (SELECT query_id, rank, text, tw, qw, list_filter(qw, lambda x: NOT list_contains(coalesce(common, []), x)) AS own FROM qt0 LEFT JOIN cm USING (query_id)),
  ft AS (SELECT query_id, rank, text, tw, CASE WHEN len(own) > 0 THEN own ELSE qw END AS terms FROM fo),
  sn AS (SELECT query_id, rank, tw, terms, unnest(ss) AS raw, unnest(range(len(ss))) AS n FROM (SELECT *, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM ft)),
  cl AS (SELECT query_id, rank, n, tw, terms, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(raw, '\s+', ' ', 'g')), '(?i)^chapter [ivxlc]+:\s*', ''), '(?i)^\d+\.\s+[^.]+?\s+([ivxlcdm]+\.\s)', '\1'), '(?i)^[ivxlcdm]+\.\s+', '') AS s FROM sn),
  sc AS (SELECT query_id, rank, n, s, len(list_intersect(terms, {_T3.replace('$X', 's')})) AS o, len(list_intersect(terms, tw)) AS h FROM cl WHERE length(s) BETWEEN 45 AND 700 AND NOT regexp_matches(lower(s), '{T.CHROME}') AND NOT regexp_matches(lower(s), '\bas (?:below|follows)\s*:')),
  on1 AS (SELECT *, round(2.0 * o + 0.35 * h, 6) AS score FROM sc WHERE o > 0 QUALIFY row_number() OVER (PARTITION BY query_id, lower(s) ORDER BY score DESC, rank, n) = 1)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, n) AS INT) AS place, s, CAST(score AS DOUBLE) AS score FROM on1 QUALIFY place <= 3"""
    )
)
def r14_answer_sentences(spark, d):
    q, p = asked(spark, d).select("query_id", "query"), passages(spark, d).select("chunk_id", F.col("document_title").alias("title"), "text")
    return R.answer_sentences(_bm25(spark, d, 5).join(p, "chunk_id").join(q, "query_id"))


# graph: documents and their links


@query("SELECT relation AS type, scope, count(*) AS n FROM $LINKS GROUP BY 1, 2")
def g_edge_types(spark, d):
    return links(spark, d).groupBy(F.col("relation").alias("type"), "scope").agg(F.count(F.lit(1)).alias("n"))


def edges(spark, d):
    return links(spark, d).filter("old_id is not null and new_id is not null and relation is not null").select(F.col("new_id").alias("source"), F.col("old_id").alias("target"), F.col("relation").alias("type"), "link_id", "created_at")


_EDGE = "e AS (SELECT new_id AS source, old_id AS target, relation AS type, link_id, created_at FROM $LINKS WHERE old_id IS NOT NULL AND new_id IS NOT NULL AND relation IS NOT NULL)"
_DEG = f"WITH {_EDGE}, dg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1)"


@query(_DEG + " SELECT * FROM dg")
def g_degree(spark, d):
    return G.degrees(edges(spark, d))


@query(_DEG + " SELECT type, count(*) AS n_edges, count(DISTINCT source) AS n_sources FROM e WHERE source IN (SELECT id FROM dg WHERE degree >= 4) AND target IN (SELECT id FROM dg WHERE degree >= 4) GROUP BY 1")
def g8_induced_overview(spark, d):
    e = edges(spark, d)
    return G.induced(e, G.degrees(e).filter("degree >= 4")).groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("source").alias("n_sources"))


@query(f"WITH {_EDGE}, n AS (SELECT source AS id, 'out' AS direction, type, target AS other FROM e WHERE type <> 'CANDIDATE' UNION ALL SELECT target, 'in', type, source FROM e WHERE type <> 'CANDIDATE') SELECT id, direction, type, count(*) AS n, count(DISTINCT other) AS n_others FROM n GROUP BY 1, 2, 3")
def g9_node_detail(spark, d):
    return G.detail(edges(spark, d), "CANDIDATE").groupBy("id", "direction", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("other").alias("n_others"))


@query(f"WITH {_EDGE} SELECT source, target, type, link_id FROM e QUALIFY row_number() OVER (PARTITION BY source, target, type ORDER BY created_at DESC NULLS LAST, link_id) = 1")
def g11_last_edges(spark, d):
    e = edges(spark, d).withColumn("k", F.concat_ws("|", "type", "source", "target"))
    return G.last_edges(e, "k", [F.col("created_at").desc_nulls_last(), F.asc("link_id")]).select("source", "target", "type", "link_id")


_MATCH = f"""WITH {_ASK}, {_EDGE}, qt AS (SELECT query_id, unnest(list_filter(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]{{3,}}')), lambda x: x NOT IN ('which', 'does', 'this', 'that', 'what'))) AS term FROM asked),
  nt AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{{3,}}'))) AS term FROM $REG WHERE title IS NOT NULL),
  m AS (SELECT query_id, id, count(*) AS overlap FROM qt JOIN nt USING (term) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, id DESC) <= 3)"""


def _matched(spark, d):
    nodes = register(spark, d).filter("title is not null").select("id", F.lit("Document").alias("type"), "title")
    return G.match_nodes(nodes, asked(spark, d), "Document")


@query(_MATCH + " SELECT query_id, id, overlap FROM m")
def g_match_nodes(spark, d):
    return _matched(spark, d)


@query(_MATCH + """, h1 AS (SELECT DISTINCT query_id, target AS id FROM m JOIN e ON source = id WHERE type IN ('SUPERSEDES', 'AMENDS')), h2 AS (SELECT DISTINCT query_id, target AS id FROM h1 JOIN e ON source = id WHERE type IN ('SUPERSEDES', 'AMENDS'))
  SELECT query_id, count(*) AS n_nodes FROM (SELECT query_id, id FROM m UNION SELECT * FROM h1 UNION SELECT * FROM h2) GROUP BY 1""")
def g14_two_hops(spark, d):
    e, m = edges(spark, d), _matched(spark, d).select("query_id", "id")
    one = G.neighbours(e, m, ["SUPERSEDES", "AMENDS"])
    two = G.neighbours(e, one, ["SUPERSEDES", "AMENDS"])
    return m.unionByName(one).unionByName(two).distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(_MATCH + """, r1 AS (SELECT DISTINCT query_id, source AS id FROM m JOIN e ON target = id WHERE type IN ('SUPERSEDES')) SELECT query_id, id FROM r1""")
def g18_reverse_step(spark, d):
    return G.neighbours(edges(spark, d), _matched(spark, d).select("query_id", "id"), ["SUPERSEDES"], reverse=True)


@query(_MATCH + """, h AS (SELECT query_id, id FROM m UNION SELECT DISTINCT query_id, target FROM m JOIN e ON source = id) SELECT a.query_id, e.link_id FROM e JOIN h a ON a.id = source JOIN h b ON b.id = target AND b.query_id = a.query_id""")
def g20_induced_evidence(spark, d):
    e, m = edges(spark, d), _matched(spark, d).select("query_id", "id")
    step = G.neighbours(e, m, ["SUPERSEDES", "AMENDS", "CANDIDATE"])
    return G.induced(e, m.unionByName(step).distinct(), ["query_id"]).select("query_id", "link_id")


@query("""SELECT CASE WHEN regexp_matches(q, 'supersed|replaced|replaces') THEN 'change' WHEN contains(q, 'amend') THEN 'amendments' WHEN regexp_matches(q, 'apply|subject to|which entities') THEN 'applicability'
  WHEN regexp_matches(q, 'product|digital lending|co-lending') THEN 'products' ELSE 'entities' END AS template, count(*) AS n FROM (SELECT DISTINCT request_id, lower(query) AS q FROM query_requests WHERE query IS NOT NULL) GROUP BY 1""")
def g19_templates(spark, d):
    return table(spark, d, "query_requests").filter("query is not null").select("request_id", "query").distinct().groupBy(G.template(F.col("query")).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {_EDGE}, s AS (SELECT source AS id, min(target) AS nxt FROM e WHERE type = 'SUPERSEDES' AND source <> target GROUP BY 1),
  w AS (SELECT id, nxt AS "end", 1 AS hops FROM s UNION ALL SELECT w.id, s.nxt, hops + 1 FROM w JOIN s ON s.id = w."end" WHERE hops < 200) SELECT id, "end", hops FROM w WHERE "end" NOT IN (SELECT id FROM s)""")
def g22_chain_ends(spark, d):
    return G.chain_ends(edges(spark, d).filter("type = 'SUPERSEDES'"))


_SENT = r"SELECT chunk_id, document_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM passages"


@query(rf"WITH {_PASS}, x AS ({_SENT}) SELECT document_id, count(*) AS n, count(*) FILTER (regexp_matches(lower(s), '\bnot\b|\bno\b')) AS n_negative FROM x WHERE regexp_matches(lower(s), '\b(must|shall|requires|required to|is required to)\b') GROUP BY 1")
def g21_obligations(spark, d):
    s = passages(spark, d).select("document_id", F.explode(T.sentences(F.col("text"))).alias("s")).filter(F.lower("s").rlike(r"\b(must|shall|requires|required to|is required to)\b"))
    return s.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower("s").rlike(r"\bnot\b|\bno\b")).alias("n_negative"))


# passages


@query(rf"""WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, regexp_extract_all(text, '\S+') AS w FROM documents WHERE text IS NOT NULL), x AS (SELECT document_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 120) / 100.0)) AS BIGINT) + 1)) AS i FROM w WHERE len(w) > 0),
  t AS (SELECT document_id, i, array_to_string(w[i * 100 + 1 : i * 100 + 120], ' ') AS text FROM x)
  SELECT document_id, CAST(i AS INT) AS chunk_index, text, 'chunk_' || substr(sha256(document_id || ':1:' || i || ':' || substr(sha256(text), 1, 12)), 1, 20) AS chunk_id FROM t""")
def w14_window_chunks(spark, d):
    pages = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), "text")
    return S.window_chunks(pages, 120, 20).select("document_id", "chunk_index", "text", "chunk_id")


_DEPT, _SER = S.DEPARTMENT, S.SERIES


@query(rf"""WITH {_PASS}, f AS (SELECT chunk_id, unnest(list_concat(regexp_extract_all(text, '{_DEPT}'), regexp_extract_all(text, '{_SER}'))) AS r FROM passages),
  k AS (SELECT chunk_id, regexp_replace(regexp_replace(upper(regexp_replace(regexp_replace(r, '(?i)[.\s]*\bNo\.\s*', '.', 'g'), '\s+', '', 'g')), '\.{{2,}}', '.', 'g'), '\b(\d{{4}})-\d{{2}}(\d{{2}})\b', '\1-\2', 'g') AS ref FROM f) SELECT chunk_id, ref, count(*) AS n FROM k GROUP BY 1, 2""")
def x10_references(spark, d):
    return passages(spark, d).select("chunk_id", F.explode(S.references(F.col("text"))).alias("ref")).groupBy("chunk_id", "ref").agg(F.count(F.lit(1)).alias("n"))


@query()
def x8_structure_chunks(spark, d):
    return S.chunked(table(spark, d, "documents").filter("text is not null"), "doc_id", "text")


@query(r"""WITH $PASS, m AS (SELECT chunk_id, document_id, list_filter(regexp_extract_all(text, '(?i:\b(?:paragraphs?|paras?)\s+\d{1,3}\b(?:\s*(?:,|and|to)\s*\d{1,3}\b)*)(?:$ELSE)?'), lambda x: NOT regexp_matches(x, '$ELSE$')) AS ms FROM passages WHERE text IS NOT NULL),
  l AS (SELECT chunk_id, document_id, flatten(list_transform(ms, lambda x: regexp_extract_all(x, '\d+'))) AS ls FROM m) SELECT chunk_id, document_id, unnest(ls) AS label, CAST(unnest(range(len(ls))) AS INT) AS place FROM l""".replace("$ELSE", S.ELSEWHERE).replace("$PASS", _PASS))
def g3_paragraph_references(spark, d):
    return S.paragraph_references(passages(spark, d))


@query()
def a22_bootstrap(spark, d):
    return M.bootstrap_mean(table(spark, d, "events"), "value", ["event_id"])


@query(_BM25 + """, t AS (SELECT query_id, max(score) AS top FROM bm GROUP BY 1) SELECT query_id, CASE WHEN coalesce(top, 0) < 12 THEN 'out_of_scope' ELSE 'grounded' END AS status FROM asked LEFT JOIN t USING (query_id)""")
def r9_abstention(spark, d):
    top = _bm25(spark, d, 1).select("query_id", F.col("score").alias("top"))
    return asked(spark, d).select("query_id").join(top, "query_id", "left").select("query_id", F.when(F.coalesce("top", F.lit(0.0)) < 12, "out_of_scope").otherwise("grounded").alias("status"))


@query(r"""SELECT source_id, lower(txt) AS line FROM (SELECT DISTINCT source_id, unnest(string_split(text_snapshot, chr(10))) AS txt FROM doc_versions WHERE text_snapshot IS NOT NULL) WHERE regexp_matches(lower(txt), 'skip to main content|not pressed|search the website|organisation structure|subscribe|follow ') GROUP BY 1, 2""")
def f17_page_chrome(spark, d):
    lines = table(spark, d, "doc_versions").filter("text_snapshot is not null").select("source_id", F.explode(F.split("text_snapshot", "\n")).alias("t")).select("source_id", F.lower("t").alias("line"))
    return lines.filter(F.col("line").rlike(T.CHROME + "|subscribe|follow ")).distinct()


@query(rf"""WITH {_PASS}, p AS (SELECT chunk_id, document_id, chunk_index, {_NORM.replace('$X', 'text')} AS t FROM passages), h AS (SELECT chunk_id, document_id, substr(t, 1, 60) AS head FROM p WHERE length(t) >= 60)
  SELECT h.chunk_id, min_by(p.chunk_id, struct_pack(i := p.chunk_index, c := p.chunk_id)) AS first_chunk FROM h JOIN p ON p.document_id = h.document_id AND contains(p.t, h.head) GROUP BY 1""")
def j12_first_chunk_with_head(spark, d):
    """For each passage the first chunk of its document that holds its first 60 characters."""
    p = passages(spark, d).select("chunk_id", "document_id", "chunk_index", T.normalise(F.col("text")).alias("t"))
    return V.first_with_head(p)
