"""The ranked retrieval of many queries, stage by stage, with a trace of what each stage did.

lexical, dense, fused, expanded, in force, re-ranked, cut. A part that is not given is skipped and the trace says so; the rest goes on
with what there is. A re-ranker is any function from candidates to scores.

Defined results: a query that nothing matches has no result and a trace of zeros; ranks are total orders (score, then the rank before,
then the id); the filter comes before the cut to the candidates that the re-ranker sees.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import retrieval as R
from annalist.sources.shared import materialize

#: Candidates that a re-ranker sees, ids that the trace keeps, and the score below which a query counts as out of scope.
CANDIDATES, TRACED, ABSTAIN = 30, 10, 0.34
#: From (query_id, query, key, text, before) to the same with a score.
Reranker = Callable[[DataFrame], DataFrame]
STAGES = ("lexical", "dense", "fused", "expanded", "in_force", "reranked", "cut")


def overlap_reranker(candidates: DataFrame) -> DataFrame:
    """The share of the query's words in the passage; for want of a model."""
    return candidates.withColumn("score", T.word_overlap(F.col("query"), F.col("text")))


RERANKERS: dict[str, Reranker] = {"overlap": overlap_reranker}


@dataclass
class Retrieved:
    results: DataFrame  #: query_id, key, rank, position_score
    stages: DataFrame  #: query_id, stage, status, n, best
    removed: DataFrame  #: query_id, key, reason, of those among the first candidates that are not in force
    reranked: DataFrame | None  #: query_id, key, before, rank, score


def _ranked(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def traced(queries: DataFrame, ranking: DataFrame | None, key: str, stage: str) -> DataFrame:
    """query_id, stage, status, n, best: how many a stage left, and the first ids."""
    every = queries.select("query_id")
    if ranking is None:
        return every.select("query_id", F.lit(stage).alias("stage"), F.lit("skipped").alias("status"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("best"))
    first = F.when(F.col("rank") <= TRACED, F.struct("rank", F.col(key).cast("string").alias("id")))
    got = ranking.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(first)), lambda x: x["id"]).alias("best"))
    return every.join(got, "query_id", "left").select("query_id", F.lit(stage).alias("stage"), F.lit("done").alias("status"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("best", F.array().cast("array<string>")).alias("best"))


def retrieve(
    queries: DataFrame, passages: DataFrame, key: str, text: str, lexical: DataFrame, dense: DataFrame | None = None, cites: DataFrame | None = None,
    in_force: Column | None = None, why: Column | None = None, rerank: Reranker | None = None, k: int = 5, candidates: int = CANDIDATES,
) -> Retrieved:
    """``queries``: query_id, query and what ``in_force`` and ``why`` read (with the passages' columns); ``lexical``, ``dense``: query_id, key, rank; ``cites``: key, target, place.

    ``queries`` has one row per id, ``passages`` one per key. Each ranking is made once, and the texts of both are fetched for the candidates of the re-ranker only.
    """
    cut = lambda r: r.select("query_id", key, "rank")
    first = materialize(cut(lexical), "lexical")
    second = None if dense is None else materialize(cut(dense), "dense")
    steps = [("lexical", first), ("dense", second)]
    order = materialize(cut(R.rrf([first, second], key)), "fused") if dense is not None else first
    steps.append(("fused", None if dense is None else order))
    if cites is not None:
        order = materialize(cut(R.expand(order, key, cites)), "expanded")
    steps.append(("expanded", None if cites is None else order))
    seen = order.join(queries, "query_id").join(passages, key)
    removed = seen.limit(0).select("query_id", key, F.lit("").alias("reason"))
    if in_force is not None:
        judged = materialize(seen.withColumn("holds", in_force).withColumn("reason", why if why is not None else F.lit("not in force")).select("query_id", key, "rank", "holds", "reason"), "judged")
        removed = judged.filter((F.col("rank") <= candidates) & ~F.col("holds")).select("query_id", key, "reason")
        order = _ranked(judged.filter("holds").withColumnRenamed("rank", "at"), F.asc("at")).drop("at", "holds", "reason")
        seen = order
    steps.append(("in_force", None if in_force is None else order))
    few = seen.filter(F.col("rank") <= candidates).select("query_id", key, F.col("rank").alias("before"))
    few = few.join(queries.select("query_id", "query"), "query_id").join(passages.select(key, text), key).select("query_id", "query", key, text, "before")
    reranked = None
    if rerank is not None:
        reranked = materialize(_ranked(rerank(few), F.desc("score"), F.asc("before"), F.asc(key)).select("query_id", key, "before", "rank", "score"), "reranked")
        order = reranked
    else:
        order = few.withColumnRenamed("before", "rank")
    steps.append(("reranked", reranked))
    results = order.filter(F.col("rank") <= k).select("query_id", key, "rank", F.round(1 / F.col("rank"), 6).alias("position_score"))
    steps.append(("cut", results))
    stages = None
    for name, r in steps:
        one = traced(queries, r, key, name)
        stages = one if stages is None else stages.unionByName(one)
    return Retrieved(results, stages, removed, reranked)


def grounded(queries: DataFrame, reranked: DataFrame, least: float = ABSTAIN) -> DataFrame:
    """query_id, status, top: a query whose best candidate scores below ``least`` is out of scope and gets no evidence."""
    top = reranked.groupBy("query_id").agg(F.max("score").alias("top"))
    score = F.coalesce("top", F.lit(0.0))
    return queries.select("query_id").join(top, "query_id", "left").select("query_id", F.when(score < least, "out_of_scope").otherwise("grounded").alias("status"), score.alias("top"))
