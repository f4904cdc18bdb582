"""Changes of state as tables: patches by key, propagation of statuses, approvals and rejections, resets.

Every operator takes the rows as they are and gives them as they should be, so that a repeated run changes nothing more. The
decisions themselves (who may approve what) are columns, not code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.versions import NON_OPERATIVE


def patch_by(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the patch's values where their key has one (null values of a patch change nothing); keys of patches must be unique."""
    p = patches.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(p, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def patch_json(doc: Column, patch: dict[str, Column]) -> Column:
    """A JSON object of flat values with some set anew; null patches and unreadable objects change nothing."""
    old = F.from_json(doc, "map<string,string>")
    new = F.map_filter(F.create_map(*[x for k, v in patch.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.when(old.isNull(), doc).otherwise(F.to_json(F.map_concat(kept, new)))


def propagated(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's status, what follows from it (authority), and its window: a rule that no longer holds ends when that was seen, unless it ended before.

    ``documents``: document_id, status, checked_on; a chunk whose document has none keeps its own.
    """
    d = documents.select("document_id", F.col("status").alias("_s"), F.col("checked_on").alias("_d"))
    j = chunks.join(d, "document_id", "left").withColumn("lifecycle", F.coalesce("_s", "lifecycle"))
    ended = F.coalesce(F.col("_s").isin(*NON_OPERATIVE), F.lit(False))
    j = j.withColumn("authority_current", F.when(F.col("_s").isNotNull(), F.col("_s").isin("ACTIVE", "AMENDED")).otherwise(F.col("authority_current")))
    return j.withColumn("in_force_to", F.when(ended, F.coalesce("in_force_to", "_d")).otherwise(F.col("in_force_to"))).select(*chunks.columns)


def approvals(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """id, wanted, outcome: approvals are refused where official evidence says that the document no longer rules, or there is no such document."""
    j = requests.join(documents.select("id", "status", F.lit(True).alias("known")), "id", "left")
    outcome = F.when(F.col("known").isNull(), "unknown document").when(F.col("status").isin(*NON_OPERATIVE), "official status stands").otherwise("approved")
    return j.select("id", "wanted", outcome.alias("outcome"))


def approved_links(links: DataFrame, new_status: str) -> DataFrame:
    """Links as a reviewer's approval leaves them: a candidate replaces the whole document; a new document that no longer rules replaces nothing."""
    candidate, dead = F.col("relation") == "CANDIDATE", F.coalesce(F.col(new_status).isin(*NON_OPERATIVE), F.lit(False))
    pick = lambda c, v: F.when(candidate & ~dead, F.lit(v)).otherwise(F.col(c)).alias(c)
    return links.select(*[c for c in links.columns if c not in ("relation", "scope", "trust")], pick("relation", "SUPERSEDES"), pick("scope", "WHOLE"), F.when(dead, F.col("trust")).otherwise("APPROVED").alias("trust"))


def reverted(documents: DataFrame, rejected: DataFrame) -> DataFrame:
    """Documents after links were rejected: the window opens again; a status goes back to review only if this link's quote brought it about.

    ``documents``: id, status, evidence, in_force_to; ``rejected``: id, quote.
    """
    r = rejected.groupBy("id").agg(F.collect_set("quote").alias("quotes"))
    j = documents.join(r, "id", "left")
    by_it = (F.col("status") == "SUPERSEDED") & F.coalesce(F.array_contains("quotes", F.col("evidence")), F.lit(False))
    hit = F.col("quotes").isNotNull()
    return j.select("id", F.when(by_it, "REVIEW_REQUIRED").otherwise(F.col("status")).alias("status"), F.when(hit, None).otherwise(F.col("in_force_to")).alias("in_force_to"), hit.alias("reopened"))


def reset(versions: DataFrame, key: str, *order: Column) -> DataFrame:
    """The newest version of each key as its first; run again, it gives the same."""
    w = Window.partitionBy(key).orderBy(*order)
    return versions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").withColumn("version", F.lit(1))


def paged(rows: DataFrame, order: list[Column], page: int, size: int = 10) -> DataFrame:
    """One page of rows in a total order, pages counted from 0."""
    return rows.orderBy(*order).offset(page * size).limit(size)
