"""References to records that do not exist, were removed, or came only later.

Parent and child keys go tagged into one long form that is grouped by parent table and key (combined before the shuffle); only
groups with something wrong are kept, written to the shared folder, and joined back to the child rows. Keys with a large share of
all references are salted in that join.

Defined results: ids compare trimmed and in lower case; null references do not count; a row with a null time is never late; of
repeated equal rows one counts; a parent with several records counts from its earliest known time; a removal without a time counts as the last word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators.skew import SHARES
from annalist.sources.shared import materialize


def plain_id(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))


def references(df: DataFrame, from_table: str, key: str, time: str, fields: dict[str, str]) -> DataFrame:
    """Child rows in long form: one per non-null reference. ``fields``: column -> parent table."""
    refs = F.array(*[F.struct(F.lit(f).alias("ref_field"), F.lit(p).alias("parent_table"), plain_id(F.col(f)).alias("ref_key")) for f, p in fields.items()])
    return (
        df.select(F.lit(from_table).alias("from_table"), F.col(key).alias("row_key"), F.col(time).alias("row_time"), F.explode(refs).alias("r"))
        .select("from_table", "row_key", "row_time", "r.*")
        .filter(F.col("ref_key").isNotNull())
    )


def orphan_references(children: DataFrame, parents: DataFrame, removals: DataFrame, n_rows: int) -> DataFrame:
    """One row per orphan reference with its kind: deleted, missing or late.

    ``children``: from ``references``; ``parents``: parent_table, ref_key, known_at; ``removals``: parent_table, ref_key, removed_at;
    ``n_rows``: an upper bound of the references (for the share that makes a key hot).
    """
    null_time, no = F.lit(None).cast("timestamp"), F.lit(False)
    long = (
        children.select("parent_table", "ref_key", no.alias("is_parent"), no.alias("is_removed"), null_time.alias("known_at"), null_time.alias("removed_at"), F.lit(1).alias("n"), F.col("row_time"))
        .unionByName(parents.select("parent_table", "ref_key", F.lit(True).alias("is_parent"), no.alias("is_removed"), "known_at", null_time.alias("removed_at"), F.lit(0).alias("n"), null_time.alias("row_time")))
        .unionByName(removals.select("parent_table", "ref_key", no.alias("is_parent"), F.lit(True).alias("is_removed"), null_time.alias("known_at"), "removed_at", F.lit(0).alias("n"), null_time.alias("row_time")))
    )
    groups = long.groupBy("parent_table", "ref_key").agg(
        F.max("is_parent").alias("has_parent"), F.max("is_removed").alias("is_removed"), F.min("known_at").alias("first_known"), F.max("known_at").alias("last_known"),
        F.max("removed_at").alias("removed_at"), F.sum("n").alias("n"), F.min("row_time").alias("first_row"),
    )
    back = F.coalesce(F.col("last_known") > F.col("removed_at"), F.lit(False))
    verdict = F.when(F.col("is_removed") & ~back, "deleted").when(~F.col("has_parent"), "missing").when(F.col("first_row") < F.col("first_known"), "late")
    limit = max(100_000, n_rows // SHARES)
    kept = groups.filter("n > 0").withColumn("orphan_kind", verdict).filter("orphan_kind is not null").select("parent_table", "ref_key", "orphan_kind", "first_known", F.ceil(F.col("n") / limit).cast("int").alias("salts"))
    kept = materialize(kept, "orphans")
    keys = ["parent_table", "ref_key"]
    few = kept.filter("salts > 1").select(*keys, "salts").collect()  # fewer than SHARES, as each holds more than limit rows
    if few:
        hot = F.broadcast(children.sparkSession.createDataFrame(few, "parent_table string, ref_key string, salts int"))
        children = children.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64("row_key", "row_time"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        kept = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        keys.append("salt")
    found = children.join(kept.drop("salts"), keys).filter((F.col("orphan_kind") != "late") | (F.col("row_time") < F.col("first_known")))
    return found.select("from_table", "row_key", "ref_field", "ref_key", "orphan_kind", F.coalesce(F.date_format("row_time", "yyyy-MM"), F.lit("unknown")).alias("ref_month")).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans by table, field, kind and month."""
    return found.groupBy("from_table", "ref_field", "orphan_kind", "ref_month").agg(F.count(F.lit(1)).alias("n_refs"))
