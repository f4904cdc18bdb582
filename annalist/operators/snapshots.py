"""What changed between full snapshots.

The index of the last snapshot is a table in buckets by source and page, with the page's hashes. A new snapshot is shuffled into the
same buckets and probes it; the index itself never moves. What differs is written with the new index in one pass, and the new index
takes the place of the old one. Old values are fetched for changed pages only.

Defined results: rows without address, source or snapshot date are ignored; among rows of one page and snapshot the one delivered last
counts (null delivery is earliest, further ties go to the larger hashes); a page belongs to the source that lists it; a source that
delivers nothing keeps its pages; an unread text (null hash) takes the page's last known hash, also one from before a removal; an unknown
hash differs from a known one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.urls import page_key
from annalist.sources.shared import bounded, bucketed, open_bucketed, scratch

KEYS = ["source_id", "url_key"]
PAGES = "source_id string, url_key string, text_hash string, meta_hash string, present boolean, change_kind string, day int, old_day int"
SOURCES = "source_id string, last_day int"
#: Sources of a snapshot that may be broadcast; more are joined without a hint.
MOST_SOURCES = 200_000
#: Pages per bucket that the default number of buckets aims at.
PER_BUCKET = 2_000_000


def pages_of(snapshots: DataFrame) -> DataFrame:
    """The columns that the comparison needs; other columns are not read."""
    rows = snapshots.select(
        "source_id", page_key(F.col("canonical_url")).alias("url_key"), F.datediff("snapshot_date", F.lit("1970-01-01")).alias("day"),
        F.col("normalized_text_hash").alias("text_hash"), F.col("metadata_hash").alias("meta_hash"), "delivered_at",
    )
    return rows.filter("source_id is not null and url_key is not null and day is not null")


class Index:
    """The index after the snapshots read so far. ``pages`` also says of each page what the last snapshot changed."""

    def __init__(self, spark: SparkSession, buckets: int, folder: str | None = None) -> None:
        self.spark, self.buckets, self.folder, self.n = spark, buckets, folder or scratch(spark, "index"), 0
        self.pages: DataFrame | None = None
        self.sources = spark.createDataFrame([], SOURCES)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, n: int, buckets: int) -> Index:
        """The index that an earlier session left after its n-th snapshot."""
        index = cls(spark, buckets, folder)
        schema = spark.createDataFrame([], PAGES).schema
        index.n, index.pages = n, open_bucketed(spark, f"{folder}/pages-{n}", schema, KEYS, buckets)
        index.sources = index._sources()
        return index

    def _sources(self) -> DataFrame:
        """Each source with its last day: the parts written so far, not those of a run that was broken off."""
        parts = [f"{self.folder}/sources/n={i}" for i in range(1, self.n + 1)]
        return self.spark.read.schema(SOURCES).parquet(*parts).groupBy("source_id").agg(F.max("last_day").alias("last_day"))

    def advance(self, snapshot: DataFrame) -> DataFrame:
        """Compare one snapshot (rows of ``pages_of``, all of one day) with the index and swap; gives source_id, url_key, day, old_day, change_kind."""
        self.n += 1
        new = snapshot.repartition(self.buckets, *KEYS).groupBy(*KEYS).agg(F.max(F.struct("delivered_at", "text_hash", "meta_hash")).alias("v")).select(*KEYS, F.col("v.text_hash").alias("new_text"), F.col("v.meta_hash").alias("new_meta"), F.lit(True).alias("listed"))
        came = bounded(snapshot.groupBy("source_id").agg(F.max("day").alias("came")).join(self.sources, "source_id", "left"), MOST_SOURCES)
        if self.pages is None:
            rows = new.select(*KEYS, F.col("new_text").alias("text_hash"), F.col("new_meta").alias("meta_hash"), F.lit(True).alias("present"), F.lit(None).cast("string").alias("change_kind"), F.lit(None).cast("int").alias("day"), F.lit(None).cast("int").alias("old_day"))
        else:
            old = self.pages.select(*KEYS, "text_hash", "meta_hash", "present")
            both = old.join(new, KEYS, "full_outer").join(came, "source_id", "left")
            text, there = F.coalesce("new_text", "text_hash"), F.coalesce("present", F.lit(False))
            same = text.eqNullSafe(F.col("text_hash")) & F.col("new_meta").eqNullSafe(F.col("meta_hash"))
            kind = F.when(F.col("last_day").isNull(), None).when(F.col("listed") & ~there, "added").when(F.col("listed") & ~same, "changed").when(F.col("listed").isNull() & there, "removed")
            rows = both.select(
                *KEYS, text.alias("text_hash"), F.when(F.col("listed"), F.col("new_meta")).otherwise(F.col("meta_hash")).alias("meta_hash"),
                F.when(F.col("came").isNotNull(), F.coalesce("listed", F.lit(False))).otherwise(there).alias("present"),
                kind.alias("change_kind"), F.when(kind.isNotNull(), F.col("came")).alias("day"), F.when(kind.isNotNull(), F.col("last_day")).alias("old_day"),
            )
        self.pages = bucketed(rows, f"{self.folder}/pages-{self.n}", KEYS, self.buckets)
        came.select("source_id", F.col("came").alias("last_day")).write.parquet(f"{self.folder}/sources/n={self.n}")
        self.sources = self._sources()
        return self.pages.filter("change_kind is not null").select(*KEYS, "day", "old_day", "change_kind")


def snapshot_changes(snapshots: DataFrame, buckets: int | None = None, folder: str | None = None) -> DataFrame:
    """Pages added, removed or changed between consecutive snapshots of their source: the snapshots are read one after the other.

    ``snapshots``: snapshot_date, source_id, canonical_url, normalized_text_hash, metadata_hash, delivered_at. Only the days come to the driver.
    """
    spark = snapshots.sparkSession
    path = scratch(spark, "pages")
    pages_of(snapshots).write.partitionBy("day").parquet(path)  # as they would be delivered
    schema = pages_of(snapshots.limit(0)).schema
    rows = spark.read.schema(schema).parquet(path)
    days = [(r["day"], r["n"]) for r in rows.groupBy("day").agg(F.count(F.lit(1)).alias("n")).orderBy("day").collect()]
    n = buckets or max([spark.sparkContext.defaultParallelism, *(-(-m // PER_BUCKET) for _, m in days)])
    index, found = Index(spark, n, folder), None
    for day, _ in days:
        one = index.advance(rows.filter(F.col("day") == day))
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], "source_id string, url_key string, day int, old_day int, change_kind string")


def with_old_values(changes: DataFrame, snapshots: DataFrame, columns: list[str]) -> DataFrame:
    """Old and new values of the changed pages only: the changes pick their rows out of the snapshots, everything else stays unread."""
    rows = snapshots.select("source_id", page_key(F.col("canonical_url")).alias("url_key"), F.datediff("snapshot_date", F.lit("1970-01-01")).alias("day"), "delivered_at", *columns)
    few = changes.filter("change_kind = 'changed'")
    wanted = few.select("source_id", "url_key", F.explode(F.array("day", "old_day")).alias("day")).distinct()
    last = rows.join(wanted, ["source_id", "url_key", "day"], "left_semi").groupBy("source_id", "url_key", "day").agg(F.max(F.struct("delivered_at", *columns)).alias("v"))
    new = last.select("source_id", "url_key", "day", *[F.col(f"v.{c}").alias(f"new_{c}") for c in columns])
    old = last.select("source_id", "url_key", F.col("day").alias("old_day"), *[F.col(f"v.{c}").alias(f"old_{c}") for c in columns])
    return few.join(new, ["source_id", "url_key", "day"]).join(old, ["source_id", "url_key", "old_day"])
