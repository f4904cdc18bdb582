"""Lines repeated across the pages of one source, found and removed.

Per source a mergeable heavy-hitter summary (a frequent-items sketch, combined before the shuffle) counts in how many versions each
line stands. A line stands in at least as many versions as on pages, so none that passes the threshold of pages is missed as long as the
summary's error stays below it; that is checked, a larger summary is made where it doesn't hold, and the lines of a source that is too
much for the largest are counted exactly. The candidates, few per source, are then counted exactly by pages in a second pass, and the
confirmed ones leave as a broadcast set whose size was checked.

Defined results: lines agree after lower-casing, turning each run of other characters than a-z into a space and trimming; below 12
characters a line never counts; a line counts if it stands on at least 5 and at least 20 % of the source's distinct pages, over all
their versions; null sources and texts hold no repeated line (a null text stays null); a row
without page counts on no page, but loses its source's repeated lines; equal rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.sources.shared import bounded

LEAST_CHARS, LEAST_PAGES, LEAST_SHARE = 12, 5, 0.2
#: Counters of a summary to begin with, and the most that Spark's sketch takes.
COUNTERS, MOST_COUNTERS = 8_192, 524_288
#: The sketch's error is at most this times the items counted, divided by its counters.
ERROR = 3.5
#: Rows of a set that may be broadcast; a larger one is joined without a hint.
MOST_LINES = 500_000


def line_key(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), "[^a-z]+", " "))


def _lines(versions: DataFrame, *more: str) -> DataFrame:
    """source, page and each line's key with its number; the keys are made before the lines are taken apart."""
    keys = F.transform(F.split("text", "\n"), line_key)
    return versions.select("source", "page", *more, F.posexplode(keys).alias("line_no", "line")).filter(F.length("line") >= LEAST_CHARS)


def candidates(versions: DataFrame, pages: DataFrame, counters: int = COUNTERS, most: int = MOST_COUNTERS) -> DataFrame:
    """(source, line hash) of every line that may pass the thresholds, and some more."""
    hashed = F.array_distinct(F.transform(F.filter(F.transform(F.split("text", "\n"), line_key), lambda x: F.length(x) >= LEAST_CHARS), lambda x: F.xxhash64(x)))
    stands = versions.select("source", F.explode(hashed).alias("line"))
    left, found = None, None
    while True:
        rows = stands if left is None else stands.join(left, "source", "left_semi")
        summary = rows.groupBy("source").agg(F.expr(f"approx_top_k_accumulate(line, {counters})").alias("s"), F.count(F.lit(1)).alias("n"))
        top = summary.join(pages, "source").select("source", "n", "least", F.expr(f"approx_top_k_estimate(s, {counters})").alias("top"))
        # exact while a source has no more items than 3/4 of the counters, else good if the threshold exceeds twice the error
        weak = (F.col("n") > 0.75 * counters) & (F.col("least") <= 2 * ERROR * F.col("n") / counters)
        top = top.select("source", weak.alias("weak"), F.when(~weak, F.filter("top", lambda t: t["count"] >= F.col("least"))).alias("top"))
        got = bounded(top.select("source", "weak", F.explode_outer("top.item").alias("line")), MOST_LINES)
        good = got.filter("not weak and line is not null").select("source", "line")
        found = good if found is None else found.unionByName(good)
        left = got.filter("weak").select("source").distinct()
        if not left.limit(1).count():
            return found
        if counters >= most:
            exact = stands.join(left, "source", "left_semi").groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))
            return found.unionByName(exact.join(pages, "source").filter("n >= least").select("source", "line"))
        counters = min(most, 8 * counters)


def repeated_lines(versions: DataFrame, counters: int = COUNTERS, most: int = MOST_COUNTERS) -> DataFrame:
    """source, line (normalised), n_pages of the lines repeated within a source. ``versions``: source, page, text."""
    rows = versions.filter("source is not null and page is not null")
    pages = rows.select("source", "page").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    pages = bounded(pages.select("source", F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("n") * LEAST_SHARE)).alias("least")), MOST_LINES)
    may = bounded(candidates(rows, pages, counters, most).withColumnRenamed("line", "hash"), MOST_LINES)
    exact = _lines(rows).withColumn("hash", F.xxhash64("line")).join(may, ["source", "hash"]).select("source", "page", "line").distinct()
    return exact.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n_pages")).join(pages, "source").filter("n_pages >= least").drop("least")


def repeated_places(versions: DataFrame, repeated: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and line_no of every occurrence of a repeated line."""
    return _lines(versions, *keep).join(bounded(repeated.select("source", "line"), MOST_LINES), ["source", "line"]).select(*keep, "line_no")


def without_repeated(versions: DataFrame, repeated: DataFrame) -> DataFrame:
    """Every row with ``clean_text``, the text without its source's repeated lines, and how many were removed."""
    sets = bounded(repeated.groupBy("source").agg(F.collect_set(F.xxhash64("line")).alias("bad")), MOST_LINES)
    keys = F.transform(F.split("text", "\n"), line_key)
    rows = versions.join(sets, "source", "left").withColumn("bad", F.coalesce("bad", F.array().cast("array<bigint>")))
    lines = F.arrays_zip(F.split("text", "\n").alias("line"), F.transform(keys, lambda k: (F.length(k) >= LEAST_CHARS) & F.array_contains("bad", F.xxhash64(k))).alias("gone"))
    rows = rows.withColumn("lines", lines)
    kept = F.array_join(F.transform(F.filter("lines", lambda x: ~x["gone"]), lambda x: x["line"]), "\n")
    return rows.withColumn("clean_text", kept).withColumn("n_removed", F.size(F.filter("lines", lambda x: x["gone"]))).drop("lines", "bad")
