"""Hot keys: found exactly, never more of them than a fixed number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot when it holds more than one part in SHARES of all rows, so there are fewer than SHARES hot keys.
SHARES = 512


def hot_keys(df: DataFrame, keys: list[str], total: int, least: int = 100_000, shares: int = SHARES) -> DataFrame | None:
    """Keys with more than max(least, total / shares) rows and how many salts each should get; None if there is none.

    The counts are combined before the shuffle. Fewer than ``shares`` rows can pass the filter, so collecting them is bounded.
    """
    limit = max(least, total // shares)
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > limit).collect()
    if not rows:
        return None
    spark = df.sparkSession
    schema = df.select(*keys).schema.add("n_rows", T.LongType()).add("salts", T.IntegerType())
    return spark.createDataFrame([(*r, -(-r["n_rows"] // limit)) for r in rows], schema)


def salted(df: DataFrame, hot: DataFrame | None, keys: list[str], by: Column) -> DataFrame:
    """Add ``salt``: 0, or for a hot key a number below its salts, chosen by ``by``."""
    if hot is None:
        return df.withColumn("salt", F.lit(0))
    few = F.broadcast(hot.select(*keys, "salts"))  # fewer than SHARES rows
    return df.join(few, keys, "left").withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")


def replicated(df: DataFrame, hot: DataFrame | None, keys: list[str]) -> DataFrame:
    """The other side of ``salted``: one copy per salt of its key."""
    if hot is None:
        return df.withColumn("salt", F.lit(0))
    few = F.broadcast(hot.select(*keys, "salts"))
    return df.join(few, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
