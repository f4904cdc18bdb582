"""Tables and scratch space that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIONS = "spark.sql.unionOutputPartitioning"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def safe_unions(spark: SparkSession) -> None:
    """Switch off the setting by which a union of parts with like partitioning is taken to be partitioned itself.

    In Spark 4.1.2 that and adaptive re-planning together repeat rows: a distinct over the union of two aggregates, joined by broadcast, came out
    with 26 rows for 20 (tests/test_operators.py). Right results come before a saved shuffle.
    """
    spark.conf.set(UNIONS, "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One logical table; a file or a folder of Parquet files."""
    safe_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one, but only if the session runs on this machine alone."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="annalist-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, below one of this application that goes when the session's machine does."""
    root = f"{shared_dir(spark)}/annalist-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{root}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str = "part", path: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage and survives lost executors.

    The shuffle files of the write go when it is done, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = path or scratch(spark, what)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, path: str, keys: list[str], n: int) -> DataFrame:
    """Write a table in n buckets by ``keys``, ordered by them in each, so that a join on all the keys needn't move it."""
    name = f"annalist_{uuid.uuid4().hex}"
    df.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return _unnamed(df.sparkSession, name)


def open_bucketed(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], n: int) -> DataFrame:
    """A table that ``bucketed`` wrote, also in another session."""
    name, by = f"annalist_{uuid.uuid4().hex}", ", ".join(keys)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{path}'")
    return _unnamed(spark, name)


def _unnamed(spark: SparkSession, name: str) -> DataFrame:
    """The table's rows, and its name out of the catalog again: the files stay, and the plan knows them and their buckets."""
    df = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return df


def bounded(df: DataFrame, most: int) -> DataFrame:
    """Broadcast a side after checking that it has at most ``most`` rows; else leave the join to the optimizer.

    At most ``most`` + 1 rows ever reach the driver.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
