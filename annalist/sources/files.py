"""Reading and writing of files: schemas are given, never inferred; broken records are set aside, not dropped."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that holds one JSON array; a missing path gives an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, status: str | None = None) -> DataFrame:
    df = spark.read.schema(schema).json(path)
    return df.filter(F.col("status") == status) if status else df


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken lines) of JSON lines."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), F.try_parse_json("value").isNull().alias("bad"))
    return parsed.filter("not bad").select("r.*"), parsed.filter("bad").select("value")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole UTF-8 files (gzip too); empty files are not documents."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.filter(F.trim("text") != "")


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, content and its checksum."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return df.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def read_jdbc(spark: SparkSession, url: str, query: str, fetch: int = 10_000, **options: str) -> DataFrame:
    """A query against a database, in batches; parts in parallel with partitionColumn, lowerBound, upperBound and numPartitions."""
    return spark.read.format("jdbc").option("url", url).option("query" if "partitionColumn" not in options else "dbtable", query).option("fetchsize", fetch).options(**options).load()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def with_defaults(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """The schema's columns in its order; missing ones are added with their defaults, others are left out."""
    defaults = defaults or {}
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_json(df: DataFrame, path: str, columns: list[str], by: str | None = None) -> None:
    """Only the allowed columns leave."""
    w = df.select(*columns).write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def swap_in(df: DataFrame, folder: str, version: str, checks: dict[str, str] | None = None) -> str:
    """Write a new version beside the others, check it, and only then let the pointer file name it.

    ``checks``: name -> SQL condition that no row may meet. A version that is there is never overwritten; a failed one is not named.
    """
    spark = df.sparkSession
    path = f"{folder}/{version}"
    df.write.mode("errorifexists").parquet(path)
    back = spark.read.parquet(path)
    for name, bad in (checks or {}).items():
        if back.filter(bad).limit(1).count():
            raise ValueError(f"{version} fails the check {name}")
    _point(spark, folder, version)
    return path


def _point(spark: SparkSession, folder: str, version: str) -> None:
    """Write the pointer beside the old one and rename it over that in one step, so a reader finds the old or the new version."""
    jvm = spark._jvm
    fs_of = jvm.org.apache.hadoop.fs
    new, old = fs_of.Path(f"{folder}/CURRENT.{uuid.uuid4().hex}"), fs_of.Path(f"{folder}/CURRENT")
    conf = spark._jsc.hadoopConfiguration()
    out = new.getFileSystem(conf).create(new)
    out.write(bytearray(version.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fs_of.FileContext.getFileContext(new.toUri(), conf).rename(new, old, over)


def current(spark: SparkSession, folder: str) -> DataFrame:
    version = spark.read.text(f"{folder}/CURRENT").first()[0]
    return spark.read.parquet(f"{folder}/{version}")


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str, version: str) -> None:
    """Nodes and edges as one version: the pointer moves when both are there and no edge has an end outside."""
    spark = nodes.sparkSession
    nodes.write.mode("errorifexists").parquet(f"{folder}/{version}/nodes")
    edges.write.mode("errorifexists").parquet(f"{folder}/{version}/edges")
    n, e = (spark.read.parquet(f"{folder}/{version}/{x}") for x in ("nodes", "edges"))
    ends = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    if ends.join(n, "id", "left_anti").limit(1).count():
        raise ValueError(f"{version} has edges without nodes")
    _point(spark, folder, version)


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    version = spark.read.text(f"{folder}/CURRENT").first()[0]
    return spark.read.parquet(f"{folder}/{version}/nodes"), spark.read.parquet(f"{folder}/{version}/edges")


def read_zip(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """archive, path, sha256, content of every file in zip archives; a broken archive is a row with a null path. For ``manifest_problems``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, data in zip(b["path"], b["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        rows = [(archive, i.filename, hashlib.sha256(c := z.read(i)).hexdigest(), c) for i in z.infolist() if not i.is_dir()]
                except zipfile.BadZipFile:
                    rows = [(archive, None, None, None)]
                yield pd.DataFrame(rows, columns=["archive", "path", "sha256", "content"])

    return read_binary(spark, path, glob).select("path", "content").mapInPandas(run, "archive string, path string, sha256 string, content binary")


def read_backup(spark: SparkSession, path: str, schema: T.StructType, sums: DataFrame) -> DataFrame:
    """The rows of gzip files of JSON lines whose checksum is the stated one (``sums``: name, sha256); a file that differs or is not named is an error."""
    files = read_binary(spark, path, "*.gz").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "sha256")
    bad = files.join(sums.select("name", F.col("sha256").alias("want")), "name", "left").filter("not (sha256 <=> want)").select("name").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['name']} is not what was backed up")
    return spark.read.schema(schema).option("pathGlobFilter", "*.gz").json(path)


def sorted_out(files: DataFrame, kind: str, supported: tuple[str, ...] = ("html", "text")) -> tuple[DataFrame, DataFrame]:
    """(files of a supported kind, the others with the reason)."""
    ok = F.coalesce(F.col(kind).isin(*supported), F.lit(False))
    return files.filter(ok), files.filter(~ok).withColumn("reason", F.concat_ws(" ", F.lit("unsupported type:"), F.coalesce(kind, F.lit("none"))))


def read_registry(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The enabled entries of a small YAML (or JSON) list of sources."""
    text = "\n".join(r[0] for r in spark.read.text(path).collect())  # a configuration file
    try:
        import yaml

        entries = yaml.safe_load(text)
    except ImportError:
        entries = json.loads(text)
    rows = [{f.name: e.get(f.name) for f in schema} for e in entries or [] if e.get("enabled", True)]
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode(mode).save()


def execute_jdbc(spark: SparkSession, url: str, statement: str) -> None:
    """One statement on the driver's connection: DDL, or a set operation inside the database."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.createStatement().execute(statement)
    finally:
        connection.close()


def upsert_jdbc(df: DataFrame, url: str, name: str, key: str, staging: str) -> None:
    """Rows go to a staging table in parallel; one MERGE in the database then puts them in place."""
    write_jdbc(df, url, staging, "overwrite")
    others = [c for c in df.columns if c != key]
    quote = lambda c: f'"{c}"'
    sets, names, values = ", ".join(f"{quote(c)} = s.{quote(c)}" for c in others), ", ".join(map(quote, df.columns)), ", ".join(f"s.{quote(c)}" for c in df.columns)
    execute_jdbc(df.sparkSession, url, f"MERGE INTO {name} t USING {staging} s ON t.{quote(key)} = s.{quote(key)} WHEN MATCHED THEN UPDATE SET {sets} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})")


def delete_jdbc(df: DataFrame, url: str, name: str, key: str, staging: str) -> None:
    """Delete the rows whose key is among those of ``df``."""
    write_jdbc(df.select(key).distinct(), url, staging, "overwrite")
    execute_jdbc(df.sparkSession, url, f'DELETE FROM {name} WHERE "{key}" IN (SELECT "{key}" FROM {staging})')


def manifest_problems(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, problem: files that differ from, are missing from, or are not named in a manifest (path, sha256), repeated names and unsafe paths."""
    named = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("sha256").alias("want"))
    both = named.join(files.select("path", F.col("sha256").alias("have")), "path", "full_outer")
    problem = (
        F.when(F.col("path").rlike(r"(^|/)\.\.(/|$)|^/"), "unsafe path")
        .when(F.col("n") > 1, "named twice")
        .when(F.col("have").isNull(), "missing")
        .when(F.col("n").isNull(), "not in the manifest")
        .when(F.col("have") != F.col("want"), "checksum differs")
    )
    return both.withColumn("problem", problem).filter("problem is not null").select("path", "problem")
