"""What a caller may replace: registries of functions on tables, each with a default that needs no model and no network.

A hosted model is one more function of the same kind (for example a ``mapInPandas`` over batches of texts). ``register`` adds it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import pipeline, retrieval, scan, segmentation
from annalist.sources import files
from annalist.streaming import monitor

# Entities by the words that name them, with their type, and the words of an obligation.
ENTITIES = [("nbfc", "RegulatedEntity", "NBFC"), ("bank", "RegulatedEntity", "Banks"), ("regulated entities", "RegulatedEntity", "Regulated Entities"), ("borrower", "Customer", "Borrowers"), ("customer", "Customer", "Customers"), ("digital lending", "LendingProduct", "Digital Lending"), ("co-lending", "LendingProduct", "Co-lending")]
OBLIGES = r"\b(?:must|shall|requires|required to|is required to)\b"
ISSUED, REQUIRES, APPLIES = 0.95, 0.72, 0.66


def extract_by_words(chunks: DataFrame, authority: list[str] | None = None) -> DataFrame:
    """chunk_id, source, type, target, confidence: what a chunk (chunk_id, title, text) says of its document, by fixed words.

    ``authority``: names of the issuing authority. A sentence with a word of obligation is a requirement of the document; it applies to every regulated entity
    that the chunk names.
    """
    low = F.lower("text")
    named = F.array_compact(F.array(*[F.when(low.rlike(rf"\b{word}\b"), F.lit(name)) for word, kind, name in ENTITIES if kind == "RegulatedEntity"]))
    duty = F.filter(T.sentences(F.col("text")), lambda s: F.lower(s).rlike(OBLIGES))
    rows = chunks.select("chunk_id", "title", F.transform(duty, lambda s: F.trim(F.substring(s, 1, 300))).alias("duty"), named.alias("named"), (low.rlike("|".join(rf"\b{a.lower()}\b" for a in authority)) if authority else F.lit(False)).alias("issued"))
    edge = lambda df, source, kind, target, sure: df.select("chunk_id", F.col(source).alias("source"), F.lit(kind).alias("type"), target.alias("target"), F.lit(sure).alias("confidence"))
    requires = rows.select("chunk_id", "title", "named", F.explode("duty").alias("requirement"))
    issued = edge(rows.filter("issued"), "title", "ISSUED_BY", F.lit((authority or [""])[0]), ISSUED)
    applies = requires.select("chunk_id", "requirement", F.explode("named").alias("entity"))
    return issued.unionByName(edge(requires, "title", "REQUIRES", F.col("requirement"), REQUIRES)).unionByName(edge(applies, "requirement", "APPLIES_TO", F.col("entity"), APPLIES))


def _unit_vectors(at: pd.Series) -> pd.Series:
    counts = [None if a is None or not len(a) else np.bincount(a, minlength=scan.DIMENSIONS).astype(float) for a in at]
    return pd.Series([None if c is None else c / np.sqrt((c * c).sum()) for c in counts], dtype=object)


def embed_by_hash(hashing: str) -> Callable[[Column], Column]:
    """A text as a unit vector of hashed words; null for texts without words."""
    return lambda text: F.pandas_udf(_unit_vectors, "array<double>")(scan.places(text, hashing))


REGISTRIES: dict[str, dict[str, Callable]] = {
    "extractor": {"words": extract_by_words},
    "answer": {"sentences": retrieval.answer_sentences},
    "fetcher": {"files": files.read_texts, "binary": files.read_binary},
    "sender": monitor.SENDERS,
    "chunker": segmentation.CHUNKERS,
    "embedder": {"md5": embed_by_hash("md5"), "blake2b": embed_by_hash("blake2b")},
    "reranker": pipeline.RERANKERS,
    "store": {"parquet": lambda spark, at: spark.read.parquet(at), "json": lambda spark, at: spark.read.json(at)},
}


def register(kind: str, name: str, function: Callable) -> None:
    if not callable(function):
        raise TypeError(f"{name} can't be called")
    REGISTRIES[kind][name] = function


def extension(kind: str, name: str) -> Callable:
    try:
        return REGISTRIES[kind][name]
    except KeyError:
        raise ValueError(f"there is no {kind} {name}; there are {sorted(REGISTRIES.get(kind, {}))}") from None


def run_steps(spark: SparkSession, steps: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """step, status, n, error: steps in their order, each counted; one that fails is reported and doesn't stop the others."""
    rows = []
    for name, step in steps.items():
        try:
            rows.append((name, "done", step().count(), None))
        except Exception as e:  # noqa: BLE001
            rows.append((name, "failed", None, f"{type(e).__name__}: {str(e)[:200]}"))
    return spark.createDataFrame(rows, "step string, status string, n long, error string")
