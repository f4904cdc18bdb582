"""Best k of all rows for many queries in one scan: rows are scored where they lie, and only each task's best k leave it.

Nothing but k rows per query and task is shuffled, however many rows share words with a query. The queries are a stated set; they go to the
executors in blocks of BLOCK. Texts are read from an index that is built once: their words as numbers, so that a batch is scored by array
operations without looking at a text again. Order: rounded score, then key.

Defined results: null texts and queries match nothing; a row without any word of a query is no result of it; equal keys count as rows; words
are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.sources.shared import materialize, scratch

BLOCK, BATCH, DIMENSIONS = 1024, 1024, 384
#: Tasks per core that a search is cut into, at least; words that are scored by a dense product, the most asked for; cells in which words are counted.
TASKS, COMMON, CELLS = 4, 256, 1 << 21
LONG = re.compile("[a-z0-9]{3,}")
#: The days of open bounds.
NEVER, EVER = -(2**30), 2**30
Matrix = Callable[[pa.RecordBatch], np.ndarray]


class Best:
    """The best k rows per query of the batches so far, by rounded score and key; score 0 or less is none.

    A score enters only if it reaches its query's k-th so far, so of most batches next to nothing is looked at twice.
    """

    def __init__(self, n: int, k: int, places: int = 6, largest: bool = False) -> None:
        self.n, self.k, self.places, self.largest = n, k, places, largest
        self.least, self.half = np.zeros(n), 0.51 * 10.0**-places
        self.query, self.score, self.row, self.keys = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), None
        self.waiting = self.rows = 0
        self.new: list[tuple[np.ndarray, ...]] = []

    def add(self, score: np.ndarray, keys: np.ndarray) -> None:
        """score: rows x queries; keys: of the rows."""
        known, n = 0 if self.keys is None else len(self.keys), len(score)
        self.keys = keys if self.keys is None else np.concatenate([self.keys, keys])
        floor = np.maximum(self.least - self.half, 0.98 * self.half)
        hit = score >= floor
        if n > self.k and np.count_nonzero(hit) > 2 * self.k * self.n:
            hit = score >= np.maximum(floor, np.partition(score, n - self.k, axis=0)[n - self.k] - 2 * self.half)
        at = np.flatnonzero(hit)
        row, query = at // self.n, at % self.n
        self.new.append((query, np.round(score.ravel()[at], self.places), known + row))
        self.waiting, self.rows = self.waiting + len(at), self.rows + n
        if self.waiting >= self.k * self.n or self.rows >= 64 * BATCH:
            self._settle()

    def _settle(self) -> None:
        query, score, row = (np.concatenate(x) for x in zip((self.query, self.score, self.row), *self.new))
        held = (score > 0) & (score >= self.least[query])
        query, score, row = query[held], score[held], row[held]
        used, row = np.unique(row, return_inverse=True)
        keys = np.zeros(0) if self.keys is None else self.keys[used]
        place = np.empty(len(keys), np.int64)
        place[np.argsort(keys, kind="stable")] = np.arange(len(keys))
        order = np.lexsort((-place[row] if self.largest else place[row], -score, query))
        query, score, row = query[order], score[order], row[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        self.least[query[nth == self.k - 1]] = score[nth == self.k - 1]
        best = nth < self.k
        self.query, self.score, self.row, self.keys = query[best], score[best], row[best], keys
        self.new, self.waiting, self.rows = [], 0, 0

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, score)."""
        self._settle()
        return self.query, self.keys[self.row], self.score


def scan_top_k(docs: DataFrame, key: str, columns: list[str], blocks: list[tuple[list, Matrix]], k: int, places: int = 6, largest: bool = False) -> DataFrame:
    """query_id, key, score, rank. ``blocks``: (query ids, what scores a batch of rows against them); ties by key, the smallest or the largest first.

    With many blocks each is scanned by few tasks, which leave k rows per query each.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    schema = pa.schema([("query_id", pa.int64()), (key, pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), ("score", pa.float64())])
    parts = -(-TASKS * spark.sparkContext.defaultParallelism // max(1, len(blocks)))
    found = None
    for ids, scorer in blocks:

        def run(batches: Iterator[pa.RecordBatch], ids=ids, scorer=scorer) -> Iterator[pa.RecordBatch]:
            best = Best(len(ids), k, places, largest)
            for b in batches:
                for at in range(0, b.num_rows, BATCH):
                    part = b.slice(at, BATCH)
                    best.add(scorer(part), part.column(key).to_numpy(zero_copy_only=False))
            query, keys, score = best.found()
            for at in range(0, len(query), 8 * BATCH):
                to = slice(at, at + 8 * BATCH)
                yield pa.RecordBatch.from_arrays([pa.array(c[to], type=f.type) for c, f in zip((np.array(ids)[query], keys, score), schema)], schema=schema)

        one = docs.select(key, *columns).coalesce(parts).mapInArrow(run, f"query_id long, {key} {kind}, score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], f"query_id long, {key} {kind}, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(key) if largest else F.asc(key))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def query_blocks(queries: DataFrame, columns: list[str]) -> Iterator[pd.DataFrame]:
    """The query set in blocks; one block at a time is on the driver."""
    block = []
    for r in queries.select("query_id", *columns).orderBy("query_id").toLocalIterator():
        block.append(tuple(r))
        if len(block) == BLOCK:
            yield pd.DataFrame(block, columns=["query_id", *columns])
            block = []
    if block:
        yield pd.DataFrame(block, columns=["query_id", *columns])


# the index: a text's words as numbers


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def blake_place(word: str) -> int:
    """The other hash that vectors are made with."""
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big") % DIMENSIONS


def _blake_places(words: pd.Series) -> pd.Series:
    known: dict[str, int] = {}

    def place(w: str) -> int:
        at = known.get(w)
        if at is None:
            at = known[w] = blake_place(w)
        return at

    return words.map(lambda ws: None if ws is None else [place(w) for w in ws])


def places(text: Column, hashing: str = "md5") -> Column:
    """The place of each word of two letters or more in the hashed vector; md5 is done by the engine, blake2b is not."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))
    if hashing == "blake2b":
        return F.pandas_udf(_blake_places, "array<int>")(words)
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 15), 16, 10).cast("long") % DIMENSIONS).cast("int"))


@dataclass
class TextIndex:
    """rows: key, keep, words (all, in order), long (different words of three letters or more), title_long, places; df: word, df; n texts of avg words."""

    rows: DataFrame
    df: DataFrame
    n: int
    avg: float
    key: str

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, title: str | None = None, keep: list[str] | None = None, hashing: str = "md5", folder: str | None = None) -> TextIndex:
        """Write the index of ``docs`` to a folder (by default of this session). Rows without text have no words, but a title may match."""
        spark = docs.sparkSession
        folder = folder or scratch(spark, "texts")
        heading = F.col(title) if title else F.lit(None).cast("string")
        rows = docs.select(key, *(keep or []), _hashed(T.tokens(F.col(text))).alias("words"), _hashed(T.terms(F.col(text))).alias("long"), _hashed(T.terms(heading)).alias("title_long"), places(F.col(text), hashing).alias("places"))
        rows = materialize(rows, path=f"{folder}/rows")
        materialize(rows.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")), path=f"{folder}/df")
        return cls.open(spark, folder, key)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, key: str) -> TextIndex:
        rows = spark.read.parquet(f"{folder}/rows")
        size = rows.filter("words is not null").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("avg")).first()
        return cls(rows, spark.read.parquet(f"{folder}/df"), size["n"], size["avg"] or 1.0, key)


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each element, element, elements per row) of a column of arrays."""
    c = batch.column(column)
    n = c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(n)), n), c.flatten().to_numpy(zero_copy_only=False), n


class _Asked:
    """Which queries ask for which word, and what each asks it for: sorted words, and their queries one after the other."""

    def __init__(self, words: list[np.ndarray], values: list[np.ndarray]) -> None:
        w, q, x = np.concatenate([*words, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(words)), [len(a) for a in words]), np.concatenate([*values, np.zeros(0)])
        order = np.argsort(w, kind="stable")
        self.query, self.value, self.n = q[order], x[order], len(words)
        self.words, self.first, self.many = np.unique(w[order], return_index=True, return_counts=True)
        most = np.argsort(-self.many, kind="stable")[:COMMON]
        self.common = np.full(len(self.words), -1)
        self.common[most] = np.arange(len(most))
        at = np.repeat(self.common, self.many)
        self.matrix = np.bincount((at * self.n + self.query)[at >= 0], self.value[at >= 0], len(most) * self.n).reshape(len(most), self.n)

    def find(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which elements are asked for, number of the word)."""
        if not len(self.words) or not len(flat):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == flat)
        return hit, at[hit]

    def product(self, n: int, row: np.ndarray, word: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """n rows x queries: weight times value, summed over a row's words; of the common words a dense product, of the others a sparse one."""
        at = self.common[word]
        own = at >= 0
        size = len(self.matrix)
        out = np.bincount(row[own] * size + at[own], weight[own], n * size).reshape(n, size) @ self.matrix
        if not own.all():
            row, word, weight = row[~own], word[~own], weight[~own]
            many = self.many[word]
            which = np.repeat(self.first[word] - np.cumsum(many) + many, many) + np.arange(many.sum())
            out += np.bincount(np.repeat(row, many) * self.n + self.query[which], np.repeat(weight, many) * self.value[which], out.size).reshape(out.shape)
        return out


def _counted(pair: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(different numbers below ``most``, how often each)."""
    if most > CELLS:
        return np.unique(pair, return_counts=True)
    n = np.bincount(pair)
    pair = np.flatnonzero(n)
    return pair, n[pair]


def _held(part: pa.RecordBatch, window: tuple[str, str], days: np.ndarray) -> np.ndarray:
    """Which rows hold on which query's day; null bounds are open."""
    number = lambda c, none: part.column(c).cast(pa.int32()).fill_null(none).to_numpy(zero_copy_only=False)[:, None]
    return (number(window[0], NEVER) <= days[None, :]) & (days[None, :] < number(window[1], EVER))


def bm25_top_k(index: TextIndex, queries: DataFrame, k: int, window: tuple[str, str] | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The best k texts of each query by BM25. ``queries``: query_id, query, and day if a window of dates (kept columns) must hold on it, before the cut."""
    asked = queries.filter("query is not null").select("query_id", _hashed(F.array_distinct(T.tokens(F.col("query")))).alias("w"), *([F.datediff("day", F.lit("1970-01-01")).alias("day")] if window else []))
    blocks = []
    for q in query_blocks(asked, ["w", *(["day"] if window else [])]):
        words = [np.array(x, dtype=np.int64) for x in q["w"]]
        every = np.unique(np.concatenate(words))
        wanted = index.df.sparkSession.createDataFrame(pd.DataFrame({"word": every}), "word long")  # the words of at most BLOCK queries
        df = {r["word"]: r["df"] for r in index.df.join(F.broadcast(wanted), "word").collect()}
        idf = lambda n: np.log(1 + (index.n - n + 0.5) / (n + 0.5))
        words = [np.array([w for w in x if w in df], dtype=np.int64) for x in words]
        table = _Asked(words, [np.array([idf(df[w]) for w in x.tolist()]) for x in words])
        days = q["day"].fillna(NEVER).to_numpy().astype(np.int64) if window else None
        average = index.avg

        def score(part: pa.RecordBatch, table=table, days=days, average=average) -> np.ndarray:
            row, flat, length = _flat(part, "words")
            hit, word = table.find(flat)
            size = max(1, len(table.words))
            pair, tf = _counted(row[hit] * size + word, part.num_rows * size)
            row, word = pair // size, pair % size
            out = table.product(part.num_rows, row, word, tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / average)))
            return np.where(_held(part, window, days), out, 0.0) if window else out

        blocks.append((q["query_id"].tolist(), score))
    return scan_top_k(index.rows, index.key, ["words", *(window or [])], blocks, k)


def _vectors(row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    v = np.bincount(row * DIMENSIONS + place, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(float)
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(length > 0, length, 1)


def blended_top_k(index: TextIndex, queries: DataFrame, k: int, hashing: str = "md5") -> DataFrame:
    """0.55 x cosine of hashed vectors + 0.45 x (0.55 x share of the query's words in the text + 0.45 x share in the title); blank queries match nothing.

    ``hashing``: what the index was built with.
    """
    asked = queries.filter("trim(query) <> ''").select("query_id", _hashed(T.keywords(F.col("query"))).alias("w"), places(F.col("query"), hashing).alias("p"))
    blocks = []
    for q in query_blocks(asked, ["w", "p"]):
        own = [np.array(x, dtype=np.int64) for x in q["p"]]
        dense = _vectors(np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own).astype(np.int64), len(own)).T
        used = np.flatnonzero(dense.any(axis=1))  # the other places add nothing
        dense = np.ascontiguousarray(dense[used])
        words = [np.array(x, dtype=np.int64) for x in q["w"]]
        table = _Asked(words, [np.full(len(x), 1 / max(1, len(x))) for x in words])

        def score(part: pa.RecordBatch, dense=dense, table=table, used=used) -> np.ndarray:
            row, place, _ = _flat(part, "places")
            found = []
            for column, share in (("long", 0.55), ("title_long", 0.45)):
                at, flat, _ = _flat(part, column)
                hit, word = table.find(flat)
                found.append((at[hit], word, np.full(len(hit), share)))
            out = table.product(part.num_rows, *(np.concatenate(x) for x in zip(*found)))
            out *= 0.45
            close = _vectors(row, place.astype(np.int64), part.num_rows)[:, used] @ dense
            close *= 0.55
            out += np.maximum(close, 0.0, out=close)
            return out

        blocks.append((q["query_id"].tolist(), score))
    return scan_top_k(index.rows, index.key, ["places", "long", "title_long"], blocks, k)


def overlap_top_k(rows: DataFrame, key: str, text: str, queries: DataFrame, k: int, stops: frozenset = frozenset()) -> DataFrame:
    """query_id, key, overlap: the k rows that share most different words of three letters or more with a query; ties go to the larger key."""
    blocks = []
    asked = queries.filter("query is not null").select("query_id", _hashed(T.terms(F.col("query"), sorted(stops))).alias("w"))
    for q in query_blocks(asked, ["w"]):
        words = [np.array(x, dtype=np.int64) for x in q["w"]]
        table = _Asked(words, [np.ones(len(x)) for x in words])

        def score(part: pa.RecordBatch, table=table) -> np.ndarray:
            row, flat, _ = _flat(part, "long")
            hit, word = table.find(flat)
            return table.product(part.num_rows, row[hit], word, np.ones(len(hit)))

        blocks.append((q["query_id"].tolist(), score))
    found = scan_top_k(rows.filter(F.col(text).isNotNull()).withColumn("long", _hashed(T.terms(F.col(text)))), key, ["long"], blocks, k, largest=True)
    return found.select("query_id", key, F.col("score").cast("long").alias("overlap"))


def dense_top_k(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, others_only: bool = True) -> DataFrame:
    """The k nearest by cosine of unit vectors. ``queries``: query_id, q; with ``others_only`` a vector isn't its own neighbour."""
    blocks = []
    for q in query_blocks(queries.filter("q is not null"), ["q"]):
        matrix, own = np.array(q["q"].tolist(), dtype=np.float64).T, q["query_id"].to_numpy()

        def score(part: pa.RecordBatch, matrix=matrix, own=own) -> np.ndarray:
            rows = _flat(part, vector)[1].astype(np.float64).reshape(part.num_rows, len(matrix))
            out = np.maximum(rows @ matrix + 1.0, 1e-9)  # so that every row is a result
            return np.where(part.column(key).to_numpy(zero_copy_only=False)[:, None] == own[None, :], 0.0, out) if others_only else out

        blocks.append((own.tolist(), score))
    found = scan_top_k(vectors.filter(F.col(vector).isNotNull()), key, [vector], blocks, k)
    return found.withColumn("score", F.round(F.col("score") - 1.0, 6))
