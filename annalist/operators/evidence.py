"""What surrounds an answer: evidence merged, notices of change, citations checked, statuses applied, texts matched."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text as T

# Fixed value: how texts define a term.
MEANS = r"[“\"]([^”\"]{2,80})[”\"]\s*(?:,\s*)?(?:means|shall mean|includes|shall include|refers to)\b"

WORD = re.compile("[a-z0-9]{3,}")


def merged(first: DataFrame, second: DataFrame, key: str, most: int) -> DataFrame:
    """first + second (query_id, key, place, value), each key once: at its first position, with its last value."""
    rows = first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1)))
    one = rows.groupBy("query_id", key).agg(F.min(F.struct("part", "place")).alias("at"), F.max_by("value", F.struct("part", "place")).alias("value"))
    w = Window.partitionBy("query_id").orderBy("at.part", "at.place", key)
    return one.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("query_id", key, "place", "value")


def notice(status: Column, starts: Column, successor_starts: Column, day: Column) -> Column:
    """replaced: the rule has a successor in force; withdrawn: it ended without one; upcoming: it is not yet in force."""
    ended = status.isin("WITHDRAWN", "REPEALED", "SUPERSEDED")
    return F.when(ended & F.coalesce(successor_starts <= day, F.lit(False)), "replaced").when(ended, "withdrawn").when(F.coalesce(starts > day, F.lit(False)), "upcoming")


def citations_valid(cited: Column, available: Column) -> Column:
    """Something is cited, and nothing that was not retrieved."""
    return (F.size(cited) > 0) & (F.size(F.array_except(cited, available)) == 0)


def verdict(verdict: Column, n_cited: Column, quote: Column, text: Column) -> Column:
    """A claim without citation or verdict is not supported; one whose quote isn't in the text is supported in part at most."""
    found = F.coalesce(F.contains(T.normalise(text), T.normalise(quote)), F.lit(False))
    return F.when((n_cited == 0) | verdict.isNull(), "not_supported").when((verdict == "supported") & ~found, "partially_supported").otherwise(verdict)


def definitions(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(MEANS), F.lit(1)), T.canonical_name)


def _matches(old: str, new: str, floor: float) -> Iterator[tuple[int, int | None, float]]:
    words = lambda t: [(k, set(WORD.findall(x.lower()))) for k, x in enumerate(t.split("\n")) if x.strip(" ")]
    sizes, places = {}, defaultdict(list)
    for k, own in words(new):
        sizes[k] = len(own)
        for w in own:
            places[w].append(k)
    for k, own in words(old):
        shared = Counter(chain.from_iterable(places[w] for w in own if w in places))
        score, at = min(((-round(n / math.sqrt(len(own) * sizes[j]), 6), j) for j, n in shared.items()), default=(0.0, None))
        yield k, at if -score >= floor else None, abs(score)


def best_match(pairs: DataFrame, keys: list[str], old: str, new: str, floor: float = 0.3) -> DataFrame:
    """keys, old_key, new_key, score: for each line of ``old`` the line of ``new`` with the most like words (cosine of their sets); ties to the first.

    Below ``floor`` new_key is null, as for a paragraph that was deleted, and score the best there was (0 if no word is shared).
    Lines are numbered from 0; blank ones are none. Both texts stand in one row, so no word is shuffled; lines that share no word never meet.
    """
    names = [*keys, "old_key", "new_key", "score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*key, *m) for *key, x, y in zip(*[b[k] for k in keys], b[old], b[new]) for m in _matches(x, y, floor)]
            yield pd.DataFrame(rows, columns=names).astype({"new_key": "Int32"})

    kinds = [f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys]
    return pairs.select(*keys, old, new).mapInPandas(run, ", ".join([*kinds, "old_key int, new_key int, score double"]))


#: Characters of a head, and of a text that are looked at at once; bits of the filter of heads, for each and at most, and bits that a head sets.
HEAD, STRETCH, BITS, MOST_BITS, SET = 60, 1 << 18, 16, 1 << 27, 4
_BASE = 0x9E3779B97F4A7C15
_POWERS, _INVERSE = (np.cumprod(np.full(STRETCH, x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _numbers(t: str, document: int) -> np.ndarray:
    """A number for each stretch of HEAD characters, the same for equal stretches of a document: a polynomial in the characters, mixed."""
    h = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _POWERS[: len(h)])])
    x = ((sums[HEAD:] - sums[:-HEAD]) * _INVERSE[: len(h) - HEAD + 1]) ^ np.uint64(document & (2**64 - 1))
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _bit(x: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The place of the n-th bit that numbers set in a filter."""
    return ((x & np.uint64(0xFFFFFFFF)) + np.uint64(n) * ((x >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)


def _kept(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which numbers may be a head's: all their bits are set."""
    at = np.arange(len(x))
    for n in range(SET):
        bit = _bit(x[at], n, 64 * len(words))
        at = at[(words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
    return at


def _filter(long: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the heads of ``long``, of which there are at most n: bits in words of 64. The bits are merged by the executors."""
    bits = 1 << min(max(6, (BITS * n).bit_length()), MOST_BITS.bit_length() - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.concatenate([np.zeros(0, np.uint64), *(_numbers(t, d) for t, d in zip(b["head"], b["document"]))])
            bit = np.concatenate([_bit(x, k, bits) for k in range(SET)])
            yield pd.DataFrame({"word": (bit >> np.uint64(6)).astype(np.int32), "set": (np.uint64(1) << (bit & np.uint64(63))).view(np.int64)})

    merged = long.select("head", "document").mapInPandas(run, "word int, set long").groupBy("word").agg(F.bit_or("set").alias("set")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[merged["word"].to_numpy()] = merged["set"].to_numpy()
    return words.view(np.uint64)


def _long(passages: DataFrame) -> DataFrame:
    rows = passages.filter((F.length("t") >= HEAD) & F.col("document_id").isNotNull())
    return rows.withColumn("head", F.substring("t", 1, HEAD)).withColumn("document", F.xxhash64("document_id"))


def held_heads(passages: DataFrame) -> DataFrame:
    """document_id, head, chunk_index, chunk_id: the stretches of HEAD characters of passages that are a head of their document, and a few others that pass for one."""
    long = _long(passages)
    kind = passages.schema["document_id"].dataType.simpleString()
    words = passages.sparkSession.sparkContext.broadcast(_filter(long, passages.count()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, i, c, t, n in zip(b["document_id"], b["chunk_index"], b["chunk_id"], b["t"], b["document"]):
                for start in range(0, len(t) - HEAD + 1, STRETCH - HEAD + 1):
                    part = t[start : start + STRETCH]
                    rows += [(d, h, i, c) for h in {part[k : k + HEAD] for k in _kept(_numbers(part, n), words.value)}]
            yield pd.DataFrame(rows, columns=["document_id", "head", "chunk_index", "chunk_id"]).astype({"chunk_index": "Int32"})

    return long.select("document_id", "chunk_index", "chunk_id", "t", "document").mapInPandas(run, f"document_id {kind}, head string, chunk_index int, chunk_id string")


def first_with_head(passages: DataFrame) -> DataFrame:
    """chunk_id, first_chunk: for each passage of HEAD characters or more the first of its document that holds its first HEAD characters.

    ``passages``: chunk_id, document_id, chunk_index, t. No text is moved, and no passage meets another: of a text only the stretches go out
    that pass a filter of all heads, and the first passage of each is an aggregate. The filter has a bounded size; beyond it more stretches pass.
    """
    found = held_heads(passages).groupBy("document_id", "head").agg(F.min(F.struct("chunk_index", "chunk_id")).alias("p"))
    return _long(passages).select("document_id", "head", "chunk_id").join(found, ["document_id", "head"]).select("chunk_id", F.col("p.chunk_id").alias("first_chunk"))


def applied(end: Column, withdrawn_on: Column) -> Column:
    """The end of a rule after a register says it was withdrawn: it only ever moves earlier."""
    return F.least(end, withdrawn_on)


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """A sample of n rows without replacement that any engine can repeat."""
    return df.withColumn("h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))).orderBy("h", key).limit(n).drop("h")
