"""Mixing sources to target weights by Pareto order sampling.

Texts are counted in tokens of a public tokenizer. A source first gets as many whole copies of all its texts as fit into its
target; the rest is a sample in which a text's inclusion probability grows with its size (capped at 1: such texts are certain). Each
text is ranked by the odds of a hash of its id divided by its inclusion odds. Pareto sampling takes a fixed number of the lowest ranks;
as the target is in tokens, not in texts, the texts of lowest rank are taken until their tokens reach it.

A histogram of sizes per source gives its plan (copies, rest, scale of the probabilities), a histogram of ranks the bin in which its cut
lies: one row per source each. Only the texts of that one bin are ordered, so no source is ever gathered in one task.

Defined results: a text that occurs in several documents counts once, for the document with the smallest id; documents of no
wanted source, null texts and texts without tokens are not used; a source that can't reach its target gives max_repeats copies of all
it has (null max_repeats: once); a wanted source without documents is reported with 0. The last text taken may exceed the target.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.sources.shared import bounded, materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer's vocabulary cuts text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BINS, SEED = 65_536, 17
#: Bins of sizes per doubling, in the histogram that the scale of the probabilities is found in.
FINE = 16
#: Wanted sources that may be broadcast; more are joined without a hint.
MOST_SOURCES = 100_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    encode = _encoding(path).encode_ordinary
    for b in batches:
        yield b.assign(n_tokens=[len(encode(t)) for t in b["text"]]).drop(columns="text")


def token_counts(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens of each different text of the wanted sources."""
    wanted = docs.select("doc_id", "source", "text").join(bounded(targets.select("source").distinct(), MOST_SOURCES), "source", "left_semi").filter("text is not null and doc_id is not null")
    rows = wanted.withColumn("h", F.sha2("text", 256))
    counted = rows.mapInPandas(lambda it: _count(it, path), "doc_id long, source string, h string, n_tokens long")
    first = counted.groupBy("h").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d"))
    return first.select("d.doc_id", "d.source", "d.n_tokens").filter("n_tokens > 0")


def _scale(rest: float, sizes: list[tuple[int, int]]) -> float:
    """c such that the expected size of a sample with probabilities min(1, c * size) is ``rest``; sizes: (tokens, texts)."""
    sizes = sorted(sizes, reverse=True)
    left, square = rest, float(sum(x * x * n for x, n in sizes))
    for x, n in sizes:
        if square <= 0 or left <= 0:
            break
        if left / square * x < 1:
            return left / square
        left -= x * n
        square -= x * x * n
    return float("inf")


PLAN = "source string, target_share double, max_repeats int, supply_tokens long, target_tokens double, whole int, rest double, c double, reachable boolean"


def _planned(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one source, from its histogram of sizes (at most FINE rows per doubling): copies of all, what is left to sample, and the scale."""
    r = rows.iloc[0]
    have, most, target = int(rows["tokens"].sum()), max(0, int(r["max_repeats"])), float(r["target_share"] * r["total"])
    whole = min(most, int(target // have)) if have else 0
    rest = target - whole * have if have and whole < most else 0.0
    sizes = rows[rows["n"] > 0]
    c = _scale(rest, list(zip((sizes["tokens"] / sizes["n"]).tolist(), sizes["n"].tolist()))) if rest > 0 else 0.0
    out = {"source": r["source"], "target_share": r["target_share"], "max_repeats": r["max_repeats"], "supply_tokens": have, "target_tokens": target, "whole": whole, "rest": rest, "c": c, "reachable": bool(have) and most * have >= target}
    return pd.DataFrame([out])


def mixture(tokens: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, n_tokens, copies) and a plan per source, for a total of ``budget`` tokens.

    By default the budget is what the wanted sources hold. ``tokens`` should be a written table: it is read several times.
    """
    wanted = targets.filter("source is not null and target_share is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    sizes = tokens.groupBy("source", F.floor(F.log2("n_tokens") * FINE).alias("size")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    rows = wanted.join(sizes, "source", "left").fillna(0, ["tokens", "n"])
    total = F.lit(budget) if budget is not None else F.sum("tokens").over(Window.partitionBy())  # a few hundred rows per source at most
    plan = materialize(rows.withColumn("total", total.cast("double")).groupBy("source").applyInPandas(_planned, PLAN), "plan")
    few = bounded(plan.select("source", "whole", "rest", "c"), MOST_SOURCES)
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    pi = F.least(F.lit(1.0), F.col("c") * F.col("n_tokens"))
    # a rank r in [0, inf) as r / (1 + r), which keeps the order and is 0 for certain texts
    r = F.when(pi >= 1, F.lit(0.0)).otherwise((u / (1 - u)) / (pi / (1 - pi)))
    ranked = tokens.join(few, "source").withColumn("q", F.when(F.col("rest") > 0, r / (1 + r))).withColumn("bin", F.when(F.col("q").isNotNull(), F.least(F.lit(BINS - 1), F.floor(F.col("q") * BINS))).cast("int"))
    by = Window.partitionBy("source").orderBy("bin")
    bins = ranked.filter("bin is not null").groupBy("source", "bin").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest")).withColumn("before", F.sum("t").over(by) - F.col("t"))
    cut = bins.filter("before < rest and before + t >= rest").groupBy("source").agg(F.min(F.struct("bin", "before")).alias("cut"))
    placed = ranked.join(bounded(cut.select("source", F.col("cut.bin").alias("cut"), F.col("cut.before").alias("before")), MOST_SOURCES), "source", "left")
    last = Window.partitionBy("source").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter("bin = cut").withColumn("extra", (F.col("before") + F.sum("n_tokens").over(last) - F.col("n_tokens") < F.col("rest")).cast("int"))
    other = placed.filter("bin is null or cut is null or bin <> cut").withColumn("extra", F.coalesce((F.col("bin") < F.col("cut")) | (F.col("cut").isNull() & F.col("bin").isNotNull()), F.lit(False)).cast("int"))
    mixed = edge.unionByName(other).withColumn("copies", F.col("whole") + F.col("extra")).filter("copies > 0")
    return mixed.select("doc_id", "source", "n_tokens", "copies"), plan


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, path: str = TOKENIZER, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    return mixture(materialize(token_counts(docs, targets, path), "tokens"), targets, budget, seed)


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per wanted source: the target and the share of all tokens reached."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("texts"), F.max("copies").alias("most_copies"))
    out = plan.join(got, "source", "left").select("source", "target_share", "max_repeats", "supply_tokens", F.round("target_tokens", 3).alias("target_tokens"), "reachable", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "texts", "most_copies")])
    return out.withColumn("reached_share", F.round(F.col("tokens") / F.greatest(F.lit(1), F.sum("tokens").over(Window.partitionBy())), 9))
