"""Measures of ranked results, thresholds and latencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.sources.shared import bounded, materialize

#: Groups that may be broadcast; more are joined without a hint.
MOST_GROUPS = 100_000


#: Groups of fewer rows are ordered whole; of larger ones only what lies within CLOSE of a wanted rank.
WHOLE, CLOSE = 10_000, 0.001


def at_ranks(rows: DataFrame, group: str, value: str, ranks: dict[str, Column], shares: list[float]) -> DataFrame:
    """group, n and per name the exact value at a rank (a whole number made from the column n; rank 1 is the smallest value).

    ``shares``: about where in a group the ranks lie. Approximate percentiles bound each rank from both sides, all rows below are only counted,
    and just those between the bounds are ordered; so no group is gathered.
    """
    rows = rows.select(group, F.col(value).alias("v")).filter("v is not null")
    sides = [min(1.0, max(0.0, s + x)) for s in shares for x in (-CLOSE, CLOSE)]
    edges = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", sides, 100_000).alias("e"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    small = F.col("n") <= WHOLE
    spans = F.array(*[F.struct(F.when(small, F.col("lo")).otherwise(F.get("e", F.lit(2 * i))).alias("lo"), F.when(small, F.col("hi")).otherwise(F.get("e", F.lit(2 * i + 1))).alias("hi")) for i in range(len(shares))])
    edges = materialize(edges.select(group, "n", spans.alias("spans")), "edges")
    placed = rows.join(bounded(edges, MOST_GROUPS), group)
    below = placed.groupBy(group).agg(F.any_value("n").alias("n"), *[F.count_if(F.col("v") < F.col("spans")[i]["lo"]).alias(f"b{i}") for i in range(len(shares))])
    near = placed.select(group, "v", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda i: F.col("v").between(F.get("spans", i)["lo"], F.get("spans", i)["hi"]))).alias("span"))
    counted = near.groupBy(group, "span", "v").agg(F.count(F.lit(1)).alias("m"))  # equal values are one row
    counted = counted.withColumn("upto", F.sum("m").over(Window.partitionBy(group, "span").orderBy("v")))
    j = counted.join(below, group).withColumn("b", F.get(F.array(*[F.col(f"b{i}") for i in range(len(shares))]), F.col("span")))
    last, first = F.col("b") + F.col("upto"), F.col("b") + F.col("upto") - F.col("m") + 1
    return j.groupBy(group, "n").agg(*[F.max(F.when(r.between(first, last), F.col("v"))).alias(name) for name, r in ranks.items()])


def quantiles(rows: DataFrame, group: str, value: str, p: float = 0.95) -> DataFrame:
    """group, n, exclusive (position p (n + 1), interpolated, within the data; null for one value), nearest (at floor(p n), from 0), upper_median."""
    n = F.col("n")
    spot = F.lit(p) * (n + 1)
    j = F.greatest(F.lit(1), F.least(F.floor(spot), n - 1))
    got = at_ranks(rows, group, value, {"x": j, "y": j + 1, "nearest": F.least(F.floor(F.lit(p) * n) + 1, n), "upper_median": F.floor(n / 2) + 1}, [p, 0.5])
    return got.select(group, "n", F.when(n > 1, F.col("x") + (spot - j) * (F.col("y") - F.col("x"))).alias("exclusive"), "nearest", "upper_median")


def recall_at(rank: Column, k: int) -> Column:
    """Share of all golds whose first hit stands at most at k; a null rank is a miss."""
    return F.round(F.avg(F.when(F.coalesce(rank <= k, F.lit(False)), 1.0).otherwise(0.0)), 4)


def mrr(rank: Column) -> Column:
    return F.round(F.sum(F.coalesce(1.0 / rank, F.lit(0.0))) / F.count(F.lit(1)), 4)


def ndcg(hits: DataFrame, golds: DataFrame, k: int = 10) -> DataFrame:
    """query_id, ndcg: hits (query_id, gold, rank); each gold counts at its first rank, each rank for one gold. golds: query_id, n_gold."""
    first = hits.filter(F.col("rank") <= k).groupBy("query_id", "gold").agg(F.min("rank").alias("rank")).groupBy("query_id", "rank").agg(F.lit(1).alias("one"))
    gain = first.groupBy("query_id").agg(F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
    return golds.join(gain, "query_id", "left").select("query_id", F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"))


def micro(sets: DataFrame, found: str, gold: str) -> DataFrame:
    """Micro precision and recall over rows of two sets."""
    hit = F.sum(F.size(F.array_intersect(found, gold)))
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return sets.agg(hit.alias("n_hit"), F.sum(F.size(found)).alias("n_found"), F.sum(F.size(gold)).alias("n_gold")).select("*", share(F.col("n_hit"), F.col("n_found")).alias("precision"), share(F.col("n_hit"), F.col("n_gold")).alias("recall"))


def sweep(rows: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """Balanced accuracy at every threshold (score >= threshold says positive). Thresholds are few and stated.

    Rows are first counted per place among the thresholds, so the shuffle carries a row per task and place, whatever the data's size.
    """
    steps = sorted(thresholds)
    place = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in steps), F.lit(0))
    counts = rows.groupBy(place.alias("place")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))
    out = counts.select("p", "n", "place", F.posexplode(F.array(*[F.lit(float(t)) for t in steps])).alias("at", "threshold"))
    over = F.col("place") > F.col("at")
    r = out.groupBy("threshold").agg(F.sum(F.when(over, F.col("p")).otherwise(0)).alias("tp"), F.sum("p").alias("p"), F.sum(F.when(~over, F.col("n")).otherwise(0)).alias("tn"), F.sum("n").alias("n"))
    return r.select("threshold", "tp", "tn", F.round((F.col("tp") / F.nullif("p", F.lit(0)) + F.col("tn") / F.nullif("n", F.lit(0))) / 2, 6).alias("balanced_accuracy"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The best balanced accuracy, at the smallest threshold that reaches it."""
    return swept.agg(F.max(F.struct("balanced_accuracy", (-F.col("threshold")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), "b.balanced_accuracy")


#: Below which share of the hash a Poisson weight of mean 1 is at most 0, 1, ... 5.
_POISSON = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815)


def _weights(h: np.ndarray, resamples: np.ndarray) -> np.ndarray:
    """A row's weight in each resample: the hash h seeds a splitmix64 stream, read at the resample's number."""
    z = h[:, None] + (resamples[None, :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    w = np.zeros(z.shape, np.uint8)
    for t in _POISSON:
        w += z > np.uint64(int(t * 2**64))
    return w


def bootstrap_mean(rows: DataFrame, value: str, key: list[str], resamples: int = 2000, seed: int = 7) -> DataFrame:
    """Mean and the 2.5 % and 97.5 % percentiles of resampled means.

    Poisson weights of a hash stand for drawing with replacement, so rows are never multiplied: each row adds to every resample's two
    sums on its own task, and the shuffle carries a row per task and resample. ``key``: what tells rows apart, so that a task run again draws the same.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, sums = np.arange(resamples, dtype=np.uint64), np.zeros((2, resamples))
        for b in batches:
            pair, h = np.stack([b["v"].to_numpy(), np.ones(len(b))]), b["h"].to_numpy().view(np.uint64)
            for at in range(0, len(b), 256):
                sums += pair[:, at : at + 256] @ _weights(h[at : at + 256], numbers).astype("float64")
        yield pd.DataFrame({"r": numbers.astype("int64"), "s": sums[0], "w": sums[1]})

    rows = rows.select(F.col(value).cast("double").alias("v"), F.xxhash64(*key, F.lit(seed)).alias("h")).filter("v is not null")
    means = rows.mapInPandas(run, "r long, s double, w double").groupBy("r").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m")).filter("m is not null")
    return means.agg(F.round(F.avg("m"), 6).alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def fingerprint(rows: DataFrame, key: str, content: str) -> DataFrame:
    """One value for a table, whatever the order of its rows: the sums of two parts of each row's digest, and the number of rows. Nothing is gathered."""
    digest = F.md5(F.concat_ws(":", key, content))
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)")).cast("string")
    return rows.agg(F.concat_ws("-", half(1), half(17)).alias("fingerprint"), F.count(F.lit(1)).alias("n_rows"))


def running_rank(scores: DataFrame, key: str) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))))
