"""Attributes as known at event time: entities hash-partitioned, an embedded DuckDB ASOF LEFT JOIN per bucket.

Each version of an entity holds for a window of days and was known for a window of instants. Within a bucket the days asked for
are numbered; a version's days become a few aligned (dyadic) intervals, a request's day lies in one interval per level, so
equality on (entity, interval) stands for "holds on the day", exactly and without listing days. Per entity and interval the
versions are turned into states in the order of availability (who wins from each instant on, ties already resolved), and one
ASOF join looks the request up in them. Of a request's levels the best candidate counts.

An entity with a large share of the requests is split by request; one with a large share of the versions is split into
blocks of versions, each request asks all blocks, and the best answer counts (the order is total, so that is exact).

Defined results: null entity keys match nothing; null bounds are open; windows that end before they begin hold nothing; equal rows count
once; a request without a candidate gives no row; a request without an instant to compare (null asked_at) gives no row.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators.skew import hot_keys, replicated, salted

REQUEST = ["entity_a", "entity_b", "request_id", "asked", "day"]
VERSION = ["entity_a", "entity_b", "version_id", "rank", "known_from", "known_to", "holds_from", "holds_to"]
ANSWER = "request_id long, asked long, day int, version_id string, known_from long, rank int"
EARLIEST, LATEST = -(2**62), 2**62
#: Requests per bucket, and versions per block of a hot entity.
PER_BUCKET, PER_BLOCK = 20_000, 100_000


def _intervals(lo: int, hi: int) -> list[int]:
    """Aligned intervals that make up [lo, hi) as numbers (level * 2^32 + place)."""
    out, level = [], 0
    while lo < hi:
        if lo & 1:
            out.append((level << 32) + lo)
            lo += 1
        if hi & 1:
            hi -= 1
            out.append((level << 32) + hi)
        lo, hi, level = lo >> 1, hi >> 1, level + 1
    return out


def _states(versions: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(instant, winner or -1) whenever the winner changes; versions: (place in the order of preference, known from, known to)."""
    events = sorted({t for v in versions for t in v[1:]})
    begin = sorted(versions, key=lambda v: v[1])
    heap: list[tuple[int, int]] = []
    out, i, last = [], 0, -2
    for t in events:
        while i < len(begin) and begin[i][1] <= t:
            heapq.heappush(heap, (begin[i][0], begin[i][2]))
            i += 1
        while heap and heap[0][1] <= t:
            heapq.heappop(heap)
        best = heap[0][0] if heap else -1
        if best != last:
            out.append((t, best))
            last = best
    return out


def _answer(requests: pd.DataFrame, versions: pd.DataFrame) -> pd.DataFrame:
    import duckdb

    names = [c.split()[0] for c in ANSWER.split(", ")]
    requests, versions = requests[REQUEST].drop_duplicates(), versions[VERSION].drop_duplicates()
    if requests.empty or versions.empty:
        return pd.DataFrame(columns=names)
    keys = ["entity_a", "entity_b"]
    entities = requests[keys].drop_duplicates().reset_index(drop=True)
    entities["k"] = np.arange(len(entities))
    r = requests.merge(entities, on=keys).reset_index(drop=True)
    v = versions.merge(entities, on=keys)
    v["known_from"] = v["known_from"].fillna(EARLIEST).astype("int64")
    v["known_to"] = v["known_to"].fillna(LATEST).astype("int64")
    v = v[v["known_from"] < v["known_to"]]
    if v.empty:
        return pd.DataFrame(columns=names)
    v = v.assign(order_rank=v["rank"].astype("float64").fillna(-np.inf)).sort_values(["known_from", "order_rank", "version_id"], ascending=[False, False, True], kind="stable").reset_index(drop=True)
    days = np.unique(r["day"].to_numpy())
    lo = np.searchsorted(days, v["holds_from"].fillna(days[0]).to_numpy(), side="left")
    hi = np.where(v["holds_to"].isna(), len(days), np.searchsorted(days, v["holds_to"].fillna(0).to_numpy(), side="left"))
    held: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for place, (k, a, b, f, t) in enumerate(zip(v["k"].tolist(), lo.tolist(), hi.tolist(), v["known_from"].tolist(), v["known_to"].tolist())):
        for node in _intervals(a, b):
            held.setdefault((k, node), []).append((place, f, t))
    s = [(k, node, t, w) for (k, node), x in held.items() for t, w in _states(x)]
    if not s:
        return pd.DataFrame(columns=names)
    state = pd.DataFrame(s, columns=["k", "node", "avail", "place"])
    at, depth = np.searchsorted(days, r["day"].to_numpy()), max(1, int(len(days)).bit_length())
    ask = pd.concat([pd.DataFrame({"row": np.arange(len(r)), "k": r["k"], "node": (lv << 32) + (at >> lv), "asked": r["asked"]}) for lv in range(depth + 1)])
    ask = ask.merge(state[["k", "node"]].drop_duplicates(), on=["k", "node"])
    db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    db.register("ask", ask)
    db.register("state", state)
    best = db.execute(
        'SELECT ask."row" AS r, min(state.place) AS place FROM ask ASOF LEFT JOIN state ON ask.k = state.k AND ask.node = state.node AND ask.asked >= state.avail WHERE state.place >= 0 GROUP BY 1'
    ).df()
    db.close()
    got, won = r.iloc[best["r"].to_numpy()], v.iloc[best["place"].to_numpy()]
    return pd.DataFrame({"request_id": got["request_id"].to_numpy(), "asked": got["asked"].to_numpy(), "day": got["day"].to_numpy(), "version_id": won["version_id"].to_numpy(), "known_from": won["known_from"].to_numpy(), "rank": won["rank"].astype("Int32").to_numpy()}, columns=names)


def asof_answers(requests: DataFrame, versions: DataFrame, n_requests: int, n_versions: int) -> DataFrame:
    """The version that held on a request's day and was known when it was asked; latest known, then highest rank, then smallest id.

    ``requests``: entity_a, entity_b, request_id, asked (microseconds), day (number); ``versions``: entity_a, entity_b, version_id, rank,
    known_from, known_to (microseconds), holds_from, holds_to (day numbers, end excluded). The counts bound the rows of each side.
    """
    keys = ["entity_a", "entity_b"]
    r = requests.select(*REQUEST).dropna(subset=[*keys, "asked", "day"])
    v = versions.select(*VERSION).dropna(subset=[*keys, "version_id"])
    many_r, many_v = hot_keys(r, keys, n_requests, PER_BUCKET), hot_keys(v, keys, n_versions, PER_BLOCK)
    # requests: salted by themselves, copied to each block of versions; versions the other way round
    r = replicated(salted(r, many_r, keys, F.col("request_id")).withColumnRenamed("salt", "part"), many_v, keys)
    v = replicated(salted(v, many_v, keys, F.col("version_id")).withColumnRenamed("salt", "block"), many_r, keys)
    r, v = r.withColumnRenamed("salt", "block"), v.withColumnRenamed("salt", "part")
    n = max(2 * r.sparkSession.sparkContext.defaultParallelism, -(-n_requests // PER_BUCKET), -(-n_versions // PER_BLOCK))
    bucket = F.pmod(F.xxhash64(*keys, "part", "block"), F.lit(n)).cast("int")
    r, v = r.select(bucket.alias("bucket"), *REQUEST), v.select(bucket.alias("bucket"), *VERSION)
    found = r.groupBy("bucket").cogroup(v.groupBy("bucket")).applyInPandas(_answer, ANSWER)
    if many_v is not None:
        first = F.min(F.struct((-F.col("known_from")).alias("a"), F.coalesce(-F.col("rank"), F.lit(2**31 - 1)).alias("b"), "version_id"))
        found = found.groupBy("request_id", "asked", "day").agg(first.alias("f")).select("request_id", "asked", "day", "f.version_id")
    return found.select("request_id", "version_id")
