"""Monitoring as a stream: per page the state of the last check; every change gives one update, written and announced once.

The state of a page is the hash of its last content and the number of its version, so it doesn't grow. Updates have ids that follow from
what changed, and the sink inserts what is absent: a batch that is run again, or a change that comes again, writes nothing twice. The
batch form of the same result is ``versions.observed``; a test holds them against each other.

Defined results: checks without content (unavailable) change nothing; a check whose number isn't above the last one seen of its page came
too late and is passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from annalist.sources.files import exists

CHECK = "page string, checked_at timestamp, seq long, content string"
UPDATE = "page string, update_id string, change string, version_no int, seq long"
STATE = "content string, version_no int, seq long"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    page = key[0]
    content, number, last = state.get if state.exists else (None, 0, -1)
    out = []
    for row in sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: r.seq):
        if row.content is None or row.seq <= last:
            continue
        last, now = row.seq, hashlib.sha256(row.content.encode()).hexdigest()
        if now == content:
            continue
        update = "update_" + hashlib.sha256(f"{page}:{content}:{now}".encode()).hexdigest()[:20]
        out.append((page, update, "NEW" if number == 0 else "MODIFIED", number + 1, row.seq))
        content, number = now, number + 1
    state.update((content, number, last))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in UPDATE.split(", ")])


def updates(checks: DataFrame) -> DataFrame:
    """``checks`` (page, checked_at, seq, content; null content: unavailable) as a stream of updates, in the order of seq."""
    return checks.groupBy("page").applyInPandasWithState(_step, UPDATE, STATE, "append", "NoTimeout")


#: What announces updates (rows of UPDATE), once each. A caller adds its own.
SENDERS: dict[str, Callable[[DataFrame], None]] = {}


def once(folder: str, sender: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: write the updates that are not there yet, and announce those; each batch has a folder of its own, so a repeated one replaces its first run."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["update_id"])
        if exists(spark, folder):
            there = spark.read.schema(UPDATE + ", batch long").parquet(folder).filter(F.col("batch") != number)
            fresh = fresh.join(there.select("update_id"), "update_id", "left_anti")
        path = f"{folder}/batch={number}"
        again = exists(spark, f"{path}/_SUCCESS")
        fresh.select(*[c.split()[0] for c in UPDATE.split(", ")]).write.mode("overwrite").parquet(path)
        if sender and not again:  # a batch that was written was announced
            sender(spark.read.schema(UPDATE).parquet(path))

    return write


class Progress(StreamingQueryListener):
    """Keeps a row per batch of a query: number, rows read, milliseconds. ``rows`` gives them as a table."""

    def __init__(self, most: int = 10_000) -> None:
        self.seen: list[tuple] = []
        self.most = most

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.seen = [*self.seen, (p.name, p.batchId, p.numInputRows, int(p.durationMs.get("triggerExecution", 0)))][-self.most :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.seen, "name string, batch long, n_rows long, ms long")
