"""History of changing entity attributes, kept by Merkle comparison of snapshots.

Keys fall into leaf buckets by hash. Each snapshot of the observations gets a digest per leaf and, above the leaves, levels of digests,
each of which combines those of the leaves below it; the tree is a table. Comparing two snapshots starts at the top and reads, level by
level, only the children of nodes that differ. The states of the differing leaves' keys are then derived, compared with the history,
and what is new or ends differently is appended to it; nothing that is there is written again.

The number of leaves follows the number of keys at the start. Tree and history are folders with a part per snapshot, so a later job
goes on where another ended.

Defined results: observations without key or valid_from belong to no period and are ignored; of observations with equal key and
valid_from the one recorded last counts (ties: the larger values); a null lifecycle repeats that of the observation before, and
stays null where there is none; nulls compare as equal; observations that a later snapshot lacks take their states along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.sources.files import exists
from annalist.sources.shared import bounded, materialize, scratch

#: Children of a node are 2 to this power.
BITS = 6
#: Keys per leaf that the number of leaves aims at.
KEYS_PER_LEAF = 4
#: Differing nodes of a level that may be broadcast; more are joined without a hint.
MOST_NODES = 200_000
#: Pieces of the time range into which the sequence of a hot key is cut.
PIECES = 64
OBSERVED = ["key", "valid_from", "state", "content"]
DELTA = "leaf long, key string, valid_from timestamp, valid_to timestamp, state string, content string, live boolean"
TREE = "node long, a long, b long, n long"


def observations(df: DataFrame, key: str, state: Column, content: str, until: Column | None = None) -> DataFrame:
    """The snapshot of a log as it was known at ``until``: one row per key and valid_from."""
    rows = df.filter(F.col(key).isNotNull() & F.col("valid_from").isNotNull())
    if until is not None:
        rows = rows.filter(F.coalesce(F.col("recorded_at") <= until, F.lit(False)))
    last = rows.groupBy(F.col(key).alias("key"), "valid_from").agg(F.max(F.struct("recorded_at", state.alias("state"), F.col(content).alias("content"))).alias("o"))
    return last.select("key", "valid_from", "o.state", "o.content")


def leaves_for(n_keys: int) -> int:
    """A power of two, one leaf for every few keys."""
    return 1 << max(BITS, (max(1, n_keys) // KEYS_PER_LEAF).bit_length())


def states(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """One row per state of a key: leaf, key, valid_from, valid_to (null: open), state, content.

    A hot key's sequence is cut into pieces by time; what a piece needs from those before and after it comes from at most
    PIECES summaries per hot key. ``hot``: the hot keys (of ``hot_keys``, so few), None if there is none.
    """
    if hot is None:
        rows = rows.withColumn("piece", F.lit(0))
    else:
        hot = F.broadcast(hot.select("key"))
        span = rows.join(hot, "key", "left_semi").groupBy("key").agg(F.min(F.unix_micros("valid_from")).alias("lo"), F.max(F.unix_micros("valid_from")).alias("hi"))
        rows = rows.join(F.broadcast(span), "key", "left").withColumn("piece", F.coalesce(((F.unix_micros("valid_from") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * PIECES).cast("int"), F.lit(0))).drop("lo", "hi")
    by = Window.partitionBy("key", "piece").orderBy("valid_from")
    rows = rows.withColumn("state", F.last("state", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    if hot is not None:
        carry = rows.join(hot, "key", "left_semi").groupBy("key", "piece").agg(F.max_by("state", "valid_from").alias("state"), F.max_by(F.struct("content"), "valid_from").alias("content"))
        before = Window.partitionBy("key").orderBy("piece")
        carry = carry.select("key", "piece", F.last("state", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("old_state"), F.lag("content").over(before).alias("old_content"))
        rows = rows.join(F.broadcast(carry), ["key", "piece"], "left").withColumn("state", F.coalesce("state", "old_state"))
    seen = F.lag(F.struct("state", "content")).over(by)
    if hot is not None:
        seen = F.coalesce(seen, F.when(F.col("old_content").isNotNull(), F.struct(F.col("old_state").alias("state"), F.col("old_content.content").alias("content"))))
    rows = rows.withColumn("seen", seen)
    same = F.col("seen").isNotNull() & F.col("seen.state").eqNullSafe(F.col("state")) & F.col("seen.content").eqNullSafe(F.col("content"))
    starts = rows.filter(~same).withColumn("valid_to", F.lead("valid_from").over(by))
    if hot is not None:
        first = starts.join(hot, "key", "left_semi").groupBy("key", "piece").agg(F.min("valid_from").alias("valid_from"))
        after = Window.partitionBy("key").orderBy("piece")
        first = first.select("key", "piece", F.lead("valid_from").over(after).alias("next_start"))
        starts = starts.join(F.broadcast(first), ["key", "piece"], "left").withColumn("valid_to", F.coalesce("valid_to", "next_start"))
    return starts.select("leaf", "key", "valid_from", "valid_to", "state", "content")


class History:
    """A history and the trees of the snapshots it was made from, in a folder. ``apply`` brings it up to a newer snapshot."""

    def __init__(self, spark: SparkSession, leaves: int, folder: str | None = None) -> None:
        if leaves & (leaves - 1):
            raise ValueError("the number of leaves must be a power of two")
        self.spark, self.leaves, self.folder = spark, leaves, folder or scratch(spark, "history")
        #: Shifts from a leaf's number to its node's, from the top level down to the leaves.
        self.shifts = [*range((leaves.bit_length() - 1) // BITS * BITS, 0, -BITS), 0]
        self.n = 0
        while exists(spark, f"{self.folder}/delta/step={self.n + 1}/_SUCCESS"):
            self.n += 1

    def _level(self, step: int, shift: int) -> DataFrame:
        return self.spark.read.schema(TREE).parquet(f"{self.folder}/tree/step={step}/shift={shift}")

    def _plant(self, rows: DataFrame, step: int) -> None:
        """Write the tree of a snapshot: two independent sums over the rows of each leaf, and over the leaves below each node."""
        whole = F.struct(*OBSERVED)
        leaf = rows.groupBy("leaf").agg(F.bit_xor(F.xxhash64(F.lit(1), whole)).alias("a"), F.bit_xor(F.xxhash64(whole, F.lit(2))).alias("b"), F.count(F.lit(1)).alias("n"))
        up = [F.struct(F.lit(s).alias("shift"), F.shiftright("leaf", s).alias("node"), *((F.col(c) if s == 0 else F.xxhash64("leaf", "a", "b", "n", F.lit(c))).alias(c) for c in "ab"), "n") for s in self.shifts]
        every = leaf.select(F.explode(F.array(*up)).alias("x")).select("x.*")
        sums = every.groupBy("shift", "node").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("n").alias("n"))
        sums.sortWithinPartitions("shift", "node").write.partitionBy("shift").mode("overwrite").parquet(f"{self.folder}/tree/step={step}")

    def differing(self, one: int, other: int) -> DataFrame:
        """node: the leaves in which two snapshots differ, found from the top down."""
        found = None
        for shift in self.shifts:
            here, there = self._level(one, shift), self._level(other, shift)
            if found is not None:
                below = F.shiftright("node", min(BITS, above - shift)).alias("up")
                here, there = (x.withColumn("up", below).join(found.select(F.col("node").alias("up")), "up", "left_semi").drop("up") for x in (here, there))
            side = lambda x, p: x.select("node", F.struct("a", "b", "n").alias(p))
            found = bounded(side(here, "x").join(side(there, "y"), "node", "full_outer").filter("not (x <=> y)").select("node"), MOST_NODES)
            above = shift
        return found

    def apply(self, rows: DataFrame, hot: DataFrame | None) -> DataFrame | None:
        """Go on to a snapshot (rows of ``observations``, with their hot keys); gives the leaves that differed (None: all, at first)."""
        step = self.n + 1
        leaf = F.pmod(F.xxhash64("key"), F.lit(self.leaves))
        rows = materialize(rows.select(leaf.alias("leaf"), *OBSERVED), "observed")
        self._plant(rows, step)
        value = ["valid_to", "state", "content"]
        if self.n == 0:
            changed, delta = None, states(rows, hot).withColumn("live", F.lit(True))
        else:
            changed = self.differing(self.n, step)
            own = changed.select(F.col("node").alias("leaf"))
            new = states(rows.join(own, "leaf", "left_semi"), hot).select("leaf", "key", "valid_from", F.struct(*value).alias("new"))
            old = self.table(own).select("leaf", "key", "valid_from", F.struct(*value).alias("old"))
            both = old.join(new, ["leaf", "key", "valid_from"], "full_outer").filter("not (old <=> new)")
            delta = both.select("leaf", "key", "valid_from", *[F.col(f"new.{c}").alias(c) for c in value], F.col("new").isNotNull().alias("live"))
        delta.write.mode("overwrite").parquet(f"{self.folder}/delta/step={step}")
        self.n = step
        return changed

    def table(self, leaves: DataFrame | None = None) -> DataFrame:
        """leaf, key, valid_from, valid_to (null: open), state, content as of the last snapshot; of some ``leaves`` only, if given."""
        rows = self.spark.createDataFrame([], DELTA + ", step int")
        if self.n:
            rows = self.spark.read.schema(DELTA + ", step int").option("basePath", f"{self.folder}/delta").parquet(*[f"{self.folder}/delta/step={i}" for i in range(1, self.n + 1)])
        if leaves is not None:
            rows = rows.join(leaves, "leaf", "left_semi")
        last = rows.groupBy("leaf", "key", "valid_from").agg(F.max_by(F.struct("valid_to", "state", "content", "live"), "step").alias("v"))
        return last.filter("v.live").select("leaf", "key", "valid_from", "v.valid_to", "v.state", "v.content")
