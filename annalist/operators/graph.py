"""A typed multigraph as two tables, nodes (id, type, title) and edges (source, target, type, ...); parallel edges count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators import scan
from annalist.sources.shared import materialize


def neighbours(edges: DataFrame, starts: DataFrame, types: list[str], reverse: bool = False) -> DataFrame:
    """query_id, id: the different nodes one typed step from ``starts`` (query_id, id)."""
    here, there = ("target", "source") if reverse else ("source", "target")
    step = edges.filter(F.col("type").isin(*types)).select(F.col(here).alias("id"), F.col(there).alias("to"))
    return starts.join(step, "id").select("query_id", F.col("to").alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """In and out together; both ends are combined before the shuffle, so a hub costs a row per task."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).filter("id is not null")
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def induced(edges: DataFrame, chosen: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Edges with both ends among the chosen nodes (id, and ``by`` if the choice is per query)."""
    by = by or []
    a = chosen.select(*by, F.col("id").alias("source")).distinct()
    b = chosen.select(*by, F.col("id").alias("target")).distinct()
    return edges.join(a, "source").join(b, [*by, "target"])


# Words of a query that match no node, and the traversal that its signal words call for, the first that fits.
NO_MATCH = ["which", "does", "this", "that", "what"]
TEMPLATES = [("change", ["supersed", "replaced", "replaces"]), ("amendments", ["amend"]), ("applicability", ["apply", "subject to", "which entities"]), ("products", ["product", "digital lending", "co-lending"])]


def match_nodes(nodes: DataFrame, queries: DataFrame, node_type: str, most: int = 3) -> DataFrame:
    """query_id, id, overlap: the nodes that share most words with a query; ties go to the larger id.

    The nodes are scored where they lie (``scan``), so words that stand in many titles multiply nothing.
    """
    return scan.overlap_top_k(nodes.filter(F.col("type") == node_type), "id", "title", queries, most, frozenset(NO_MATCH))


def template(query: Column) -> Column:
    """Which traversal answers a query."""
    q = F.lower(query)
    return F.coalesce(*[F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(q, w)), F.lit(name)) for name, words in TEMPLATES], F.lit("entities"))


def detail(edges: DataFrame, hidden: str = "PART_OF") -> DataFrame:
    """id, direction, type, other: every edge of a node from either side, without the hidden type."""
    shown = edges.filter(F.col("type") != hidden)
    out = shown.select(F.col("source").alias("id"), F.lit("out").alias("direction"), "type", F.col("target").alias("other"))
    return out.unionByName(shown.select(F.col("target").alias("id"), F.lit("in").alias("direction"), "type", F.col("source").alias("other")))


def last_edges(edges: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One edge per key, the last written."""
    w = Window.partitionBy(key).orderBy(*order)
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges), "id", "left_anti")


def chain_ends(edges: DataFrame) -> DataFrame:
    """id, end, hops: where a chain of successors ends (the smallest successor where there are several).

    Pointer jumping: every round doubles the hops, so a chain of n needs about log2(n) rounds; each round is written to the shared folder.
    Chains that run into a circle have no end and give no row.
    """
    one = edges.filter("source is not null and target is not null and source <> target").groupBy(F.col("source").alias("id")).agg(F.min("target").alias("end"))
    jump = materialize(one.withColumn("hops", F.lit(1)), "chain")
    for _ in range(jump.count().bit_length() + 1):  # no chain has more hops than there are nodes
        on = jump.select(F.col("id").alias("end"), F.col("end").alias("next"), F.col("hops").alias("more"))
        grown = jump.join(on, "end", "left").select("id", F.coalesce("next", "end").alias("end"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("moved"))
        grown = materialize(grown, "chain")
        jump = grown.drop("moved")
        if not grown.filter("moved").limit(1).count():
            return jump
    return jump.join(jump.select(F.col("id").alias("end")), "end", "left_anti").select("id", "end", "hops")


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id): labels spread along edges and their labels' labels until none changes."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).filter("source is not null and target is not null").distinct()
    both = materialize(both, "edges")
    label = materialize(both.groupBy(F.col("source").alias("id")).agg(F.least(F.col("source"), F.min("target")).alias("label")), "labels")
    while True:  # labels only ever get smaller
        near = both.join(label.select(F.col("id").alias("target"), "label"), "target").groupBy(F.col("source").alias("id")).agg(F.min("label").alias("near"))
        step = label.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = label.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = materialize(step.join(up, "label", "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        label = new.select("id", "label")
        if not new.filter("old <> label").limit(1).count():
            break
    return label.select("id", F.col("label").alias("component"))
