"""Connected components by alternating large-star and small-star steps, each two shuffles, until nothing changes.

Minima are aggregated (with map-side combine) and joined back; the minima of nodes that hold a large part of all edges
are broadcast, so that a hub's edges stay where they are. Each round's edges are settled in the shared folder. Nodes are
longs; nothing is collected but counts, a checksum and fewer than ``hot.PARTS`` hubs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.hot import join_unique
from linkweave.runtime import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    return join_unique(both, settle(low, "minima"), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` lead from the larger to the smaller node."""
    low = settle(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "minima")
    moved = join_unique(edges, low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs: (node, component) for each node with an edge; component is its smallest node."""
    now = settle(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = None
    while True:
        row = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(row) == mark or not row[0]:
            break
        mark = tuple(row)
        now = settle(_small_star(_large_star(now)), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
