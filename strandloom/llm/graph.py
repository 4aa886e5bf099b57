"""Connected components by alternating large-star and small-star steps, all of them joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import stored


def _signature(edges: DataFrame) -> tuple[int, int]:
    n, h = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return n, h or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id) for every node of edges (u, v): component_id is the smallest node that it reaches.

    A round hangs all larger neighbours of a node on its smallest one (large star), then all smaller ones (small star);
    minima are pre-aggregated before the shuffle and no neighbourhood is ever collected. Each round is written to the
    shared folder, and rounds go on until none changes a link, which comes for every graph. Self-links, repeated and null links are dropped; nodes without a link to another do not appear.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "cc")
    last = _signature(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "cc")
        now = _signature(edges)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(roots)
