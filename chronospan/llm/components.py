"""Connected components of a graph kept in tables, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronospan.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "edges") -> DataFrame:
    """node and its component, the smallest node reachable, for each node of ``links`` (a, b long; null-free).

    Each round hangs every node's larger neighbours on its smallest neighbour
    (large star), then its smaller ones (small star); it ends when a round
    changes nothing.  Rows are pre-aggregated by node before each shuffle and
    every round is written to ``scratch`` and the one before dropped, so lineage
    stays short.  An empty graph gives an empty table.
    """
    edges = scratch.saved(links.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"{name}0")
    state, k = None, 0
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small star: edges point from the larger end to the smaller
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("m", F.explode(F.array("u", "v")).alias("w")).where("m <> w").select(F.col("m").alias("u"), F.col("w").alias("v")).distinct()
        edges, k = scratch.saved(small, f"{name}{k + 1}"), k + 1
        scratch.drop(f"{name}{k - 1}")
        # stars alone: no node is both a centre and a leaf, and no leaf has two centres
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if state == (now["n"], now["h"]):
            break
        state = (now["n"], now["h"])
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
