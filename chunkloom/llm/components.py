"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chunkloom.llm.common import materialise, outlive, scratch

#: Edges of one file while an edge table is rewritten; a small table is not spread over all shuffle partitions.
FILE_EDGES = 100_000


def _written(edges: DataFrame, name: str, files: int | None = None) -> tuple[DataFrame, tuple]:
    """The edges as a table, with their number and a checksum that are gathered while it is written."""
    seen = Observation()
    mark = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
    observed = edges.observe(seen, F.count(F.lit(1)).alias("n"), mark.alias("s"))
    out = materialise(observed.coalesce(files) if files else observed, name)
    return out, (seen.get["n"], seen.get["s"])


def _large_star(edges: DataFrame, files: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(files), "least")
    return both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, files: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them (edges run from larger to smaller)."""
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(files), "least")
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b), any order, repeats and loops allowed -> node, component (smallest reachable node), for nodes with an edge to another node.

    Each round's tables are deleted when the next one's are written.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, state = _written(now, "edges")
    for _ in range(rounds):
        if not state[0]:
            break
        files = 2 + state[0] // FILE_EDGES
        before = state
        with scratch():
            large = materialise(_large_star(now, files).distinct().coalesce(files), "large")
            now, state = _written(_small_star(large, files).distinct(), "small", files)
            outlive(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
