"""Connected components of a graph kept in DataFrames (large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step over edges (u, v) with u > v.

    large: every larger neighbour of a node is tied to the node's smallest neighbour;
    small: a node and its smaller neighbours are tied to the smallest of them.
    """
    if large:
        around = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select("u", "v")
    lowest = around.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = around.join(lowest, "u")
    if large:
        tied = joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        tied = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionAll(
            lowest.select("u", F.col("low").alias("v"))
        )
    return tied.where("u != v").distinct()


def connected_components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for all nodes of ``edges`` (columns src, dst of one integer type).

    ``component`` is the smallest node reachable. Self-edges, repeats and edges in
    either direction are fine; null ends are ignored; no edges give no rows. State
    between rounds is a table in the shared folder, never on the driver. The number
    of rounds is logarithmic in the longest path; running out raises.
    """
    current = materialize(
        edges.where("src is not null and dst is not null and src != dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        f"{label}-edges",
    )
    before = None
    for _ in range(max_rounds):
        size, total = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if size == 0 or (size, total) == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = (size, total)
        done = current
        current = materialize(_star(_star(done, large=True), large=False), f"{label}-round")
        discard(done)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
