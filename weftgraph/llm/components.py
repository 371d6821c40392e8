"""Connected components of an edge table, distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import discard, materialize


def connected_components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(v, label) for each end of an edge (u, v), as a written table; label is the least vertex of its component.

    Each round replaces the edges by stars: every vertex hooks its larger
    neighbours onto the least vertex it sees, first from the larger side, then
    from the smaller one, so that paths shrink to a logarithm of rounds. Minima
    are combined before the shuffle. They are written before the edges are
    joined to them, so that the join has a shuffle of its own on both sides,
    where a vertex with very many edges is split (adaptive skew join), or none
    where the minima are few. Every round is a written table, and the one
    before is deleted.
    """
    held = materialize(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "edges")
        discard(least)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        grown = materialize(small.where("u <> v").distinct(), "edges")
        for old in (low, large, held):
            discard(old)
        held = grown
        # (edges, sum of ends) stays the same only when all edges are stars on their least vertex
        now = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = held.select(F.col("u").alias("v"), F.col("v").alias("label"))
    out = materialize(stars.unionByName(held.select("v", F.col("v").alias("label")).distinct()), "components")
    discard(held)
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the least place that links a-b reach."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label
