"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges (a, b) of two longs -> (node, label), one row per node that has an edge to another; label: one node of its component.

    Each round lets every node point at its smallest neighbour (or itself, if
    smaller), follows the pointers four steps, and contracts the edges. Rounds
    grow with the logarithm of the longest path. No node's neighbours are
    collected: a node of any degree costs one running minimum.
    """
    spark = scratch.spark
    edges = scratch.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    maps: list[DataFrame] = []
    step = 0
    while not edges.isEmpty():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        for jump in range(2):
            up = scratch.write(up, f"{name}-up-{step}-{jump}")
            above = up.select(F.col("node").alias("up"), F.col("up").alias("above"))
            up = up.join(above, "up", "left").select("node", F.coalesce("above", "up").alias("up"))
        up = scratch.write(up, f"{name}-map-{step}")
        maps.append(up)
        x, y = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        step += 1
        edges = scratch.write(
            edges.join(x, "a").join(y, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), f"{name}-edges-{step}"
        )
    scratch.drop_but(f"{name}-edges-")
    scratch.drop_but(f"{name}-up-")
    if not maps:
        return spark.createDataFrame([], "node bigint, label bigint")
    label = maps[-1].select("node", F.col("up").alias("label"))
    for k, up in enumerate(reversed(maps[:-1])):
        later = label.select(F.col("node").alias("up"), "label")
        label = scratch.write(up.join(later, "up", "left").select("node", F.coalesce("label", "up").alias("label")), f"{name}-label-{k}")
    return label
