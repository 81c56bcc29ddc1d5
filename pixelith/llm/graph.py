"""Connected components by hooking and shortcutting, in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelith.llm.common import stored


def roots(parent: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, up) whose parents are smaller than their children: pointers double each round."""
    table = stored(parent.select("node", F.col("up").alias("root")), "roots")
    while True:
        above = table.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        step = stored(table.join(above, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        table = step.select("node", "root")
        if step.where("moved").isEmpty():
            return table


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches, for nodes that are not it.

    Each round every node hooks to its smallest smaller neighbour, the trees flatten, and the edges between
    different trees remain for the next one. At least half of the nodes that still have edges drop out in a round.
    The smallest neighbour comes from an aggregate that combines before its shuffle, so a node of any degree is fine.
    """
    live = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    while not live.isEmpty():
        flat = roots(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        if found is None:
            found = flat
        else:
            over = flat.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            moved = found.join(over, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
            found = stored(moved.unionByName(flat), "components")
        up = flat.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        for side in ("a", "b"):
            live = live.join(up, F.col(side) == F.col("_n"), "left").withColumn(side, F.coalesce("_r", side)).select("a", "b")
        live = stored(live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return edges.sparkSession.createDataFrame([], "node long, root long") if found is None else found
