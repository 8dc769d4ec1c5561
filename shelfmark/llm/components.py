"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, root) of every node that has an edge; edges: (u, v) of any type that has an order.

    In each round every node hands its larger neighbours, and then its smaller ones, to the least node it knows; the
    rounds needed grow with the logarithm of a component's size. Each round is staged; one flag reaches the driver. Rounds go on
    until every component is a star; with `most_rounds`, more than that are an error, never a partial result.
    """
    now = staged(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for done in itertools.count(1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(down, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = staged(handed.unionByName(down.withColumnRenamed("m", "v")).distinct(), "edges")
        unstage(now)
        now = new
        ends = now.select(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(now.select(F.col("v").alias("n"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        sides = ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if sides.filter("below > 1 or below > 0 and above > 0").isEmpty():  # stars: each node hangs on one root
            break
        if most_rounds is not None and done >= most_rounds:
            raise RuntimeError(f"components are no stars after {done} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
