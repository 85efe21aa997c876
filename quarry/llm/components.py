"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` (the component's smallest node) for every node that has an edge ``a, b``.

    Large-star and small-star steps alternate until all edges lead to their component's
    smallest node, which takes about as many rounds as the logarithm of the longest path.  Minima are summed on the
    map side before they are shuffled, so a node with many edges costs one row per task,
    and every round is written to the shared folder.  Loops and repeated edges do no harm.
    """
    now = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct()
    now = written(now, name)
    while not _stars(now):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi > lo")
        now = written(small.union(lowest.select("hi", "m")).distinct(), name)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either the centre of a star or has one edge, to a centre."""
    roles = edges.select(F.col("hi").alias("u"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("lo", F.lit(0), F.lit(1)))
    return roles.groupBy("u").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below + above > 1").isEmpty()
