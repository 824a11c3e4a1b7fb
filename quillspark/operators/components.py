"""Connected components by alternating star contraction; every round is staged, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.staging import stage


def connected_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, class): the class of a node is the least node it is linked with. Nulls and loops link nothing."""
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges = stage(edges, "edges")
    # Every round that isn't the last one brings nodes closer to the least of their class, so the rounds end: about the logarithm of the longest path.
    while True:
        # Large star: each node links its larger neighbours to the least of its neighbourhood; small star: the smaller ones.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = stage(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        # Stars only: no centre is itself linked to a lesser node.
        if new.select("u").intersect(new.select("v")).isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            edges = new
            break
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class")).union(edges.select("v", "v").distinct())
