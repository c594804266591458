"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the smallest node of each node's component, for all nodes that have a link (a, b are longs).

    Each round joins every node's larger neighbours, then its smaller ones, to the smallest of all; this ends when all
    nodes point at their component's smallest, after about log(size) rounds. Every round is written to the shared folder."""
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    while True:
        ends = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = ends.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"))
        # Done when every node is the smallest of its neighbours, or has one only, a smaller one.
        if near.where(~((F.col("least") > F.col("u")) | ((F.col("least") == F.col("most")) & (F.col("most") < F.col("u"))))).isEmpty():
            break
        large = ends.where("v > u").join(near.select("u", F.least("least", "u").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
