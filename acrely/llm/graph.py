"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrely.session import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in a link; a component is named by its smallest id.

    Alternating star contraction (Kiveris et al.): large stars hang the larger neighbours of a node on its
    smallest, small stars hang the smaller neighbours of a node and itself on its smallest. The links are a
    forest of stars after a logarithmic number of rounds. Links are dealt out by node twice a round; every
    round is a written table, and the driver sees a count and a checksum.
    """
    links = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links, before = cut(links), None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(
            F.col("v").alias("u"), F.col("m").alias("v")).repartition("u").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.unionByName(lowest.withColumnRenamed("m", "v")).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # Every star: its leaves, and its centre.
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after the links (a, b) between ids join components: only these are contracted."""
    a = labels.select(F.col("id").alias("a"), F.col("component").alias("_a"))
    b = labels.select(F.col("id").alias("b"), F.col("component").alias("_b"))
    joined = components(links.join(a, "a").join(b, "b"), "_a", "_b").select(F.col("id").alias("component"), F.col("component").alias("_to"))
    return cut(labels.join(joined, "component", "left").select("id", F.coalesce("_to", "component").alias("component")))
