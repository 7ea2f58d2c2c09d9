"""Connected components of a link table, by contraction rounds in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id it can reach.

    Each round points every id of a neighbourhood at the neighbourhood's smallest
    id, first over its larger neighbours, then over its smaller ones; the links
    become stars in a number of rounds that grows with the logarithm of the
    longest path. Minima are combined before the shuffle, so an id with very many
    links costs a task no more than its distinct partners there. The links of a
    round are written to the shared folder: a lost executor re-reads them.
    """
    links = cut_lineage(links.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        # larger neighbours of u, and u itself, point at the smallest neighbour of u
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a")))
        large = (
            both.join(least, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .where("a <> b")
            .distinct()
        )
        large = cut_lineage(large)
        # a > b now: smaller neighbours of u, and u itself, point at the smallest of them
        low = cut_lineage(large.groupBy("a").agg(F.min("b").alias("low")))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b"))
        )
        links = cut_lineage(small.where("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    star = links.groupBy("a").agg(F.min("b").alias("component"))
    heads = links.select(F.col("b").alias("a")).distinct().withColumn("component", F.col("a"))
    return star.unionByName(heads).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("component"))
