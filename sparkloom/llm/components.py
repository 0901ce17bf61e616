"""Connected components of a link table by alternating star contraction, all in joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import drop_tables, materialize, tables_written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id that occurs in links; null ends and loops link nothing.

    Each round points neighbours at the smallest one (large star, then small star), so even long chains end after a
    logarithmic number of rounds. Minima are combined before the shuffle, so a node with very many links is no hot spot.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null").where("u <> v")
    mark = tables_written()
    edges, before = materialize(ends.distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_tables(links.sparkSession, mark)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def smallest_ids(rows: DataFrame) -> DataFrame:
    """(root, component_id) for rows (id, root): the smallest id of each root, where roots that hold the same id are one."""
    owned = rows.where("id is not null").select("id", "root").distinct()
    several = owned.groupBy("id").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("id", "lo")
    bound = materialize(owned.join(several, "id").where("root <> lo").select(F.col("root").alias("a"), F.col("lo").alias("b")).distinct())
    least = owned.groupBy("root").agg(F.min("id").alias("component_id"))
    if bound.isEmpty():
        return least
    one = connected_components(bound).select(F.col("id").alias("root"), "component")
    placed = least.join(one, "root", "left").withColumn("component", F.coalesce("component", "root"))
    return placed.select("root", "component").join(placed.groupBy("component").agg(F.min("component_id").alias("component_id")), "component").select("root", "component_id")
