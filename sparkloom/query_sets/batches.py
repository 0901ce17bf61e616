"""Batches loaded into a reconciled table, and tables published in versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.registry import register
from sparkloom.session import new_path, table
from sparkloom.sources import versions
from sparkloom.streaming import ledger


@register("ledger_entries", """WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS n, count(*) FILTER (month(o_orderdate) = 12) AS late FROM orders GROUP BY 1)
SELECT a.y AS batch, a.n + coalesce(b.late, 0) AS rows, a.n AS inserted, coalesce(b.late, 0) AS unchanged FROM y a LEFT JOIN y b ON b.y = a.y - 1""")  # fmt: skip
def _entries(spark, sf_dir):
    """A batch a year, each with the last month of the year before once more; every batch comes twice."""
    path, year = new_path(spark), F.year("o_orderdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("line_key"), "o_totalprice", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM").alias("drop_key"))
    for y in sorted(r[0] for r in orders.select(year).distinct().collect()):  # a few years
        batch = orders.where((year == y) | (F.col("drop_key") == f"{y - 1}-12"))
        for _ in range(2):
            ledger.load(batch, path, y, "orders")
    return ledger.entries(spark, path).select("batch", "rows", "inserted", "unchanged")


@register("published_versions", """SELECT c_custkey AS key, CASE WHEN c_custkey % 10 = 2 THEN 'missing' WHEN c_custkey % 10 = 1 THEN 'new' ELSE 'changed' END AS change FROM customer WHERE c_custkey % 10 IN (1, 2) OR c_custkey % 7 = 0""")
def _versions(spark, sf_dir):
    """What changed from the first version of a table to its second."""
    path, customers = new_path(spark), table(spark, sf_dir, "customer")
    versions.publish(customers.where("c_custkey % 10 <> 1"), path, {"source": "first delivery"})
    later = customers.where("c_custkey % 10 <> 2").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    versions.publish(later, path, {"source": "second delivery"})
    return versions.changed_rows(spark, path, "c_custkey", 1, 2)
