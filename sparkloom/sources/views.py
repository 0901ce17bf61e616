"""The bundled views over the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import cleaned, file_states, new_path, spread, table


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order, customer's country and part; the optimiser picks the joins and prunes columns."""
    t = lambda name: table(spark, sf_dir, name)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("l_orderkey").alias("invoice_no"), F.col("o_orderdate").alias("invoiced_at"), F.col("l_partkey").alias("stock_code"), F.col("p_name").alias("description"),
        F.col("l_quantity").alias("quantity"), F.col("p_retailprice").alias("unit_price"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.col("o_custkey").alias("customer_id"), F.col("n_name").alias("country"), (F.col("l_returnflag") == "R").alias("is_cancellation"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"),
    )


_derived: dict[tuple, str] = {}


def derived(name: str, build: Callable[[SparkSession, str], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    """What build makes of the star schema, written as a table once per application and state of the source files: their
    names, lengths and times, so that a table that was written again is built again also where folders have no time."""
    sources = ("lineitem", "orders", "customer", "nation", "part")
    key = (spark.sparkContext.applicationId, name, sf_dir, *[file_states(spark, f"{sf_dir}/{t}.parquet") for t in sources])
    if key not in _derived:
        path = new_path(spark)
        with cleaned(spark):
            build(spark, sf_dir).write.option("compression", "zstd").parquet(path)
        _derived[key] = path
    return spark.read.parquet(_derived[key])


def bundled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sales() as the derived table that plans scan: a plan prunes columns and row groups of it, and none pays for the joins again."""
    return derived("sales", sales, spark, sf_dir)


SALES_SQL = """sales AS (SELECT l_orderkey AS invoice_no, o_orderdate AS invoiced_at, l_partkey AS stock_code, p_name AS description, l_quantity AS quantity,
 p_retailprice AS unit_price, l_extendedprice * (1 - l_discount) AS revenue, o_custkey AS customer_id, n_name AS country, l_returnflag = 'R' AS is_cancellation,
 nullif(o_orderpriority, '5-LOW') AS priority
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

#: Monthly drops as text, made from all order lines with defects at fixed keys (some lines in the drop after theirs); the same SQL runs in both engines.
DROP_SQL = """drop_rows AS (SELECT
 CASE WHEN l_orderkey % 97 = 0 THEN ' ' WHEN l_orderkey % 89 = 0 THEN 'X12' WHEN l_orderkey % 83 = 0 THEN 'A' || lpad(CAST(l_orderkey % 1000000 AS STRING), 6, '0')
      WHEN l_returnflag = 'R' THEN 'C' || lpad(CAST(l_orderkey % 1000000 AS STRING), 6, '0') ELSE lpad(CAST(l_orderkey % 1000000 AS STRING), 6, '0') END AS invoice_raw,
 CASE WHEN l_partkey % 71 = 0 THEN '' WHEN l_partkey % 67 = 0 THEN 'TEST001' WHEN l_partkey % 61 = 0 THEN 'POST' WHEN l_partkey % 59 = 0 THEN '99999x'
      WHEN l_partkey % 2 = 0 THEN lpad(CAST(l_partkey % 100000 AS STRING), 5, '0') || 'a' ELSE lpad(CAST(l_partkey % 100000 AS STRING), 5, '0') END AS stock_raw,
 CASE WHEN l_partkey % 13 = 0 THEN '' ELSE ' ' || p_name || '  x ' END AS description_raw,
 CASE WHEN l_suppkey % 53 = 0 THEN 'many' WHEN l_suppkey % 47 = 0 THEN '0' WHEN l_suppkey % 43 = 0 THEN '1.5' WHEN l_returnflag = 'R' AND l_linenumber <> 3
      THEN '-' || CAST(CAST(l_quantity AS INT) AS STRING) WHEN l_suppkey % 41 = 0 AND l_returnflag <> 'R' THEN '12000' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS quantity_raw,
 CASE WHEN l_orderkey % 79 = 0 THEN '31/12/1996' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 08:26:00' END AS date_raw,
 CASE WHEN l_partkey % 41 = 0 THEN 'free' WHEN l_partkey % 37 = 0 THEN '-1.50' WHEN l_partkey % 31 = 0 THEN '0' ELSE CAST(CAST(floor(p_retailprice) AS INT) AS STRING) || '.25' END AS price_raw,
 CASE WHEN o_custkey % 7 = 0 THEN '' WHEN o_custkey % 29 = 0 THEN 'guest' ELSE CAST(o_custkey AS STRING) END AS customer_raw,
 n_name AS country_raw,
 CASE WHEN l_linenumber = 7 AND l_partkey % 5 = 0 THEN substr(CAST(CAST(date_trunc('month', o_orderdate) AS DATE) + INTERVAL 1 MONTH AS STRING), 1, 7) ELSE substr(CAST(o_orderdate AS STRING), 1, 7) END AS period, l_orderkey * 8 + l_linenumber + 2 AS line_number
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""


def drop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DROP_SQL with the contract's column names; line_number follows from the order line, so it is the same in every run."""
    for name in ("lineitem", "orders", "customer", "nation", "part"):
        rows = table(spark, sf_dir, name)
        (spread(rows) if name == "lineitem" else rows).createOrReplaceTempView(name)
    rows = spark.sql(f"WITH {DROP_SQL} SELECT * FROM drop_rows")
    names = {"invoice_raw": "Invoice", "stock_raw": "StockCode", "description_raw": "Description", "quantity_raw": "Quantity", "date_raw": "InvoiceDate", "price_raw": "Price", "customer_raw": "Customer ID", "country_raw": "Country"}
    return rows.withColumnsRenamed(names)
