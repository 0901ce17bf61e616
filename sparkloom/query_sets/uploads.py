"""Queries over files that they write and read back: drops, uploads, catalogues, nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.registry import register
from sparkloom.session import table
from sparkloom.sources import files
from sparkloom.sources.views import DROP_SQL, drop_rows

_DROPS = f"WITH {DROP_SQL.replace('AS STRING', 'AS VARCHAR')}"


@register("drop_round_trip", f"""{_DROPS} SELECT period, count(*) AS lines, 0::BIGINT AS issues, min(2)::BIGINT AS first_line, (count(*) + 1)::BIGINT AS last_line, sum(length(coalesce(description_raw, '')))::BIGINT AS letters,
 count(*) FILTER (trim(invoice_raw) = '') AS blank_invoices FROM drop_rows GROUP BY 1""")  # fmt: skip
def _drops(spark, sf_dir):
    folder = files.staged(spark)
    files.write_drops(drop_rows(spark, sf_dir), folder)
    read = files.read_drop(spark, f"{folder}/*/*.csv.gz").withColumn("period", F.regexp_extract("file", "period=([^/]+)", 1))
    return read.groupBy("period").agg(
        F.count("*").alias("lines"), F.count("issue").alias("issues"), F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"),
        F.sum(F.length(F.coalesce("Description", F.lit("")))).alias("letters"), F.count_if(F.trim(F.coalesce("Invoice", F.lit(""))) == "").alias("blank_invoices"),
    )


#: Customers as lines of drops, some of them broken, in four files.
_LINE_KINDS = """li AS (SELECT c_custkey AS k, c_custkey % 4 AS f, row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY c_custkey) + 1 AS line_number, c_custkey % 10 AS kind, c_name FROM customer)"""


@register("drop_line_issues", f"""WITH {_LINE_KINDS} SELECT f::VARCHAR AS file, line_number::INT AS line_number, CASE WHEN kind = 3 THEN 'encoding_error' WHEN kind IN (4, 5) THEN 'malformed_row' END AS issue, CASE WHEN kind < 3 OR kind > 5 THEN k::VARCHAR END AS invoice,
 CASE WHEN kind = 1 THEN 'a, "' || c_name || '"' WHEN kind = 2 THEN 'café ' || c_name WHEN kind < 3 OR kind > 5 THEN c_name END AS description FROM li WHERE kind NOT IN (6, 7)""")  # fmt: skip
def _issues(spark, sf_dir):
    folder, kind = files.staged(spark), F.col("c_custkey") % 10
    key, name = F.col("c_custkey").cast("string"), F.col("c_name")
    line = lambda text, *more: F.concat(key, F.lit(","), text, F.lit(",x,2,d,1.5,7,UK"), *more)
    broken = F.unhex(F.lit("fffe")).cast("string")  # bytes that are no text
    text = F.when(kind == 1, line(F.concat(F.lit('"a, ""'), name, F.lit('"""')))).when(kind == 2, line(F.concat(F.lit("café "), name))).when(kind == 3, line(F.concat(name, broken))).when(kind == 4, F.concat(key, F.lit(","), name, F.lit(",short")))
    text = F.concat(F.lit("X,"), F.when(kind == 5, line(name, F.lit(",more"))).when(kind == 6, "").when(kind == 7, "   ").otherwise(F.coalesce(text, line(name))))
    lines = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 4).alias("file"), F.col("c_custkey").alias("at"), F.concat(F.substring(text, F.lit(3), F.length(text)), F.lit("\r")).alias("value"))
    heads = spark.range(4).select(F.col("id").alias("file"), F.lit(-1).cast("long").alias("at"), F.lit("Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\r").alias("value"))
    lines.unionByName(heads).repartition(4, "file").sortWithinPartitions("file", "at").select("file", "value").write.partitionBy("file").option("compression", "gzip").text(folder)
    read = files.read_drop(spark, f"{folder}/*/*.txt.gz")
    return read.select(F.regexp_extract("file", "file=([0-9]+)", 1).alias("file"), F.col("line_number").cast("int").alias("line_number"), "issue", F.col("Invoice").alias("invoice"), F.col("StockCode").alias("description"))


@register("upload_types", "SELECT c_custkey::INTEGER AS c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS column_4, DATE '1996-02-01' + (c_custkey % 28)::INT AS opened FROM customer")
def _upload(spark, sf_dir):
    folder = files.staged(spark)
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("x" * 70), F.date_add(F.lit("1996-02-01").cast("date"), (F.col("c_custkey") % 28).cast("int")).alias("opened")
    )
    rows.write.option("header", True).option("sep", ";").option("maxRecordsPerFile", files.MAX_ROWS).csv(folder)  # as many uploads as it takes
    return files.read_upload(spark, folder)


@register("upload_refusals", """WITH u AS (SELECT p_brand, regexp_extract(p_brand, '[0-9]+')::INT % 8 AS kind, sum(length(p_name) + length(p_partkey::VARCHAR) + 2) + 7 AS n FROM part GROUP BY 1)
SELECT p_brand AS file, CASE WHEN kind = 1 THEN 'empty_file' WHEN n > (SELECT median(n) FROM u) AND kind <> 1 THEN 'file_too_large' WHEN kind IN (2, 3, 4, 5) THEN 'not_csv' END AS refusal FROM u""")  # fmt: skip
def _refusals(spark, sf_dir):
    """A file for each brand with its parts, some of them blank, large, or of another kind than their name says or than is taken."""
    kind = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int") % 8
    lines = table(spark, sf_dir, "part").select("p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(","), "p_name", F.lit("\n")).alias("line"))
    text = F.concat(F.lit("id,name"), F.array_join(F.collect_list("line"), ""))
    size = F.sum(F.length("line")) + 7
    found = lines.groupBy("p_brand").agg(text.alias("t"), size.alias("length")).withColumn("kind", kind)  # a brand's parts, as an upload is one file
    start = F.when(F.col("kind") == 2, F.unhex(F.lit("504B0304"))).when(F.col("kind") == 3, F.unhex(F.lit("FFD8FF"))).when(F.col("kind") == 4, F.unhex(F.lit("610062"))).otherwise(F.lit("").cast("binary"))
    content = F.when(F.col("kind") == 1, F.lit(" \r\n\t ").cast("binary")).otherwise(F.concat(start, F.col("t").cast("binary")))
    path = F.concat(F.lit("in/"), "p_brand", F.when(F.col("kind") == 5, ".exe").when(F.col("kind") == 6, "").otherwise(".csv"))
    uploads = found.select(path.alias("path"), "length", content.alias("content"))
    limit = int(found.agg(F.median("length")).first()[0])
    seen = files.admission(uploads, files.UploadLimits(max_bytes=limit))
    return seen.select(F.regexp_extract("path", "in/([^.]*)", 1).alias("file"), "refusal")


@register("catalogue_round_trip", "SELECT p_brand AS stock_code, min(p_name) AS description FROM part GROUP BY 1")
def _catalogue(spark, sf_dir):
    folder = files.staged(spark)
    files.write_catalogue(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("stock_code")).agg(F.min("p_name").alias("description")), folder)
    return files.read_catalogue(spark, folder)


@register("nested_records", "SELECT o_orderkey AS number, strftime(o_orderdate, '%Y-%m-%d') AS issued, count(l_orderkey) AS lines, coalesce(sum(l_quantity), 0) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def _records(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("stock_code"), F.col("l_quantity").alias("quantity"))).alias("lines"))  # one order's lines
    records = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued"), "lines")
    folder = files.staged(spark)
    files.write_records(records, folder)
    read = files.read_records(spark, folder, "number long, issued string, lines array<struct<stock_code: long, quantity: double>>")
    own = F.coalesce("lines", F.array().cast("array<struct<stock_code: bigint, quantity: double>>"))
    return read.select("number", "issued", F.size(own).cast("long").alias("lines"), F.aggregate(own, F.lit(0.0), lambda s, x: s + x["quantity"]).alias("quantity"))


@register("uploads_to_purge", """WITH u AS (SELECT event_id AS id, ts AS created_at, ts + INTERVAL 10 DAY AS expires_at FROM events)
SELECT id, 'expired' AS cause FROM u WHERE expires_at <= TIMESTAMP '2024-01-20' UNION ALL SELECT id, 'over_capacity' FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS r FROM u WHERE expires_at > TIMESTAMP '2024-01-20') WHERE r > 40""")  # fmt: skip
def _purge(spark, sf_dir):
    u = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"))
    return files.to_purge(u, "2024-01-20", 40)


@register("price_texts", "SELECT p_partkey, regexp_replace(regexp_replace(printf('%.3f', p_retailprice), '0+$', ''), '\\.$', '') AS price FROM part")
def _prices(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", files.price_text(F.col("p_retailprice")).alias("price"))


@register("corrupted_drop", """WITH h AS (SELECT l_orderkey, l_linenumber, ('0x' || substr(md5(concat_ws('-', '11', l_orderkey::VARCHAR, l_linenumber::VARCHAR)), 1, 8))::BIGINT % 1000 AS b FROM lineitem)
SELECT CASE WHEN b < 40 THEN 'quantity' WHEN b < 60 THEN 'date' WHEN b < 70 THEN 'price' WHEN b < 75 THEN 'fields' ELSE 'none' END AS fault, count(*) AS n FROM h GROUP BY 1""")  # fmt: skip
def _corrupted(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("5").alias("quantity"), F.lit("1996-01-02 03:04:05").alias("date"), F.lit("1.25").alias("price"))
    broken = C.corrupted(lines, ["l_orderkey", "l_linenumber"], 11, "quantity", "date", "price")
    fault = F.when(F.col("quantity") == "five", "quantity").when(F.col("date") == "01/02/1996 3:04 AM", "date").when(F.col("price") == "", "price").when(F.col("cut"), "fields").otherwise("none")
    return broken.groupBy(fault.alias("fault")).agg(F.count("*").alias("n"))
