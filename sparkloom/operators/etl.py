"""Contract-checked batches: typed rows, first-match reject reasons, warnings, de-duplication, keys, checks and publishing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.columns import clean, collapse, drop_time, number, row_hashes, row_key, stock_code

#: The contract's header, and reject reasons by precedence.
RAW = ("Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country")
REASONS = (
    "missing_invoice", "bad_invoice_format", "bad_date", "bad_quantity", "zero_quantity", "bad_price", "missing_stock_code", "bad_customer_id", "outside_drop_period", "test_record",
    "accounting_adjustment", "stock_adjustment", "negative_price", "cancellation_sign_mismatch", "unknown_product", "unknown_customer",
)
WARNINGS = ("missing_customer_id", "zero_price_line", "extreme_quantity", "stock_code_normalised", "description_variant")
LINE_TYPES = {"POST": "postage", "DOT": "postage", "C2": "postage", "M": "manual", "D": "discount", "BANK CHARGES": "fee", "AMAZONFEE": "fee", "CRUK": "fee", "S": "sample"}
WEIGHTS = {"gate": 3, "warn": 2, "info": 1}


def _numbered(code: Column) -> Column:
    """Whether a code begins with a digit, which letter case doesn't touch; changing the case of a text costs far more than this."""
    return (code >= "0") & (code < ":")


def _month(time: Column) -> Column:
    """yyyy-MM of a timestamp, the first seven characters of its text."""
    year, padded = F.year(time), lambda n, size: F.lpad(n.cast("string"), size, "0")
    return F.when(year.between(0, 9999), F.concat(padded(year, 4), F.lit("-"), padded(F.month(time), 2))).otherwise(F.substring(time.cast("string"), 1, 7))


def _same_but_case(a: Column, b: Column) -> Column:
    """upper(a) = upper(b), without the letters of texts in ASCII that differ in length."""
    plain = lambda c: F.octet_length(c) == F.length(c)
    return F.when(plain(a) & plain(b) & (F.length(a) != F.length(b)), False).otherwise(F.upper(a) == F.upper(b))


def coerce(records: DataFrame) -> DataFrame:
    """records with typed columns; the raw ones are kept as raw_<name>, as column names don't differ by case."""
    c = {x: clean(F.col(f"`{x}`")) for x in RAW}
    quantity, price, customer = number(c["Quantity"]), number(c["Price"]), number(c["Customer ID"])
    out = records.select(
        *[F.col(f"`{x}`").alias(f"raw_{x}" if x in RAW else x) for x in records.columns],
        c["Invoice"].alias("invoice"), c["StockCode"].alias("stock_code_raw"), collapse(c["Description"]).alias("description"),
        F.when(quantity % 1 == 0, quantity).cast("long").alias("quantity"),
        drop_time(c["InvoiceDate"]).alias("invoiced_at"),
        price.alias("unit_price"), F.when(customer % 1 == 0, customer).cast("long").alias("customer_id"), c["Country"].alias("country"),
        c["Customer ID"].isNotNull().alias("_customer_given"),
    )
    return out.withColumns({"stock_code": stock_code(F.coalesce("stock_code_raw", F.lit(""))), "_month": _month(F.col("invoiced_at"))})


def reject_reason(period: str | Column, known_products: DataFrame | None = None, known_customers: DataFrame | None = None) -> Column:
    """The first reason by precedence that applies to a coerced row; null for a row to keep.

    Membership in the dictionaries is looked up beforehand as the flags product_known and customer_known.
    """
    invoice = F.coalesce("invoice", F.lit(""))
    cancel = invoice.startswith("C")
    masks = {
        "missing_invoice": F.col("invoice").isNull(),
        "bad_invoice_format": ~invoice.rlike(r"^[CA]?\d{6}$"),
        "bad_date": F.col("invoiced_at").isNull(),
        "bad_quantity": F.col("quantity").isNull(),
        "zero_quantity": F.col("quantity") == 0,
        "bad_price": F.col("unit_price").isNull(),
        "missing_stock_code": F.col("stock_code_raw").isNull(),
        "bad_customer_id": F.col("_customer_given") & F.col("customer_id").isNull(),
        "outside_drop_period": F.col("_month") != (F.lit(period) if isinstance(period, str) else period),
        "test_record": ~_numbered(F.col("stock_code")) & F.upper("stock_code").startswith("TEST"),
        "accounting_adjustment": invoice.startswith("A"),
        "stock_adjustment": (F.col("unit_price") == 0) & F.col("customer_id").isNull(),
        "negative_price": F.col("unit_price") < 0,
        "cancellation_sign_mismatch": (cancel & (F.col("quantity") > 0)) | (~cancel & (F.col("quantity") < 0)),
        "unknown_product": F.col("stock_code_raw").isNotNull() & ~F.col("product_known"),
        "unknown_customer": F.col("customer_id").isNotNull() & ~F.col("customer_known"),
    }
    # as an array, like warnings(): one expression of all masks makes a method that the JVM doesn't compile
    return F.get(F.array_compact(F.array(*[F.when(masks[r], F.lit(r)) for r in REASONS])), F.lit(0))


def with_references(rows: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """rows with product_known, canonical (the catalogue's description) and customer_known; every row stays."""
    p = products.select(F.col("stock_code").alias("_p"), F.col("description").alias("canonical")).dropDuplicates(["_p"])
    c = customers.select(F.col("customer_id").alias("_c")).distinct()
    joined = rows.join(p, F.col("stock_code") == F.col("_p"), "left").join(c, F.col("customer_id") == F.col("_c"), "left")
    return joined.withColumn("product_known", F.col("_p").isNotNull()).withColumn("customer_known", F.col("_c").isNotNull()).drop("_p", "_c")


def line_type(code: Column) -> Column:
    """The kind of a stock code: a fixed map, gift_ codes are vouchers, others products."""
    known = F.create_map(*[F.lit(x) for pair in LINE_TYPES.items() for x in pair])
    return F.when(_numbered(code), "product").otherwise(F.coalesce(known[F.upper(code)], F.when(F.lower(code).startswith("gift_"), "voucher"), F.lit("product")))


def warnings() -> Column:
    """All warnings of an accepted row, in a fixed order."""
    masks = {
        "missing_customer_id": F.col("customer_id").isNull(),
        "zero_price_line": F.col("unit_price") == 0,
        "extreme_quantity": F.abs("quantity") >= 10_000,
        "stock_code_normalised": F.col("stock_code") != F.col("stock_code_raw"),
        "description_variant": ~_same_but_case(F.col("description"), F.col("canonical")),
    }
    return F.array_compact(F.array(*[F.when(masks[w], F.lit(w)) for w in WARNINGS]))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with duplicate: whether an earlier row in the given order has equal keys (nulls are equal).

    Rows are dealt and sorted by a 128-bit hash of the keys, not by the keys themselves.
    """
    one, other = row_hashes([F.col(f"`{k}`") for k in keys])
    hashed = rows.withColumn("_k1", one).withColumn("_k2", other)
    w = Window.partitionBy("_k1", "_k2").orderBy(*order)
    return hashed.withColumn("duplicate", F.row_number().over(w) > 1).drop("_k1", "_k2")


def validate(records: DataFrame, period: str | Column, products: DataFrame, customers: DataFrame, order: str = "line_number", within: tuple[str, ...] = ()) -> DataFrame:
    """records with typed columns, reason (a reject reason, duplicate_line or null), severity, and warnings of accepted rows.

    period: the drop's month, or a column of it where records holds several drops; within names columns that tell drops
    apart, as lines repeat only inside one.
    """
    # Equal raw rows have equal reasons, so the first of equal rows is the first of the accepted ones. They are compared before
    # anything is worked out: no typed column is dealt out with them, and no step is too large for the JVM to compile.
    rows = with_references(coerce(keep_first(records, [*within, *RAW], [order])), products, customers).withColumn("reason", reject_reason(period))
    reason = F.coalesce("reason", F.when(F.col("duplicate"), "duplicate_line"))
    severity = F.when(F.col("reason").isNotNull(), "reject").when(F.col("duplicate"), "dropped")
    rows = rows.withColumn("severity", severity).withColumn("reason", reason).drop("duplicate")
    accepted = F.col("reason").isNull()
    rows = rows.withColumn("description", F.when(accepted, F.coalesce("description", "canonical")).otherwise(F.col("description")))
    return rows.withColumn("warnings", F.when(accepted, warnings())).withColumn("line_type", F.when(accepted, line_type(F.col("stock_code"))))


def quarantined(rows: DataFrame, broken: DataFrame) -> DataFrame:
    """(line_number, reason, raw): rejected and dropped rows of validate(), and the lines that could not be read at all (line_number, issue, line)."""
    raw = F.to_json(F.struct(*[F.coalesce(F.col(f"`raw_{x}`"), F.lit("")).alias(x) for x in RAW]))
    own = rows.where("reason is not null").select("line_number", "reason", raw.alias("raw"))
    return own.unionByName(broken.where("issue is not null").select("line_number", F.col("issue").alias("reason"), F.substring("line", 1, 500).alias("raw")))


def transform(accepted: DataFrame) -> DataFrame:
    """Accepted rows with line_key and line_total, one row per key (the first by line_number)."""
    price = F.format_string("%.3f", F.col("unit_price"))
    key = row_key(F.col("invoice"), F.col("stock_code_raw"), F.col("description"), F.col("quantity"), price, F.date_format("invoiced_at", "yyyy-MM-dd HH:mm:ss"), F.col("customer_id"), F.col("country"))
    total = (F.col("quantity").cast("decimal(12,0)") * F.col("unit_price").cast("decimal(12,3)")).cast("decimal(14,3)")
    return keep_first(accepted.withColumn("line_key", key), ["line_key"], ["line_number"]).where(~F.col("duplicate")).drop("duplicate").withColumn("line_total", total)


def first_lines(lines: DataFrame) -> DataFrame:
    """One header per invoice, from its first line."""
    head = F.min_by(F.struct("customer_id", "country", "invoiced_at"), "line_number").alias("h")
    return lines.groupBy("invoice").agg(head).select("invoice", "h.*", F.when(F.col("invoice").startswith("C"), "cancellation").otherwise("sale").alias("kind"))


def batch_checks(rows: DataFrame, reject_gate: float = 0.05, duplicate_warn: float = 0.1, completeness_min: float = 0.6, by: tuple[str, ...] = ()) -> DataFrame:
    """(name, dimension, severity, passed, value) of a validated batch, or of each one that the columns in by tell apart, from one aggregate."""
    kept = F.col("reason").isNull()
    sale = kept & (F.col("line_type") == "product") & ~F.col("invoice").startswith("C")
    rejected = F.col("severity") == "reject"
    c = rows.groupBy(*by).agg(
        F.count("*").alias("read"), F.count_if(rejected).alias("rejected"), F.count_if(F.col("severity") == "dropped").alias("dropped"),
        F.avg(F.when(sale, F.col("customer_id").isNotNull().cast("double"))).alias("complete"),
        F.count_if(F.col("reason").isin("unknown_product", "unknown_customer")).alias("orphans"),
        F.count_if(F.col("invoiced_at").isNotNull()).alias("dated"), F.count_if(F.col("reason") == "outside_drop_period").alias("outside"),
    )
    read = F.greatest(F.col("read"), F.lit(1))
    checks = [
        ("reject_ratio", "validity", "gate", F.col("rejected") / read, lambda v: v <= reject_gate),
        ("duplicate_ratio", "uniqueness", "warn", F.col("dropped") / read, lambda v: v <= duplicate_warn),
        ("customer_completeness", "completeness", "warn", F.coalesce("complete", F.lit(1.0)), lambda v: v >= completeness_min),
        ("period_consistency", "timeliness", "warn", 1 - F.col("outside") / F.greatest("dated", F.lit(1)), lambda v: v >= 0.99),
        ("reference_integrity", "integrity", "warn", F.col("orphans") / read, lambda v: v <= 0.001),
    ]
    entries = [F.struct(F.lit(n).alias("name"), F.lit(d).alias("dimension"), F.lit(s).alias("severity"), test(v).alias("passed"), F.round(v, 6).alias("value")) for n, d, s, v, test in checks]
    return c.select(*by, F.inline(F.array(*entries)))


def dq_score(checks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """score, by the columns in by: the weighted share of passed checks in percent, one decimal."""
    weight = reduce(lambda acc, kv: acc.when(F.col("severity") == kv[0], kv[1]), list(WEIGHTS.items())[1:], F.when(F.col("severity") == "gate", WEIGHTS["gate"]))
    return checks.groupBy(*by).agg(F.round(100.0 * F.sum(F.when(F.col("passed"), weight).otherwise(0)) / F.sum(weight), 1).alias("score"))


def publish(lines: DataFrame, path: str, key: str = "line_key", partition: str = "drop_key") -> DataFrame:
    """Append the rows whose key the table lacks, partitioned; returns what was added. A replay adds nothing.

    Only partitions that the batch touches are read of the table (their number is small: a batch is a few drops). A key
    belongs to one partition. Writing is Spark's committed append: a failed job leaves no rows.
    """
    spark = lines.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    added = fresh = lines.dropDuplicates([key]).persist()
    try:
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            touched = [r[0] for r in fresh.select(partition).distinct().collect()]
            old = spark.read.schema(lines.schema).parquet(path).where(F.col(partition).isin(touched) | F.lit(None in touched) & F.col(partition).isNull()).select(F.col(key).alias("_key"))
            added = fresh.join(old, F.col(key) == F.col("_key"), "left_anti").persist()
        n = added.count()
        if n:
            added.write.mode("append").partitionBy(partition).parquet(path)
        return spark.createDataFrame([(n,)], "added long")
    finally:
        fresh.unpersist()
        added.unpersist()


def merge_customers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by customer_id: the new country, the earlier first_seen; changed tells whether a row is new or differs."""
    o = old.select("customer_id", F.col("country").alias("_c"), F.col("first_seen").alias("_f"))
    joined = new.join(o, "customer_id", "full_outer")
    country, seen = F.coalesce("country", "_c"), F.least("first_seen", "_f")
    changed = F.col("_f").isNull() & F.col("_c").isNull() | ~(country.eqNullSafe(F.col("_c")) & seen.eqNullSafe(F.col("_f")))
    return joined.select("customer_id", country.alias("country"), seen.alias("first_seen"), changed.alias("changed"))
