"""Registered queries with their SQL twins, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.operators import etl, profile, retrieval, rules
from sparkloom.plans import plan
from sparkloom.registry import ORACLES, QUERIES  # noqa: F401
from sparkloom.registry import register as _register
from sparkloom.session import delete_path, table, written, written_at
from sparkloom.sources.views import DROP_SQL, SALES_SQL, bundled, derived, drop_rows

def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to two decimals, so sums in another order compare equal."""
    return df.select(*[F.round(f.name, 2).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


def _plan(name: str, data: dict, sql: str) -> None:
    """A plan over sales; sql selects from sales and groups, sorts and limits likewise."""
    _register(name, f"WITH {SALES_SQL} {sql}")(lambda spark, sf_dir: _rounded(plan.run(data, bundled(spark, sf_dir))))


def _m(agg: str, column: str | None = None) -> dict:
    return {"agg": agg, "column": column}


_plan("top_parts_by_revenue", {"metrics": [_m("sum", "revenue"), _m("count")], "group_by": ["Description"], "filters": [{"column": "is_cancellation", "op": "eq", "value": "false"}], "limit": 10},
      "SELECT description, round(sum(revenue), 2) AS sum_revenue, count(*) AS rows FROM sales WHERE NOT is_cancellation GROUP BY 1 ORDER BY sum(revenue) DESC NULLS LAST, 1 LIMIT 10")
_plan("revenue_by_month", {"metrics": [_m("sum", "revenue")], "time_bucket": {"column": "invoiced_at", "grain": "month"}, "limit": 100},
      "SELECT date_trunc('month', invoiced_at)::DATE AS month, round(sum(revenue), 2) AS sum_revenue FROM sales GROUP BY 1 ORDER BY 1 LIMIT 100")
_plan("orders_by_week", {"metrics": [_m("count_distinct", "invoice_no")], "time_bucket": {"column": "invoiced_at", "grain": "week"}, "sort": "group_desc", "limit": 60},
      "SELECT date_trunc('week', invoiced_at)::DATE AS week, count(DISTINCT invoice_no) AS distinct_invoice_no FROM sales GROUP BY 1 ORDER BY 1 DESC LIMIT 60")
_plan("revenue_by_quarter_nation", {"metrics": [_m("avg", "revenue"), _m("max", "quantity")], "time_bucket": {"column": "invoiced_at", "grain": "quarter"}, "group_by": ["country"], "limit": 100},
      "SELECT date_trunc('quarter', invoiced_at)::DATE AS quarter, country, round(avg(revenue), 2) AS avg_revenue, max(quantity) AS max_quantity FROM sales GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 100")
_plan("global_metrics", {"metrics": [_m("count", "priority"), _m("min", "invoiced_at"), _m("avg", "unit_price")]},
      "SELECT count(priority) AS count_priority, min(invoiced_at) AS min_invoiced_at, round(avg(unit_price), 2) AS avg_unit_price FROM sales")
_plan("filter_ne_notin", {"metrics": [_m("count")], "group_by": ["priority"], "filters": [{"column": "priority", "op": "ne", "value": "1-URGENT"}, {"column": "country", "op": "not_in", "value": ["NATION_3", "NATION_11"]}]},
      "SELECT priority, count(*) AS rows FROM sales WHERE priority <> '1-URGENT' AND country NOT IN ('NATION_3', 'NATION_11') GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 20")
_plan("filter_contains_escaped", {"metrics": [_m("count")], "group_by": ["description"], "filters": [{"column": "description", "op": "contains", "value": "R"}, {"column": "country", "op": "contains", "value": "tion_1"}], "limit": 30},
      "SELECT description, count(*) AS rows FROM sales WHERE contains(lower(description), 'r') AND contains(lower(country), 'tion_1') GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 30")
_plan("filter_between_dates", {"metrics": [_m("sum", "quantity")], "group_by": ["country"], "filters": [{"column": "invoiced_at", "op": "between", "value": ["1996", "1997-03"]}, {"column": "quantity", "op": "between", "value": [5, 30]}]},
      "SELECT country, round(sum(quantity), 2) AS sum_quantity FROM sales WHERE invoiced_at >= TIMESTAMP '1996-01-01' AND invoiced_at < TIMESTAMP '1997-04-01' AND quantity BETWEEN 5 AND 30 GROUP BY 1 ORDER BY sum(quantity) DESC NULLS LAST, 1 LIMIT 20")
_plan("filter_date_gt_lte", {"metrics": [_m("count")], "time_bucket": {"column": "invoiced_at", "grain": "day"}, "filters": [{"column": "invoiced_at", "op": "gt", "value": "1996-02"}, {"column": "invoiced_at", "op": "lte", "value": "1996-04-10"}], "limit": 50},
      "SELECT date_trunc('day', invoiced_at)::DATE AS day, count(*) AS rows FROM sales WHERE invoiced_at >= TIMESTAMP '1996-03-01' AND invoiced_at < TIMESTAMP '1996-04-11' GROUP BY 1 ORDER BY 1 LIMIT 50")
_plan("filter_null_checks", {"metrics": [_m("count"), _m("count_distinct", "customer_id")], "group_by": ["country", "priority"], "filters": [{"column": "priority", "op": "is_null"}, {"column": "customer_id", "op": "not_null"}], "sort": "metric_asc", "limit": 15},
      "SELECT country, priority, count(*) AS rows, count(DISTINCT customer_id) AS distinct_customer_id FROM sales WHERE priority IS NULL AND customer_id IS NOT NULL GROUP BY 1, 2 ORDER BY 3 NULLS LAST, 1, 2 LIMIT 15")
_plan("filter_in_comparisons", {"metrics": [_m("min", "revenue"), _m("max", "revenue")], "group_by": ["is_cancellation"], "filters": [{"column": "country", "op": "in", "value": ["NATION_7", "NATION_21"]}, {"column": "unit_price", "op": "gte", "value": "£905.50"}, {"column": "quantity", "op": "lt", "value": 40}]},
      "SELECT is_cancellation, round(min(revenue), 2) AS min_revenue, round(max(revenue), 2) AS max_revenue FROM sales WHERE country IN ('NATION_7', 'NATION_21') AND unit_price >= 905.5 AND quantity < 40 GROUP BY 1 ORDER BY min(revenue) DESC NULLS LAST, 1 LIMIT 20")
_plan("rows_by_year", {"metrics": [_m("count")], "time_bucket": {"column": "invoiced_at", "grain": "year"}, "filters": [{"column": "invoiced_at", "op": "gte", "value": "1997"}]},
      "SELECT date_trunc('year', invoiced_at)::DATE AS year, count(*) AS rows FROM sales WHERE invoiced_at >= TIMESTAMP '1997-01-01' GROUP BY 1 ORDER BY 1 LIMIT 20")


@_register("profile_columns", """
SELECT 'c_custkey' AS column_name, 'integer' AS kind, count(c_custkey) AS non_null, count(DISTINCT c_custkey) AS distinct_values, min(c_custkey)::VARCHAR AS min_value, max(c_custkey)::VARCHAR AS max_value, round(avg(c_custkey), 4) AS mean, 0::BIGINT AS negatives, count(*) AS n_rows FROM customer
UNION ALL SELECT 'c_acctbal', 'number', count(c_acctbal), count(DISTINCT c_acctbal), min(c_acctbal)::VARCHAR, max(c_acctbal)::VARCHAR, round(avg(c_acctbal), 4), count(*) FILTER (c_acctbal < 0), count(*) FROM customer
UNION ALL SELECT 'c_mktsegment', 'text', count(c_mktsegment), count(DISTINCT c_mktsegment), min(c_mktsegment), max(c_mktsegment), NULL, 0, count(*) FROM customer
UNION ALL SELECT 'opened', 'date', count(*), count(DISTINCT c_custkey % 28), min(DATE '1996-02-01' + (c_custkey % 28)::INT)::VARCHAR, max(DATE '1996-02-01' + (c_custkey % 28)::INT)::VARCHAR, NULL, 0, count(*) FROM customer""")  # fmt: skip
def _profile_columns(spark, sf_dir):
    p = profile.profile(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", F.date_add(F.lit("1996-02-01").cast("date"), (F.col("c_custkey") % 28).cast("int")).alias("opened")))
    return p.select("column_name", "kind", "non_null", "distinct_values", "min_value", "max_value", "mean", "negatives", "n_rows")


@_register("profile_findings", """
WITH t AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey::VARCHAR END AS code, CASE WHEN c_custkey % 50 = 0 THEN '=1+1' ELSE ' ' || c_name END AS note, c_acctbal AS balance, 'x' AS same FROM customer)
SELECT 'mostly_missing' AS code, 'code' AS column_name, count(*) - count(code) AS affected FROM t UNION ALL SELECT 'numbers_stored_as_text', 'code', count(code) FROM t
UNION ALL SELECT 'untrimmed_text', 'note', count(*) FILTER (note <> trim(note)) FROM t UNION ALL SELECT 'formula_like_text', 'note', count(*) FILTER (regexp_matches(note, '^[=+@]')) FROM t
UNION ALL SELECT 'negative_values', 'balance', count(*) FILTER (balance < 0) FROM t UNION ALL SELECT 'constant_column', 'same', count(*) FROM t
UNION ALL SELECT * FROM (SELECT 'duplicate_rows', NULL, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS n FROM t) WHERE n > 0""")  # fmt: skip
def _profile_findings(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey").cast("string")).alias("code"),
        F.when(F.col("c_custkey") % 50 == 0, "=1+1").otherwise(F.concat(F.lit(" "), "c_name")).alias("note"), F.col("c_acctbal").alias("balance"), F.lit("x").alias("same"),
    )
    return profile.findings(t)


@_register("top_values", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "part"), "p_name")


_TYPED = f"""{DROP_SQL},
cleaned AS (SELECT *, nullif(trim(invoice_raw), '') AS invoice, nullif(trim(stock_raw), '') AS stock_code_raw, nullif(regexp_replace(trim(description_raw), '\\s+', ' ', 'g'), '') AS description0,
  TRY_CAST(quantity_raw AS DOUBLE) AS q, try_strptime(date_raw, '%Y-%m-%d %H:%M:%S') AS invoiced_at, TRY_CAST(price_raw AS DOUBLE) AS unit_price, TRY_CAST(nullif(customer_raw, '') AS DOUBLE) AS c FROM drop_rows),
typed AS (SELECT *, CASE WHEN q % 1 = 0 THEN q::BIGINT END AS quantity, CASE WHEN c % 1 = 0 THEN c::BIGINT END AS customer_id,
  CASE WHEN regexp_matches(stock_code_raw, '^[0-9]{{5}}[a-z]+$') OR stock_code_raw = 'm' THEN upper(stock_code_raw) ELSE coalesce(stock_code_raw, '') END AS stock_code FROM cleaned),
products AS (SELECT CASE WHEN p_partkey % 61 = 0 THEN 'POST' WHEN p_partkey % 2 = 0 THEN lpad((p_partkey % 100000)::VARCHAR, 5, '0') || 'A' ELSE lpad((p_partkey % 100000)::VARCHAR, 5, '0') END AS code, min(p_name) AS canonical FROM part GROUP BY 1),
known AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 11 <> 0),
flagged AS (SELECT t.*, p.code IS NOT NULL AS product_known, canonical, coalesce(description0, canonical) AS description, k.id IS NOT NULL AS customer_known FROM typed t LEFT JOIN products p ON p.code = t.stock_code LEFT JOIN known k ON k.id = t.customer_id),
reasoned AS (SELECT *, CASE WHEN invoice IS NULL THEN 'missing_invoice' WHEN NOT regexp_full_match(invoice, '[CA]?[0-9]{{6}}') THEN 'bad_invoice_format' WHEN invoiced_at IS NULL THEN 'bad_date'
  WHEN quantity IS NULL THEN 'bad_quantity' WHEN quantity = 0 THEN 'zero_quantity' WHEN unit_price IS NULL THEN 'bad_price' WHEN stock_code_raw IS NULL THEN 'missing_stock_code'
  WHEN customer_raw <> '' AND customer_id IS NULL THEN 'bad_customer_id' WHEN strftime(invoiced_at, '%Y-%m') <> period THEN 'outside_drop_period' WHEN upper(stock_code) LIKE 'TEST%' THEN 'test_record'
  WHEN invoice LIKE 'A%' THEN 'accounting_adjustment' WHEN unit_price = 0 AND customer_id IS NULL THEN 'stock_adjustment' WHEN unit_price < 0 THEN 'negative_price'
  WHEN (invoice LIKE 'C%' AND quantity > 0) OR (invoice NOT LIKE 'C%' AND quantity < 0) THEN 'cancellation_sign_mismatch' WHEN NOT product_known THEN 'unknown_product'
  WHEN customer_id IS NOT NULL AND NOT customer_known THEN 'unknown_customer' END AS reject,
  row_number() OVER (PARTITION BY period, invoice_raw, stock_raw, description_raw, quantity_raw, date_raw, price_raw, customer_raw, country_raw) AS copy FROM flagged),
judged AS (SELECT *, coalesce(reject, CASE WHEN copy > 1 THEN 'duplicate_line' END) AS reason, CASE WHEN reject IS NOT NULL THEN 'reject' WHEN copy > 1 THEN 'dropped' END AS severity FROM reasoned)"""
_DROP_ORACLE = _TYPED.replace("AS STRING", "AS VARCHAR")


def _validated(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    padded = F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0")
    code = F.when(F.col("p_partkey") % 61 == 0, "POST").when(F.col("p_partkey") % 2 == 0, F.concat(padded, F.lit("A"))).otherwise(padded)
    # a table whose size is known: the few codes of many parts are then copied to the tasks, and the rows aren't shuffled to meet them
    products = written(part.groupBy(code.alias("stock_code")).agg(F.min("p_name").alias("description")))
    customers = customer.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("customer_id"))
    return etl.validate(drop_rows(spark, sf_dir) if rows is None else rows, F.col("period"), products, customers, within=("period",))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validated drops as a table without the raw columns, which the steps after validation share.

    The drops are written before, so that the shuffles of their joins are gone when they are dealt to be judged.
    """
    folders: list[str] = []

    def build(*of) -> DataFrame:
        drops, folder = written_at(drop_rows(*of), "zstd")
        folders.append(folder)
        rows = _validated(*of, drops)
        return rows.select(*[c for c in rows.columns if not c.startswith("raw_")])

    judged = derived("validated", build, spark, sf_dir)
    for folder in folders:
        delete_path(spark, folder)
    return judged


@_register("first_reject_reason", f"WITH {_DROP_ORACLE} SELECT period, coalesce(reason, 'accepted') AS reason, coalesce(severity, '') AS severity, count(*) AS n FROM judged GROUP BY 1, 2, 3")
def _first_reject_reason(spark, sf_dir):
    return _validated(spark, sf_dir).groupBy("period", F.coalesce("reason", F.lit("accepted")).alias("reason"), F.coalesce("severity", F.lit("")).alias("severity")).agg(F.count("*").alias("n"))


@_register("warning_counts", f"""WITH {_DROP_ORACLE}, ok AS (SELECT * FROM judged WHERE reason IS NULL)
SELECT warning, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN customer_id IS NULL THEN 'missing_customer_id' END, CASE WHEN unit_price = 0 THEN 'zero_price_line' END, CASE WHEN abs(quantity) >= 10000 THEN 'extreme_quantity' END,
 CASE WHEN stock_code <> stock_code_raw THEN 'stock_code_normalised' END, CASE WHEN upper(description) <> upper(canonical) THEN 'description_variant' END], lambda x: x IS NOT NULL)) AS warning FROM ok) GROUP BY 1""")  # fmt: skip
def _warning_counts(spark, sf_dir):
    return _judged(spark, sf_dir).select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


_CHECKS = f"""{_DROP_ORACLE}, c AS (SELECT period, count(*) AS n, count(*) FILTER (severity = 'reject') AS rejected, count(*) FILTER (severity = 'dropped') AS dropped,
 avg((customer_id IS NOT NULL)::INT::DOUBLE) FILTER (reason IS NULL AND stock_code <> 'POST' AND invoice NOT LIKE 'C%') AS complete, count(*) FILTER (reason IN ('unknown_product', 'unknown_customer')) AS orphans,
 greatest(count(invoiced_at), 1) AS dated, count(*) FILTER (reason = 'outside_drop_period') AS outside FROM judged GROUP BY 1),
checks AS (SELECT period, 'reject_ratio' AS name, 'gate' AS severity, rejected / n <= 0.3 AS passed, round(rejected / n, 6) AS value FROM c UNION ALL SELECT period, 'duplicate_ratio', 'warn', dropped / n <= 0.1, round(dropped / n, 6) FROM c
 UNION ALL SELECT period, 'customer_completeness', 'warn', coalesce(complete, 1) >= 0.85, round(coalesce(complete, 1), 6) FROM c UNION ALL SELECT period, 'period_consistency', 'warn', 1 - outside / dated >= 0.99, round(1 - outside / dated, 6) FROM c
 UNION ALL SELECT period, 'reference_integrity', 'warn', orphans / n <= 0.001, round(orphans / n, 6) FROM c)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.batch_checks(_judged(spark, sf_dir), reject_gate=0.3, completeness_min=0.85, by=("period",))


@_register("quality_checks", f"WITH {_CHECKS} SELECT period, name, severity, passed, value FROM checks")
def _quality_checks(spark, sf_dir):
    return _checked(spark, sf_dir).select("period", "name", "severity", "passed", "value")


@_register("dq_score", f"WITH {_CHECKS}, w AS (SELECT *, CASE severity WHEN 'gate' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END AS w FROM checks) SELECT period, round(100.0 * sum(CASE WHEN passed THEN w ELSE 0 END) / sum(w), 1)::DOUBLE AS score FROM w GROUP BY 1")
def _dq_score(spark, sf_dir):
    return etl.dq_score(_checked(spark, sf_dir), by=("period",))


@_register("line_key", f"""WITH {_DROP_ORACLE}, k AS (SELECT *, substr(sha256(concat_ws(chr(31), coalesce(invoice, ''), coalesce(stock_code_raw, ''), coalesce(description, ''), coalesce(quantity::VARCHAR, ''),
 printf('%.3f', unit_price), strftime(invoiced_at, '%Y-%m-%d %H:%M:%S'), coalesce(customer_id::VARCHAR, ''), coalesce(country_raw, ''))), 1, 32) AS line_key FROM judged WHERE reason IS NULL)
SELECT line_key, min(invoice) AS invoice, min(stock_code_raw) AS stock_code_raw, min(round(quantity * unit_price, 3)) AS line_total FROM k GROUP BY 1""")  # fmt: skip
def _line_key(spark, sf_dir):
    return etl.transform(_judged(spark, sf_dir).where("reason is null")).select("invoice", "stock_code_raw", "line_key", F.col("line_total").cast("double").alias("line_total"))


@_register("dedup_keep_first", "SELECT l_orderkey, l_linenumber, count(*) AS copies, min(l_partkey) AS first_part FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _dedup(spark, sf_dir):
    rows = etl.keep_first(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], ["l_partkey"])
    out = rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"), F.min(F.when(~F.col("duplicate"), F.col("l_partkey"))).alias("first_part"))
    return out.where("copies > 1")


@_register("first_line_per_order", """SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1""")
def _first_line(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    head = F.min_by(F.struct("l_partkey", "l_quantity"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return t.groupBy("l_orderkey").agg(head.alias("h")).select("l_orderkey", "h.*")


@_register("mode_with_ties", """SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM
 (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE r = 1""")  # fmt: skip
def _mode(spark, sf_dir):
    return profile.mode_per_key(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@_register("date_span_per_key", "SELECT o_custkey, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders GROUP BY 1")
def _date_span(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))


@_register("orphans_left_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def _orphans(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@_register("reconcile_counts", "SELECT o_orderstatus, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _reconcile(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.coalesce(F.sum("k"), F.lit(0)).alias("lines"))


@_register("merge_customers", """WITH o AS (SELECT c_custkey AS id, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0),
 n AS (SELECT o_custkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'MOVED' ELSE n_name END AS country, min(o_orderdate)::DATE AS first_seen FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT coalesce(n.id, o.id) AS customer_id, coalesce(n.country, o.country) AS country, CASE WHEN o.id IS NULL THEN first_seen WHEN n.id IS NULL THEN DATE '1996-06-01' ELSE least(first_seen, DATE '1996-06-01') END AS first_seen,
 o.id IS NULL OR (n.id IS NOT NULL AND (n.country <> o.country OR first_seen < DATE '1996-06-01')) AS changed FROM n FULL JOIN o ON n.id = o.id""")  # fmt: skip
def _merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("country"), F.lit("1996-06-01").cast("date").alias("first_seen"))
    seen = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("first_seen"))
    new = seen.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("customer_id"), F.when(F.col("o_custkey") % 5 == 0, "MOVED").otherwise(F.col("n_name")).alias("country"), "first_seen")
    return etl.merge_customers(old, new)


@_register("latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _latest(spark, sf_dir):
    return rules.latest_per_key(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@_register("stratified_head", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= (SELECT greatest(1, 53 // count(DISTINCT event_type)) FROM events)")
def _stratified(spark, sf_dir):
    return rules.head_per_group(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], 53).select("event_type", "event_id")


@_register("page_offset", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50")
def _page(spark, sf_dir):
    return rules.page(table(spark, sf_dir, "events"), [F.desc("ts"), "event_id"], 50, 25).select("event_id", "user_id")


@_register("numbered_lines", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_linenumber, l_shipdate, l_discount, l_tax) AS line_no FROM lineitem")
def _numbered(spark, sf_dir):
    t = rules.number_lines(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_partkey", "l_suppkey", "l_extendedprice", "l_linenumber", "l_shipdate", "l_discount", "l_tax"])
    return t.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", F.col("line_no").cast("long").alias("line_no"))


@_register("order_rollup_filtered", """SELECT l_orderkey, min(l_shipdate) AS first_ship, count(*) AS n_lines, round(coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 0), 2) AS returned, count(*) FILTER (l_linestatus = 'O') AS open_lines FROM lineitem GROUP BY 1""")
def _rollup(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"), F.count("*").alias("n_lines"), F.round(F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))), F.lit(0.0)), 2).alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open_lines"))


@_register("customer_summary", "SELECT o_custkey, count(*) AS n_orders, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def _summary(spark, sf_dir):
    t = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return t.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_SHIP_SQL = """o AS (SELECT o_orderkey::VARCHAR AS invoice_no, o_orderdate AS placed, CASE WHEN c_nationkey < 5 THEN 'home' WHEN c_nationkey < 15 THEN 'near' ELSE 'far' END AS region, o_totalprice, o_orderstatus,
  ('0x' || substr(sha256('shipment:' || o_orderkey::VARCHAR), 1, 12))::BIGINT AS h FROM orders JOIN customer ON o_custkey = c_custkey),
d AS (SELECT *, placed::DATE + CASE WHEN hour(placed) < 15 THEN 1 ELSE 2 END AS s FROM o),
e AS (SELECT *, s + CASE isodow(s) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS dispatched_on FROM d),
f AS (SELECT *, dispatched_on + CAST(CASE region WHEN 'home' THEN 2 + h % 2 WHEN 'near' THEN 3 + h % 4 ELSE 6 + h % 6 END AS INT) AS estimated_delivery, (h >> 8) % 100 AS roll, (h >> 16) AS z FROM e),
g AS (SELECT *, CASE WHEN roll < 6 THEN NULL WHEN roll < 14 THEN estimated_delivery + (4 + z % 9)::INT ELSE estimated_delivery - (z % 2)::INT END AS due FROM f),
ship AS (SELECT *, CASE WHEN roll < 4 AND DATE '1998-08-05' > estimated_delivery + 10 THEN 'lost' WHEN roll >= 4 AND roll < 6 AND DATE '1998-08-05' >= estimated_delivery + 6 THEN 'returned_to_sender'
  WHEN roll >= 6 AND roll < 14 AND DATE '1998-08-05' >= due THEN 'delivered_late' WHEN roll >= 14 AND DATE '1998-08-05' >= due THEN 'delivered' ELSE 'in_transit' END AS status FROM g),
shipped AS (SELECT *, CASE WHEN status IN ('delivered', 'delivered_late') THEN due END AS delivered_on,
  CASE WHEN status = 'lost' THEN DATE '1998-08-05' - estimated_delivery WHEN status IN ('delivered', 'delivered_late') THEN greatest(due - estimated_delivery, 0) ELSE 0 END AS days_late FROM ship)"""


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    region = F.when(F.col("c_nationkey") < 5, "home").when(F.col("c_nationkey") < 15, "near").otherwise("far")
    return rules.shipments(o.select(F.col("o_orderkey").cast("string").alias("invoice_no"), F.col("o_orderdate").alias("invoiced_at"), region.alias("region"), "o_totalprice", "o_orderstatus"), "1998-08-05")


@_register("shipments_from_hash", f"WITH {_SHIP_SQL} SELECT invoice_no, status, dispatched_on, estimated_delivery, delivered_on, days_late::INT AS days_late FROM shipped")
def _shipments(spark, sf_dir):
    return _shipped(spark, sf_dir).select("invoice_no", "status", "dispatched_on", "estimated_delivery", "delivered_on", F.col("days_late").cast("int").alias("days_late"))


@_register("refund_decisions", f"""WITH {_SHIP_SQL}, claims AS (SELECT *, CASE invoice_no::BIGINT % 5 WHEN 0 THEN 'damaged' WHEN 1 THEN 'missing_items' WHEN 2 THEN 'late_delivery' WHEN 3 THEN 'lost_parcel' ELSE 'return_unused' END AS reason,
 o_orderstatus = 'P' AS credit, round(o_totalprice::DECIMAL(14,4), 2)::DECIMAL(14,2) AS goods, CAST(CASE WHEN invoice_no::BIGINT % 3 = 0 THEN 7.5 ELSE 0 END AS DECIMAL(14,2)) AS shipping, round((o_totalprice / 1000)::DECIMAL(14,4), 2)::DECIMAL(14,2) AS claimed FROM shipped),
amounts AS (SELECT *, CASE WHEN credit THEN NULL WHEN reason IN ('damaged', 'missing_items') AND DATE '1998-08-05' - delivered_on <= 14 THEN claimed WHEN reason = 'return_unused' AND DATE '1998-08-05' - delivered_on <= 30 THEN claimed
 WHEN reason = 'late_delivery' AND status = 'delivered_late' THEN CASE WHEN shipping > 0 THEN shipping ELSE least(round((goods * 0.05)::DECIMAL(14,4), 2), 10) END WHEN reason = 'lost_parcel' AND status = 'lost' THEN goods END AS amount0 FROM claims),
final AS (SELECT *, CASE WHEN reason = 'return_unused' THEN amount0 ELSE least(amount0, goods + shipping) END AS amount1 FROM amounts),
ok AS (SELECT *, coalesce(amount1 > 0 OR (reason = 'return_unused' AND amount0 IS NOT NULL), false) AND amount1 IS NOT NULL AS eligible FROM final)
SELECT invoice_no, reason, eligible, CAST(CASE WHEN eligible THEN amount1 ELSE 0 END AS DOUBLE) AS amount, CASE WHEN NOT eligible OR reason = 'return_unused' THEN 'none' WHEN amount1 <= 50 THEN 'agent' ELSE 'supervisor' END AS approval FROM ok""")  # fmt: skip
def _refunds(spark, sf_dir):
    key = F.col("invoice_no").cast("long")
    reason = F.element_at(F.array(*map(F.lit, ("damaged", "missing_items", "late_delivery", "lost_parcel", "return_unused"))), (key % 5 + 1).cast("int"))
    money = lambda c: F.round(c.cast("decimal(14,4)"), 2)
    claims = _shipped(spark, sf_dir).select(
        "invoice_no", reason.alias("reason"), (F.col("o_orderstatus") == "P").alias("is_credit_note"), "status", "delivered_on", "days_late", money(F.col("o_totalprice")).alias("goods_total"),
        F.when(key % 3 == 0, 7.5).otherwise(0.0).alias("shipping_total"), money(F.col("o_totalprice") / 1000).alias("claimed"),
    )
    return rules.refund_decisions(claims, "1998-08-05").select("invoice_no", "reason", "eligible", F.col("amount").cast("double").alias("amount"), "approval")


_RANKED = "r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@_register("nearest_rank_percentiles", f"WITH {_RANKED} SELECT event_type, min(value) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, min(value) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95 FROM r GROUP BY 1")
def _ranks(spark, sf_dir):
    return profile.ranked_values(table(spark, sf_dir, "events"), "event_type", "value", {"p50": C.nearest_rank(0.5), "p95": C.nearest_rank(0.95)})


@_register("floor_rank_percentiles", f"WITH {_RANKED} SELECT event_type, min(value) FILTER (i = least(n - 1, floor(0.95 * n))) AS p95, min(value) FILTER (i = n // 2) AS upper_median FROM r GROUP BY 1")
def _floor(spark, sf_dir):
    return profile.ranked_values(table(spark, sf_dir, "events"), "event_type", "value", {"p95": C.floor_rank(0.95), "upper_median": C.upper_median()})


@_register("median_latency", "SELECT event_type, round(median(value), 6) AS median_value FROM events GROUP BY 1")
def _median(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median_value"))


@_register("hourly_quota", "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def _hourly(spark, sf_dir):
    return rules.quota_counts(table(spark, sf_dir, "events"), "user_id", "ts")


@_register("quota_decisions", "SELECT *, used <= 2 AS allowed, greatest(2 - used, 0) AS remaining FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) AS used FROM events)")
def _quota(spark, sf_dir):
    t = rules.quota_decisions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2)
    return t.select("event_id", F.col("used").cast("long").alias("used"), "allowed", F.col("remaining").cast("long").alias("remaining"))


@_register("budget_running_total", """SELECT event_id, spent, spent + c <= 400 * 0.85 AS admitted FROM (SELECT event_id, c, coalesce(sum(c) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent
 FROM (SELECT *, floor(value)::BIGINT AS c FROM events))""")  # fmt: skip
def _budget(spark, sf_dir):
    t = table(spark, sf_dir, "events").withColumn("c", F.floor("value").cast("long"))
    return rules.budget_decisions(t, "user_id", "ts", "event_id", "c", 400).select("event_id", "spent", "admitted")


@_register("usage_by_type", "SELECT event_type, user_id % 3 AS provider, count(*) AS calls, floor(sum(floor(value)))::BIGINT AS tokens, count(*) FILTER (value > 50) AS slow FROM events GROUP BY 1, 2")
def _usage(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    return t.groupBy("event_type", (F.col("user_id") % 3).alias("provider")).agg(F.count("*").alias("calls"), F.sum(F.floor("value")).cast("long").alias("tokens"), F.count_if(F.col("value") > 50).alias("slow"))


#: Every row whose id is divisible by 100 is a query, against all rows.
_NEAR = """c AS (SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
 near AS (SELECT query, id, s, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, id) AS rank FROM c QUALIFY rank <= 20)"""


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", 20)


@_register("vector_topk", f"WITH {_NEAR} SELECT query, id, round(s, 4) AS similarity, rank FROM near")
def _vector(spark, sf_dir):
    return _nearest(spark, sf_dir).select("query", "id", F.round("similarity", 4).alias("similarity"), F.col("rank").cast("long").alias("rank"))


#: A query's words are the first three of its document that are no stop words; a document with more of them comes first.
_KEYWORDS = """words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), own AS (SELECT doc_id, w, list_filter(w, lambda x: NOT list_contains(STOP, x)) AS o FROM words),
 kept AS (SELECT doc_id, CASE WHEN len(o) > 0 THEN o ELSE w END AS w FROM own), tt AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest(w) AS term FROM kept) GROUP BY 1, 2),
 firsts AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS i FROM kept WHERE doc_id % 100 = 0), seen AS (SELECT doc_id, term, min(i) AS i FROM firsts GROUP BY 1, 2),
 asked AS (SELECT doc_id AS query, term FROM seen QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 3),
 hits AS (SELECT query, id, count(*) AS matched, sum(ln(1 + tf)) AS s FROM asked JOIN tt USING (term) GROUP BY 1, 2),
 fits AS (SELECT h.* FROM hits h JOIN (SELECT query, max(matched) AS best FROM hits GROUP BY 1) USING (query) JOIN (SELECT query, count(*) AS n FROM asked GROUP BY 1) USING (query) WHERE matched = n OR best < n),
 keyword AS (SELECT query, id, round(s / (s + 1), 9) AS score, row_number() OVER (PARTITION BY query ORDER BY round(s / (s + 1), 9) DESC, id) AS rank FROM fits QUALIFY rank <= 20)""".replace("STOP", str(retrieval.STOP_WORDS))  # fmt: skip


def _keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = retrieval.terms(F.col("text"))
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.explode(F.slice(F.array_distinct(words), 1, 3)).alias("term"))
    return retrieval.keyword_rankings(docs, "doc_id", "text", asked, 20)


@_register("keyword_rankings", f"WITH {_KEYWORDS} SELECT query, id, score, rank FROM keyword")
def _keyword_rankings(spark, sf_dir):
    return _keyword(spark, sf_dir).select("query", "id", "score", F.col("rank").cast("long").alias("rank"))


@_register("rrf_hybrid", f"""WITH {_NEAR}, {_KEYWORDS}, fused AS (SELECT query, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query, id, rank FROM near UNION ALL SELECT query, id, rank FROM keyword) GROUP BY 1, 2),
 top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM fused QUALIFY place <= 6)
SELECT top.query, top.id, top.score, round(c.s, 4) AS similarity FROM top LEFT JOIN c ON c.query = top.query AND c.id = top.id""")  # fmt: skip
def _rrf(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    top = retrieval.fuse_top([_nearest(spark, sf_dir), _keyword(spark, sf_dir)], 6)
    return retrieval.with_similarity(top, vectors, "vec_id", "embedding").select("query", "id", "score", "similarity")


_TERMS = """w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
 tt AS (SELECT id, term, count(*) AS tf FROM w WHERE term IN ('tion', 'license', 'ered') GROUP BY 1, 2), h AS (SELECT id, count(*) AS matched, sum(ln(1 + tf)) AS s FROM tt GROUP BY 1)"""


@_register("term_all_any_match", f"WITH {_TERMS} SELECT id, matched, round(s / (s + 1), 9) AS score FROM h WHERE matched = 3 OR (SELECT max(matched) FROM h) < 3 ORDER BY 3 DESC, 1 LIMIT 20")
def _terms(spark, sf_dir):
    query = ["tion", "license", "ered"]
    return retrieval.keyword_search(retrieval.term_table(table(spark, sf_dir, "documents"), "doc_id", "text", only=query), query)


@_register("idf_overlap", f"WITH {_TERMS}, d AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / (1.0 + count(*))) AS w FROM tt GROUP BY 1) SELECT id, round(sum(w) / (SELECT sum(w) FROM d), 6) AS overlap FROM tt JOIN d USING (term) GROUP BY 1")
def _overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return retrieval.overlap_scores(docs.select(F.col("doc_id").alias("id"), retrieval.terms(F.col("text")).alias("words")), ["tion", "license", "ered"], docs.count())


@_register("model_agreement", """WITH h AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: abs(x::DOUBLE)) AS a, list_transform(embedding[17:32], lambda x: abs(x::DOUBLE)) AS b FROM embeddings),
 p AS (SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS a, list_transform(b, lambda x: x / list_sum(b)) AS b FROM h),
 u AS (SELECT vec_id, unnest(range(16)) AS i, unnest(a) AS x, unnest(b) AS y FROM p),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS ra, row_number() OVER (PARTITION BY vec_id ORDER BY y DESC, i) AS rb FROM u),
 v AS (SELECT vec_id, max((ra = 1 AND rb = 1)::INT) AS t, sum((ra <= 5 AND rb <= 5)::INT) / 5 AS o, max(abs(x - y)) AS m, avg(abs(x - y)) AS d, sum(CASE WHEN x > 0 THEN x * ln(x / greatest(y, 1e-12)) ELSE 0 END) AS k,
  max(x) >= 0.2 AS confident, max((ra = 1 AND rb <= 5)::INT) AS f FROM r GROUP BY 1)
SELECT round(avg(t), 6) AS top1, round(avg(t) FILTER (confident), 6) AS confident_top1, round(avg(o), 6) AS top5_overlap, round(avg(f), 6) AS top1_in_top5, round(max(m), 6) AS max_diff, round(avg(d), 6) AS mean_diff, round(avg(k), 6) AS kl FROM v""")  # fmt: skip
def _agreement(spark, sf_dir):
    norm = lambda c: F.transform(c, lambda x: F.abs(x.cast("double")) / F.aggregate(c, F.lit(0.0), lambda s, y: s + F.abs(y.cast("double"))))
    t = table(spark, sf_dir, "embeddings").select(norm(F.slice("embedding", 1, 16)).alias("a"), norm(F.slice("embedding", 17, 16)).alias("b"))
    return retrieval.agreement(t, "a", "b", confident=0.2)


@_register("chunks")
def _chunks(spark, sf_dir):
    return retrieval.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@_register("strip_running_lines", r"""WITH l AS (SELECT lang AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10)))))::INT AS line FROM documents),
 m AS (SELECT *, regexp_replace(lower(text), '[0-9]+', '#', 'g') AS t FROM l), p AS (SELECT doc, count(DISTINCT page) AS pages FROM l GROUP BY 1),
 r AS (SELECT m.doc, t FROM m JOIN p ON m.doc = p.doc GROUP BY m.doc, t, pages HAVING pages >= 3 AND count(DISTINCT page) >= 0.02 * pages)
SELECT doc, page, line, text FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc = m.doc AND r.t = m.t)""")  # fmt: skip
def _running(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumnRenamed("lang", "doc")
    return retrieval.strip_running_lines(lines, 0.02)


@_register("accuracy_by_split_grouping_sets", """WITH r AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'held_out' ELSE 'dev' END AS split, lang AS variant, quality = 1 AS exact, toxic = 1 AS flagged FROM labels JOIN documents USING (doc_id))
SELECT split, variant, count(*) AS n, round(100 * avg(exact::INT), 2) AS exact_pct, count(*) FILTER (flagged) AS flagged, count(*) FILTER (flagged AND NOT exact) AS caught, count(*) FILTER (NOT flagged AND NOT exact) AS silently_wrong
FROM r GROUP BY GROUPING SETS ((), (split, variant), (variant))""")  # fmt: skip
def _accuracy(spark, sf_dir):
    r = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    r = r.select(F.when(F.col("doc_id") % 3 == 0, "held_out").otherwise("dev").alias("split"), F.col("lang").alias("variant"), (F.col("quality") == 1).alias("exact"), (F.col("toxic") == 1).alias("flagged"))
    return retrieval.accuracy(r)


@_register("invoice_checks", """WITH l AS (SELECT l_orderkey AS number, count(*) FILTER (abs(l_quantity * p_retailprice - l_extendedprice) > 0.005) AS wrong, sum(l_extendedprice) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT o_orderkey AS number, coalesce(wrong, 0) = 0 AS lines_ok, coalesce(abs(o_totalprice - s) <= 0.005, false) AS total_ok, true AS header_ok, true AS sign_ok FROM orders LEFT JOIN l ON number = o_orderkey""")  # fmt: skip
def _invoices(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("number"), F.col("l_quantity").alias("quantity"), F.col("p_retailprice").alias("unit_price"), F.col("l_extendedprice").alias("amount"))
    headers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), F.col("o_orderdate").alias("issued"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("total"), F.lit(False).alias("credit_note"))
    return retrieval.invoice_checks(lines, headers)


@_register("set_difference", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@_register("page_of_offset", "SELECT page_id, len(list_filter([0, 500, 1000, 2000], lambda s: s <= length(html) // 2)) AS page FROM pages")
def _page_of(spark, sf_dir):
    starts = F.array(*map(F.lit, (0, 500, 1000, 2000)))
    return table(spark, sf_dir, "pages").select("page_id", retrieval.page_of(starts, F.floor(F.length("html") / 2)).cast("long").alias("page"))


@_register("content_fingerprint", """WITH h AS (SELECT sha256(concat_ws(chr(31), c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_mktsegment)) AS h FROM customer),
 p AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 12))::BIGINT) AS a, sum(('0x' || substr(h, 13, 12))::BIGINT) AS b, sum(('0x' || substr(h, 25, 12))::BIGINT) AS c FROM h)
SELECT n AS n_rows, sha256(concat_ws(':', n::VARCHAR, a::VARCHAR, b::VARCHAR, c::VARCHAR)) AS digest FROM p""")  # fmt: skip
def _fingerprint(spark, sf_dir):
    return profile.content_fingerprint(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


from sparkloom import query_sets  # noqa: E402, F401  (registers the others)
