"""Queries about a customer's orders, refunds to authorise, eligible documents and samples of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import orders, rules
from sparkloom.registry import register
from sparkloom.session import dealt, table

_LINES = """li AS (SELECT CASE WHEN l_orderkey % 9 = 0 THEN 'C' ELSE '' END || l_orderkey::VARCHAR AS invoice_no, CASE WHEN l_partkey % 23 = 0 THEN 'POST' WHEN l_partkey % 29 = 0 THEN 'M' WHEN l_partkey % 31 = 0 THEN 'gift_0001' ELSE 'p' || l_partkey::VARCHAR END AS stock_code,
 CASE WHEN l_partkey % 37 = 0 THEN 'Next Day Carriage' ELSE p_name END AS description, l_quantity::BIGINT AS quantity, round(p_retailprice::DECIMAL(12, 4), 2)::DECIMAL(12, 2) AS unit_price, o_orderdate AS invoiced_at, o_custkey AS customer_id, n_name AS country,
 l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
line AS (SELECT *, quantity * unit_price AS line_total, CASE WHEN stock_code IN ('POST', 'DOT', 'C2') OR lower(description) = 'next day carriage' THEN 'shipping' WHEN stock_code IN ('M', 'TEST001') OR starts_with(stock_code, 'gift_') THEN 'other' ELSE 'product' END AS kind,
 row_number() OVER (PARTITION BY invoice_no ORDER BY stock_code, description, quantity, unit_price, l_linenumber, l_suppkey, l_extendedprice) AS line_no FROM li),
inv AS (SELECT invoice_no, min(invoiced_at) AS invoiced_at, min(customer_id) AS customer_id, min(country) AS country, count(*) AS lines, sum(quantity) FILTER (kind = 'product')::BIGINT AS units, coalesce(sum(line_total) FILTER (kind = 'product'), 0) AS goods_total,
 coalesce(sum(line_total) FILTER (kind = 'shipping'), 0) AS shipping_total, sum(line_total) AS total, starts_with(invoice_no, 'C') AS is_credit_note FROM line GROUP BY invoice_no)"""


def _lines(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    part = F.col("l_partkey")
    code = F.when(part % 23 == 0, "POST").when(part % 29 == 0, "M").when(part % 31 == 0, "gift_0001").otherwise(F.concat(F.lit("p"), part.cast("string")))
    held = joined.select(
        F.concat(F.when(F.col("l_orderkey") % 9 == 0, "C").otherwise(""), F.col("l_orderkey").cast("string")).alias("invoice_no"), code.alias("stock_code"), F.when(part % 37 == 0, "Next Day Carriage").otherwise(F.col("p_name")).alias("description"),
        F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("p_retailprice").cast("decimal(12,4)"), 2).cast("decimal(12,2)").alias("unit_price"), F.col("o_orderdate").alias("invoiced_at"), F.col("o_custkey").alias("customer_id"),
        F.col("n_name").alias("country"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
    )
    held = held.withColumn("line_total", F.col("quantity").cast("decimal(10,0)") * F.col("unit_price")).withColumn("kind", orders.line_kind(F.col("stock_code"), F.col("description")))
    return rules.number_lines(held, "invoice_no", ["stock_code", "description", "quantity", "unit_price", "l_linenumber", "l_suppkey", "l_extendedprice"])


@register("line_kinds", f"WITH {_LINES} SELECT kind, count(*) AS n, sum(line_total)::DOUBLE AS total FROM line GROUP BY 1")
def _kinds(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.sum("line_total").cast("double").alias("total"))


@register("invoice_rollup", f"WITH {_LINES} SELECT invoice_no, invoiced_at, customer_id, country, lines, units, goods_total::DOUBLE AS goods_total, shipping_total::DOUBLE AS shipping_total, total::DOUBLE AS total, is_credit_note FROM inv")
def _invoices(spark, sf_dir):
    return orders.invoices(_lines(spark, sf_dir)).withColumns({c: F.col(c).cast("double") for c in ("goods_total", "shipping_total", "total")})


@register("latest_invoices", f"WITH {_LINES} SELECT customer_id, invoice_no, place FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY invoiced_at DESC, invoice_no DESC) AS place FROM inv WHERE invoiced_at < TIMESTAMP '1997-06-01') WHERE place <= 3")
def _latest(spark, sf_dir):
    return orders.latest_invoices(orders.invoices(_lines(spark, sf_dir)), 3, "1997-06-01").select("customer_id", "invoice_no", F.col("place").cast("long").alias("place"))


@register("own_invoices", f"WITH {_LINES} SELECT customer_id, count(*) AS n FROM inv WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND invoiced_at < TIMESTAMP '1996-01-01' GROUP BY 1")
def _own(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("customer_id"))
    return orders.own_invoices(orders.invoices(_lines(spark, sf_dir)), owners, "1996-01-01").groupBy("customer_id").agg(F.count("*").alias("n"))


@register("customer_cards", f"""WITH {_LINES}, r AS (SELECT customer_id, string_agg(invoice_no, ',' ORDER BY place) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY invoiced_at DESC, invoice_no DESC) AS place FROM inv) WHERE place <= 5 GROUP BY 1)
SELECT customer_id, min(country) AS country, count(*) AS invoices, min(invoiced_at) AS first_order, max(invoiced_at) AS last_order, min(recent) AS recent FROM inv JOIN r USING (customer_id) WHERE NOT is_credit_note GROUP BY 1""")  # fmt: skip
def _cards(spark, sf_dir):
    return orders.customer_cards(orders.invoices(_lines(spark, sf_dir))).withColumn("recent", F.array_join(F.transform("recent", lambda r: r["invoice_no"]), ","))


@register("invoice_views", f"""WITH {_LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY invoice_no, kind ORDER BY line_no) AS p FROM line)
SELECT invoice_no, coalesce(string_agg(stock_code, ',' ORDER BY line_no) FILTER (kind = 'product' AND p <= 3), '') AS products, greatest(count(*) FILTER (kind = 'product') - 3, 0) AS more_products, count(*) FILTER (kind <> 'product') AS other_lines FROM n GROUP BY 1""")  # fmt: skip
def _views(spark, sf_dir):
    v = orders.invoice_views(_lines(spark, sf_dir), 3)
    return v.select("invoice_no", F.array_join(F.transform("products", lambda p: p["stock_code"]), ",").alias("products"), "more_products", F.size("other_lines").cast("long").alias("other_lines"))


@register("selected_items", f"""WITH {_LINES}, items AS (SELECT invoice_no, CASE WHEN l_partkey % 5 = 0 THEN 'P0x' ELSE upper(stock_code) || ' ' END AS stock_code, CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 60 END::BIGINT AS quantity FROM line WHERE line_no = 1),
 f AS (SELECT invoice_no, upper(stock_code) AS code, arg_min(quantity, line_no) AS held, arg_min(unit_price, line_no) AS price FROM line WHERE kind = 'product' AND quantity > 0 GROUP BY 1, 2),
 m AS (SELECT i.*, held, price, coalesce(i.quantity, held) AS taken FROM items i LEFT JOIN f ON f.invoice_no = i.invoice_no AND f.code = upper(trim(i.stock_code))),
 p AS (SELECT *, CASE WHEN held IS NULL THEN 'not_on_invoice' WHEN taken <= 0 THEN 'no_quantity' WHEN taken > held THEN 'more_than_bought' END AS problem FROM m)
SELECT invoice_no, stock_code, quantity, problem, CASE WHEN problem IS NULL THEN (price * taken)::DOUBLE END AS amount, CASE WHEN problem IS NULL THEN price * held >= 15 END AS return_needed FROM p""")  # fmt: skip
def _items(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    k = F.col("l_partkey")
    items = lines.where("line_no = 1").select("invoice_no", F.when(k % 5 == 0, "P0x").otherwise(F.concat(F.upper("stock_code"), F.lit(" "))).alias("stock_code"), F.when(k % 4 == 1, 1).when(k % 4 == 2, 0).when(k % 4 == 3, 60).cast("long").alias("quantity"))
    return orders.selected_items(lines, items).withColumn("amount", F.col("amount").cast("double"))


@register("authorised_refunds", """WITH d AS (SELECT o_orderkey AS invoice_no, 'damaged' AS reason, o_orderkey % 4 <> 0 AS eligible, round((o_totalprice / 1000)::DECIMAL(14, 4), 2)::DECIMAL(14, 2) AS due, CASE o_orderkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'agent' ELSE 'supervisor' END AS approval FROM orders),
 r AS (SELECT l_orderkey * 10 + l_linenumber AS request_id, l_orderkey AS invoice_no, CASE WHEN l_linenumber = 5 THEN 'late' ELSE 'damaged' END AS reason, due + CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END AS amount FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN d ON invoice_no = l_orderkey),
 n AS (SELECT r.request_id, r.invoice_no, r.reason, CASE WHEN d.eligible IS NULL THEN 'not_calculated' WHEN NOT d.eligible THEN 'not_eligible' WHEN approval = 'none' THEN 'refunded_on_return' WHEN abs(due - amount) > 0.005 THEN 'another_amount' END AS no, approval FROM r LEFT JOIN d ON d.invoice_no = r.invoice_no AND d.reason = r.reason),
 t AS (SELECT *, row_number() OVER (PARTITION BY invoice_no, reason, no IS NULL ORDER BY request_id) AS t FROM n)
SELECT request_id, coalesce(no, CASE WHEN t > 1 THEN 'already_requested' END, CASE approval WHEN 'agent' THEN 'approved' ELSE 'pending_supervisor' END) AS status FROM t""")  # fmt: skip
def _authorised(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    due = F.round((F.col("o_totalprice") / 1000).cast("decimal(14,4)"), 2).cast("decimal(14,2)")
    d = o.select(key.alias("invoice_no"), F.lit("damaged").alias("reason"), (key % 4 != 0).alias("eligible"), due.alias("amount"), F.when(key % 3 == 0, "none").when(key % 3 == 1, "agent").otherwise("supervisor").alias("approval"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().join(d.select("invoice_no", "amount"), F.col("l_orderkey") == F.col("invoice_no"))
    r = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), "invoice_no", F.when(F.col("l_linenumber") == 5, "late").otherwise("damaged").alias("reason"), (F.col("amount") + F.when(F.col("l_linenumber") == 2, 1).otherwise(0)).alias("amount"))
    return orders.authorised(r, d).select("request_id", "status")


@register("known_events", "SELECT user_id, count(*) AS n FROM events WHERE ts::DATE <= DATE '2024-01-15' GROUP BY 1 UNION ALL SELECT user_id, 0 FROM events GROUP BY 1 HAVING min(ts)::DATE > DATE '2024-01-15'")
def _events(spark, sf_dir):
    held = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("ts").alias("at"), "event_type")).alias("events"))  # a user's events
    return orders.known_events(held, "events", "at", "2024-01-15").select("user_id", F.size("events").cast("long").alias("n"))


_DOCUMENTS = """dl AS (SELECT CASE WHEN l_orderkey % 11 = 0 THEN 'X' ELSE '' END || lpad(l_orderkey::VARCHAR, 6, '0') AS invoice, CASE WHEN l_partkey % 97 = 0 THEN 'ODD' WHEN l_partkey % 53 = 0 THEN 'POST' ELSE lpad((l_partkey % 100000)::VARCHAR, 5, '0') END AS stock_code,
 CASE WHEN l_partkey % 89 = 0 THEN ' ' ELSE p_name END AS description, CASE WHEN l_partkey % 83 = 0 THEN 0 WHEN l_partkey % 79 = 0 THEN 1.005 ELSE round(p_retailprice, 2) END AS price, o_orderdate AS invoice_date,
 CASE WHEN o_custkey % 13 = 0 THEN NULL WHEN l_partkey % 101 = 0 THEN NULL ELSE o_custkey END AS customer_id, o_orderpriority AS country FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
per AS (SELECT invoice, count(DISTINCT invoice_date) AS dates, count(DISTINCT customer_id) AS customers, count(*) FILTER (customer_id IS NULL) AS nameless, count(DISTINCT country) AS countries, count(*) FILTER (NOT regexp_full_match(stock_code, '[0-9]{5}[A-Za-z]{0,2}') AND stock_code NOT IN ('POST')) AS odd,
 count(*) FILTER (round(price * 100, 6) % 1 <> 0 OR price <= 0) AS priced, count(*) FILTER (trim(description) = '') AS blank, count(*) AS lines FROM dl GROUP BY 1),
ok AS (SELECT invoice, lines FROM per WHERE dates = 1 AND ((customers = 1 AND nameless = 0) OR (customers = 0 AND nameless = lines)) AND countries = 1 AND odd = 0 AND priced = 0 AND blank = 0 AND lines <= 60 AND regexp_full_match(invoice, 'C?[0-9]{6}'))"""


def _eligible(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    p, key = F.col("l_partkey"), F.col("l_orderkey").cast("string")
    return orders.eligible_invoices(joined.select(
        F.concat(F.when(F.col("l_orderkey") % 11 == 0, "X").otherwise(""), F.lpad(key, 6, "0")).alias("invoice"), F.when(p % 97 == 0, "ODD").when(p % 53 == 0, "POST").otherwise(F.lpad((p % 100000).cast("string"), 5, "0")).alias("stock_code"),
        F.when(p % 89 == 0, " ").otherwise(F.col("p_name")).alias("description"), F.when(p % 83 == 0, 0.0).when(p % 79 == 0, 1.005).otherwise(F.round("p_retailprice", 2)).alias("price"), F.col("o_orderdate").alias("invoice_date"),
        F.when((F.col("o_custkey") % 13 != 0) & (p % 101 != 0), F.col("o_custkey")).alias("customer_id"), F.col("o_orderpriority").alias("country"),
    ))


@register("eligible_invoices", f"WITH {_DOCUMENTS} SELECT * FROM ok")
def _ok(spark, sf_dir):
    return _eligible(spark, sf_dir)


@register("stratified_sample", f"""WITH {_DOCUMENTS}, b AS (SELECT *, CASE WHEN lines BETWEEN 1 AND 2 THEN 0 WHEN lines BETWEEN 3 AND 5 THEN 1 WHEN lines BETWEEN 6 AND 60 THEN 2 END AS band FROM ok),
 r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('7-' || invoice), invoice) AS r, [20, 15, 10][band + 1] AS n FROM b WHERE band IS NOT NULL)
SELECT invoice, lines, band, CASE WHEN r <= n THEN 'dev' ELSE 'held_out' END AS split FROM r WHERE r <= 2 * n""")  # fmt: skip
def _sample(spark, sf_dir):
    return orders.stratified_sample(_eligible(spark, sf_dir), "invoice", "lines", [(1, 2, 20), (3, 5, 15), (6, 60, 10)], 7)


@register("alternating_split", "SELECT c_custkey, CASE WHEN (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) % 2 = 0 THEN 'dev' ELSE 'held_out' END AS split FROM customer")
def _split(spark, sf_dir):
    return orders.alternating_split(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_custkey"]).select("c_custkey", "split")


@register("matched_products", """WITH o AS (SELECT DISTINCT l_orderkey AS text_id, l_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey), c AS (SELECT text_id, l_partkey AS clause, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey % 7 END AS quantity, unnest(list_distinct(string_split('two ' || p_name, ' '))) AS word FROM o),
 p AS (SELECT text_id, l_partkey AS product_id, 4 AS held, unnest(list_distinct(string_split(p_name, ' '))) AS word FROM o), s AS (SELECT text_id, clause, product_id, count(*) AS n, min(quantity) AS quantity, min(held) AS held FROM c JOIN p USING (text_id, word) GROUP BY 1, 2, 3),
 t AS (SELECT *, max(n) OVER (PARTITION BY text_id, clause) AS best FROM s), u AS (SELECT *, count(*) OVER (PARTITION BY text_id, clause) AS k FROM t WHERE n = best) SELECT text_id, clause, product_id, CASE WHEN quantity IS NOT NULL THEN least(quantity, held) END AS quantity FROM u WHERE k = 1""")  # fmt: skip
def _matched(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    named = lines.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("text_id"), "l_partkey", "p_name")
    o = dealt(named, lines, "text_id").distinct()
    clauses = o.select("text_id", F.col("l_partkey").alias("clause"), F.split(F.concat(F.lit("two "), F.col("p_name")), " ").alias("words"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey") % 7).alias("quantity"))
    products = o.select("text_id", F.col("l_partkey").alias("product_id"), F.split("p_name", " ").alias("words"), F.lit(4).cast("long").alias("held"))
    return orders.matched_products(clauses, products)


@register("scenario_problems", """SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'wrong_refund' END, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 'refund_not_due' END,
 CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 5 = 0 THEN 'request_not_due' END, CASE WHEN o_orderkey % 7 = 0 THEN 'no_reply' END, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'no_ticket:1-URGENT' END, CASE WHEN o_orderkey % 7 = 0 OR o_orderstatus <> 'F' THEN 'unsaid:F!' END, CASE WHEN o_orderstatus <> 'O' THEN 'unused:O' END], lambda x: x IS NOT NULL), ',') AS problems FROM orders""")  # fmt: skip
def _scenarios(spark, sf_dir):
    key = F.col("o_orderkey")
    some = lambda test, v: F.array_compact(F.array(F.when(test, v)))
    s = table(spark, sf_dir, "orders").select(
        key.alias("id"), F.when(key % 2 == 0, "r").alias("wanted"), some(key % 3 == 0, "r").alias("refunds"), some(key % 5 == 0, "r").alias("requests"), F.array(F.lit("1-URGENT")).alias("tickets_wanted"), F.array("o_orderpriority").alias("tickets"),
        F.array(F.lit("F!")).alias("mentions"), F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("it is "), F.lower("o_orderstatus"), F.lit("!"))).alias("reply"), F.array(F.lit("O")).alias("tools_wanted"), F.array("o_orderstatus").alias("tools"),
    )
    return orders.scenario_problems(s).select("id", F.array_join("problems", ",").alias("problems"))


@register("ranked_choices", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment DESC, c_acctbal DESC, c_custkey) AS place FROM customer")
def _ranked(spark, sf_dir):
    return orders.ranked_choices(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_mktsegment"), F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_custkey", F.col("place").cast("long").alias("place"))


_DELIVERED = """d AS (SELECT l_orderkey AS invoice, 'p' || l_partkey AS stock_code, CASE WHEN l_partkey % 19 = 0 THEN NULL WHEN l_partkey % 37 = 0 THEN 'Next Day Carriage' ELSE p_name END AS description, l_quantity::BIGINT AS quantity, o_orderdate AS invoice_date,
 round(p_retailprice, 2) AS price, CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE o_custkey END AS customer_id, o_orderstatus AS country FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
 e AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE invoice % 3 = 0 UNION ALL SELECT * REPLACE (quantity + 1 AS quantity) FROM d WHERE invoice % 5 = 0),
 k AS (SELECT DISTINCT * FROM e WHERE customer_id IS NOT NULL)"""


@register("known_order_lines", f"""WITH {_DELIVERED} SELECT invoice AS invoice_no, row_number() OVER (PARTITION BY invoice ORDER BY stock_code NULLS LAST, description NULLS LAST, quantity NULLS LAST, price NULLS LAST, invoice_date NULLS LAST, customer_id, country NULLS LAST) AS line_no, stock_code,
 coalesce(description, '') AS description, quantity, price AS unit_price, round(quantity * price, 2) AS line_total, invoice_date AS invoiced_at, customer_id, country, CASE WHEN lower(description) = 'next day carriage' THEN 'shipping' ELSE 'product' END AS kind FROM k""")  # fmt: skip
def _known(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    description = F.when(F.col("l_partkey") % 19 != 0, F.when(F.col("l_partkey") % 37 == 0, "Next Day Carriage").otherwise(F.col("p_name")))
    rows = joined.select(
        F.col("l_orderkey").alias("invoice"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("stock_code"), description.alias("description"), F.col("l_quantity").cast("long").alias("quantity"), F.col("o_orderdate").alias("invoice_date"),
        F.round("p_retailprice", 2).alias("price"), F.when(F.col("o_custkey") % 6 != 0, F.col("o_custkey")).alias("customer_id"), F.col("o_orderstatus").alias("country"),
    )
    # lines that were delivered again, and some of them with a line of another quantity, from one scan
    key = F.col("invoice")
    copies = F.array_compact(F.array(F.lit(0), F.when(key % 3 == 0, 0), F.when(key % 5 == 0, 1)))
    again = rows.select("*", F.explode(copies).alias("_more")).withColumn("quantity", F.col("quantity") + F.col("_more")).drop("_more")
    found = orders.known_lines(again, t("lineitem"))
    return found.withColumns({"line_no": F.col("line_no").cast("long"), "quantity": F.col("quantity").cast("long"), "unit_price": F.col("unit_price").cast("double"), "line_total": F.col("line_total").cast("double")})
