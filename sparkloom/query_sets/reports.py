"""Queries over published tables, runs, usage and quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.operators import warehouse
from sparkloom.registry import register
from sparkloom.session import table

_WAREHOUSE = """i AS (SELECT o_orderkey AS invoice_no, CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE o_custkey END AS customer_id, strftime(o_orderdate, '%Y-%m') AS drop_key FROM orders WHERE month(o_orderdate) NOT IN (4, 8)),
 pub AS (SELECT * FROM i WHERE invoice_no % 50 <> 0 OR drop_key < '1996'), l AS (SELECT drop_key, invoice_no FROM lineitem JOIN i ON l_orderkey = invoice_no WHERE l_orderkey % 997 <> 5), k AS (SELECT c_custkey FROM customer WHERE c_custkey % 40 <> 0),
 w AS (SELECT drop_key, count(*) AS wanted FROM lineitem JOIN i ON l_orderkey = invoice_no GROUP BY 1)"""


def _published(spark, sf_dir):
    i = table(spark, sf_dir, "orders").where("month(o_orderdate) not in (4, 8)").select(F.col("o_orderkey").alias("invoice_no"), F.when(F.col("o_custkey") % 17 != 0, F.col("o_custkey")).alias("customer_id"), F.date_format("o_orderdate", "yyyy-MM").alias("drop_key"))
    every = table(spark, sf_dir, "lineitem").join(i, F.col("l_orderkey") == F.col("invoice_no")).select("drop_key", "invoice_no")
    customers = table(spark, sf_dir, "customer").where("c_custkey % 40 <> 0").select(F.col("c_custkey").alias("customer_id"))
    return every.where("invoice_no % 997 <> 5"), i.where("invoice_no % 50 <> 0 or drop_key < '1996'"), customers, every.groupBy("drop_key").agg(F.count("*").alias("lines"))


@register("warehouse_checks", f"""WITH {_WAREHOUSE}, p AS (SELECT drop_key, wanted, lag(drop_key) OVER (ORDER BY drop_key) AS prev, (SELECT count(*) FROM l WHERE l.drop_key = w.drop_key) AS loaded,
 (SELECT count(*) FROM l WHERE l.drop_key = w.drop_key AND invoice_no NOT IN (SELECT invoice_no FROM pub)) + (SELECT count(*) FROM pub WHERE pub.drop_key = w.drop_key AND customer_id IS NOT NULL AND customer_id NOT IN (SELECT c_custkey FROM k)) AS orphans FROM w)
SELECT drop_key, 'load_reconciliation' AS name, 'gate' AS severity, loaded >= wanted AS passed, loaded::DOUBLE AS value FROM p UNION ALL SELECT drop_key, 'warehouse_orphans', 'warn', orphans = 0, orphans::DOUBLE FROM p
UNION ALL SELECT drop_key, 'drop_sequence', 'info', drop_key <= strftime((prev || '-01')::DATE + INTERVAL 1 MONTH, '%Y-%m'), NULL FROM p WHERE prev IS NOT NULL""")  # fmt: skip
def _checks(spark, sf_dir):
    return warehouse.warehouse_checks(*_published(spark, sf_dir))


@register("staged_reconciliation", "SELECT count(DISTINCT l_orderkey) AS staged, count(DISTINCT l_orderkey) FILTER (l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)) AS found, count(DISTINCT l_orderkey) = count(DISTINCT l_orderkey) FILTER (l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)) AS passed FROM lineitem")
def _reconciliation(spark, sf_dir):
    staged = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line_key"))
    return warehouse.reconciled(staged, table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("line_key")))


@register("warehouse_summary", "SELECT (SELECT count(*) FROM lineitem) AS lines, (SELECT count(*) FROM orders) AS invoices, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM part) AS products, (SELECT round(coalesce(sum(l_extendedprice), 0), 2) FROM lineitem) AS revenue")
def _summary(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    count = F.count("*")
    return warehouse.totals(lines=(t("lineitem"), count), invoices=(t("orders"), count), customers=(t("customer"), count), products=(t("part"), count), revenue=(t("lineitem"), F.round(F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)), 2)))


@register("load_status", """WITH d AS (SELECT strftime(o_orderdate, '%Y-%m') AS drop_key, count(*) AS rows FROM orders GROUP BY 1), l AS (SELECT strftime(o_orderdate, '%Y-%m') AS drop_key, o_orderdate AS moment FROM orders WHERE o_orderkey % 400 = 3)
SELECT d.drop_key, rows, first_loaded_at, coalesce(n, 0) AS times_processed, n IS NOT NULL AS loaded FROM d LEFT JOIN (SELECT drop_key, min(moment) AS first_loaded_at, count(*) AS n FROM l GROUP BY 1) x USING (drop_key)""")  # fmt: skip
def _load_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("drop_key", F.date_format("o_orderdate", "yyyy-MM"))
    loads = o.where("o_orderkey % 400 = 3").select("drop_key", F.col("o_orderdate").alias("at"))
    return warehouse.load_status(o.groupBy("drop_key").agg(F.count("*").alias("rows")), loads)


@register("labelled_reasons", "SELECT o_orderpriority AS reason, count(*) AS n, o_orderpriority AS label FROM orders GROUP BY 1 UNION ALL SELECT 'bad_date', 3, 'No readable date' UNION ALL SELECT 'duplicate_line', 2, 'Row given before'")
def _reasons(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("reason")).agg(F.count("*").alias("n"))
    return warehouse.labelled_reasons(counts.unionByName(spark.createDataFrame([("bad_date", 3), ("duplicate_line", 2)], "reason string, n long")))


@register("previous_drop", "WITH d AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS drop_key FROM orders WHERE month(o_orderdate) % 5 <> 0), p AS (SELECT drop_key, lag(drop_key) OVER (ORDER BY drop_key) AS previous_drop FROM d) SELECT *, coalesce(drop_key <= strftime((previous_drop || '-01')::DATE + INTERVAL 1 MONTH, '%Y-%m'), true) AS in_sequence FROM p")
def _previous(spark, sf_dir):
    return warehouse.drop_sequence(table(spark, sf_dir, "orders").where("month(o_orderdate) % 5 <> 0").select(F.date_format("o_orderdate", "yyyy-MM").alias("drop_key")))


@register("next_turn", "WITH d AS (SELECT user_id::VARCHAR AS drop_key, max(ts) FILTER (event_type <> 'error') AS moment FROM events GROUP BY 1) SELECT min_by(drop_key, (coalesce(moment, TIMESTAMP '0001-01-01'), drop_key)) AS least, max_by(drop_key, (coalesce(moment, TIMESTAMP '0001-01-01'), drop_key)) AS most FROM d")
def _turn(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("drop_key")).agg(F.max(F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp_ntz"))).alias("processed_at"))
    return warehouse.turn_of(d).withColumnRenamed("drop_key", "least").crossJoin(warehouse.turn_of(d, least=False).withColumnRenamed("drop_key", "most"))


@register("recent_runs", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM (SELECT * FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 30)")
def _recent(spark, sf_dir):
    from pyspark.sql.window import Window

    runs = warehouse.recent_runs(table(spark, sf_dir, "events"), "ts", "event_id", 30, pending=F.col("event_type") == "view")
    return runs.select("event_id", F.row_number().over(Window.orderBy("ts", "event_id")).cast("long").alias("place"))  # 30 rows


@register("failures_by_user", "SELECT user_id, count(*) AS runs, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 0)::BIGINT AS failed FROM events GROUP BY 1")
def _failures(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("runs"), F.coalesce(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)), F.lit(0)).alias("failed"))


@register("latest_by_label", "SELECT event_type AS label, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _latest(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).orderBy("label")


_RUNS = "r AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'queued' ELSE 'succeeded' END AS status, ts AS started_at FROM events)"


def _runs(spark, sf_dir):
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "queued").otherwise("succeeded")
    return table(spark, sf_dir, "events").select("event_id", "user_id", status.alias("status"), F.col("ts").cast("timestamp_ntz").alias("started_at"))


@register("expired_runs", f"WITH {_RUNS}, e AS (SELECT status = 'running' AND started_at < TIMESTAMP '2024-01-20' - INTERVAL 6 HOUR AS expired, status FROM r) SELECT CASE WHEN expired THEN 'failed' ELSE status END AS status, expired, count(*) AS n FROM e GROUP BY 1, 2")
def _expired(spark, sf_dir):
    return warehouse.expire_runs(_runs(spark, sf_dir), "2024-01-20", 6).groupBy("status", "expired").agg(F.count("*").alias("n"))


@register("queue_depth", f"WITH {_RUNS} SELECT status, count(*) AS n FROM r WHERE status IN ('queued', 'running') GROUP BY 1")
def _depth(spark, sf_dir):
    return _runs(spark, sf_dir).where(F.col("status").isin("queued", "running")).groupBy("status").agg(F.count("*").alias("n"))


@register("swept_jobs", f"WITH {_RUNS} SELECT CASE WHEN status IN ('queued', 'running') AND started_at + INTERVAL 5 MINUTE < TIMESTAMP '2024-01-20' - INTERVAL 15 MINUTE THEN 'failed' ELSE status END AS status, count(*) AS n FROM r WHERE started_at >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY GROUP BY 1")
def _swept(spark, sf_dir):
    jobs = _runs(spark, sf_dir).select("status", F.col("started_at").alias("created_at"), (F.col("started_at") + F.expr("INTERVAL 5 MINUTES")).alias("updated_at"))
    return warehouse.swept(jobs, "2024-01-20", 7, 15).groupBy("status").agg(F.count("*").alias("n"))


@register("retained_messages", "SELECT event_type, count(*) AS n, min(ts) AS oldest FROM events WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 12 DAY GROUP BY 1")
def _retained(spark, sf_dir):
    return warehouse.retained(table(spark, sf_dir, "events"), "2024-01-25", "ts", 12).groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


@register("purged_counters", "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) >= TIMESTAMP '2024-01-20'")
def _counters(spark, sf_dir):
    from sparkloom.operators import rules

    return rules.quota_counts(table(spark, sf_dir, "events"), "user_id", "ts").where(F.col("window_start") >= F.lit("2024-01-20").cast("timestamp"))


@register("worst_state", "SELECT user_id, ['ok', 'degraded', 'down'][max(CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 2 ELSE 1 END)] AS state FROM events GROUP BY 1")
def _worst(spark, sf_dir):
    state = F.when(F.col("event_type") == "error", "down").when(F.col("event_type") == "click", "degraded").otherwise("ok")
    return warehouse.worst_state(table(spark, sf_dir, "events").select("user_id", state.alias("state")), ["user_id"])


@register("usage_pivot", "SELECT event_type AS status, count(*) FILTER (user_id % 2 = 0) AS model, count(*) FILTER (user_id % 2 = 1) AS rules, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS retries FROM events GROUP BY 1")
def _usage(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), F.when(F.col("user_id") % 2 == 0, "model").otherwise("rules").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("retries"))
    return warehouse.usage_by_status(calls, "status", "kind", "retries")


@register("spent_since", "SELECT user_id, coalesce(sum(floor(value)::BIGINT) FILTER (ts >= TIMESTAMP '2024-01-28'), 0)::BIGINT AS spent FROM events GROUP BY 1")
def _spent(spark, sf_dir):
    return warehouse.spent_since(table(spark, sf_dir, "events").withColumn("c", F.floor("value").cast("long")), "2024-01-28", "ts", "c", ["user_id"])


@register("composite_quota", """WITH u AS (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) AS used_hour, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS used_day FROM events),
 w AS (SELECT *, CASE WHEN used_hour > 1 THEN floor(epoch(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR)) - floor(epoch(ts)) END AS h, CASE WHEN used_day > 2 THEN floor(epoch(date_trunc('day', ts) + INTERVAL 1 DAY)) - floor(epoch(ts)) END AS d FROM u)
SELECT event_id, used_hour, used_day, h IS NULL AND d IS NULL AS allowed, greatest(h, d)::BIGINT AS retry_after FROM w""")  # fmt: skip
def _composite(spark, sf_dir):
    q = warehouse.composite_quota(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 1, 2)
    return q.select("event_id", F.col("used_hour").cast("long").alias("used_hour"), F.col("used_day").cast("long").alias("used_day"), "allowed", "retry_after")


@register("month_keys", "SELECT o_orderkey, last_day(o_orderdate) AS month_end, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m') AS next_month, strftime(o_orderdate + INTERVAL 55 MINUTE, '%m/%d/%Y ') || ltrim(strftime(o_orderdate + INTERVAL 55 MINUTE, '%I:%M %p'), '0') AS us_date FROM orders")
def _months(spark, sf_dir):
    month = F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.month_end(month).alias("month_end"), C.next_month(month).alias("next_month"), C.us_date(F.col("o_orderdate") + F.expr("INTERVAL 55 MINUTES")).alias("us_date"))


_PRINTED = ("%d/%m/%Y", "%Y-%m-%d", "%d %B %Y", "%d %b %Y", "%d.%m.%Y", "%d-%b-%Y")


@register("printed_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 6 THEN o_orderdate::DATE + CASE WHEN o_orderkey % 16 >= 8 THEN INTERVAL 495 MINUTE ELSE INTERVAL 0 MINUTE END END AS printed FROM orders")
def _printed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.coalesce(*[F.when(F.col("o_orderkey") % 8 == i, F.date_format("o_orderdate", f)) for i, f in enumerate(("dd/MM/yyyy", "yyyy-MM-dd", "d MMMM yyyy", "dd MMM yyyy", "d.M.yyyy", "d-MMM-yyyy"))], F.lit("32/13/1996"))
    text = F.concat(F.lit("  "), day, F.when(F.col("o_orderkey") % 16 >= 8, "  8:15").otherwise(""))
    return o.select("o_orderkey", C.printed_date(text).alias("printed"))


@register("most_threads", "SELECT user_id, len(list_filter(r, lambda x: x.threads = list_max(list_transform(r, lambda y: y.threads))))::BIGINT AS kept FROM (SELECT user_id, list({'threads': event_id % 3, 'id': event_id}) AS r FROM events GROUP BY 1)")
def _threads(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct((F.col("event_id") % 3).alias("threads"), "event_id")).alias("results"))  # a user's runs
    return warehouse.at_most_threads(runs, "results", "threads").select("user_id", F.size("results").cast("long").alias("kept"))
