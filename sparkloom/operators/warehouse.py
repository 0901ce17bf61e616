"""Checks on published tables and reports about runs, usage and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.columns import next_month

# Labels and severities of reason codes, and how bad each state of a component is.
REASON_LABELS = {
    "missing_invoice": "No invoice number", "bad_invoice_format": "Invoice number of another form", "bad_date": "No readable date", "bad_quantity": "No whole quantity", "zero_quantity": "Quantity of nothing",
    "bad_price": "No readable price", "missing_stock_code": "No stock code", "bad_customer_id": "No whole customer number", "outside_drop_period": "Another month's row", "test_record": "Test row",
    "accounting_adjustment": "Adjustment by accounting", "stock_adjustment": "Adjustment of stock", "negative_price": "Price below zero", "cancellation_sign_mismatch": "Sign against the kind of invoice",
    "unknown_product": "Product not in the catalogue", "unknown_customer": "Customer not in the register", "duplicate_line": "Row given before",
}
SEVERITY_RANK = ("ok", "degraded", "down")


def schema_check(columns: list[str], contract: tuple[str, ...]) -> tuple[str, str, bool, float]:
    """(name, severity, passed, value) of the check that a header is the contract's."""
    passed = [c.strip() for c in columns] == list(contract)
    return "schema_conforms", "gate", passed, float(passed)


def drop_sequence(drops: DataFrame) -> DataFrame:
    """drops (drop_key, a month each) with previous_drop and in_sequence: whether none is missing before it.

    One window over a row a drop; a first drop is in sequence.
    """
    w = Window.orderBy("drop_key")
    held = drops.select("drop_key").distinct().withColumn("previous_drop", F.lag("drop_key").over(w))
    return held.withColumn("in_sequence", F.coalesce(F.col("drop_key") <= next_month(F.col("previous_drop")), F.lit(True)))


def warehouse_checks(lines: DataFrame, invoices: DataFrame, customers: DataFrame, expected: DataFrame) -> DataFrame:
    """(drop_key, name, severity, passed, value) of each drop in expected (drop_key, lines), against what was published.

    lines (drop_key, invoice_no), invoices (drop_key, invoice_no, customer_id), customers (customer_id).
    """
    loaded = lines.groupBy("drop_key").agg(F.count("*").alias("loaded"))
    lost_lines = lines.join(invoices.select("invoice_no"), "invoice_no", "left_anti").groupBy("drop_key").agg(F.count("*").alias("lines_lost"))
    lost = invoices.where("customer_id is not null").join(customers.select("customer_id"), "customer_id", "left_anti").groupBy("drop_key").agg(F.count("*").alias("invoices_lost"))
    held = expected.select("drop_key", F.col("lines").alias("wanted")).join(loaded, "drop_key", "left").join(lost_lines, "drop_key", "left").join(lost, "drop_key", "left").join(drop_sequence(expected), "drop_key")
    held = held.fillna(0, ["loaded", "lines_lost", "invoices_lost"])
    orphans = F.col("lines_lost") + F.col("invoices_lost")
    none = F.lit(None).cast("double")
    entries = [
        ("load_reconciliation", "gate", F.col("loaded") >= F.col("wanted"), F.col("loaded").cast("double"), F.lit(True)), ("warehouse_orphans", "warn", orphans == 0, orphans.cast("double"), F.lit(True)),
        ("drop_sequence", "info", F.col("in_sequence"), none, F.col("previous_drop").isNotNull()),
    ]
    every = F.array(*[F.when(shown, F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), ok.alias("passed"), v.alias("value"))) for n, s, ok, v, shown in entries])
    return held.select("drop_key", F.inline(F.array_compact(every)))


def reconciled(staged: DataFrame, published: DataFrame, key: str = "line_key") -> DataFrame:
    """(staged, found, passed): how many staged keys the published table holds."""
    both = staged.select(key).distinct().join(published.select(key, F.lit(1).alias("_f")).distinct(), key, "left")
    return both.agg(F.count("*").alias("staged"), F.count("_f").alias("found")).withColumn("passed", F.col("staged") == F.col("found"))


def totals(**counted: tuple[DataFrame, Column]) -> DataFrame:
    """One row with an aggregate of each table."""
    frames = [df.agg(agg.alias(name)) for name, (df, agg) in counted.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(F.broadcast(f))  # one row each
    return out


def load_status(drops: DataFrame, loaded: DataFrame) -> DataFrame:
    """drops (drop_key, rows) with loaded, first_loaded_at and times_processed from loaded (drop_key, at), a row for each load."""
    seen = loaded.groupBy("drop_key").agg(F.min("at").alias("first_loaded_at"), F.count("*").alias("times_processed"))
    return drops.join(seen, "drop_key", "left").withColumn("loaded", F.col("times_processed").isNotNull()).fillna(0, ["times_processed"])


def labelled_reasons(counts: DataFrame) -> DataFrame:
    """counts (reason, n) with label; a code that isn't known is its own label."""
    known = F.create_map(*[F.lit(x) for pair in REASON_LABELS.items() for x in pair])
    return counts.withColumn("label", F.coalesce(known[F.col("reason")], F.col("reason")))


def recent_runs(runs: DataFrame, ended: str, tie: str, most: int = 30, pending: Column | None = None) -> DataFrame:
    """The latest `most` finished runs, the oldest of them first."""
    done = runs if pending is None else runs.where(~pending)
    return done.orderBy(F.desc(ended), F.desc(tie)).limit(most).orderBy(ended, tie)


def turn_of(drops: DataFrame, least: bool = True) -> DataFrame:
    """The drop that was processed least (or most) recently, of drops (drop_key, processed_at); never processed ones come first, then the smaller key."""
    at = F.coalesce(F.col("processed_at"), F.lit("0001-01-01").cast("timestamp_ntz"))
    return drops.agg((F.min_by if least else F.max_by)("drop_key", F.struct(at.alias("a"), "drop_key")).alias("drop_key"))


def expire_runs(runs: DataFrame, now: str, hours: int, status: str = "status", started: str = "started_at") -> DataFrame:
    """runs; running ones that started over `hours` ago are failed, with expired telling which."""
    old = (F.col(status) == "running") & (F.col(started) < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))
    return runs.withColumn("expired", F.coalesce(old, F.lit(False))).withColumn(status, F.when(F.col("expired"), "failed").otherwise(F.col(status)))


def worst_state(components: DataFrame, by: list[str]) -> DataFrame:
    """(by, state): the worst state of the components (state) of each group."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY_RANK)), F.col("state"))
    return components.groupBy(*by).agg(F.max_by("state", rank).alias("state"))


def usage_by_status(calls: DataFrame, status: str, kind: str, retries: str) -> DataFrame:
    """(status, one column for each kind, retries): how often each happened; kinds are found in one pass over the small counts."""
    return calls.groupBy(status).pivot(kind).agg(F.count(F.lit(1))).join(calls.groupBy(status).agg(F.sum(retries).alias("retries")), status).fillna(0)


def spent_since(usage: DataFrame, since: str, ts: str, cost: str, by: list[str]) -> DataFrame:
    """(by, spent): the cost since then; keys without any have 0."""
    recent = F.when(F.col(ts) >= F.lit(since).cast("timestamp_ntz"), F.col(cost))
    return usage.groupBy(*by).agg(F.coalesce(F.sum(recent), F.lit(0)).alias("spent"))


def composite_quota(events: DataFrame, key: str, ts: str, tie: str, hourly: int, daily: int) -> DataFrame:
    """events with used_hour, used_day, allowed and retry_after in seconds: an event counts in both windows, and waits for the later of those that are full."""
    out = events
    for name, width in (("hour", "1 hour"), ("day", "1 day")):
        out = out.withColumn(f"_{name}", F.window(ts, width)["start"]).withColumn(f"_{name}_end", F.window(ts, width)["end"])
        out = out.withColumn(f"used_{name}", F.row_number().over(Window.partitionBy(key, f"_{name}").orderBy(ts, tie)))
    wait = lambda name, limit: F.when(F.col(f"used_{name}") > limit, F.unix_seconds(F.col(f"_{name}_end").cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp")))
    later = F.greatest(wait("hour", hourly), wait("day", daily))
    return out.withColumn("allowed", later.isNull()).withColumn("retry_after", later).drop("_hour", "_hour_end", "_day", "_day_end")


def retained(rows: DataFrame, now: str, ts: str, days: int) -> DataFrame:
    """The rows of the last `days` days; write them with publish_whole() to delete the others."""
    return rows.where(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def swept(jobs: DataFrame, now: str, ttl_days: int, stuck_minutes: int) -> DataFrame:
    """jobs (status, created_at, updated_at): those past their time are left out, and those that are stuck are failed."""
    at = F.lit(now).cast("timestamp_ntz")
    live = jobs.where(F.col("created_at") >= at - F.expr(f"INTERVAL {ttl_days} DAYS"))
    stuck = F.col("status").isin("queued", "running") & (F.col("updated_at") < at - F.expr(f"INTERVAL {stuck_minutes} MINUTES"))
    return live.withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def at_most_threads(runs: DataFrame, results: str, threads: str) -> DataFrame:
    """runs with only those entries of an array of results that used as many threads as any entry of the same run."""
    most = F.array_max(F.transform(results, lambda r: r[threads]))
    return runs.withColumn(results, F.filter(results, lambda r: r[threads] == most))
