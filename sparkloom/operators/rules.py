"""Order facts, hash-derived shipments, refund decisions, quotas and budgets as Column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.columns import working_day

# Windows, caps and shares of the refund rules, and of shipments.
DAMAGE_DAYS, RETURN_DAYS, LATE_AFTER, LOST_AFTER = 14, 30, 3, 10
LATE_SHARE, LATE_CAP = "0.05", "10"


def number_lines(lines: DataFrame, order: str, ties: list[str]) -> DataFrame:
    """lines with line_no, from 1 within each order."""
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy(order).orderBy(*ties)))


def shipments(orders: DataFrame, as_of: str) -> DataFrame:
    """orders (invoice_no string, invoiced_at, region: home, near or far) with their simulated shipment as known on as_of.

    Everything follows from 48 bits of a hash of the invoice number; there is no randomness and no state.
    """
    day = F.lit(as_of).cast("date")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("shipment:"), F.col("invoice_no")).cast("binary"), 256), 1, 12), 16, 10).cast("long")
    out = orders.withColumn("_h", h)
    start = F.date_add(F.col("invoiced_at").cast("date"), F.when(F.hour("invoiced_at") < 15, 1).otherwise(2))
    transit = F.when(F.col("region") == "home", 2 + F.col("_h") % 2).when(F.col("region") == "near", 3 + F.col("_h") % 4).otherwise(6 + F.col("_h") % 6)
    out = out.withColumn("dispatched_on", working_day(start)).withColumn("estimated_delivery", F.date_add("dispatched_on", transit.cast("int")))
    roll, spread = F.shiftright("_h", 8) % 100, F.shiftright("_h", 16)
    late = F.date_add("estimated_delivery", (LATE_AFTER + 1 + spread % 9).cast("int"))
    due = F.when(roll < 6, F.lit(None)).when(roll < 14, late).otherwise(F.date_sub("estimated_delivery", (spread % 2).cast("int")))
    status = (
        F.when((roll < 4) & (day > F.date_add("estimated_delivery", LOST_AFTER)), "lost")
        .when((roll >= 4) & (roll < 6) & (day >= F.date_add("estimated_delivery", 6)), "returned_to_sender")
        .when((roll >= 6) & (roll < 14) & (day >= F.col("_due")), "delivered_late")
        .when((roll >= 14) & (day >= F.col("_due")), "delivered")
        .otherwise("in_transit")
    )
    out = out.withColumn("_due", due).withColumn("status", status)
    arrived = F.col("status").isin("delivered", "delivered_late")
    out = out.withColumn("delivered_on", F.when(arrived, F.col("_due")))
    days = F.when(F.col("status") == "lost", F.datediff(day, "estimated_delivery")).when(arrived, F.greatest(F.datediff("_due", "estimated_delivery"), F.lit(0))).otherwise(0)
    return out.withColumn("days_late", days).drop("_h", "_due")


def refund_decisions(claims: DataFrame, as_of: str, auto_approve: float = 50.0) -> DataFrame:
    """claims (reason, is_credit_note, status, delivered_on, days_late, goods_total, shipping_total, claimed) with
    eligible, amount and approval. Amounts are decimals; halves round up."""
    money = lambda c: F.round(c.cast("decimal(14,4)"), 2).cast("decimal(14,2)")
    age = F.datediff(F.lit(as_of).cast("date"), F.col("delivered_on"))
    reason = F.col("reason")
    goods, shipping, claimed = (F.col(c).cast("decimal(14,2)") for c in ("goods_total", "shipping_total", "claimed"))
    late = F.when(shipping > 0, shipping).otherwise(F.least(money(goods * F.lit(LATE_SHARE).cast("decimal(3,2)")), F.lit(LATE_CAP).cast("decimal(14,2)")))
    amount = (
        F.when(F.col("is_credit_note") | F.col("status").isNull(), None)
        .when(reason.isin("damaged", "missing_items") & (age <= DAMAGE_DAYS), claimed)
        .when((reason == "return_unused") & (age <= RETURN_DAYS), claimed)
        .when((reason == "late_delivery") & (F.col("status") == "delivered_late"), late)
        .when((reason == "lost_parcel") & (F.col("status") == "lost"), goods)
    )
    capped = F.when(reason == "return_unused", amount).otherwise(F.least(amount, (goods + shipping).cast("decimal(14,2)")))
    eligible = F.coalesce((capped > 0) | (reason == "return_unused") & amount.isNotNull(), F.lit(False))
    approval = F.when(~eligible | (reason == "return_unused"), "none").when(capped <= auto_approve, "agent").otherwise("supervisor")
    return claims.select("*", eligible.alias("eligible"), F.when(eligible, capped).otherwise(F.lit(0)).cast("decimal(14,2)").alias("amount"), approval.alias("approval"))


def quota_counts(events: DataFrame, key: str, ts: str, width: str = "1 hour") -> DataFrame:
    """(key, window_start, n): events per epoch-aligned window; the same plan runs on a stream."""
    return events.groupBy(F.col(key), F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("window_start"), "n")


def quota_decisions(events: DataFrame, key: str, ts: str, tie: str, limit: int, width: str = "1 hour") -> DataFrame:
    """events with window_start, used (the event's number in its window), allowed and remaining."""
    start = F.window(ts, width)["start"]
    out = events.withColumn("window_start", start)
    used = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(ts, tie))
    out = out.withColumn("used", used)
    return out.withColumn("allowed", F.col("used") <= limit).withColumn("remaining", F.greatest(limit - F.col("used"), F.lit(0)))


def budget_decisions(usage: DataFrame, key: str, ts: str, tie: str, cost: str, budget: int, reserve: float = 0.15) -> DataFrame:
    """usage with spent (before the row, that day, of the key) and admitted: whether the cost still fits beside the reserve."""
    w = Window.partitionBy(key, F.date_trunc("day", ts)).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(cost).over(w), F.lit(0))
    return usage.withColumn("spent", spent).withColumn("admitted", F.col("spent") + F.col(cost) <= budget * (1 - reserve))


def latest_per_key(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """Each key's latest row, by a partial aggregate rather than a sort; nulls come last."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, tie)).alias("r")).select(key, "r.*")


def head_per_group(rows: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """At most max(1, limit div groups) rows of each group."""
    groups = rows.select(group).distinct().agg(F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.count("*"), F.lit(1)))).alias("_most"))
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).join(F.broadcast(groups), F.col("_r") <= F.col("_most")).drop("_r", "_most")  # one row


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of the rows in a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_with_total(rows: DataFrame, order: list, offset: int, limit: int) -> tuple[DataFrame, int]:
    """One page of the rows, and how many there are in all."""
    return page(rows, order, offset, limit), rows.count()


def intent(text: Column, intents: dict[str, tuple[str, ...]]) -> Column:
    """The first intent one of whose words starts a word of the text."""
    return F.coalesce(*[F.when(F.lower(text).rlike(r"\b(" + "|".join(words) + ")"), name) for name, words in intents.items()])
