"""Order facts for a customer: kinds of lines, invoices, cards, items to refund, authorisations, eligibility and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import dealt

# Codes and a description that are shipping, and codes that are no product either; codes that an ordinary document may hold.
SHIPPING_CODES, SHIPPING_TEXT = ("POST", "DOT", "C2"), "next day carriage"
OTHER_CODES = ("M", "m", "D", "S", "BANK CHARGES", "ADJUST", "AMAZONFEE", "B", "CRUK", "TEST001")
KEPT_SPECIAL = ("POST", "DOT", "C2", "M")
#: Most lines of an ordinary document, products shown of an invoice, and the goods' worth below which nothing is sent back.
MOST_LINES, MOST_SHOWN, RETURN_FROM = 60, 40, "15"


def line_kind(code: Column, description: Column) -> Column:
    """shipping, other or product."""
    shipping = code.isin(*SHIPPING_CODES) | (F.lower(description) == SHIPPING_TEXT)
    return F.when(F.coalesce(shipping, F.lit(False)), "shipping").when(code.isin(*OTHER_CODES) | code.startswith("gift_"), "other").otherwise("product")


#: Columns of an order line as it is delivered.
DELIVERED = ("invoice", "stock_code", "description", "quantity", "invoice_date", "price", "customer_id", "country")


def known_lines(rows: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Numbered order lines of known customers: rows (DELIVERED) without those of no customer, equal ones once.

    (invoice_no, line_no, stock_code, description, quantity, unit_price, line_total, invoiced_at, customer_id, country, kind).
    Lines of an invoice are numbered by code, description, quantity and price, ties by the other columns, so numbers don't
    depend on the files' order; nulls come last; a missing description is empty, and numbered as if it were missing.
    Rows are dealt out by invoice once, which serves both the comparison of whole rows and the numbering; with scan, the table
    that they come from, over as many tasks as it has rows for.
    """
    known = rows.select(*DELIVERED).where(F.col("customer_id").isNotNull())
    known = (known.repartition("invoice") if scan is None else dealt(known, scan, "invoice")).dropDuplicates()
    order = [F.asc_nulls_last(c) for c in ("stock_code", "description", "quantity", "price", "invoice_date", "customer_id", "country")]
    total = F.round(F.col("quantity") * F.col("price"), 2).cast("decimal(14,2)")
    return known.select(
        F.col("invoice").alias("invoice_no"), F.row_number().over(Window.partitionBy("invoice").orderBy(*order)).alias("line_no"), "stock_code", F.coalesce("description", F.lit("")).alias("description"),
        F.col("quantity").cast("int").alias("quantity"), F.col("price").cast("decimal(12,2)").alias("unit_price"), total.alias("line_total"), F.col("invoice_date").cast("timestamp_ntz").alias("invoiced_at"),
        F.col("customer_id").cast("long").alias("customer_id"), "country", line_kind(F.col("stock_code"), F.col("description")).alias("kind"),
    )


def invoices(lines: DataFrame) -> DataFrame:
    """One row per invoice of lines (invoice_no, invoiced_at, customer_id, country, kind, quantity, line_total).

    An invoice has one customer and country; should it have several, the smallest are taken, so the result is stable.
    """
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)))
    return lines.groupBy("invoice_no").agg(
        F.min("invoiced_at").alias("invoiced_at"), F.min("customer_id").alias("customer_id"), F.min("country").alias("country"), F.count("*").alias("lines"), of("product", "quantity").alias("units"),
        F.coalesce(of("product", "line_total"), F.lit(0)).alias("goods_total"), F.coalesce(of("shipping", "line_total"), F.lit(0)).alias("shipping_total"), F.sum("line_total").alias("total"),
        F.first(F.col("invoice_no").startswith("C")).alias("is_credit_note"),
    )


def own_invoices(headers: DataFrame, owners: DataFrame, before: str | None = None) -> DataFrame:
    """headers of the given owners (customer_id) only; with `before`, those from before that time."""
    own = headers.join(owners.select("customer_id").distinct(), "customer_id", "left_semi")
    return own if before is None else own.where(F.col("invoiced_at") < F.lit(before).cast("timestamp_ntz"))


def latest_invoices(headers: DataFrame, most: int, before: str | None = None) -> DataFrame:
    """At most `most` invoices of each customer, the latest first (column place), ties by the larger number."""
    held = headers if before is None else headers.where(F.col("invoiced_at") < F.lit(before).cast("timestamp_ntz"))
    w = Window.partitionBy("customer_id").orderBy(F.desc("invoiced_at"), F.desc("invoice_no"))
    return held.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def customer_cards(headers: DataFrame, most: int = 5) -> DataFrame:
    """A row per customer with orders: country, invoices, first_order, last_order, and recent, the nested latest invoices."""
    own = headers.where(~F.col("is_credit_note")).groupBy("customer_id").agg(F.min("country").alias("country"), F.count("*").alias("invoices"), F.min("invoiced_at").alias("first_order"), F.max("invoiced_at").alias("last_order"))
    recent = latest_invoices(headers, most).groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("place", "invoice_no", "invoiced_at", "total", "is_credit_note"))).alias("recent"))  # `most` entries
    return own.join(recent, "customer_id", "left")


def invoice_views(lines: DataFrame, most: int = MOST_SHOWN) -> DataFrame:
    """A row per invoice of lines (invoice_no, line_no, kind, stock_code, quantity, line_total): its first products, how many more there are, and its other lines, nested.

    A line's number decides whether it is collected, so an invoice of any length is a bounded array of products.
    """
    place = F.row_number().over(Window.partitionBy("invoice_no", "kind").orderBy("line_no"))
    numbered = lines.withColumn("_p", place)
    shown = F.when((F.col("kind") == "product") & (F.col("_p") <= most), F.struct("line_no", "stock_code", "quantity", "line_total"))
    other = F.when(F.col("kind") != "product", F.struct("line_no", "stock_code", "line_total"))
    return numbered.groupBy("invoice_no").agg(
        F.array_sort(F.collect_list(shown)).alias("products"), F.greatest(F.count_if(F.col("kind") == "product") - most, F.lit(0)).alias("more_products"), F.array_sort(F.collect_list(other)).alias("other_lines")
    )


def selected_items(lines: DataFrame, items: DataFrame) -> DataFrame:
    """items (invoice_no, stock_code, quantity or null for all) with problem or amount, and return_needed.

    lines (invoice_no, line_no, kind, stock_code, quantity, unit_price): the first line of a code counts, whatever its case.
    """
    goods = lines.where("kind = 'product' and quantity > 0").withColumn("code", F.upper("stock_code"))
    first = goods.groupBy("invoice_no", "code").agg(F.min_by(F.struct(F.col("quantity").alias("held"), "unit_price"), "line_no").alias("l"))
    asked = items.withColumn("code", F.upper(F.trim("stock_code")))
    met = asked.join(first, ["invoice_no", "code"], "left").select(asked["*"], "l.held", "l.unit_price").withColumn("taken", F.coalesce("quantity", "held"))
    problem = F.when(F.col("held").isNull(), "not_on_invoice").when(F.col("taken") <= 0, "no_quantity").when(F.col("taken") > F.col("held"), "more_than_bought")
    amount = F.round((F.col("unit_price").cast("decimal(12,4)") * F.col("taken").cast("decimal(10,0)")), 2).cast("decimal(14,2)")
    return met.select(
        *items.columns, problem.alias("problem"), F.when(problem.isNull(), amount).alias("amount"), F.when(problem.isNull(), F.col("unit_price") * F.col("held") >= F.lit(RETURN_FROM).cast("decimal(5,0)")).alias("return_needed")
    )


def known_events(shipments: DataFrame, events: str, at: str, as_of: str) -> DataFrame:
    """shipments with only those entries of an array of events that had happened by a day."""
    return shipments.withColumn(events, F.filter(events, lambda e: e[at].cast("date") <= F.lit(as_of).cast("date")))


def authorised(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """requests (request_id, invoice_no, reason, amount) with status against decisions (invoice_no, reason, eligible, amount, approval).

    The amount must be the calculated one; the first request of an invoice and reason that is in order counts, later ones
    repeat its answer as already_requested.
    """
    d = decisions.select("invoice_no", "reason", "eligible", F.col("amount").alias("_due"), "approval")
    held = requests.join(d, ["invoice_no", "reason"], "left")
    refusal = F.when(F.col("eligible").isNull(), "not_calculated").when(~F.col("eligible"), "not_eligible").when(F.col("approval") == "none", "refunded_on_return").when(F.abs(F.col("_due") - F.col("amount")) > 0.005, "another_amount")
    held = held.withColumn("_no", refusal)
    turn = F.row_number().over(Window.partitionBy("invoice_no", "reason", F.col("_no").isNull()).orderBy("request_id"))
    answer = F.when(F.col("approval") == "agent", "approved").otherwise("pending_supervisor")
    return held.withColumn("_t", turn).select(*requests.columns, F.coalesce("_no", F.when(F.col("_t") > 1, "already_requested"), answer).alias("status"))


def eligible_invoices(lines: DataFrame) -> DataFrame:
    """(invoice, lines) of the invoices that make an ordinary document: one date, one country, one customer or none, known
    kinds of codes, prices in whole pennies above zero, described lines, not too many of them, a number of the usual form.

    lines (invoice, stock_code, description, price, invoice_date, customer_id, country); join it left semi to keep their rows.
    """
    odd_code = ~F.coalesce(F.col("stock_code").rlike(r"^\d{5}[A-Za-z]{0,2}$"), F.lit(False)) & ~F.coalesce(F.col("stock_code").isin(*KEPT_SPECIAL), F.lit(False))
    pennies = F.round(F.col("price") * 100, 6)
    per = lines.groupBy("invoice").agg(
        F.countDistinct("invoice_date").alias("dates"), F.countDistinct("customer_id").alias("customers"), F.countDistinct("country").alias("countries"), F.count_if(F.col("customer_id").isNull()).alias("nameless"),
        F.count_if(odd_code).alias("odd"), F.count_if((pennies % 1 != 0) | (F.col("price") <= 0)).alias("priced"), F.count_if(F.trim(F.coalesce("description", F.lit(""))) == "").alias("blank"), F.count("*").alias("lines"),
    )
    one = (F.col("customers") == 1) & (F.col("nameless") == 0) | (F.col("customers") == 0) & (F.col("nameless") == F.col("lines"))
    return per.where((F.col("dates") == 1) & one & (F.col("countries") == 1) & (F.col("odd") == 0) & (F.col("priced") == 0) & (F.col("blank") == 0) & (F.col("lines") <= MOST_LINES) & F.col("invoice").rlike(r"^C?\d{6}$")).select("invoice", "lines")


def stratified_sample(rows: DataFrame, id_col: str, size: str, bands: list[tuple[int, int, int]], seed: int) -> DataFrame:
    """rows with band and split: of each band (least, most, count) of sizes `count` rows for dev and as many for held_out.

    Rows come in the order of a seeded hash of their id, so the draw is stable and without replacement. Bands are disjoint.
    """
    band = F.coalesce(*[F.when(F.col(size).between(lo, hi), i) for i, (lo, hi, _) in enumerate(bands)])
    count = F.get(F.array(*[F.lit(n) for _, _, n in bands]), F.col("band"))
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    drawn = rows.withColumn("band", band).where("band is not null").withColumn("_r", F.row_number().over(Window.partitionBy("band").orderBy(order, id_col)))
    return drawn.where(F.col("_r") <= 2 * count).withColumn("split", F.when(F.col("_r") <= count, "dev").otherwise("held_out")).drop("_r")


def alternating_split(rows: DataFrame, kind: str, order: list) -> DataFrame:
    """rows with split: every other one of its kind, in the given order, is held out."""
    place = F.row_number().over(Window.partitionBy(kind).orderBy(*order)) - 1
    return rows.withColumn("split", F.when(F.pmod(place, F.lit(2)) == 0, "dev").otherwise("held_out"))


def matched_products(clauses: DataFrame, products: DataFrame) -> DataFrame:
    """(text_id, clause, product_id, quantity): the product that shares most words with a clause, where there is only one such.

    clauses (text_id, clause, words, quantity or null), products (text_id, product_id, words, held): a quantity is at most what is held.
    A text's few clauses and products meet with their lists of words, so no word is a row; rows dealt by text_id stay where they are.
    """
    listed = lambda words: F.array_compact(F.array_distinct(words))
    c = clauses.where("clause is not null").select("text_id", "clause", "quantity", listed("words").alias("_c"))
    p = products.select("text_id", "product_id", "held", listed("words").alias("_p"))
    met = c.join(p, "text_id").select("text_id", "clause", "product_id", "quantity", "held", F.size(F.array_intersect("_c", "_p")).alias("n")).where("n > 0")
    shared = met.groupBy("text_id", "clause", "product_id").agg(F.sum("n").alias("n"), F.min("quantity").alias("quantity"), F.min("held").alias("held"))
    own = Window.partitionBy("text_id", "clause")
    best = shared.withColumn("_best", F.max("n").over(own)).withColumn("_k", F.count_if(F.col("n") == F.col("_best")).over(own)).where("n = _best and _k = 1")
    return best.select("text_id", "clause", "product_id", F.least("quantity", F.when(F.col("quantity").isNotNull(), F.col("held"))).alias("quantity"))


def scenario_problems(scenarios: DataFrame) -> DataFrame:
    """scenarios (id, wanted, refunds, requests, tickets_wanted, tickets, mentions, reply, tools_wanted, tools) with problems, an array of codes.

    wanted is the refund that should have been recorded, null for none; refunds, requests and the others are arrays.
    """
    due = F.col("wanted").isNotNull()
    lacking = lambda a, b, code: F.transform(F.array_except(a, b), lambda x: F.concat(F.lit(f"{code}:"), x))
    unsaid = F.transform(F.filter("mentions", lambda m: ~F.contains(F.lower("reply"), F.lower(m))), lambda m: F.concat(F.lit("unsaid:"), m))
    single = F.array_compact(F.array(
        F.when(due & ~((F.size("refunds") == 1) & F.array_contains("refunds", F.col("wanted"))), "wrong_refund"), F.when(~due & (F.size("refunds") > 0), "refund_not_due"),
        F.when(~due & (F.size("requests") > 0), "request_not_due"), F.when(F.coalesce(F.col("reply"), F.lit("")) == "", "no_reply"),
    ))
    return scenarios.withColumn("problems", F.concat(single, lacking("tickets_wanted", "tickets", "no_ticket"), unsaid, lacking("tools_wanted", "tools", "unused")))


def ranked_choices(scores: DataFrame, by: list[str], best_first: list[Column]) -> DataFrame:
    """scores with place: by the given criteria, one after the other, within each group."""
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*best_first)))
