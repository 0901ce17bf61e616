"""Invoices read from the boxes of their pages: header fields, a table over pages, totals and checks.

A document's boxes are few, so the task that holds them reads it whole (box_reader); boxes are dealt once and nothing is written
in between. The same steps as joins and windows over frames are here too; read_by_frames() goes through them, and tests hold
both readings against each other. There, where reading goes on from row to row, its state is put in closed form: a page either
stops and resumes the table or leaves it as it was, so the state at a page's start follows from the last page that decides it
and the number of pages since that turn it round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.columns import money, printed_date, whole_number
from sparkloom.operators import box_reader
from sparkloom.operators.layout import cells, column_kinds, gutters, rows_of_boxes
from sparkloom.session import written

# Labels of header fields, words of header cells by role, labels of totals and of rows that count items, footers.
FIELD_LABELS = {
    "number": ("invoice no", "invoice number", "invoice #", "number", "no", "credit note no", "credit note number", "credit note #"),
    "date": ("date", "invoice date", "credit note date", "issued", "date of issue"),
    "customer": ("customer", "customer id", "customer no", "account"),
    "country": ("country", "ship to", "delivery country"),
}
ROLE_WORDS = {
    "code": ("code", "stock code", "item", "sku"), "description": ("description", "item description", "product"), "quantity": ("qty", "quantity", "units"),
    "unit_price": ("unit price", "price", "unit cost"), "amount": ("amount", "total", "line total"),
}
TOTALS, SUBTOTAL, COUNTS = ("total", "total due", "amount due", "invoice total"), "subtotal", ("items", "item count", "number of items")
FOOTER = r"(?i)^page \d+ of \d+$"
#: How far edges may be apart to line up, the gap of a wrapped line and of a block of pairs in heights, rows that totals may take.
REACH, WRAP_GAP, BLOCK_GAP, TOTAL_ROWS, HOLDS = 8.0, 1.6, 2.2, 6, 0.8
NUMERIC = ("quantity", "unit_price", "amount")


def plain_label(text: Column) -> Column:
    """A printed label to compare: lower case, without currency and the marks at its end, single spaces."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"\(gbp\)|£", ""), r"^\s+|[\s:]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\.", " "), r"\s+", " "))


def _named(label: Column, words: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*[F.when(label.isin(*own), F.lit(name)) for name, own in words.items()])


def value_kind(text: Column) -> Column:
    """date, number, customer, country or null: what a printed value looks like."""
    t = F.trim(text)
    return (
        F.when(printed_date(t).isNotNull(), "date").when(t.rlike(r"^(?:C\d{5,7}|\d{6,7})$"), "number").when(t.rlike(r"^\d{3,6}$") | t.isin("—", "-", "Guest"), "customer")
        .when(t.rlike(r"^[A-Za-z][A-Za-z .'-]{1,40}$"), "country")
    )


def numbered_rows(boxes: DataFrame) -> DataFrame:
    """boxes (doc, page, text, x0, x1, top, bottom) with line, a row's number in its document, place, a box's number in its row, and what it reads as."""
    placed = rows_of_boxes(boxes)
    placed = placed.withColumn("line", F.dense_rank().over(Window.partitionBy("doc").orderBy("page", "row"))).drop("row")
    text = F.col("text")
    reads = {"amount": money(text), "units": whole_number(text), "label": plain_label(text), "height": F.greatest(F.lit(1.0), F.col("bottom") - F.col("top"))}
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("doc", "line").orderBy("x0", "text")) - 1).withColumns(reads)


def row_facts(boxes: DataFrame) -> DataFrame:
    """(doc, page, line, boxes, amounts, item_like, footer, label, top, bottom, height) of numbered_rows()."""
    bare = F.when(F.col("amount").isNull() & F.col("units").isNull(), F.struct("place", "text"))
    out = boxes.groupBy("doc", "page", "line").agg(
        F.count("*").alias("boxes"), F.count("amount").alias("amounts"), F.count("units").alias("_units"), F.count_if(F.col("text").rlike("[A-Za-z]{2}")).alias("_words"), F.bool_or(F.trim("text").rlike(FOOTER)).alias("footer"),
        F.array_sort(F.collect_list(bare)).alias("_l"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.sort_array(F.collect_list("height")).alias("_h"),
    )
    like = (F.col("amounts") >= 1) & (F.col("_units") >= 1) & (F.col("_words") >= 1) & (F.col("boxes") >= 3)
    label = plain_label(F.array_join(F.transform("_l", lambda x: x["text"]), " "))
    height = F.get("_h", F.floor(F.size("_h") / 2).cast("int"))
    return out.select("doc", "page", "line", "boxes", "amounts", like.alias("item_like"), "footer", label.alias("label"), "top", "bottom", height.alias("height"))


def table_header(boxes: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc, head, head_page): the first row with three roles, a numeric and a textual one among them; else one of the two rows
    above the first item that is near, wide and has no amount."""
    role = _named(F.col("label"), ROLE_WORDS)
    per = boxes.groupBy("doc", "line").agg(F.collect_set(role).alias("r"))
    fits = (F.size("r") >= 3) & F.arrays_overlap("r", F.array(*map(F.lit, NUMERIC))) & F.arrays_overlap("r", F.array(F.lit("code"), F.lit("description")))
    named = per.where(fits).groupBy("doc").agg(F.min("line").alias("named"))
    item = rows.where("item_like").groupBy("doc").agg(F.min_by(F.struct("line", "page", "top", "height"), "line").alias("i"))
    above = rows.join(item, "doc").where((F.col("line") < F.col("i.line")) & (F.col("line") >= F.col("i.line") - 2) & (F.col("page") == F.col("i.page")))
    near = above.where((F.col("boxes") >= 3) & (F.col("amounts") == 0) & (F.col("i.top") - F.col("bottom") < 4 * F.col("i.height"))).groupBy("doc").agg(F.max("line").alias("near"))
    found = named.join(near, "doc", "full_outer").select("doc", F.coalesce("named", "near").alias("head"))
    return found.join(rows.select("doc", F.col("line").alias("head"), F.col("page").alias("head_page")), ["doc", "head"])


def split_boxes(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """boxes with those that reach over column edges (doc, edge) cut at the word that crosses: a piece for each run of words in one column.

    Where a word stands is taken from its place among the characters. Boxes of one word, and those within a column, stay.
    """
    listed = edges.groupBy("doc").agg(F.sort_array(F.collect_list("edge")).alias("_e"))  # a few columns
    held = boxes.join(listed, "doc", "left").withColumn("_e", F.coalesce("_e", F.array().cast("array<double>")))
    band = lambda x: F.size(F.filter("_e", lambda e: e <= x))
    per = (F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))
    kind = "struct<at: int, pieces: array<struct<band: int, text: string, x0: double, x1: double>>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<band: int, text: string, x0: double, x1: double>>").alias("pieces")).cast(kind)

    def step(acc: Column, part: Column) -> Column:
        x0, x1 = F.col("x0") + acc["at"] * per, F.col("x0") + (acc["at"] + F.length(part)) * per
        last = F.try_element_at(acc["pieces"], F.lit(-1))
        own = F.struct(band((x0 + x1) / 2).alias("band"), part.alias("text"), x0.alias("x0"), x1.alias("x1"))
        more = F.struct(last["band"].alias("band"), F.concat(last["text"], F.lit(" "), part).alias("text"), last["x0"].alias("x0"), x1.alias("x1"))
        joined = F.when(F.size(acc["pieces"]) == 0, F.array(own)).when(last["band"] == own["band"], F.concat(F.slice(acc["pieces"], F.lit(1), F.size(acc["pieces"]) - 1), F.array(more))).otherwise(F.concat(acc["pieces"], F.array(own)))
        return F.struct((acc["at"] + F.length(part)).alias("at"), F.when(part.rlike(r"^\s"), acc["pieces"]).otherwise(joined).alias("pieces")).cast(kind)

    parts = F.regexp_extract_all("text", F.lit(r"\s+|\S+"), F.lit(0))
    cut = (band(F.col("x0") + 1) != band(F.col("x1") - 1)) & (F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))) > 1)
    whole = F.array(F.struct(F.lit(0).alias("band"), F.col("text").alias("text"), F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1")))
    pieces = F.when(cut, F.transform(F.aggregate(parts, zero, step, lambda acc: acc["pieces"]), lambda p: F.struct(p["band"].alias("band"), p["text"].alias("text"), F.round(p["x0"], 1).alias("x0"), F.round(p["x1"], 1).alias("x1")))).otherwise(whole)
    rest = [c for c in boxes.columns if c not in ("text", "x0", "x1")]
    return held.select(*rest, F.explode(pieces).alias("_p")).select(*rest, "_p.text", "_p.x0", "_p.x1")


def content_roles(table: DataFrame, columns: DataFrame) -> DataFrame:
    """columns (doc, place, x0, x1, text, role) with a role, where they have none, from what cells (doc, row, column, text) of item rows hold.

    quantity, unit_price and amount are the columns whose numbers multiply on most rows, amount to the right where both ways
    do; named columns keep their role. The longest column of texts is the description, the first other one the code.
    """
    kinds = column_kinds(table).withColumnRenamed("column", "place")
    known = columns.join(kinds, ["doc", "place"], "left")
    has = known.where("role is not null").groupBy("doc").agg(F.collect_set("role").alias("has"))
    known = known.join(has, "doc", "left").withColumn("has", F.coalesce("has", F.array().cast("array<string>")))
    may = lambda role, kind: known.where((F.col("role") == role) | F.col("role").isNull() & (F.col("kind") == kind) & ~F.array_contains("has", role)).select("doc", F.col("place").alias("column"))
    read = lambda role, kind, number, name: table.join(may(role, kind), ["doc", "column"]).select("doc", "row", F.col("column").alias(name), number(F.col("text")).alias(f"n{name}"))
    both = read("quantity", "int", whole_number, "q").join(read("unit_price", "money", money, "p"), ["doc", "row"]).join(read("amount", "money", money, "a"), ["doc", "row"]).where("p <> a and q <> p and q <> a and nq is not null and np is not null and na is not null")
    holds = both.groupBy("doc", "q", "p", "a").agg(F.avg((F.abs(F.col("nq") * F.col("np") - F.col("na")) < 0.005).cast("double")).alias("share")).where(F.col("share") >= HOLDS)
    best = holds.groupBy("doc").agg(F.max_by(F.struct("q", "p", "a"), F.struct("share", F.col("a") > F.col("p"), -F.col("q"), -F.col("p"), -F.col("a"))).alias("b"))
    found = known.join(best, "doc", "left")
    triple = F.when(F.col("place") == F.col("b.q"), "quantity").when(F.col("place") == F.col("b.p"), "unit_price").when(F.col("place") == F.col("b.a"), "amount")
    found = found.withColumn("role", F.coalesce("role", triple))
    length = table.groupBy("doc", F.col("column").alias("place")).agg(F.sum(F.length("text")).alias("chars"))
    found = found.join(length, ["doc", "place"], "left")
    w = Window.partitionBy("doc")
    longest = F.max(F.when(F.col("role").isNull() & (F.col("kind") == "text"), F.struct("chars", -F.col("place")))).over(w)
    described = F.col("role").isNull() & ~F.array_contains("has", "description") & (F.struct("chars", -F.col("place")) == longest)
    found = found.withColumn("role", F.when(described, "description").otherwise(F.col("role")))
    first = F.min(F.when(F.col("role").isNull() & F.col("kind").isin("code", "int"), F.col("place"))).over(w)
    coded = F.col("role").isNull() & ~F.array_contains("has", "code") & (F.col("place") == first)
    return found.withColumn("role", F.when(coded, "code").otherwise(F.col("role"))).select(*columns.columns)


def active_rows(rows: DataFrame) -> DataFrame:
    """rows (doc, page, line, stops, resumes) with active: whether the table is being read at a row, itself not a stop or a resumption.

    A stop holds for the rest of its page. On a later page the table goes on after a row that resumes it; a page without a
    stop before it goes on as it was.
    """
    page = Window.partitionBy("doc", "page").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("_seen", F.sum(F.col("resumes").cast("int")).over(page) > 0)
    after = Window.partitionBy("doc", "page", "_seen").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_part", F.sum(F.col("stops").cast("int")).over(after)).withColumn("_all", F.sum(F.col("stops").cast("int")).over(page))
    # the state at a page's end for both states at its start
    pages = held.groupBy("doc", "page").agg((F.max("_all") == 0).alias("from_active"), (F.bool_or("_seen") & (F.coalesce(F.max(F.when(F.col("_seen"), F.col("_part"))), F.lit(0)) == 0)).alias("from_paused"))
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    same, turns = F.col("from_active") == F.col("from_paused"), F.col("from_paused") & ~F.col("from_active")
    pages = pages.withColumn("_turns", F.sum(turns.cast("int")).over(Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)))
    decided = F.last(F.when(same, F.struct(F.col("from_active").alias("s"), F.col("_turns").alias("t"))), ignorenulls=True).over(before)
    pages = pages.withColumn("_d", decided).withColumn("_b", F.coalesce(F.lag("_turns").over(Window.partitionBy("doc").orderBy("page")), F.lit(0)))
    start = F.coalesce(F.col("_d.s"), F.lit(True)) != ((F.col("_b") - F.coalesce(F.col("_d.t"), F.lit(0))) % 2 == 1)
    out = held.join(pages.select("doc", "page", start.alias("_start")), ["doc", "page"])
    reads = F.when(F.col("_start"), F.col("_all") == 0).otherwise(F.col("_seen") & (F.col("_part") == 0))
    return out.withColumn("active", reads & ~F.col("resumes")).drop("_seen", "_part", "_all", "_start")


def table_rows(facts: DataFrame, filled: DataFrame, header: DataFrame, repeats: DataFrame) -> DataFrame:
    """(doc, line, item): the rows below the header that belong to items, numbered from 1, and line `end` after the table as item null.

    facts are row_facts(), filled (doc, line, n, textual) tells how many cells a row fills and whether only cells of texts,
    repeats (doc, line) which rows repeat the header. A row with three cells starts an item, one with texts alone and near
    goes on with it, any other stops the table until the header comes again on a later page, as a footer does. Totals end it,
    and so does, after an item, a row with a label and one amount.
    """
    rows = facts.join(header, "doc").where("line > head").join(filled, ["doc", "line"], "left").fillna(0, ["n"]).fillna(False, ["textual"])
    rows = rows.join(repeats.withColumn("_rep", F.lit(True)), ["doc", "line"], "left").withColumn("resumes", F.coalesce(F.col("_rep") & (F.col("page") > F.col("head_page")), F.lit(False))).drop("_rep")
    total = F.col("label").isin(*TOTALS, SUBTOTAL, *COUNTS)
    is_item = ((F.col("n") >= 3) | (F.col("n") >= 2) & F.col("item_like")) & ~F.col("footer") & ~F.col("resumes") & ~total
    rows = written(rows.withColumn("is_item", is_item).withColumn("is_total", total))
    early = active_rows(rows.withColumn("stops", F.col("footer")))
    first = early.where("active and is_item").groupBy("doc").agg(F.min("line").alias("first"))
    rows = rows.join(first, "doc", "left").withColumn("later", F.coalesce(F.col("line") > F.col("first"), F.lit(False)))
    ends = F.col("is_total") | F.col("later") & (F.col("amounts") == 1) & (F.col("boxes") <= 3) & ~F.col("item_like")
    last = rows.where(ends).groupBy("doc").agg(F.min("line").alias("end"))
    rows = rows.join(last, "doc", "left").where("end is null or line < end")
    # a wrapped line goes on from the row before: no row between is without a place in the item
    run = Window.partitionBy("doc", "page").orderBy("line")
    wraps = F.col("later") & ~F.col("is_item") & F.col("textual") & (F.col("n") > 0) & (F.col("top") - F.max("bottom").over(Window.partitionBy("doc", "page", "_i").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)) < WRAP_GAP * F.col("height"))
    rows = rows.withColumn("_i", F.sum(F.col("is_item").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("wraps", F.coalesce(wraps & (F.col("_i") > 0), F.lit(False)))
    stops = F.col("footer") | F.col("later") & ~F.col("is_item") & ~F.col("wraps") & ~F.col("resumes") & (F.col("n") > 0)
    read = active_rows(rows.withColumn("stops", stops)).where("active and (is_item or wraps)")
    read = read.withColumn("item", F.sum(F.col("is_item").cast("long")).over(Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))).where("item > 0")
    after = header.join(facts.groupBy("doc").agg(F.max("line").alias("_last")), "doc").join(last, "doc", "left").select("doc", F.coalesce("end", F.col("_last") + 1).alias("line"), F.lit(None).cast("long").alias("item"))
    return read.select("doc", "line", "item").unionByName(after)


def header_pairs(boxes: DataFrame) -> DataFrame:
    """(doc, line, place, label, value, field, found): pairs of boxes above the table, in reading order; field null for a label that isn't known.

    Found in three ways: a row of labels over a row of values that start at the same x; a label with its value to the right,
    or in the same box. Two boxes side by side whose label isn't known count where both line up with known pairs and are
    within a block of them: a block grows from known pairs over all steps that are short enough, which in one dimension is
    the island of row tops that holds a known pair.
    """
    field, kind = _named(F.col("label"), FIELD_LABELS), value_kind(F.col("text"))
    held = boxes.withColumn("field", field).withColumn("_n", F.count("*").over(Window.partitionBy("doc", "line")))
    below = held.select("doc", (F.col("line") - 1).alias("line"), F.col("text").alias("value"), F.col("x0").alias("vx"))
    values = held.withColumn("_k", kind).groupBy("doc", "line").agg(F.count_if(F.col("_k").isin("date", "number", "customer")).alias("values"))
    met = held.join(below, ["doc", "line"]).where(F.abs(F.col("vx") - F.col("x0")) < REACH)
    nearest = met.groupBy("doc", "line", "place", "text", "field", "_n").agg(F.min_by("value", F.struct(F.abs(F.col("vx") - F.col("x0")), "vx")).alias("value"))
    aligned = nearest.groupBy("doc", "line").agg(F.count("*").alias("aligned"), F.first("_n").alias("_n")).join(values, ["doc", "line"])
    rows = aligned.where((F.col("_n") >= 3) & (F.col("values") == 0) & (F.col("aligned") >= F.greatest(F.lit(3), F.col("_n") - 1))).select("doc", "line")
    stacked = nearest.join(rows, ["doc", "line"]).select("doc", "line", "place", F.col("text").alias("label"), "value", "field", F.lit("stacked").alias("found"))
    rest = written(held.join(rows, ["doc", "line"], "left_anti"))
    w = Window.partitionBy("doc", "line").orderBy("place")
    beside = rest.withColumns({"_v": F.lead("text").over(w), "_vx": F.lead("x0").over(w), "_vf": F.lead("field").over(w)})
    side = beside.where("field is not null and _v is not null and _vf is null")
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    # a row for each cut, so that labels are columns and not worked out twice in a lambda function; a label leaves a word for its value
    cuts = rest.where("field is null").select("doc", "line", "place", words.alias("_w")).where("size(_w) > 1").select("doc", "line", "place", "_w", F.explode_outer(F.sequence(F.lit(1), F.least(F.lit(4), F.size("_w") - 1))).alias("_c"))
    cuts = cuts.select("doc", "line", "place", "_w", "_c", F.array_join(F.slice("_w", F.lit(1), F.col("_c")), " ").alias("label")).where(_named(plain_label(F.col("label")), FIELD_LABELS).isNotNull())
    value = F.trim(F.regexp_replace(F.array_join(F.slice("_w", F.col("_c") + 1, F.size("_w")), " "), r"^[:#\s]+|[:#\s]+$", ""))
    inline = cuts.select("doc", "line", "place", F.struct("label", value.alias("value")).alias("c")).where("c.value <> ''")
    inline = inline.groupBy("doc", "line", "place").agg(F.min_by("c", F.length("c.label")).alias("c")).select("doc", "line", "place", "c.label", "c.value", _named(plain_label(F.col("c.label")), FIELD_LABELS).alias("field"), F.lit("inline").alias("found"))
    # blocks of pairs side by side
    seeds = side.select("doc", "line", "top", "x0", "_vx", "height")
    steps = seeds.groupBy("doc").agg((BLOCK_GAP * F.max("height")).alias("_step"))
    pair = beside.where("place = 0 and _n = 2 and field is null and _v is not null").select("doc", "line", "place", "text", "_v", "top", F.col("x0").alias("lx"), "_vx")
    lines_up = lambda mine, theirs: pair.join(seeds.select("doc", F.col("line").alias("_sl"), F.col(theirs).alias("_s")), "doc").where((F.abs(F.col(mine) - F.col("_s")) < REACH) & (F.col("line") != F.col("_sl"))).select("doc", "line").distinct()
    fits = pair.join(lines_up("lx", "x0"), ["doc", "line"], "left_semi").join(lines_up("_vx", "_vx"), ["doc", "line"], "left_semi")
    tops = seeds.select("doc", "line", "top", F.lit(True).alias("seed")).unionByName(fits.select("doc", "line", "top", F.lit(False).alias("seed"))).join(steps, "doc")
    order = Window.partitionBy("doc").orderBy("top", "line")
    tops = tops.withColumn("_b", F.sum(F.coalesce(F.col("top") - F.lag("top").over(order) > F.col("_step"), F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grown = tops.withColumn("_in", F.bool_or("seed").over(Window.partitionBy("doc", "_b"))).where("_in and not seed").select("doc", "line")
    block = fits.join(grown, ["doc", "line"], "left_semi").select("doc", "line", "place", F.col("text").alias("label"), F.col("_v").alias("value"), F.lit(None).cast("string").alias("field"), F.lit("block").alias("found"))
    side = side.select("doc", "line", "place", F.col("text").alias("label"), F.col("_v").alias("value"), "field", F.lit("side").alias("found"))
    return reduce(DataFrame.unionByName, (stacked, side, inline, block))


def header_fields(pairs: DataFrame) -> DataFrame:
    """(doc, field, value, label, by): a value for each field: of its first known label, else, by elimination, of the first
    pair with an unknown label, of letters, whose value has the field's look; each field is found once."""
    order = F.struct("line", "place")
    known = pairs.where("field is not null").groupBy("doc", "field").agg(F.min_by(F.struct("value", "label"), order).alias("v")).select("doc", "field", "v.value", "v.label", F.lit("label").alias("by"))
    loose = pairs.where("field is null").where(F.col("label").rlike("[A-Za-z]{2}")).withColumn("field", value_kind(F.col("value"))).where("field is not null")
    found = loose.join(known.select("doc", "field"), ["doc", "field"], "left_anti").groupBy("doc", "field").agg(F.min_by(F.struct("value", "label"), F.struct((F.col("found") == "block").cast("int"), "line", "place")).alias("v"))
    return known.unionByName(found.select("doc", "field", "v.value", "v.label", F.lit("elimination").alias("by")))


def printed_totals(boxes: DataFrame, facts: DataFrame, ends: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, total, subtotal, item_count, total_by) from the first TOTAL_ROWS rows at the table's end (doc, line), up to a footer.

    Of a row's amounts the one whose right end is nearest to the amount column's (doc, edge); of rows the first with a
    total's label, else the last one.
    """
    after = facts.join(ends.select("doc", F.col("line").alias("_end")), "doc").where((F.col("line") >= F.col("_end")) & (F.col("line") < F.col("_end") + TOTAL_ROWS))
    foot = after.where("footer").groupBy("doc").agg(F.min("line").alias("_foot"))
    after = after.join(foot, "doc", "left").where("_foot is null or line < _foot").select("doc", "line", F.col("label").alias("row_label"))
    near = boxes.join(after, ["doc", "line"]).join(edges, "doc", "left")
    amounts = near.where("amount is not null").groupBy("doc", "line", "row_label").agg(F.min_by("amount", F.struct(F.coalesce(F.abs(F.col("x1") - F.col("edge")), -F.col("place")), "place")).alias("n")).where(~F.col("row_label").isin(*COUNTS))
    counts = near.where(F.col("row_label").isin(*COUNTS) & F.col("units").isNotNull()).groupBy("doc").agg(F.max_by("units", F.struct("line", "place")).alias("item_count"))
    is_total, is_sub = F.col("row_label").isin(*TOTALS), F.col("row_label") == SUBTOTAL
    picked = amounts.groupBy("doc").agg(F.min_by(F.when(is_total, F.col("n")), F.when(is_total, F.col("line"))).alias("a"), F.max_by("n", "line").alias("b"), F.max_by(F.when(is_sub, F.col("n")), F.when(is_sub, F.col("line"))).alias("subtotal"))
    out = ends.select("doc").distinct().join(picked, "doc", "left").join(counts, "doc", "left")
    return out.select("doc", F.coalesce("a", "b").alias("total"), "subtotal", "item_count", F.when(F.col("a").isNotNull(), "label").when(F.col("b").isNotNull(), "fallback").alias("total_by"))


def _frame(boxes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """numbered_rows(), row_facts() and table_header() of boxes, written."""
    placed = written(numbered_rows(boxes))
    facts = written(row_facts(placed))
    return placed, facts, written(table_header(placed, facts))


def _first_pages(facts: DataFrame) -> DataFrame:
    return facts.groupBy("doc").agg(F.min("page").alias("first_page"), F.max("line").alias("last_line"))


def _region(placed: DataFrame, facts: DataFrame, header: DataFrame) -> DataFrame:
    """The boxes of first pages above the table, written."""
    above = (F.col("page") == F.col("first_page")) & (F.col("line") < F.coalesce("head", F.col("last_line") + 1))
    return written(placed.join(_first_pages(facts), "doc").join(header, "doc", "left").where(above).select(*placed.columns))


def _items(placed: DataFrame, facts: DataFrame, header: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The items of read_invoices(), table_rows() and the columns with their roles, written."""
    role = _named(F.col("label"), ROLE_WORDS)
    heads = placed.join(header, "doc").where("line = head").select("doc", "place", "x0", "x1", "text", "label", role.alias("role"))
    again = F.row_number().over(Window.partitionBy("doc", "role").orderBy("place"))
    heads = written(heads.withColumn("role", F.when(again == 1, F.col("role"))))
    under = facts.join(header, "doc").where("line > head")
    total = F.col("label").isin(*TOTALS, SUBTOTAL, *COUNTS)
    stop = under.where((F.col("page") != F.col("head_page")) | total | F.col("footer")).groupBy("doc").agg(F.min("line").alias("_stop"))
    body = under.join(stop, "doc", "left").where("_stop is null or line < _stop").select("doc", "line", "item_like")
    edges = written(gutters(placed.join(body, ["doc", "line"]), heads))
    pieces = written(split_boxes(placed.join(header, "doc").where("line > head").select("doc", "page", F.col("line").alias("row"), "text", "x0", "x1", "top", "bottom"), edges))
    table = written(cells(pieces, edges).withColumnRenamed("row", "line").where("text <> ''"))
    sample = table.join(body.where("item_like").select("doc", "line"), ["doc", "line"]).withColumnRenamed("line", "row")
    columns = written(content_roles(sample, heads))

    repeated = placed.join(heads.select("doc", F.col("label").alias("_l")).distinct(), "doc").where(F.col("label") == F.col("_l")).groupBy("doc", "line").agg(F.count("*").alias("_m"))
    names = heads.groupBy("doc").agg(F.countDistinct("label").alias("_n"))
    repeats = repeated.join(names, "doc").where(F.col("_m") >= F.greatest(F.lit(2), F.col("_n") - 1)).select("doc", "line")
    textual = F.coalesce(F.col("role") == "description", F.lit(True))
    marked = table.join(columns.select("doc", F.col("place").alias("column"), "role"), ["doc", "column"])
    filled = marked.groupBy("doc", "line").agg(F.count("*").alias("n"), F.bool_and(textual).alias("textual"))
    read = written(table_rows(facts, filled, header, repeats))

    parts = read.where("item is not null").join(marked.where("role is not null"), ["doc", "line"])
    joined = parts.groupBy("doc", "item", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("text"))
    cell = lambda name: F.max(F.when(F.col("role") == name, F.col("text")))
    started = read.where("item is not null").select("doc", "item").distinct()
    items = started.join(joined.groupBy("doc", "item").agg(*[cell(r).alias(r) for r in ROLE_WORDS]), ["doc", "item"], "left")
    items = written(items.select("doc", "item", "code", F.trim(F.regexp_replace("description", r"\s+", " ")).alias("description"), whole_number(F.col("quantity")).alias("quantity"), money(F.col("unit_price")).alias("unit_price"), money(F.col("amount")).alias("amount")))
    return items, read, columns


def read_by_frames(boxes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """read_invoices() by joins and windows; many times slower."""
    placed, facts, header = _frame(boxes)
    first, region = _first_pages(facts), _region(placed, facts, header)
    fields = written(header_fields(written(header_pairs(region))))
    noted = region.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "place", "text"))), lambda x: x["text"]), " ").alias("t")).select("doc", F.lower("t").contains("credit note").alias("noted"))
    items, read, columns = _items(placed, facts, header)
    right = columns.where("role = 'amount'").select("doc", F.col("x1").alias("edge"))
    totals = printed_totals(placed, facts, read.where("item is null"), right)
    value = lambda name: F.max(F.when(F.col("field") == name, F.trim("value")))
    wide = fields.groupBy("doc").agg(*[value(n).alias(f"_{n}") for n in FIELD_LABELS])
    whole = F.coalesce(F.abs(F.col("quantity") * F.col("unit_price") - F.col("amount")) < 0.005, F.lit(False))
    sums = items.groupBy("doc").agg(F.count("*").alias("lines"), F.count_if(~whole).alias("_bad"), F.count("amount").alias("_n"), F.sum("amount").alias("_sum"))
    out = first.select("doc").join(wide, "doc", "left").join(noted, "doc", "left").join(sums, "doc", "left").join(totals, "doc", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    return _checked(out).fillna(False, ["lines_multiply"]), items, fields


def _checked(out: DataFrame) -> DataFrame:
    """Documents with the values that were found, read and checked."""
    number, issued = F.nullif(F.regexp_replace("_number", " ", ""), F.lit("")), printed_date(F.col("_date"))
    credit = F.coalesce("noted", F.lit(False)) | F.coalesce(number.startswith("C"), F.lit(False))
    return out.select(
        "doc", number.alias("number"), issued.alias("issued"), F.when(F.col("_customer").rlike(r"^\d+$"), F.col("_customer").try_cast("long")).alias("customer"), F.nullif(F.col("_country"), F.lit("")).alias("country"), credit.alias("credit_note"),
        "lines", "total", "subtotal", "item_count", "total_by", ((F.col("lines") > 0) & (F.col("_bad") == 0)).alias("lines_multiply"),
        F.coalesce((F.col("_n") == F.col("lines")) & (F.abs(F.col("_sum") - F.col("total")) < 0.005), F.lit(False)).alias("total_fits"), (F.col("item_count") == F.col("lines")).alias("count_fits"),
        (number.isNotNull() & issued.isNotNull()).alias("header_complete"), F.when(F.col("total").isNotNull(), ((F.col("total") < 0) == credit) | (F.col("total") == 0)).alias("sign_fits"),
    )


TERMS = box_reader.Terms(box_reader.by_word(FIELD_LABELS), box_reader.by_word(ROLE_WORDS), TOTALS, SUBTOTAL, COUNTS)
_FIELD = "field string, value string, label string, by string"
_ITEM = "code string, description string, quantity bigint, unit_price decimal(14,2), amount decimal(14,2)"
_SUMS = "lines bigint, _bad bigint, _n bigint, _sum decimal(24,2), total decimal(14,2), subtotal decimal(14,2), item_count bigint, total_by string, noted boolean"


def _lists(rows: list[list[tuple]], kinds: list[tuple[str, Callable | pa.DataType]]) -> pa.Array:
    """Lists of structs from lists of tuples."""
    flat = [x for own in rows for x in own]
    columns = list(zip(*flat, strict=True)) if flat else [()] * len(kinds)
    made = [kind(list(c)) if callable(kind) else pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)]
    ends = np.concatenate(([0], np.cumsum([len(own) for own in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(made, [n for n, _ in kinds]))


def _reading(boxes: DataFrame, fields: bool, items: bool, pages: box_reader.Pages | None) -> DataFrame:
    """(doc, fields, items, and what documents are checked by), a row per document with boxes."""
    id_type = boxes.schema["doc"].dataType.simpleString()
    schema = f"doc {id_type}, fields array<struct<{_FIELD}>>, items array<struct<{_ITEM}>>, {_SUMS}"

    def read(found: list, kind: pa.DataType) -> pa.RecordBatch:
        # a document without a key has a row, but nothing is found in it
        rows = [(d, box_reader.invoice(own, TERMS, fields and d is not None, items and d is not None)) for d, own in found]
        docs, out = [d for d, x in rows if x is not None], [x for _, x in rows if x is not None]
        sums = []
        for x in out:
            amounts = [a for *_, a in x.items if a is not None]
            bad = sum(q is None or p is None or a is None or q * p != a for _, _, q, p, a in x.items)
            sums.append((len(x.items), bad, len(amounts), sum(amounts) if amounts else None, *x.totals, x.noted))
        lines, bad, n, total, *totals, noted = zip(*sums, strict=True) if sums else [()] * 9
        text = pa.string()
        return pa.RecordBatch.from_arrays([
            pa.array(docs, kind), _lists([x.fields for x in out], [("field", text), ("value", text), ("label", text), ("by", text)]),
            _lists([x.items for x in out], [("code", text), ("description", text), ("quantity", pa.int64()), ("unit_price", box_reader.decimals), ("amount", box_reader.decimals)]),
            *[pa.array(c, pa.int64()) for c in (lines, bad, n)], box_reader.decimals(list(total), 24), box_reader.decimals(list(totals[0])), box_reader.decimals(list(totals[1])), pa.array(totals[2], pa.int64()), pa.array(totals[3], text), pa.array(noted, pa.bool_()),
        ], ["doc", "fields", "items", "lines", "_bad", "_n", "_sum", "total", "subtotal", "item_count", "total_by", "noted"])

    return box_reader.by_document(boxes, read, schema, pages)


def _documents(reading: DataFrame) -> DataFrame:
    value = lambda name: F.get(F.filter("fields", lambda f: f["field"] == name), F.lit(0))["value"]
    return _checked(reading.withColumns({f"_{n}": F.trim(value(n)) for n in FIELD_LABELS}))


def _fields(reading: DataFrame) -> DataFrame:
    return reading.select("doc", F.inline("fields"))


def _listed(reading: DataFrame) -> DataFrame:
    return reading.select("doc", F.posexplode("items").alias("at", "x")).select("doc", (F.col("at") + 1).cast("long").alias("item"), "x.*")


def invoice_fields(boxes: DataFrame, pages: box_reader.Pages | None = None) -> DataFrame:
    """The header fields of read_invoices() alone; nothing below the header is read."""
    return _fields(_reading(boxes, True, False, pages))


def invoice_lines(boxes: DataFrame, pages: box_reader.Pages | None = None) -> DataFrame:
    """The items of read_invoices() alone; header fields aren't looked for."""
    return _listed(_reading(boxes, False, True, pages))


def invoice_documents(boxes: DataFrame, pages: box_reader.Pages | None = None) -> DataFrame:
    """The documents of read_invoices() alone; nothing is written."""
    return _documents(_reading(boxes, True, True, pages))


def read_invoices(boxes: DataFrame, pages: box_reader.Pages | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of boxes (doc, page, text, x0, x1, top, bottom): documents, items and header fields.

    documents (doc, number, issued, customer, country, credit_note, lines, total, subtotal, item_count, and five checks: each
    line multiplies, lines add up to the total, the item count fits, number and date are there, the sign fits; a check with
    nothing to compare is null), items (doc, item, code, description, quantity, unit_price, amount), fields as
    header_fields(). A document without boxes has no row, one without a table no items. pages as in box_reader.by_document().
    """
    reading = written(_reading(boxes, True, True, pages))
    return _documents(reading), _listed(reading), _fields(reading)
