"""Invoices read in the task that holds their boxes, against the same steps over frames and the columns' functions."""

import random

from pyspark.sql import functions as F

from sparkloom.functions.columns import money, printed_date, whole_number
from sparkloom.operators import box_reader, invoices, layout
from sparkloom.query_sets.invoices import _invoice

BOX = "doc long, page long, text string, x0 double, x1 double, top double, bottom double"
ODD = ["Total due:", "Page 3 of 4", "12", "(3.00)", "£4.50", "2 May 1996", "Date", "Invoice no. 123456", "Items", "a word", "x", "  ", "Subtotal", "Country", "Guest", "Description", None, "Qty"]


def _faulty(rng, doc):
    lines = [(f"A{rng.randrange(99)}", rng.choice(["MUG", "RED CUP", "OLD LAMP 3"]), rng.randrange(1, 9), rng.randrange(100, 999)) for _ in range(rng.randrange(1, 7))]
    out = []
    for page, text, x0, x1, top, bottom in _invoice(rng.randrange(2000), "1996-01-02", "1234", "FRANCE", lines):
        fault = rng.random() if doc % 3 else 1
        if fault < 0.03:
            continue
        if fault < 0.06:
            text = rng.choice(ODD)
        elif fault < 0.1:
            x0, x1, top = x0 + rng.uniform(-30, 30), x1 + rng.uniform(-30, 60), top + rng.uniform(-9, 9)
        elif fault < 0.11:
            page = rng.choice([1, 2, 3])
        elif fault < 0.115 and doc % 5 == 0:
            x0, top = rng.choice([(None, top), (x0, None)])
        out.append((doc, page, text, x0, x1, top, bottom))
    rng.shuffle(out)
    return out


def test_reading_in_the_task_equals_the_steps_over_frames(spark):
    rng = random.Random(8)
    rows = [b for doc in range(120) for b in _faulty(rng, doc)] + [(1000, 1, "  ", 1.0, 2.0, 3.0, 4.0), (1001, 1, "alone", 1.0, 2.0, 3.0, 4.0), (1002, None, "no page", 1.0, 2.0, 3.0, 4.0)]
    boxes = spark.createDataFrame(rows, BOX).repartition(3)
    for mine, theirs in zip(invoices.read_invoices(boxes), invoices.read_by_frames(boxes), strict=True):
        found, wanted = (sorted(map(repr, (tuple(r) for r in x.select(*theirs.columns).collect()))) for x in (mine, theirs))
        assert found == wanted and mine.select(*theirs.columns).dtypes == theirs.dtypes


def test_texts_are_read_as_columns_read_them(spark):
    rng = random.Random(4)
    texts = ["5", "-5", "(1,234)", "1,23", "12.50", "£1,000.00", "−2.00", "(GBP3.00)", "( 3.00 )", "3.00\n", "3.00\x85", "9" * 19, "9" * 20, "9" * 13 + ".00", "9" * 12 + ".00", "Total (GBP):", "a.b  c : ", " \x1f x", "ÀB:", "x\xa0:", "٣", "page 1 of 2", "Guest", "C12345", "Isle of Man", "O'Neil-Smith"]
    texts += ["1/2/1996", "31/2/1996", "29/2/2000", "29/2/1900", "1996-1-2", "2 May 1996", "2 Mai 1996", "2 sept 1996", "2 SEP 1996", "02-Jan-1996", "2.1.1996", "1/2/96", "1/2/1996 12:30", "1/2/1996 24:00", "0/1/1996", "1/2/0000", "+12345-1-2", "-1996-1-2", "2  May 1996 1:2", "005/1/2020", "1/2/1996x", "2 May 1996 "]
    texts += ["".join(rng.choice("0123456789/-. :MayJunSep,£(−") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    c = F.col("t")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", (money(c) * 100).cast("decimal(20,0)").cast("string"), whole_number(c), invoices.plain_label(c), invoices.value_kind(c), printed_date(c).isNotNull(), F.trim(c).rlike(invoices.FOOTER)).collect()
    for t, *want in got:
        pennies, whole, label, _, footer = box_reader.reads(t)
        assert [None if pennies is None else str(pennies), whole, label, box_reader.value_kind(t), box_reader.is_date(t), footer] == want, t


def test_boxes_are_dealt_once_and_nothing_is_written(spark, monkeypatch):
    boxes = spark.createDataFrame(_faulty(random.Random(1), 3), BOX)
    monkeypatch.setattr(invoices, "written", None)
    for read in (invoices.invoice_documents, invoices.invoice_lines, invoices.invoice_fields):
        found = read(boxes)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert found.count() > 0


def test_tables_are_read_in_the_task(spark):
    head = [("Description", 0.0, 10.0), ("Qty", 100.0, 10.0), ("Price", 200.0, 10.0), ("Amount", 300.0, 10.0)]
    rows = [("MUG", 0.0, 40.0), ("2", 101.0, 40.0), ("1.50", 202.0, 40.0), ("3.00", 300.0, 40.0), ("in a box", 0.0, 53.0), ("CUP", 0.0, 70.0), ("1", 100.0, 70.0), ("4.00", 200.0, 70.0), ("4.00", 300.0, 70.0)]
    foot = [("Total due:", 200.0, 110.0), ("7.00", 300.0, 110.0), ("9.99", 0.0, 110.0), ("Thank you", 0.0, 150.0)]
    wrong = [(t if t != "7.00" else "8.00", x, y) for t, x, y in foot]
    boxes = [(doc, 1, t, x, x + 30, y, y + 10) for doc, own in enumerate((head + rows + foot, head + rows + wrong, rows + foot[:0], head, rows[:4])) for t, x, y in own] + [(9, 1, None, 1.0, 2.0, 3.0, 4.0)]
    random.Random(2).shuffle(boxes)
    found = layout.extracted_invoices(spark.createDataFrame(boxes, BOX))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    # without a header row the row above the first amounts is taken, and here there is none
    assert sorted((r["doc"], r["items"], r["quantity"], float(r["amount"]), float(r["total"]), r["consistent"]) for r in found.collect()) == [(0, 2, 3, 7.0, 7.0, True), (1, 2, 3, 7.0, 8.0, False)]
