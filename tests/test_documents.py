"""Invoices and outlines: the closed forms against the loops they stand for, and known pages."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import invoices, outline

BOX = "doc long, page long, text string, x0 double, x1 double, top double, bottom double"


def _state(rows):
    """Whether the table is read at each row, row by row."""
    active, since, out = True, None, []
    for page, stops, resumes in rows:
        if not active and resumes and page > since:
            active = True
            out.append(False)
            continue
        if active and stops:
            active, since = False, page
        out.append(active and not resumes)
    return out


def test_table_state_over_pages(spark):
    rng, rows, want = random.Random(6), [], {}
    for doc in range(150):
        own, last = [], 0
        for page in range(rng.randint(1, 6)):
            for _ in range(rng.randint(0, 5)):
                stops = rng.random() < 0.25
                own.append((page, stops, page > 0 and not stops and rng.random() < 0.25))
        for line, (r, a) in enumerate(zip(own, _state(own), strict=True)):
            rows.append((doc, r[0], line, r[1], r[2]))
            want[doc, line] = a
    found = invoices.active_rows(spark.createDataFrame(rows, "doc int, page int, line int, stops boolean, resumes boolean")).collect()
    assert {(r["doc"], r["line"]): r["active"] for r in found} == want


def test_boxes_are_split_at_columns(spark):
    edges = spark.createDataFrame([(1, 100.0), (1, 200.0)], "doc long, edge double")
    boxes = [(1, 1, "6 PINK HAPPY BUNTING", 92.0, 192.0, 0.0, 10.0), (1, 1, "one", 90.0, 210.0, 0.0, 10.0), (1, 1, "in one column", 110.0, 190.0, 0.0, 10.0), (1, 1, "a  b          c", 50.0, 250.0, 0.0, 10.0), (2, 1, "no edges here", 0.0, 900.0, 0.0, 10.0)]
    found = [tuple(r)[2:] for r in invoices.split_boxes(spark.createDataFrame(boxes, BOX), edges).select("doc", "page", "text", "x0", "x1").collect()]
    assert sorted(found) == sorted([("6", 92.0, 97.0), ("PINK HAPPY BUNTING", 102.0, 192.0), ("one", 90.0, 210.0), ("in one column", 110.0, 190.0), ("a b", 50.0, 103.3), ("c", 236.7, 250.0), ("no edges here", 0.0, 900.0)])


def _page(rows, page=1, doc=1):
    """Boxes of rows (y, [(text, x0), ...])."""
    return [(doc, page, t, float(x), float(x) + 5 * len(t), float(y), float(y) + 10) for y, own in rows for t, x in own]


def _fields(spark, boxes):
    placed = invoices.numbered_rows(spark.createDataFrame(boxes, BOX))
    return {r["field"]: (r["value"], r["label"], r["by"]) for r in invoices.header_fields(invoices.header_pairs(placed)).collect()}


def test_fields_beside_below_and_inside(spark):
    side = _page([(0, [("Acme Ltd", 0), ("Leeds", 60)]), (50, [("Invoice no.", 300), ("489434", 400)]), (64, [("Datum", 303), ("1 December 2009", 398)]), (86, [("Sold to", 300), ("United Kingdom", 404)]), (150, [("Kind of paper", 300), ("Green", 400)])])
    assert _fields(spark, side) == {"number": ("489434", "Invoice no.", "label"), "date": ("1 December 2009", "Datum", "elimination"), "country": ("United Kingdom", "Sold to", "elimination")}
    below = _page([(50, [("Invoice number", 40), ("Issued", 160), ("Who", 280)]), (64, [("C489449", 43), ("2010-01-05", 156), ("12345", 280)])])
    assert _fields(spark, below) == {"number": ("C489449", "Invoice number", "label"), "date": ("2010-01-05", "Issued", "label"), "customer": ("12345", "Who", "elimination")}
    assert _fields(spark, _page([(50, [("Invoice no.: 489434", 40)]), (64, [("Remarks", 40), ("Date: 05/01/2010", 300)])])) == {"number": ("489434", "Invoice no.:", "label"), "date": ("05/01/2010", "Date:", "label")}


def test_blocks_of_pairs_grow_until_stable(spark):
    rng = random.Random(9)
    for _ in range(4):
        tops = sorted(rng.sample(range(20, 520, 8), 14))
        known = set(rng.sample(range(14), 2))
        rows = [(t, [("Invoice no" if i in known else f"label {i}", 300), (f"value {i}", 400)]) for i, t in enumerate(tops)]
        placed = invoices.numbered_rows(spark.createDataFrame(_page(rows), BOX))
        found = {r["label"] for r in invoices.header_pairs(placed).where("found = 'block'").collect()}
        members, grown = [tops[i] for i in known], True
        rest = {i: t for i, t in enumerate(tops) if i not in known}
        taken = set()
        while grown:
            near = {i for i, t in rest.items() if i not in taken and any(abs(t - m) <= 22.0 for m in members)}
            grown = bool(near)
            taken |= near
            members += [rest[i] for i in near]
        assert found == {f"label {i}" for i in taken}


HEAD = [("Code", 40), ("Qty", 110), ("Description", 165), ("Price", 330), ("Amount", 420)]


def _item(y, code, qty, name, price, amount):
    return (y, [(t, x) for t, x in ((code, 40), (qty, 112), (name, 165), (price, 332), (amount, 422)) if t])


def _read(spark, boxes):
    docs, items, _ = invoices.read_invoices(spark.createDataFrame(boxes, BOX))
    return docs.collect(), [(r["item"], r["code"], r["description"], r["quantity"], float(r["unit_price"] or 0), float(r["amount"] or 0)) for r in items.orderBy("doc", "item").collect()]


def test_table_pauses_between_pages_and_stops_at_totals(spark):
    first = [(20, [("Invoice no.", 300), ("489434", 400)]), (34, [("Date", 300), ("2010-01-05", 400)]), (100, HEAD), _item(130, "A1", "2", "PINK MUG", "1.50", "3.00"), (142, [("with a lid", 165)]), _item(160, "A2", "1", "LAMP", "4.00", "4.00"), (300, [("see over", 165)]), _item(320, "A9", "9", "NOT AN ITEM", "1.00", "9.00"), (700, [("Page 1 of 3", 250)])]
    second = [(20, [("Invoice 489434", 40)]), _item(40, "A8", "8", "BEFORE THE HEADER", "1.00", "8.00"), (700, [("Page 2 of 3", 250)])]
    third = [(60, HEAD), _item(90, "A3", "3", "RED CUP", "1.00", "3.00"), (130, [("Items:", 330), ("3", 422)]), (144, [("Subtotal", 330), ("10.00", 422)]), (158, [("Total due:", 330), ("£10.00", 422)]), (172, [("Total", 330), ("99.00", 422)])]
    docs, items = _read(spark, _page(first) + _page(second, 2) + _page(third, 3))
    assert items == [(1, "A1", "PINK MUG with a lid", 2, 1.5, 3.0), (2, "A2", "LAMP", 1, 4.0, 4.0), (3, "A3", "RED CUP", 3, 1.0, 3.0)]
    d = docs[0]
    assert (d["number"], d["lines"], float(d["total"]), float(d["subtotal"]), d["item_count"], d["total_by"]) == ("489434", 3, 10.0, 10.0, 3, "label")
    assert d["lines_multiply"] and d["total_fits"] and d["count_fits"] and d["header_complete"] and d["sign_fits"] and not d["credit_note"]


@pytest.mark.parametrize("fault", ["price", "total", "count", "sign", "date", "none"])
def test_checks_find_faults(spark, fault):
    rows = [(20, [("Invoice no.", 300), ("489434", 400)]), *([(34, [("Date", 300), ("2010-01-05", 400)])] if fault != "date" else []), (100, HEAD), _item(130, "A1", "2", "PINK MUG", "1.60" if fault == "price" else "1.50", "3.00"), _item(160, "A2", "1", "LAMP", "4.00", "4.00"),
            (190, [("Items", 330), ("4" if fault == "count" else "2", 422)]), (204, [("Total", 330), ({"total": "8.00", "sign": "(7.00)"}.get(fault, "7.00"), 422)])]
    d = _read(spark, _page(rows))[0][0]
    seen = {"price": d["lines_multiply"], "total": d["total_fits"], "count": d["count_fits"], "sign": d["sign_fits"], "date": d["header_complete"]}
    assert {k for k, v in seen.items() if not v} == ({"sign", "total"} if fault == "sign" else {fault} - {"none"})


def test_pages_without_a_table_or_boxes(spark):
    docs, items = _read(spark, _page([(20, [("A letter", 40)]), (40, [("of two rows", 40)])]))
    assert items == [] and docs[0]["lines"] == 0 and docs[0]["lines_multiply"] is False and docs[0]["total"] is None
    none, lines, fields = invoices.read_invoices(spark.createDataFrame([], BOX))
    assert (none.count(), lines.count(), fields.count()) == (0, 0, 0)


def test_running_lines_in_margins(spark):
    lines = [(1, p, n, t, top, top + 10.0, size) for p in range(1, 6) for n, (t, top, size) in enumerate([(f"Report 2023 | {p}", 10.0, 9.0), ("a line" if p < 3 else f"line {p}", 70.0, 10.0), ("Table", 300.0, 10.0), ("Table", 400.0, 10.0), ("text that ends", 500.0, 10.0), ("Acme", 770.0, 9.0), (f"- {p} -", 785.0, 9.0)])]
    lines += [(2, p, 0, f"Chapter {p}", 10.0, 24.0, 20.0) for p in range(1, 5)] + [(3, 1, 0, "Acme", 10.0, 20.0, 10.0), (3, 2, 0, "Acme", 10.0, 20.0, 10.0), (4, 1, 0, "Acme", 10.0, 20.0, 10.0)]
    frame = spark.createDataFrame(lines, "doc long, page long, line long, text string, top double, bottom double, size double")
    pages = frame.select("doc", "page").distinct().withColumn("height", F.lit(800.0))
    body = spark.createDataFrame([(d, 10.0) for d in (1, 2, 3, 4)], "doc long, body double")
    kept = outline.without_margins(frame, pages, body)
    assert kept.columns == frame.columns
    texts = [(r["doc"], r["text"]) for r in kept.orderBy("doc", "page", "line").collect()]
    assert [t for d, t in texts if d == 1] == [t for p in range(1, 6) for t in ("a line" if p < 3 else f"line {p}", "Table", "Table", "text that ends")]
    assert [t for d, t in texts if d > 1] == [f"Chapter {p}" for p in range(1, 5)] + ["Acme"]


def test_run_in_labels(spark):
    blocks = [("heading", "1 Scope", 14.0), ("heading", "Note:", 10.0), ("para", "it runs on.", 10.0), ("para", "alone", 10.0), ("heading", "First:", 10.0), ("heading", "GOVERN 1:", 10.0), ("para", "text", 10.0), ("heading", "Last:", 10.0)]
    rows = [(1, 1, i, k, t, s, 10.0) for i, (k, t, s) in enumerate(blocks)] + [(1, 2, 20, "para", "on the next page", 10.0, 10.0)]
    found = outline.run_in_labels(spark.createDataFrame(rows, "doc long, page long, place long, kind string, text string, size double, body double"))
    assert [(r["kind"], r["text"]) for r in found.orderBy("place").collect()] == [("heading", "1 Scope"), ("para", "Note: it runs on."), ("para", "alone"), ("para", "First:"), ("para", "GOVERN 1: text"), ("para", "Last:"), ("para", "on the next page")]


def test_outline_is_a_tree(spark):
    heads = [("Report", 20.0), ("1 Scope", 14.0), ("1.1 Aims", 10.0), ("Remarks", 10.0), ("1.2 Means", 10.0), ("2 Results", 14.0), ("Appendix A", 10.0), ("Tables", 10.0)]
    rows = [(1, i, 1 + i // 3, t, s, 10.0) for i, (t, s) in enumerate(heads)]
    tree = outline.outline(spark.createDataFrame(rows, "doc long, place long, page int, text string, size double, body double"))
    found = [(r["level"], r["parent"], r["until"]) for r in tree.orderBy("place").collect()]
    assert found == [(1, None, None), (2, 0, 5), (3, 1, 4), (4, 2, 4), (3, 1, 5), (2, 0, None), (3, 5, None), (4, 6, None)]
    assert tree.where("title = 'Remarks'").first()["path"] == ["Report", "1 Scope", "1.1 Aims", "Remarks"]
    assert outline.nested(tree).first()["outline"].split("\n")[:3] == ["- Report (1)", "  - 1 Scope (1)", "    - 1.1 Aims (1)"]
