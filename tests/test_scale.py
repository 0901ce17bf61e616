"""Steps whose work must follow their input's rows, not the values in them or the number of shuffle partitions."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import queries, session
from sparkloom.functions.columns import money, printed_date, stem, stems, whole_number
from sparkloom.operators import answers, etl, invoices, layout, orders, outline, retrieval, term_index
from sparkloom.session import dealt
from sparkloom.sources import files, views


def _emptiest(boxes, heads):
    """The boundaries strip by strip."""
    out, heads = {}, sorted(heads)
    for (place, _, x1), (_, x0, _) in zip(heads, heads[1:], strict=False):
        lo, hi, mid = int(x1 // 1), int(x0 // 1) + 1, (x1 + x0) / 2
        over = {x: sum(min(a, b) // 1 <= x <= max(a, b) // 1 for a, b in boxes) for x in range(lo, hi + 1)}
        out[place] = float(min(over, key=lambda x: (over[x], abs(x - mid), x))) if hi > lo else mid
    return out


def test_gutters_strip_by_strip(spark):
    rng, boxes, heads = random.Random(3), {}, {}
    for doc in range(40):
        edges = sorted(rng.uniform(0, 120) for _ in range(8))
        heads[doc] = [(i, edges[2 * i], edges[2 * i + 1]) for i in range(4)]
        boxes[doc] = [(a, a + rng.uniform(-3, 30)) for a in (rng.uniform(-10, 130) for _ in range(rng.randint(0, 12)))]
    found = layout.gutters(
        spark.createDataFrame([(d, *b) for d, own in boxes.items() for b in own], "doc long, x0 double, x1 double"), spark.createDataFrame([(d, *h) for d, own in heads.items() for h in own], "doc long, place int, x0 double, x1 double")
    )
    assert {(r["doc"], r["place"]): r["edge"] for r in found.collect()} == {(d, p): e for d in heads for p, e in _emptiest(boxes[d], heads[d]).items()}


def test_gutters_of_very_wide_boxes(spark):
    heads = spark.createDataFrame([(1, 0, 0.0, 1e9), (1, 1, 3e9, 4e9)], "doc long, place int, x0 double, x1 double")
    boxes = spark.createDataFrame([(1, 0.0, 1.5e9), (1, 2e9, 4e9)], "doc long, x0 double, x1 double")
    assert [tuple(r) for r in layout.gutters(boxes, heads).collect()] == [(1, 0, 2e9 - 1)]


def test_tasks_follow_the_rows(spark):
    rows = spark.range(400_000)
    assert dealt(rows, rows, "id").rdd.getNumPartitions() == 8 and dealt(rows, rows.limit(10), "id").rdd.getNumPartitions() == 4


def _best_texts(docs, asked, k):
    """Rankings text by text, in plain Python; docs has a list of words a row."""
    out, counts = set(), {}
    for i, words in docs:
        for w in words:
            counts.setdefault(i, {}).setdefault(w, 0)
            counts[i][w] += 1
    for query, own in asked.items():
        hits = [(sum(t in c for t in own), -round(s / (s + 1), 9), i) for i, c in counts.items() for s in [sum(math.log1p(c.get(t, 0)) for t in own)] if s]
        whole = [h for h in hits if h[0] == len(own)]
        out |= {(query, i, n, -s, rank) for rank, (s, i, n) in enumerate(sorted((s, i, n) for n, s, i in whole or hits)[:k], 1)}
    return out


def test_keyword_rankings_text_by_text(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = [(i % 90, [rng.choice(words) for _ in range(rng.randint(1, 9))]) for i in range(100)]  # some ids twice
    asked = {q: rng.sample([*words, "x1", "x2"], 3) for q in range(25)} | {98: ["x1"], 99: ["w1", "x1", "x2"]}
    texts = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)
    rows = spark.createDataFrame([(q, t) for q, own in asked.items() for t in own], "query long, term string")
    for block, terms in ((1 << 20, 1 << 17), (40, 20)):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        monkeypatch.setattr(retrieval, "PASS_TERMS", terms)
        found = retrieval.keyword_rankings(texts, "doc_id", "text", rows, 7)
        assert {(r["query"], r["id"], r["matched"], round(r["score"], 9), r["rank"]) for r in found.collect()} == _best_texts(docs, asked, 7)


def test_keyword_rankings_shuffle_no_hits(spark):
    texts, asked = spark.createDataFrame([(i, "same words here") for i in range(4000)], "doc_id long, text string"), spark.createDataFrame([(q, t) for q in range(100) for t in ("same", "words")], "query long, term string")
    plan = retrieval.keyword_rankings(texts, "doc_id", "text", asked, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_hits_are_kept_in_blocks():
    held, least = [], None
    rng = random.Random(2)
    hits = [(q, i, round(rng.random(), 1)) for q in range(3) for i in range(50)]
    rng.shuffle(hits)
    for at in range(0, len(hits), 9):
        own = hits[at : at + 9]
        held, least = retrieval._keep_best(held, [np.array(x) for x in zip(*own, strict=True)], 3, 4)
    assert list(zip(*[x.tolist() for x in held], strict=True)) == [(q, i, s) for q in range(3) for s, i in [(-s, i) for s, i in sorted((-s, i) for p, i, s in hits if p == q)[:4]]]
    assert least.tolist() == [held[2][4 * q + 3] for q in range(3)]


def test_upload_limits_hold_for_each_file(spark, tmp_path):
    for name, n in (("a.csv", 3), ("b.csv", 3)):
        (tmp_path / name).write_text("k,v\n" + "".join(f"{i},x\n" for i in range(n)))
    assert files.read_upload(spark, str(tmp_path), files.UploadLimits(max_rows=3)).count() == 6
    with pytest.raises(files.Rejected):
        files.read_upload(spark, str(tmp_path), files.UploadLimits(max_rows=2))


def test_postings_take_each_text_apart_once(spark):
    rows = spark.createDataFrame([(1, 0, "c", "Apples", "the pie of apples"), (1, 1, "c", None, "defines apples"), (1, 2, "c", "x", None)], "id long, ordinal int, collection string, heading string, text string")
    found = term_index.postings(rows.repartition(3, "id", "ordinal"))
    plan = found._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("regexp_extract_all") == 2 and plan.executedPlan().toString().count("Exchange") == 1
    held = {(r["term"], r["ordinal"]): [tuple(p) for p in r["places"]] for r in found.collect()}
    assert held == {("apple", 0): [(1, True), (6, False)], ("pie", 0): [(4, False)], ("apple", 1): [(2, False)], ("define", 1): [(1, False)], (term_index.DEFINES, 1): [(1, False)], ("x", 2): [(1, True)]}


def test_postings_of_a_term_are_shared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(term_index, "CHARS_PER_TASK", 100)
    docs = spark.createDataFrame([(i, "c", "t", "apple " * 20) for i in range(30)], "id long, collection string, title string, text string")
    index = term_index.update(docs, str(tmp_path / "i"), buckets=2)
    files = {r[0] for r in index._read("postings").where("term = 'apple'").select("_metadata.file_path").collect()}
    assert len(files) > 3 and index._read("postings").count() == 30


def test_indexes_are_built_in_passes_and_searched_in_blocks(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "en", "t", f"apple word{i % 5} refers to plum {i}. pear word{i % 3}") for i in range(60)], "id long, collection string, title string, text string")
    queries = spark.createDataFrame([(q, None, f"apple word{q % 5}" if q % 2 else f'"word{q % 3}" or plum -apple') for q in range(12)], "query long, collection string, text string")
    whole = term_index.update(docs, str(tmp_path / "whole"), buckets=2)
    rows = lambda df: sorted(map(tuple, df.drop("segment").collect()))
    wanted, defined = rows(term_index.search(whole, queries)), rows(term_index.definitions(whole, queries))
    posted, blocks, search, shuffles = [], [], term_index._search, []
    monkeypatch.setattr(term_index, "CHARS_PER_TASK", 300)
    monkeypatch.setattr(term_index, "CHARS_PER_PASS", 1200)
    monkeypatch.setattr(term_index, "HITS_PER_BLOCK", 500)
    make = term_index.postings
    monkeypatch.setattr(term_index, "postings", lambda *a: (posted.append(1), make(*a))[1])
    monkeypatch.setattr(term_index, "_search", lambda *a: (blocks.append(search(*a)), shuffles.append(spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")), blocks[-1])[2])
    parts = term_index.update(docs, str(tmp_path / "parts"), buckets=2)
    assert len(posted) > 1 and rows(parts._read("postings").select("term", "id", "ordinal")) == rows(whole._read("postings").select("term", "id", "ordinal"))
    assert rows(term_index.search(parts, queries)) == wanted and len(blocks) > 1 and set(shuffles) == {"false"}
    assert rows(term_index.definitions(parts, queries)) == defined
    assert not any(os.path.exists(folder.removeprefix("file://")) for _, folders in blocks for folder in folders)
    again = term_index.compacted(parts)
    assert rows(term_index.search(again, queries)) == wanted


def test_shuffles_of_written_tables_are_deleted(spark, tmp_path):
    seen = []

    class Frame:  # what is set while a frame is written
        sparkSession, schema = spark, spark.range(1).schema
        write = property(lambda self: self)

        def parquet(self, path):
            seen.append(spark.conf.get(session.CLEAN_SHUFFLES))
            spark.range(1).write.parquet(path)

    session.written(Frame())
    assert seen == ["true"] and spark.conf.get(session.CLEAN_SHUFFLES, "false") == "false"


def test_one_pattern_decides_for_texts_that_are_no_numbers(spark):
    rows = [("1,234.50", -1), ("(£12.00)", 1), ("−£ 3.10", 1), ("£-3.10", 1), ("GBP 7.00", 0), ("12", 0), ("(1,000)", 1), ("(-5)", 1), ("-(5)", 0), ("(5", 0), ("1,23", 0), ("", 0), (None, 0), ("x", 0), ("99999999999999999999", 0), ("12.00\n", 0), ("--1.00", 1)]
    texts = spark.createDataFrame(rows, "t string, n int").select("t", money(F.col("t")).cast("string").alias("m"), whole_number(F.col("t")).alias("w"))
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 4 and "regexp_extract" not in plan
    held = {r["t"]: (r["m"], r["w"]) for r in texts.collect()}
    assert held == {"1,234.50": ("1234.50", None), "(£12.00)": ("-12.00", None), "−£ 3.10": ("-3.10", None), "£-3.10": ("-3.10", None), "GBP 7.00": ("7.00", None), "12": (None, 12), "(1,000)": (None, -1000), "(-5)": (None, -5), "-(5)": (None, None), "(5": (None, None), "1,23": (None, None), "": (None, None), None: (None, None), "x": (None, None), "99999999999999999999": (None, None), "12.00\n": ("12.00", None), "--1.00": ("-1.00", None)}


def test_texts_that_are_no_dates_are_not_parsed(spark):
    texts = spark.createDataFrame([(t,) for t in ("3/4/2024", "2024-3-4 9:05", "4 March 2024", "4  Mar 2024", "4.3.2024", "4-Mar-2024", "4-3-2024", "1,234.50", "A12", "soon", None)], "t string").select("t", printed_date(F.col("t")).cast("string").alias("d"))
    assert texts._jdf.queryExecution().optimizedPlan().toString().upper().count("CASE WHEN") > 1
    assert [r["d"] for r in texts.collect()] == ["2024-04-03 00:00:00", "2024-03-04 09:05:00", *["2024-03-04 00:00:00"] * 4, None, None, None, None, None]


def test_defining_passages_are_looked_up_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "c", "t", f"apple {i} defines pie") for i in range(6)], "id long, collection string, title string, text string")
    index, asked = term_index.update(docs, str(tmp_path / "i"), buckets=2), []
    lookup = term_index.TermIndex.lookup
    monkeypatch.setattr(term_index.TermIndex, "lookup", lambda self, rows: (asked.append(rows), lookup(self, rows))[1])
    subjects = spark.createDataFrame([(q, None, "apple") for q in range(5)], "query long, collection string, text string")
    assert term_index.definitions(index, subjects).count() == 30
    assert sum(rows.where(F.col("term") == term_index.DEFINES).count() for rows in asked) == 1


def test_fields_and_lines_are_read_alone(spark, monkeypatch):
    boxes = spark.createDataFrame([(1, 1, "Invoice no.", 300.0, 340.0, 50.0, 60.0), (1, 1, "123456", 400.0, 440.0, 50.0, 60.0)], "doc long, page long, text string, x0 double, x1 double, top double, bottom double")
    with monkeypatch.context() as m:
        m.setattr(invoices, "content_roles", None)
        assert [(r["doc"], r["field"], r["value"]) for r in invoices.invoice_fields(boxes).collect()] == [(1, "number", "123456")]
    monkeypatch.setattr(invoices, "header_pairs", None)
    assert invoices.invoice_lines(boxes).count() == 0


def test_drops_are_compared_before_they_are_typed(spark):
    raw = [("123456", "10002a", "NAME  x", "2", "1996-02-03 08:26:00", "1.25", "7", "UK"), ("123456", "10002a", "NAME  x", "2", "1996-02-03 08:26:00", "1.25", "7", "UK"), ("123457", "test1", "n", "2", "1996-03-03 08:26:00", "1.25", "8", "UK")]
    rows = spark.createDataFrame([(*r, "1996-02", i) for i, r in enumerate(raw)], ", ".join(f"`{c}` string" for c in etl.RAW) + ", period string, line_number long")
    products, customers = spark.createDataFrame([("10002A", "name X")], "stock_code string, description string"), spark.createDataFrame([(7,)], "customer_id long")
    found = etl.validate(rows, F.col("period"), products, customers, within=("period",))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.find("Join") < plan.find("Window") < plan.rfind("xxhash64")
    held = {r["line_number"]: r for r in found.collect()}
    assert [(held[i]["reason"], held[i]["severity"], held[i]["warnings"], held[i]["line_type"]) for i in range(3)] == [(None, None, ["stock_code_normalised"], "product"), ("duplicate_line", "dropped", None, None), ("outside_drop_period", "reject", None, None)]


def test_drops_are_written_before_they_are_judged(spark, monkeypatch):
    made, sf, write = [], "/root/testdata/sf0.001", queries.written_at
    monkeypatch.setattr(views, "_derived", {})
    monkeypatch.setattr(queries, "written_at", lambda df, *a: (made.append(write(df, *a)), made[-1])[1])
    judged = queries._judged(spark, sf)
    wanted = queries._validated(spark, sf).groupBy("period", "reason").count()
    assert sorted(map(repr, judged.groupBy("period", "reason").count().collect())) == sorted(map(repr, wanted.collect()))
    assert len(made) == 1 and not os.path.exists(made[0][1].removeprefix("file://"))  # and gone when they are


def test_cheap_comparisons_are_the_plain_ones(spark):
    texts = ["abc", "ABC", "ab", "straße", "STRASSE", "é", "É", "", None]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    assert pairs.where(~etl._same_but_case(F.col("a"), F.col("b")).eqNullSafe(F.upper("a") == F.upper("b"))).count() == 0
    times = spark.createDataFrame([("1996-02-03 04:05:06",), ("0007-12-01 00:00:00",), ("+12345-01-02 00:00:00",), (None,)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert times.where(~etl._month(F.col("t")).eqNullSafe(F.substring(F.col("t").cast("string"), 1, 7))).count() == 0


def test_known_lines_follow_the_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i // 3, "c", None, i, "1996-01-01", 1.5, 7, "UK") for i in range(90)], "invoice long, stock_code string, description string, quantity long, invoice_date string, price double, customer_id long, country string")
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    found = orders.known_lines(rows, rows)
    assert found.rdd.getNumPartitions() == 9 and found.where("line_no <= 3").count() == 90


def test_matched_products_make_no_row_of_a_word(spark):
    clauses = spark.createDataFrame([(1, 1, ["two", "red", "hats", "hats"], 9), (1, 2, ["red"], None), (1, 3, [None], 1), (2, 1, ["x"], 1)], "text_id long, clause long, words array<string>, quantity long")
    products = spark.createDataFrame([(1, 5, ["red", "hats"], 4), (1, 6, ["red", "cup", None], 4), (3, 5, ["x"], 4)], "text_id long, product_id long, words array<string>, held long")
    found = orders.matched_products(clauses, products)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, 1, 5, 4)]


def test_cells_are_joined_without_windows_and_read_once(spark):
    boxes = spark.createDataFrame([(1, 1, "c", 5.0, 8.0, 20.0, 30.0), (1, 1, "b", 9.0, 12.0, 1.0, 11.0), (1, 1, "a", 1.0, 4.0, 0.0, 10.0), (1, 1, "2", 60.0, 70.0, 0.0, 10.0), (1, 1, None, 160.0, 170.0, 0.0, 10.0), (2, 1, "x", 60.0, 70.0, 0.0, 10.0)], "doc long, row long, text string, x0 double, x1 double, top double, bottom double")
    edges = spark.createDataFrame([(1, 0, 50.0), (1, 1, 150.0)], "doc long, place int, edge double")
    table = layout.cells(boxes, edges)
    assert "Window" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in table.collect()) == [(1, 1, 0, "a b c"), (1, 1, 1, "2"), (1, 1, 2, ""), (2, 1, 0, "x")]
    rows = spark.createDataFrame([(1, 1, 0, "2"), (1, 1, 1, "1.50"), (1, 1, 2, "3.00")], "doc long, row long, column int, text string")
    roles = layout.column_roles(rows)
    assert roles._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= 5
    assert [tuple(r) for r in roles.collect()] == [(1, 0, 1, 2)]


def test_kept_hyphens_follow_the_texts(spark, monkeypatch):
    monkeypatch.setattr(session, "TEXTS_PER_TASK", 10)
    assert session.tasks_for_texts(spark.range(95)) == 10 and session.tasks_for_texts(spark.range(5)) == 4
    lines = spark.createDataFrame([(1, 0, "a well-"), (1, 1, "known well-known x"), (2, 0, "for-"), (2, 1, "ward forward")], "doc long, line long, text string")
    found = layout.kept_hyphens(lines, 10)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") >= 3
    assert sorted((r["doc"], r["line"], r["keep_hyphen"]) for r in found.collect()) == [(1, 0, True), (1, 1, None), (2, 0, False), (2, 1, None)]


def test_chunks_hold_few_texts_at_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 20 if i % 3 else None) for i in range(30)], "doc_id long, text string").coalesce(1)
    whole = retrieval.chunks(docs, "doc_id", "text", 8).collect()
    monkeypatch.setattr(retrieval, "TEXTS_AT_A_TIME", 1)
    found = retrieval.chunks(docs, "doc_id", "text", 8)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.collect() == whole and {r["id"] for r in whole} == {i for i in range(30) if i % 3} and retrieval.chunks(docs.limit(0), "doc_id", "text").count() == 0


def test_drops_are_read_without_a_shuffle_of_lines(spark, tmp_path):
    rows = [(f"{i:06d}", "1", ' a "b", c ', "2", "1996-02-03 08:26:00", "1.25", None, "UK", f"1996-0{1 + i % 2}") for i in range(20)]
    files.write_drops(spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in etl.RAW) + ", period string"), str(tmp_path / "d"), most=4)
    assert len(list((tmp_path / "d").glob("period=1996-01/*.csv.gz"))) >= 3
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = files.read_drop(spark, str(tmp_path / "d" / "*"))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r["Invoice"], r["Description"], r["Customer ID"], r["issue"]) for r in found.collect()) == [(r[0], r[2], None, None) for r in rows]
    head = ",".join(etl.RAW)
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + head.replace(",", " , ").encode() + b"\r\n" + b"1,2,x,4,5,6,7,8\r\n \r\n\xff,2,x,4,5,6,7,8\n1,2\n" + head.encode() + b"\n")
    read = files.read_drop(spark, str(tmp_path / "a.csv")).select("line_number", "issue", "Invoice", "Country", "line").collect()
    assert sorted((r["line_number"], r["issue"], r["Invoice"], r["Country"]) for r in read) == [(2, None, "1", "8"), (4, "encoding_error", None, None), (5, "malformed_row", None, None), (6, None, "Invoice", "Country")]
    assert {r["line"] for r in read if r["line_number"] == 2} == {"1,2,x,4,5,6,7,8"}
    (tmp_path / "b.csv").write_text("1,2,x,4,5,6,7,8\n" + head + "\n")
    with pytest.raises(files.SchemaMismatch, match="b.csv: '1,2,x"):
        files.read_drop(spark, str(tmp_path / "b.csv"))


def test_rows_of_a_drop_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(*["x"] * 8, "1996-02")] * 12, ", ".join(f"`{c}` string" for c in etl.RAW) + ", period string")
    files.write_drops(rows.mapInArrow(count, rows.schema), str(tmp_path / "d"))
    assert made.value == 12


def test_headings_are_worked_out_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    heads = spark.createDataFrame([(1, 0, 1, "Report", 20.0, 10.0), (1, 1, 1, "1 Scope", 14.0, 10.0), (1, 2, 2, "1.1 Aims", 10.0, 10.0)], "doc long, place long, page int, text string, size double, body double")
    tree = outline.outline(heads.mapInArrow(count, heads.schema))
    assert sorted((r["place"], r["level"], r["parent"]) for r in tree.collect()) == [(0, 1, None), (1, 2, 0), (2, 3, 1)] and made.value == 3
    lines = spark.createDataFrame([(1, 1, 1, "Head line", 14.0, True), (1, 1, 2, "x" * 90, 10.0, False)], "doc long, page long, line long, text string, size double, bold boolean")
    found = layout.headings(lines)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with the body's size only
    assert [(r["line"], r["kind"]) for r in found.orderBy("line").collect()] == [(1, "size"), (2, None)]


def test_only_lines_that_may_be_contents_entries_are_searched(spark):
    ends = ["", " ", "\t", "\r", "\x0b", "\x0c", "\x85", "\u2028", "\u2029", "\r\x85", "\xa0", ".", "x", "\xe9"]
    texts = [(f"{a}{n}{e}",) for a in ("Aims ... ", "Aims ", "Aims..", "Aims", "") for n in ("", "7", "1234", "12345", "\u0663") for e in ends] + [(None,)]
    rows = spark.createDataFrame(texts, "text string")
    whole, may = F.col("text").rlike(layout.CONTENTS_ENTRY), F.substring("text", -1, 1).rlike(layout.ENTRY_END)
    assert rows.where(whole & ~may).count() == 0 and rows.where(whole).count() > 50 and rows.where(~may).count() > 30


def test_words_of_sentences_are_stemmed_once(spark):
    words = ["Flies", "dies", "Glasses", "glass", "king", "Singing", "bed", "Wanted", "does", "boxes", "cats", "as", "it's", "It’s", "boss's", "x", ""]
    row = spark.createDataFrame([(words,)], "w array<string>").select(stems(F.col("w")).alias("a"), F.array(*[stem(F.col("w")[i]) for i in range(len(words))]).alias("b")).first()
    assert row["a"] == row["b"] and row["a"][:4] == ["fly", "die", "glass", "glass"]
    questions = spark.createDataFrame([(1, "Are cats singing or flying?", None), (2, "x y", None)], "question_id long, question string, subject string")
    passages = spark.createDataFrame([(1, 1, "A cat sings to us. No dog flies there at all. Nothing else is here."), (2, 1, "One two three four.")], "question_id long, number int, text string")
    scores = answers.sentence_scores(questions, passages)
    assert "(?s)" not in scores._jdf.queryExecution().optimizedPlan().toString()
    held = {(r["question_id"], r["place"]): r["overlap"] for r in scores.collect()}
    assert held[1, 0] > 0 and held[1, 2] == held[2, 0] == 0 and len(held) == 4


def test_boxes_meet_their_parts_in_dealt_tasks(spark, monkeypatch):
    from sparkloom.query_sets.answers import _boxes

    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    lines = session.table(spark, "/root/testdata/sf0.001", "lineitem")
    tasks, boxes = -(-lines.count() // 500), _boxes(spark, "/root/testdata/sf0.001")
    plan = boxes._jdf.queryExecution().executedPlan().toString()
    assert tasks > 8 and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert all(f"hashpartitioning({key}" in plan for key in ("l_partkey", "p_partkey", "l_orderkey")) and plan.count(f", {tasks}), REPARTITION_BY_NUM") == 3
    assert boxes.count() == 4 * lines.count()


def test_token_sets_are_not_shuffled_again(spark):
    from sparkloom.llm.common import bucketed
    from sparkloom.llm.ngram_join import _verified

    rows = [(i, [i, i + 1, i + 2, 7, 8, 9, 10, 11, 12]) for i in range(100, 140)]
    sets = bucketed(spark.createDataFrame([*rows, rows[0]], "id long, tokens array<long>"), "id")
    pairs = spark.createDataFrame([(i, i + d) for i in range(100, 137) for d in (0, 1, 2)], "a long, b long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = _verified(pairs, sets, 75)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sets.count() == 40 and plan.count("Exchange") == 2
    assert sorted(map(tuple, found.collect())) == [(i, i + d) for i in range(100, 137) for d in (0, 1)]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("scratch_")]
