"""Probabilities, trials with coarse parts, safe JSON, order lines of known customers and uploads in several encodings, on small inputs."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.operators import orders, trials
from sparkloom.session import new_path, write_bytes
from sparkloom.sources import files


def _probabilities(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def test_softmax_and_its_best(spark):
    rows = [(1, [1.0, 3.0, 3.0, -2.0]), (2, [1000.0, 999.0]), (3, []), (4, None), (5, [1.0, None]), (6, [1.0, float("nan")]), (7, [float("inf"), 1.0]), (8, [5.0])]
    found = {r["id"]: r for r in spark.createDataFrame(rows, "id int, x array<double>").select("id", C.softmax(F.col("x")).alias("p"), C.top_k(C.softmax(F.col("x")), 2).alias("k")).collect()}
    for i in (1, 2, 8):
        assert found[i]["p"] == pytest.approx(_probabilities(rows[i - 1][1]))
    assert all(found[i]["p"] is None and found[i]["k"] is None for i in (3, 4, 5, 6, 7))
    assert [t["label"] for t in found[1]["k"]] == [1, 2] and [t["label"] for t in found[8]["k"]] == [0]


def test_parts_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(6)]) for i in range(40)] + [(40, None), (41, [0.0, None, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    near = lambda x, fine: [v if i in fine else float(round(v)) for i, v in enumerate(x)]

    def kl(fine):
        total = 0.0
        for _, x in rows[:40]:
            a, b = _probabilities(x), _probabilities(near(x, fine))
            total += sum(p * math.log(p / q) for p, q in zip(a, b, strict=True))
        return total / 40

    want = sorted(((kl(set(range(6)) - {j}), j) for j in range(6)), reverse=True)
    got = trials.part_sensitivity(df, "x", 6, 1.0).orderBy("place").collect()
    assert [r["part"] for r in got] == [j for _, j in want] and [r["kl"] for r in got] == pytest.approx([k for k, _ in want], abs=1e-8)
    kept = {r["kept"]: r for r in trials.kept_trials(df, "x", 6, 1.0, 0.3).collect()}
    assert sorted(kept) == [0, 1, 2]
    order = [j for _, j in want]
    for k, r in kept.items():
        assert r["kl"] == pytest.approx(kl(set(order[:k])), abs=1e-5)


def test_best_trial_stops_at_the_first_that_is_enough(spark):
    rows = [("a", 0, 0.5, 0.1), ("a", 1, 0.7, 0.1), ("a", 2, 0.7, 0.1), ("a", 4, 0.95, 0.3), ("a", 8, 0.99, 0.1), ("b", 0, 0.95, 0.1), ("b", 1, 0.99, 0.0), ("c", 0, None, 0.5), ("c", 1, 0.2, 0.4), ("c", 2, 0.2, 0.4)]
    df = spark.createDataFrame(rows, "g string, kept int, share double, kl double")
    best = trials.best_trial(df, ("g",), "kept", [F.desc_nulls_last("share"), F.asc("kl")], F.col("share") >= 0.9).collect()
    assert sorted((r["g"], r["kept"]) for r in best if r["chosen"]) == [("a", 4), ("b", 0), ("c", 1)]
    assert sorted((r["g"], r["kept"]) for r in best if not r["tried"]) == [("a", 8), ("b", 1)]


def test_safe_json(spark):
    df = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")], None), (2, -1.5, None, "é\"")], "id int, x double, `v.w` array<double>, t string")
    found = [json.loads(r[0]) for r in df.select(C.safe_json(df)).orderBy("id").collect()]
    assert found == [{"id": 1, "x": None, "v.w": [1.0, None], "t": None}, {"id": 2, "x": -1.5, "v.w": None, "t": 'é"'}]


def test_known_lines(spark):
    row = ("7", "p1", "Tea", 2, "2020-01-01 08:00:00", 1.25, 5, "X")
    other = lambda **k: tuple(k.get(c, v) for c, v in zip(orders.DELIVERED, row, strict=True))
    rows = [row, row, other(customer_id=None), other(quantity=1), other(description=None), other(description=None), other(stock_code="POST"), other(invoice="8"), other(price=None), other(stock_code="a", description="Next Day Carriage")]
    df = spark.createDataFrame([(*r, "more") for r in rows], "invoice string, stock_code string, description string, quantity int, invoice_date string, price double, customer_id long, country string, more string")
    found = [tuple(r) for r in orders.known_lines(df).select("invoice_no", "line_no", "stock_code", "description", "quantity", "kind").orderBy("invoice_no", "line_no").collect()]
    assert found == [("7", 1, "POST", "Tea", 2, "shipping"), ("7", 2, "a", "Next Day Carriage", 2, "shipping"), ("7", 3, "p1", "Tea", 1, "product"), ("7", 4, "p1", "Tea", 2, "product"), ("7", 5, "p1", "Tea", 2, "product"), ("7", 6, "p1", "", 2, "product"), ("8", 1, "p1", "Tea", 2, "product")]
    assert orders.known_lines(df.limit(0)).count() == 0
    plan = orders.known_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_files_of_a_folder_have_encodings_of_their_own(spark):
    folder = new_path(spark)
    for name, data in (("a.csv", "n;v\n1;é\n2;ü\n".encode()), ("b.csv", "n;v\n3;à\n".encode("cp1252")), ("c.csv", b"\xef\xbb\xbfn;v\n4;plain\n"), ("d.csv", b"n;v\n5;\x81\n")):
        write_bytes(spark, f"{folder}/{name}", data)
    read = files.read_upload(spark, folder)
    assert read.columns == ["n", "v"] and [tuple(r) for r in read.orderBy("n").collect()] == [(1, "é"), (2, "ü"), (3, "à"), (4, "plain"), (5, "�")]
