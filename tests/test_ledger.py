"""Batches that are loaded once, as a whole and reconciled."""

import pytest
from pyspark.sql import functions as F

from sparkloom.session import new_path
from sparkloom.sources import versions
from sparkloom.streaming import ledger

KIND = "line_key string, n long, drop_key string"


def _rows(spark, *rows):
    return spark.createDataFrame([(f"k{k}", k, d) for k, d in rows], KIND)


def _held(spark, path):
    return sorted((r["line_key"], r["n"], r["drop_key"]) for r in ledger.published(spark, path).collect())


def test_batches_are_loaded_once(spark):
    path = new_path(spark)
    assert ledger.published(spark, path) is None
    first = _rows(spark, (1, "a"), (2, "a"), (2, "a"), (3, None))
    assert ledger.load(first, path, 0, expected=3) == {"rows": 3, "inserted": 3, "unchanged": 0, "source": "", "batch": 0, "loaded": True}
    assert ledger.load(first, path, 0)["loaded"] is False
    assert ledger.load(first, path, 0, source="other")["unchanged"] == 3
    again = ledger.load(_rows(spark, (1, "a"), (3, None), (4, "b")), path, 1)
    assert (again["inserted"], again["unchanged"]) == (1, 2)
    assert _held(spark, path) == [("k1", 1, "a"), ("k2", 2, "a"), ("k3", 3, None), ("k4", 4, "b")]
    told = ledger.entries(spark, path).orderBy("version").collect()
    assert [(r["source"], r["batch"], r["rows"], r["inserted"]) for r in told] == [("", 0, 3, 3), ("other", 0, 3, 0), ("", 1, 3, 1)]


def test_nothing_is_published_that_doesnt_fit(spark):
    path = new_path(spark)
    ledger.load(_rows(spark, (1, "a")), path, 0)
    with pytest.raises(ledger.ReconciliationError, match="has 2 rows, not 3"):
        ledger.load(_rows(spark, (1, "a"), (2, "a")), path, 1, expected=3)
    with pytest.raises(ledger.ReconciliationError, match="too few"):
        ledger.load(_rows(spark, (2, "a")), path, 1, checks=(lambda batch, old, staged: ["too few"] if staged.count() < old.count() + 1 else [],))
    with pytest.raises(ledger.ReconciliationError, match="1 of 1 rows"):  # a row that got lost
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(ledger, "_read", lambda s, p, state, read=ledger._read: read(s, p, state).where("line_key <> 'k5'"))
            ledger.load(_rows(spark, (5, "a")), path, 1)
    assert _held(spark, path) == [("k1", 1, "a")] and ledger.entries(spark, path).count() == 1
    assert ledger.load(_rows(spark, (2, "a")), path, 1)["loaded"]


def test_loads_that_died_and_rivals(spark, monkeypatch):
    path = new_path(spark)
    ledger.load(_rows(spark, (1, "a")), path, 0)
    _rows(spark, (7, "a")).write.partitionBy("drop_key").parquet(f"{path}/data/load=died")
    assert _held(spark, path) == [("k1", 1, "a")]
    commit, rivals = versions.commit, [1]

    def contested(s, p, content, after):
        if rivals:
            rivals.pop()
            ledger.load(_rows(spark, (2, "a")), path, 0, source="rival")
        return commit(s, p, content, after)

    monkeypatch.setattr(versions, "commit", contested)
    assert ledger.load(_rows(spark, (2, "a"), (3, "a")), path, 1)["inserted"] == 1  # tried again, the rival's row is there
    assert [k for k, *_ in _held(spark, path)] == ["k1", "k2", "k3"]
    ledger.compact(spark, path)
    assert len(versions.latest(spark, path)[1]["folders"]) == 1 and [k for k, *_ in _held(spark, path)] == ["k1", "k2", "k3"]
    assert ledger.drop_unused(spark, path) >= 3 and len(_held(spark, path)) == 3
    assert ledger.load(_rows(spark, (3, "a")), path, 1)["loaded"] is False


def test_streams_fill_the_ledger(spark):
    source, path, marks = (new_path(spark) for _ in range(3))
    read = lambda: spark.readStream.schema(KIND).parquet(source)
    for step, rows in enumerate([[(1, "a"), (2, "a")], [(2, "a"), (3, "b")]]):
        _rows(spark, *rows).write.mode("append").parquet(source)
        ledger.stream_into(read(), path, marks, prepare=lambda b: b.withColumn("n", F.col("n") * 10)).awaitTermination()
        ledger.stream_into(read(), path, marks).awaitTermination()  # nothing new
        assert ledger.entries(spark, path).count() == step + 1
    assert _held(spark, path) == [("k1", 10, "a"), ("k2", 20, "a"), ("k3", 30, "b")]
    # a stream that lost its marks brings the first batch again
    ledger.stream_into(read(), path, new_path(spark)).awaitTermination()
    assert len(_held(spark, path)) == 3
