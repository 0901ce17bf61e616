"""A table that batches are loaded into, each once and as a whole, after it was reconciled.

A batch's new rows are written to a folder of their own, read back and compared with the batch; then one manifest names
the folder and the batch's entry in the ledger together. So rows and ledger can't part: a batch that fails or dies leaves an
unnamed folder, a repeated one finds its entry, and of two writers the second tries again on what the first has left.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.session import delete_path
from sparkloom.sources import versions

#: Folders after which a load joins them into one, and attempts against other writers.
MOST_FOLDERS, ATTEMPTS = 64, 5

#: What a check gets: the batch, the published rows before it (None at first) and the staged ones. It returns what is wrong.
Check = Callable[[DataFrame, "DataFrame | None", DataFrame], list[str]]


class ReconciliationError(RuntimeError):
    """What was staged isn't what the batch has; nothing was published."""


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the table; None before its first batch."""
    found = versions.latest(spark, path)
    return _read(spark, path, found[1]) if found else None


def _read(spark: SparkSession, path: str, state: dict[str, Any]) -> DataFrame:
    return spark.read.schema(state["schema"]).option("basePath", f"{path}/data").parquet(*[f"{path}/data/{f}" for f in state["folders"]]).drop("load")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(version, source, batch, rows, inserted, unchanged, committed_at): the ledger, an entry for each load that was committed."""
    rows = [(n, m["source"], m["batch"], m["rows"], m["inserted"], m["unchanged"], m["committed_at"]) for n, m in versions.manifests(spark, path) if "batch" in m]
    return spark.createDataFrame(rows, "version long, source string, batch long, rows long, inserted long, unchanged long, committed_at string")


def load(batch: DataFrame, path: str, number: int, source: str = "", key: str = "line_key", partition: str = "drop_key", checks: tuple[Check, ...] = (), expected: int | None = None) -> dict[str, Any]:
    """Load a batch unless its number, or a later one of the same source, is in the ledger; its entry, with `loaded` telling which.

    Rows whose key the table has already are unchanged and left out; a key belongs to one partition. Reconciled are: the
    batch's rows with what was expected; the staged rows with those that were to be inserted; every key of the batch with
    the table as it will be; and the given checks. Numbers of a source rise, as a stream's do.
    """
    spark = batch.sparkSession
    lines = batch.dropDuplicates([key]).persist()
    try:
        for attempt in range(ATTEMPTS):
            found = versions.latest(spark, path)
            state = found[1] if found else {"folders": [], "batches": {}}
            if number <= state["batches"].get(source, -1):
                return {"source": source, "batch": number, "loaded": False}
            before, folder = versions.next_number(spark, path), f"load={uuid.uuid4().hex}"
            old = _read(spark, path, state) if found else None
            fresh = lines
            if old is not None:
                touched = [r[0] for r in lines.select(partition).distinct().collect()]  # a batch is a few partitions
                held = old.where(F.col(partition).isin(touched) | F.lit(None in touched) & F.col(partition).isNull()).select(F.col(key).alias("_key"))
                fresh = lines.join(held, F.col(key) == F.col("_key"), "left_anti")
            fresh.write.partitionBy(partition).parquet(f"{path}/data/{folder}")
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted(lines.schema.fields, key=lambda f: f.name == partition)) + ", load string"
            after = state | {"folders": [*state["folders"], folder], "schema": schema}
            staged = _read(spark, path, after | {"folders": [folder]})
            entry = _reconciled(lines, old, staged, after, spark, path, key, partition, checks, expected)
            content = after | entry | {"source": source, "batch": number, "batches": state["batches"] | {source: number}}
            try:
                versions.commit(spark, path, content, before)
            except versions.Conflict:
                time.sleep(0.1 * 2**attempt)
                continue
            if len(after["folders"]) > MOST_FOLDERS:
                compact(spark, path, partition)
            return entry | {"source": source, "batch": number, "loaded": True}
        raise versions.Conflict(f"{path} is always written by others")
    finally:
        lines.unpersist()


def _reconciled(lines: DataFrame, old: DataFrame | None, staged: DataFrame, after: dict[str, Any], spark: SparkSession, path: str, key: str, partition: str, checks: tuple[Check, ...], expected: int | None) -> dict[str, int]:
    """The entry's numbers; the staged folder is deleted and an error raised where something doesn't fit."""
    rows, inserted = lines.count(), staged.count()
    keys = lines.select(key, partition)
    held = _read(spark, path, after).select(F.col(key).alias("_key"), F.col(partition).alias("_part"))
    missing = keys.join(held, (F.col(key) == F.col("_key")) & F.col(partition).eqNullSafe(F.col("_part")), "left_anti").count()
    problems = [] if expected is None or rows == expected else [f"the batch has {rows} rows, not {expected}"]
    problems += [f"{missing} of {rows} rows aren't in the table or in another partition"] if missing else []
    problems += [] if staged.select(key).distinct().count() == inserted else ["keys were staged twice"]
    for check in checks:
        problems += check(lines, old, staged)
    if problems:
        delete_path(spark, f"{path}/data/{after['folders'][-1]}")
        raise ReconciliationError("; ".join(problems))
    return {"rows": rows, "inserted": inserted, "unchanged": rows - inserted}


def compact(spark: SparkSession, path: str, partition: str = "drop_key") -> int:
    """The table's rows in one folder; a version of its own. Folders of before go with drop_unused()."""
    found = versions.latest(spark, path)
    if found is None:
        raise FileNotFoundError(f"no table in {path}")
    state, folder = {k: found[1][k] for k in ("folders", "batches", "schema")}, f"load={uuid.uuid4().hex}"
    _read(spark, path, state).repartition(partition).write.partitionBy(partition).parquet(f"{path}/data/{folder}")
    return versions.commit(spark, path, state | {"folders": [folder]}, found[0])


def drop_unused(spark: SparkSession, path: str) -> int:
    """Delete the folders that the newest version doesn't name; how many went. No load may be under way."""
    used = set(versions.latest(spark, path)[1]["folders"])
    folder, fs = versions._filesystem(spark, f"{path}/data")
    gone = [s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName() not in used]
    for name in gone:
        delete_path(spark, f"{path}/data/{name}")
    return len(gone)


def stream_into(stream: DataFrame, path: str, checkpoint: str, source: str = "stream", prepare: Callable[[DataFrame], DataFrame] | None = None, every: str | None = None, **options: Any) -> StreamingQuery:
    """Load each micro-batch by its number: all that is there now and stop, or, with `every` (15 minutes), again and again.

    options are those of load(). A batch that can't be reconciled stops the query; started again, it is tried again.
    """

    def each(batch: DataFrame, number: int) -> None:
        load(prepare(batch) if prepare else batch, path, number, source, **options)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
