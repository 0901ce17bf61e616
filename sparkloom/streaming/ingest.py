"""Streaming twins: windowed quotas and idempotent micro-batch publishing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from sparkloom.operators.etl import publish


def quota_stream(events: DataFrame, key: str, ts: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(key, window_start, n) of a stream; counters expire once the watermark has passed their window."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    return timed.groupBy(F.col(key), F.window("_ts", width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("window_start"), "n")


def split_by_period(rows: DataFrame, ts: str, period: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the period, and early, late or undated ones, which a watermark would drop silently."""
    inside = F.coalesce(F.date_format(ts, "yyyy-MM") == period, F.lit(False))
    return rows.where(inside), rows.where(~inside)


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str = "line_key", partition: str = "drop_key", prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Publish each micro-batch once; a replayed batch finds its keys published and adds nothing."""

    def each(batch: DataFrame, _: int) -> None:
        publish(prepare(batch) if prepare else batch, target, key, partition)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Keeps (batch, rows) of the last batches."""

    def __init__(self, most: int = 100):
        self.seen: list[tuple[int, int]] = []
        self.most = most

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.seen = [*self.seen, (event.progress.batchId, event.progress.numInputRows)][-self.most :]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
