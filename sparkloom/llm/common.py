"""Shared pieces of the corpus operators: scratch tables, Arrow text batches and vectorised word hashing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task; numpy needs a few dozen bytes of memory per byte of it.
CHUNK_BYTES = 2 << 20

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_scratch: list[str] = []
_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir; where it is unset, in local mode only (tests), a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\[]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _local_scratch:
            _local_scratch.append(tempfile.mkdtemp(prefix="llm-scratch-"))
            atexit.register(shutil.rmtree, _local_scratch[0], ignore_errors=True)
        base = f"file://{_local_scratch[0]}"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later steps neither recompute it nor lose it with an executor."""
    path, conf = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(CLEAN_SHUFFLES, "false")
    conf.set(CLEAN_SHUFFLES, "true")  # the table stands for its shuffle files
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEAN_SHUFFLES, before)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """One row of df for each key, written to the shared folder in buckets by it, so that joins by the key don't shuffle these rows again."""
    spark = df.sparkSession
    path, name, conf = f"{scratch_dir(spark)}/{uuid.uuid4().hex}", f"scratch_{uuid.uuid4().hex}", spark.conf
    parts, before = int(conf.get("spark.sql.shuffle.partitions")), conf.get(CLEAN_SHUFFLES, "false")
    conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.repartition(parts, key).dropDuplicates([key]).write.bucketBy(parts, key).option("path", path).saveAsTable(name, format="parquet")
    finally:
        conf.set(CLEAN_SHUFFLES, before)
    _written.append(path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files lie in the folder, and out knows their buckets
    return out


def tables_written() -> int:
    """A mark for drop_tables(): how many scratch tables there are."""
    return len(_written)


def drop_tables(spark: SparkSession, since: int) -> None:
    """Delete the scratch tables written since the mark, but for the last one; frames that still read them become unreadable."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written[since:-1]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    del _written[since:-1]


def settled(df: DataFrame, since: int) -> DataFrame:
    """df as a table of its own, and the tables that led to it deleted."""
    out = materialize(df)
    drop_tables(df.sparkSession, since)
    return out


#: A key with more rows than this, and more than one of MOST_HOT parts of all rows, is hot; so fewer than MOST_HOT keys are.
HOT_ROWS = 20_000
MOST_HOT = 50_000


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, spread: list[str]) -> DataFrame:
    """left joined with right by key. right holds each key of left once, with the number of its rows in left in column `rows`.

    The rows of a hot key are dealt over parts by a hash of the columns in spread. The list of hot keys has fewer than
    MOST_HOT rows by its definition, so it is broadcast.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    least = max(HOT_ROWS, total // MOST_HOT)
    parts = F.ceil(F.col(rows) / least)
    hot = F.broadcast(right.where(F.col(rows) > least).select(key, parts.alias("_parts")))
    dealt = left.join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")), F.lit(0).cast("long"))).drop("_parts")
    every = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col(rows) > least, parts).otherwise(1).cast("long") - 1))).drop(rows)
    return dealt.join(every, [key, "_part"]).drop("_part")


def text_chunks(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each (a longer text is a slice of its own)."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(text_col)).fill_null(0), dtype=np.int64)
        cum, start = np.cumsum(sizes), 0
        while start < len(sizes):
            base = cum[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(cum, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Word bytes: everything but \x20 and \x09-\x0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of lower-cased text: everything but \x00-\x2F, \x3A-\x60 and \x7B-\x7F.
ALNUM = np.ones(256, dtype=bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

_RADIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit over all others."""
    x = np.bitwise_xor(x, x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = np.bitwise_xor(x, x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return np.bitwise_xor(x, x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _RADIX, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def hash_words(texts: list[bytes], word_bytes: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash every word of every text, A-Z lower-cased, without a Python loop over words.

    Returns the hashes (uint64) of all words in order, their first and last-plus-one byte in "\\n".join(texts), and
    bounds: words bounds[i]:bounds[i + 1] are those of text i.
    """
    joined = np.frombuffer(b"\n".join(texts).lower(), dtype=np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    inside = word_bytes[joined]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edges[0::2], edges[1::2]
    bounds = np.concatenate(([0], np.searchsorted(starts, ends_of))).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, bounds
    body = joined[starts[0] : ends[-1]]
    gaps = np.diff(np.concatenate((starts, [ends[-1]])))
    at = np.arange(len(body)) - np.repeat(starts - starts[0], gaps)
    terms = np.where(inside[starts[0] : ends[-1]], body.astype(np.uint64) + np.uint64(1), np.uint64(0))
    terms *= _powers(int(gaps.max()))[at]
    return mix64(np.add.reduceat(terms, starts - starts[0])), starts, ends, bounds


def kgrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, by first word; the last k - 1 entries of words start none."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    weights = _powers(k + 1)[1:]
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out += words[j : j + len(out)] * weights[j]
    return mix64(out + np.uint64(k))


def as_long(x: np.ndarray) -> pa.Array:
    """uint64 hashes as the signed integers that Spark stores."""
    return pa.array(x.view(np.int64))


def key_bitmap(keys: DataFrame, column: str, bits: int = 25) -> np.ndarray:
    """A bitmap of 2**bits cells, set where a key hashes to; at most 2**(bits - 6) rows reach the driver at any input."""
    cell = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    words = keys.select(F.shiftright(cell, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 64L) as int))").alias("b"))
    out = np.zeros(1 << (bits - 6), np.int64)
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # numbers only, not an object for each
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of xxhash64(key) (int64) may be keys of the bitmap; never false for a key."""
    cell = np.mod(hashes, np.int64(len(bitmap) * 64))
    return (bitmap[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1
