"""One place that knows how sessions are set up."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times, ANSI casts and adaptive execution; keyword arguments use _ for . in setting names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt anew where its files give fewer tasks than there are cores; what follows a scan of few, small files is then shared."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: Rows of a scan that one task holds after dealt(); what a task sorts and keeps follows from it, whatever the input's size.
ROWS_PER_TASK = 50_000


def dealt(rows: DataFrame, scan: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys over as many tasks as the rows of the scan, which they come from, ask for; not fewer than there are cores.

    A fixed number of shuffle partitions has tasks grow with the input until their sorts no longer fit in memory.
    """
    return rows.repartition(tasks_for_rows(scan), *keys)


def tasks_for_rows(scan: DataFrame) -> int:
    """As many tasks as the rows of a scan ask for; not fewer than there are cores."""
    return max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // ROWS_PER_TASK))


def met(rows: DataFrame, scan: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """rows joined with other by a key that a bounded number of rows share, both dealt as dealt() deals rows, so that the
    sorts of the join don't grow with the input either; Spark's own join has a fixed number of partitions, or a copy of other in each executor.
    """
    tasks = tasks_for_rows(scan)
    return rows.repartition(tasks, key).hint("merge").join(other.repartition(tasks, other_key), F.col(key) == F.col(other_key))


#: Texts of a scan whose lines and words one task holds.
TEXTS_PER_TASK = 2_000


def tasks_for_texts(scan: DataFrame) -> int:
    """As many tasks as the texts of a scan ask for; not fewer than there are cores."""
    return max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // TEXTS_PER_TASK))


def _filesystem(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it, wherever it lies."""
    folder, fs = _filesystem(spark, path)
    fs.delete(folder, True)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; OSError where the file system refuses."""
    folder, fs = _filesystem(spark, source)
    if not fs.rename(folder, _filesystem(spark, target)[0]):
        raise OSError(f"{source} can't be moved to {target}")


def file_states(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(name, length, time of the last write in milliseconds) of a file, or of all files in a folder and those below it."""
    folder, fs = _filesystem(spark, path)
    found, out = fs.listFiles(folder, True), []
    while found.hasNext():
        status = found.next()
        out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file."""
    folder, fs = _filesystem(spark, path)
    out = fs.create(folder, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


_local: list[str] = []


def new_path(spark: SparkSession) -> str:
    """A new name under the folder that driver and executors share; a temporary one in local mode where none is set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\[]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="sparkloom-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = f"file://{_local[0]}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside are deleted as soon as it is written, as nothing reads them again."""
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)


def written_at(df: DataFrame, compression: str | None = None) -> tuple[DataFrame, str]:
    """written() and the folder, for those who delete it."""
    path = new_path(df.sparkSession)
    with cleaned(df.sparkSession):
        (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that what is built on it doesn't work it out again."""
    return written_at(df)[0]
