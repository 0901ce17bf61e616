"""Files that come in and go out: contract-checked drops, uploads of unknown shape, catalogues and whole-table publishing."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.etl import RAW
from sparkloom.session import new_path
from sparkloom.sources import versions

# Limits of an upload, the endings it may have, and how files of other kinds begin (in hexadecimal digits).
MAX_BYTES, MAX_COLUMNS, MAX_ROWS, MAX_NAME = 10_000_000, 60, 100_000, 64
MOST_DROP_ROWS = 1_000_000
SUFFIXES = ("csv", "tsv", "txt", "")
BINARY_STARTS = ("504B0304", "25504446", "89504E47", "47494638", "FFD8FF", "4D5A", "7F454C46", "D0CF11E0", "53514C69746520666F726D61742033", "1F8B")
DELIMITERS = (",", ";", "\t", "|")


class SchemaMismatch(ValueError):
    """A drop whose header isn't the contract's."""


class Rejected(ValueError):
    """An upload that isn't taken; code tells why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, at): lines of plain or gzip files; at rises along a split."""
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _numbered(lines: DataFrame) -> DataFrame:
    """(file, line_number, valid, value): _lines() with their physical numbers, however a file is split.

    Lines are counted by split first; the table of counts, a row a split, is broadcast and gives each split the number of
    its first line, so no line is shuffled.
    """
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "block", "first", before.alias("before"))
    return lines.join(F.broadcast(starts), ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_number"), F.is_valid_utf8("value").alias("valid"), _text(F.col("value")).alias("value"))


def _text(value: Column) -> Column:
    """A line without a carriage return at its end, undecodable bytes replaced."""
    text = F.make_valid_utf8(value)
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r$", "")).otherwise(text)


def _check_headers(lines: DataFrame, schema: str, options: dict[str, str]) -> None:
    """SchemaMismatch where the first line of a file of _lines() isn't the contract's header; lines without its names aren't parsed."""
    text = lambda value: F.regexp_replace(_text(value), "^﻿", "")

    def same(value: Column) -> Column:
        names = F.from_csv(text(value), schema, options)
        return (F.array(*[F.trim(names[c]) for c in RAW]) == F.array(*map(F.lit, RAW))) & names["_bad"].isNull()

    may = functools.reduce(lambda a, b: a & b, [F.contains("value", F.lit(c)) for c in RAW])
    is_header = F.when(may, F.exists(F.array("value"), same)).otherwise(False)  # in a lambda, so that the method over all lines stays small enough to be compiled
    heads = lines.where("block = 0").groupBy("file").agg(F.min("at").alias("first"), F.min(F.when(is_header, F.col("at"))).alias("header"))
    wrong = heads.where("not first <=> header").limit(1).collect()
    if wrong:
        head = lines.where((F.col("file") == wrong[0]["file"]) & (F.col("block") == 0)).agg(F.min_by(text(F.col("value")), "at")).first()[0]
        raise SchemaMismatch(f"{wrong[0]['file']}: {head!r}")


def read_drop(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, issue, line, and the contract's columns) of plain or gzip CSV files; the header is line 1.

    A quoted field may hold commas and doubled quotes, no line breaks. A blank line is skipped, an undecodable one is an
    encoding_error, one with a wrong number of fields a malformed_row. SchemaMismatch for a file with another header.
    """
    schema = ", ".join(f"`{c}` string" for c in RAW) + ", _bad string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "quote": '"', "escape": '"'}
    lines = _lines(spark, path)
    _check_headers(lines, schema, options)
    body = _numbered(lines).where("line_number > 1 and value rlike '[^ \\\\t\\\\r\\\\f\\\\x0b]'")
    valid = F.col("valid")
    parsed = body.withColumnRenamed("value", "line").withColumn("r", F.when(valid, F.from_csv("line", schema, options)))
    issue = F.when(~valid, "encoding_error").when(F.col("r._bad").isNotNull(), "malformed_row")
    return parsed.select("file", "line_number", issue.alias("issue"), "line", *[F.when(issue.isNull(), F.col(f"r.`{c}`")).alias(c) for c in RAW])


def price_text(price: Column) -> Column:
    """A price without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", price), "0+$", ""), r"\.$", "")


def write_drops(rows: DataFrame, path: str, month: str = "period", most: int = MOST_DROP_ROWS) -> None:
    """Monthly gzip CSV drops in the contract's column order, a folder a month; rows has RAW columns and the month.

    Rows are dealt by month once, and adaptive execution shares a month of more than a partition's advisory size among
    several tasks; a file has at most `most` rows and a header of its own.
    """
    files = rows.select(month, *[F.col(f"`{c}`") for c in RAW]).hint("rebalance", month)
    files.write.partitionBy(month).option("maxRecordsPerFile", most).option("header", True).option("compression", "gzip").option("escape", "\"").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


@dataclass(frozen=True)
class UploadLimits:
    max_bytes: int = MAX_BYTES
    max_columns: int = MAX_COLUMNS
    max_rows: int = MAX_ROWS


def admission(files: DataFrame, limits: UploadLimits = UploadLimits()) -> DataFrame:
    """files (path, length, content) as (path, refusal): why a file isn't taken, null for one that is; content isn't passed on."""
    head = F.substring("content", 1, 8192)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise(""))
    digits = F.hex(F.substring("content", 1, 16))
    binary = F.exists(F.array(*map(F.lit, BINARY_STARTS)), lambda b: digits.startswith(b)) | F.contains(head.cast("string"), F.lit("\0"))
    blank = F.length(F.btrim(F.col("content").cast("string"), F.lit(" \t\r\n\x0b\x0c"))) == 0
    refusal = F.when(blank, "empty_file").when(F.col("length") > limits.max_bytes, "file_too_large").when(~suffix.isin(*SUFFIXES), "not_csv").when(binary, "not_csv")
    return files.select("path", refusal.alias("refusal"))


def sniff_delimiter(lines: Iterable[str]) -> str:
    """The delimiter that cuts the first lines into the same number of fields, more of them if several do; a comma without any."""
    rows = [re.sub(r'"[^"]*"', "", line) for line in lines if line.strip()][:50]
    scored = []
    for rank, d in enumerate(DELIMITERS):
        counts = [row.count(d) for row in rows]
        if counts and counts[0]:
            scored.append((sum(c == counts[0] for c in counts) / len(counts), counts[0], -rank, d))
    return max(scored)[-1] if scored else ","


def repaired_names(names: list[str]) -> list[str]:
    """Column names; blank, very long ones and those with control characters are named by their position."""
    return [f"column_{i}" if not n.strip() or len(n) > MAX_NAME or any(ord(c) < 32 for c in n) else n for i, n in enumerate(names, 1)]


def file_label(name: str | None) -> str:
    """A file's own name, safe to show."""
    own = re.sub(r"[^\w .()-]", "_", re.split(r"[\\/]", name or "")[-1])[:60]
    return own or "upload.csv"


def decoded(content: Column) -> Column:
    """The text of a file's bytes: UTF-8, without a mark at its start, where they are, else Windows-1252, which Spark's own
    decoder doesn't offer, with a replacement for the bytes that it leaves open."""

    def windows(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode("cp1252", errors="replace"))

    text = content.cast("string")
    utf8 = F.is_valid_utf8(text)
    return F.when(utf8, F.regexp_replace(text, "^\ufeff", "")).otherwise(F.pandas_udf(windows, "string")(F.when(~utf8, content)))


def read_upload(spark: SparkSession, path: str, limits: UploadLimits = UploadLimits()) -> DataFrame:
    """A CSV file of unknown shape as a table: delimiter and types found from all of its rows, short rows filled with nulls.

    A folder's files are one table, and each has its own encoding: UTF-8 with or without a mark at its start, anything else
    as Windows-1252; they need the same header. Limits are those of a file: a folder may hold
    any number of files. Rejected with a code for what can't be taken.
    """
    file = spark.read.format("binaryFile").load(path)
    seen = admission(file, limits).collect()  # a file a row
    for row in seen:
        if row["refusal"]:
            raise Rejected(row["refusal"])
    if file.where(~F.is_valid_utf8(F.col("content").cast("string"))).limit(1).count():
        utf8 = new_path(spark)
        # a file of its own for each, as each has a header; files are max_bytes at most
        file.repartition(len(seen), "path").select(F.sha2("path", 256).alias("file"), decoded(F.col("content")).alias("text")).write.partitionBy("file").text(utf8)
        path = f"{utf8}/file=*"
    head = spark.read.option("lineSep", "\n").text(path).limit(50).collect()
    delimiter = sniff_delimiter([(r[0] or "").lstrip("﻿") for r in head])
    reader = spark.read.option("header", True).option("inferSchema", True).option("sep", delimiter).option("escape", '"').option("mode", "PERMISSIVE")
    rows = reader.csv(path)
    names = [re.sub(r"^_c\d+$", "", n.lstrip("﻿")) for n in rows.columns]
    if len(names) > limits.max_columns:
        raise Rejected("too_many_columns")
    found = rows.groupBy(F.input_file_name().alias("_file")).count().agg(F.max("count")).first()[0]
    if not found:
        raise Rejected("no_rows")
    if found > limits.max_rows:
        raise Rejected("too_many_rows")
    return rows.toDF(*repaired_names(names))


def write_catalogue(products: DataFrame, path: str) -> None:
    """A JSON catalogue: one document for each first letter of the code, with its products nested and sorted."""
    shelf = F.substring("stock_code", 1, 1)
    products.groupBy(shelf.alias("shelf")).agg(F.array_sort(F.collect_list(F.struct("stock_code", "description"))).alias("products")).write.json(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(stock_code, description) of the nested products of a catalogue."""
    schema = "shelf string, products array<struct<stock_code: string, description: string>>"
    return spark.read.schema(schema).json(path).select(F.inline("products"))


def write_records(records: DataFrame, path: str) -> None:
    """Nested records, one JSON document a line."""
    records.write.json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested records by their schema; what it lacks is left out, what a document lacks is null."""
    return spark.read.schema(schema).json(path)


def publish_whole(df: DataFrame, path: str, compression: str = "zstd") -> int:
    """Make df the newest version of the table in a folder, which versions.read() reads; a failed job changes nothing."""
    return versions.publish(df, path, compression=compression)


def verified(df: DataFrame, columns: list[str] | None = None, rows: int | None = None, span: tuple[str, str, str] | None = None, digest: str | None = None) -> list[str]:
    """What of the expected content df doesn't have: columns, number of rows, (column, first, last) and fingerprint."""
    from sparkloom.operators.profile import content_fingerprint

    problems = [] if columns is None or df.columns == columns else [f"columns {df.columns}"]
    if problems:
        return problems
    aggs = [F.count("*").alias("n")] + ([F.min(span[0]).cast("string").alias("lo"), F.max(span[0]).cast("string").alias("hi")] if span else [])
    found = df.agg(*aggs).first()
    if rows is not None and found["n"] != rows:
        problems.append(f"{found['n']} rows")
    if span and (found["lo"], found["hi"]) != span[1:]:
        problems.append(f"{span[0]} from {found['lo']} to {found['hi']}")
    if digest is not None and content_fingerprint(df).first()["digest"] != digest:
        problems.append("another content")
    return problems


def materialize_first(sources: list[tuple[str, Callable[[], DataFrame]]], path: str, check: Callable[[DataFrame], list[str]]) -> str:
    """Publish the first source that can be read and passes the check; its name. RuntimeError with all reasons where none does.

    The version's provenance holds the source's name and why those before it were passed over.
    """
    reasons: dict[str, str] = {}
    for name, read in sources:
        try:
            df = read()
            problems = check(df)
        except Exception as e:  # noqa: BLE001  (the next source may do)
            problems = [f"{type(e).__name__}: {str(e).splitlines()[0]}"]
        if not problems:
            versions.publish(df, path, {"source": name, "passed_over": reasons})
            return name
        reasons[name] = ", ".join(problems)
    raise RuntimeError("; ".join(f"{name}: {why}" for name, why in reasons.items()))


def to_purge(uploads: DataFrame, now: str, keep: int) -> DataFrame:
    """uploads (id, created_at, expires_at) that are expired, and the oldest ones beyond the `keep` newest.

    The cut is found from counts by creation day, and only the day in which it lies is numbered.
    """
    live = uploads.where(F.col("expires_at") > F.lit(now).cast("timestamp"))
    days = live.groupBy(F.to_date("created_at").alias("_day")).agg(F.count("*").alias("_n"))
    later = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as days
    placed = live.withColumn("_day", F.to_date("created_at")).join(F.broadcast(days.withColumn("_later", later)), "_day")
    newest = F.row_number().over(Window.partitionBy("_day").orderBy(F.desc("created_at"), F.desc("id")))
    beyond = placed.withColumn("_r", newest + F.col("_later")).where(F.col("_r") > keep)
    expired = uploads.where(F.col("expires_at") <= F.lit(now).cast("timestamp"))
    return expired.select("id", F.lit("expired").alias("cause")).unionByName(beyond.select("id", F.lit("over_capacity").alias("cause")))


def staged(spark: SparkSession) -> str:
    """A new folder name for files that a query writes and reads back."""
    return new_path(spark)
