"""Column profiles and findings about a table, from one aggregate over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.columns import formula_like, number, row_hashes
from sparkloom.plans.catalog import NUMERIC, kind_of


def _stats(name: str, kind: str) -> dict[str, Column]:
    c = F.col(f"`{name}`")
    text = kind == "text"
    numeric = kind in NUMERIC
    none = F.lit(None)
    given = text and F.trim(c) != ""
    full_date = r"^\d{4}-\d{1,2}-\d{1,2}( \d{1,2}:\d{2}(:\d{2})?)?$"
    return {
        "column_name": F.lit(name), "kind": F.lit(kind), "non_null": F.count(c), 
        "min_value": F.min(c).cast("string") if kind in ("integer", "number", "date", "text") else none.cast("string"),
        "max_value": F.max(c).cast("string") if kind in ("integer", "number", "date", "text") else none.cast("string"),
        "mean": F.round(F.avg(c.cast("double")), 4) if numeric else none.cast("double"),
        "negatives": F.count_if(c < 0) if numeric else F.lit(0).cast("long"),
        "numeric_texts": F.count_if(given & number(F.regexp_replace(c, ",", "")).isNotNull()) if text else F.lit(0).cast("long"),
        "date_texts": F.count_if(given & F.trim(c).rlike(full_date)) if text else F.lit(0).cast("long"),
        "untrimmed": F.count_if(c != F.trim(c)) if text else F.lit(0).cast("long"),
        "formula_like": F.count_if(formula_like(c)) if text else F.lit(0).cast("long"),
    }


def _distinct_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """One row with the exact number of distinct values of each column, as _0_distinct_values and so on.

    Values are unpivoted into (column, value) and grouped, so a task combines its own repeats before the shuffle, and one
    column's values are spread over all tasks; a count of distinct values in one aggregate would copy every row by column.
    """
    every = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{n}`").cast("string").alias("v")) for i, n in enumerate(names)])).alias("e")).select("e.*")
    counted = every.where("v is not null").groupBy("i", "v").agg(F.lit(1).alias("one")).agg(*[F.count_if(F.col("i") == i).alias(f"_{i}_distinct_values") for i in range(len(names))])
    return counted


def profile(df: DataFrame) -> DataFrame:
    """One row per column: one pass for all statistics, and one for the distinct values."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    aggs, entries = [F.count("*").alias("_rows")], []
    for i, (name, kind) in enumerate(kinds.items()):
        stats = _stats(name, kind)
        aggs += [v.alias(f"_{i}_{k}") for k, v in stats.items() if k not in ("column_name", "kind")]
        named = [k for k in stats if k not in ("column_name", "kind")]
        order = ["non_null", "distinct_values", *[k for k in named if k != "non_null"]]
        entries.append(F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("kind"), *[F.col(f"_{i}_{k}").alias(k) for k in order], F.col("_rows").alias("n_rows")))
    both = df.agg(*aggs).crossJoin(F.broadcast(_distinct_counts(df, list(kinds))))  # one row each
    return both.select(F.inline(F.array(*entries)))


def ranked_values(df: DataFrame, key: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(key, one column for each rank): the values at ranks of each key's sorted values, nulls left out.

    Equal values are counted first; only the counts are numbered within a key, so a key with very many rows costs as
    much as it has distinct values, and no list of values is ever built.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    sizes = counted.groupBy(key).agg(F.sum("_c").alias("_n"))
    placed = counted.withColumn("_hi", upto).join(sizes, key)
    return placed.groupBy(key).agg(*[F.min(F.when(F.col("_hi") > rank(F.col("_n")), F.col(value))).alias(name) for name, rank in ranks.items()])


def findings(df: DataFrame) -> DataFrame:
    """(code, column_name, affected) of what the profile shows to be odd; duplicate rows have no column."""
    p = profile(df)
    nulls = F.col("n_rows") - F.col("non_null")
    rules = [
        ("empty_column", (F.col("non_null") == 0) & (F.col("n_rows") > 0), F.col("n_rows")),
        ("mostly_missing", (F.col("non_null") > 0) & (nulls / F.col("n_rows") >= 0.2), nulls),
        ("missing_values", (F.col("non_null") > 0) & (nulls > 0) & (nulls / F.col("n_rows") < 0.2), nulls),
        ("constant_column", (F.col("distinct_values") == 1) & (F.col("n_rows") > 1), F.col("non_null")),
        ("negative_values", F.col("negatives") > 0, F.col("negatives")),
        ("numbers_stored_as_text", (F.col("non_null") > 0) & (F.col("numeric_texts") >= 0.9 * F.col("non_null")), F.col("numeric_texts")),
        ("dates_stored_as_text", (F.col("non_null") > 0) & (F.col("date_texts") >= 0.9 * F.col("non_null")), F.col("date_texts")),
        ("untrimmed_text", F.col("untrimmed") > 0, F.col("untrimmed")),
        ("formula_like_text", F.col("formula_like") > 0, F.col("formula_like")),
    ]
    found = p.select(F.inline(F.filter(F.array(*[F.struct(F.when(test, code).alias("code"), F.col("column_name"), n.alias("affected")) for code, test, n in rules]), lambda x: x["code"].isNotNull())))
    row, again = row_hashes([F.col(f"`{c}`") for c in df.columns])
    repeated = df.groupBy(row.alias("a"), again.alias("b")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("affected")).where("affected > 0")
    return found.unionByName(repeated.select(F.lit("duplicate_rows").alias("code"), F.lit(None).cast("string").alias("column_name"), "affected"))


def known_values(df: DataFrame, column: str, longest: int = 60) -> DataFrame:
    """(value, n): all values of at most `longest` characters, the commonest first, ties by value."""
    return df.where(F.length(F.col(column)) <= longest).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def top_values(df: DataFrame, column: str, most: int = 5) -> DataFrame:
    """(value, n): the commonest values, ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def mode_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): each key's commonest value, ties by the smaller value."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return counted.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def content_fingerprint(df: DataFrame) -> DataFrame:
    """digest: equal for tables with equal rows in any order, from sums of row hashes; no row leaves its task."""
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns])
    h = F.sha2(row.cast("binary"), 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[F.coalesce(part(a), F.lit(0).cast("decimal(38,0)")).cast("string") for a in (1, 13, 25)]).cast("binary"), 256).alias("digest"))
