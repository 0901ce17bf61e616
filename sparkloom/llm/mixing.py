"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Weights are whole numbers of parts, taken exactly. With Q parts in all, block k of a source with a parts may run from
slot floor(k * Q / a) and must run before slot ceil((k + 1) * Q / a); the earliest deadline runs first. Every deadline
holds, and after any number of slots each source is less than one block from its weight. The schedule repeats every Q
slots. Only how many sources have which number of parts is needed to work out one period; its table of Q rows is joined
to the numbered blocks. Where a source has run out, its slots stay empty and the others keep their order and proportions.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 16
#: Default weights are whole thousandths of their sum, at least one.
DEFAULT_PARTS = 1000
#: Parts in all at most, for given weights; more raise an error, as the period is worked out on the driver.
MOST_PARTS = 1 << 20
#: A table of sources, or of a period, with fewer bytes than this is broadcast.
BROADCAST_BYTES = 8 << 20


def pfair_period(shares: list[int]) -> list[tuple[int, int]]:
    """(source, block) of each slot of one period of sum(shares) slots; ties go to the earlier source."""
    total, out = sum(shares), []
    waiting = [(0, s, 0) for s in range(len(shares))]  # (release, source, block)
    ready: list[tuple[int, int, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // shares[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append((s, k))
        if k + 1 < shares[s]:
            heapq.heappush(waiting, ((k + 1) * total // shares[s], s, k + 1))
    return out


def whole_parts(weights: dict[str, float | int | str | Fraction]) -> dict[str, int]:
    """The given weights as whole numbers in the same proportions; a float counts as its shortest decimal."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    unit = math.lcm(*(w.denominator for w in exact.values()))
    parts = {s: int(w * unit) for s, w in exact.items()}
    common = math.gcd(*parts.values())
    return {s: a // common for s, a in parts.items()}


def _numbers(spark: SparkSession, known: dict, key: str, value: str) -> DataFrame:
    """A small mapping of the driver as a table (key string, value long), made from one literal."""
    text = json.dumps({str(k): v for k, v in known.items() if k is not None})
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), "map<string, bigint>")).alias(key, value))


def _small(df: DataFrame, rows: int, size: int) -> DataFrame:
    """df marked for a broadcast where its size was found to be small."""
    return F.broadcast(df) if rows * 48 + size < BROADCAST_BYTES else df


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float | int | str | Fraction] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with mix_block, mix_slot and mix_position; the mixed order is by mix_slot, then mix_position.

    weights: target weight per source, kept exactly, in a common unit of which there are MOST_PARTS at most in all
    (ValueError beyond). Sources without a given weight have the smallest one; a null source is a source like any other.
    By default the square root of a source's row count in thousandths of the sum, at least one, so large sources are
    damped and small ones lifted. There may be any number of sources. Within a source rows are ordered by md5 of the id;
    rows that repeat an id each have a place of their own, and rows equal in id and source are interchangeable. No row
    is dropped. Columns of docs with the new names are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_position")]
    source = F.col(f"`{source_col}`").cast("string")
    sizes = docs.groupBy(source.alias("_mix_source")).agg(F.count("*").alias("n"))
    if weights:
        parts = whole_parts(weights)
        given = F.broadcast(_numbers(spark, parts, "_mix_source", "a"))  # the caller's own
        shares = sizes.join(given, "_mix_source", "left").withColumn("a", F.coalesce("a", F.lit(min(parts.values()))))
    else:
        whole = sizes.agg(F.round(F.sum(F.sqrt("n")), 6)).first()[0]
        shares = sizes.withColumn("a", F.greatest(F.lit(1), F.round(DEFAULT_PARTS * F.sqrt("n") / F.lit(whole or 1.0))).cast("long"))
    kinds = shares.groupBy("a").agg(F.count("*").alias("sources"), F.sum("n").alias("rows"), F.sum(F.coalesce(F.length("_mix_source"), F.lit(0))).alias("letters")).orderBy(F.desc("a")).collect()  # one row for each number of parts
    total, rows = sum(r["a"] * r["sources"] for r in kinds), sum(r["rows"] for r in kinds)
    if weights and total > MOST_PARTS + sum(r["sources"] for r in kinds):
        raise ValueError(f"the weights need {total} parts, more than {MOST_PARTS}; give them in whole numbers of a larger unit")
    if not kinds:
        return docs.select(*[f"`{c}`" for c in columns], *[F.lit(0).cast("long").alias(c) for c in ("mix_block", "mix_slot", "mix_position")])
    before, first = 0, {}
    for r in kinds:
        first[r["a"]] = before
        before += r["sources"]
    base = F.broadcast(_numbers(spark, first, "a", "_mix_first").withColumn("a", F.col("a").cast("long")))  # as many rows as kinds
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), F.asc_nulls_last("_mix_source"))) - 1
    numbered = shares.join(base, "a").select("_mix_source", F.col("a").alias("_mix_a"), (F.col("_mix_first") + rank).alias("_mix_s"))
    named = _small(numbered, before, 4 * sum(r["letters"] for r in kinds))
    period = ",".join(str(s) for s, _ in pfair_period([r["a"] for r in kinds for _ in range(r["sources"])]))
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(period), ",")).alias("_mix_at", "_mix_s")).select(F.col("_mix_at").cast("long").alias("_mix_at"), F.col("_mix_s").cast("long").alias("_mix_s"))
    turn = F.row_number().over(Window.partitionBy("_mix_s").orderBy("_mix_at")) - 1
    places = _small(slots.withColumn("_mix_k", turn.cast("long")), total, 0)
    # numbers within a source: counts of hash buckets are added up, rows are numbered inside a bucket; a large source is many buckets
    digits = min(5, max(2, math.ceil(math.log(max(rows, 1) / 20_000, 16)))) if rows > 20_000 else 2
    key = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    keyed = docs.select(*[F.col(f"`{c}`") for c in columns], source.alias("_mix_name"), key.alias("_mix_h"))
    keyed = keyed.join(named, F.col("_mix_name").eqNullSafe(F.col("_mix_source"))).drop("_mix_name", "_mix_source").withColumn("_mix_b", F.substring("_mix_h", 1, digits))
    bucket_sizes = keyed.groupBy("_mix_s", "_mix_b").agg(F.count("*").alias("_mix_n"))
    earlier = Window.partitionBy("_mix_s").orderBy("_mix_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = bucket_sizes.select("_mix_s", "_mix_b", F.coalesce(F.sum("_mix_n").over(earlier), F.lit(0)).alias("_mix_base"))
    inside = Window.partitionBy("_mix_s", "_mix_b").orderBy("_mix_h", F.col(f"`{id_col}`"))
    held = keyed.withColumn("_mix_i", F.row_number().over(inside) - 1).join(bases, ["_mix_s", "_mix_b"]).withColumn("_mix_i", F.col("_mix_i") + F.col("_mix_base"))
    held = held.withColumn("_mix_block", F.floor(F.col("_mix_i") / block_rows)).withColumn("_mix_k", F.col("_mix_block") % F.col("_mix_a")).join(places, ["_mix_s", "_mix_k"])
    slot = F.floor(F.col("_mix_block") / F.col("_mix_a")) * total + F.col("_mix_at")
    return held.select(*[F.col(f"`{c}`") for c in columns], F.col("_mix_block").alias("mix_block"), slot.cast("long").alias("mix_slot"), (F.col("_mix_i") % block_rows).cast("long").alias("mix_position"))


#: DuckDB SQL for mix(documents) with the default weights, columns doc_id, source and the three that it adds.
ORACLE = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
shares AS (
  SELECT source, row_number() OVER (ORDER BY n DESC, source) AS i,
         greatest(1, round({DEFAULT_PARTS} * sqrt(n) / (SELECT round(sum(sqrt(n)), 6) FROM sizes)))::BIGINT AS a
  FROM sizes
),
every AS (SELECT list(a ORDER BY i) AS a, sum(a)::BIGINT AS q FROM shares),
turns AS (
  SELECT 0::BIGINT AS t, list_transform(a, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick FROM every
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(a) + 1), lambda i: done[i] + (i = p)::BIGINT), p FROM (
    SELECT t, done, a, q, list_min(list_transform(range(1, len(a) + 1), lambda i:
      CASE WHEN done[i] < a[i] AND done[i] * q // a[i] <= t THEN ((done[i] + 1) * q + a[i] - 1) // a[i] * 1000 + i ELSE 1000000000000 END)) % 1000 AS p
    FROM turns, every WHERE t < q)
),
slots AS (SELECT t - 1 AS slot, pick AS i, done[pick] - 1 AS k FROM turns WHERE t > 0),
numbered AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS r FROM documents
),
blocks AS (SELECT doc_id, source, r // {BLOCK_ROWS} AS block, r % {BLOCK_ROWS} AS position FROM numbered)
SELECT doc_id, b.source, block::BIGINT AS mix_block, (block // a * (SELECT q FROM every) + slot)::BIGINT AS mix_slot, position::BIGINT AS mix_position
FROM blocks b JOIN shares s ON b.source IS NOT DISTINCT FROM s.source JOIN slots t ON t.i = s.i AND t.k = block % a
"""
