"""Which parts of a model stay exact: what each costs when it alone is coarse, and the best of growing sets of exact parts.

Rows are inputs with their logits, a part is one logit's path, and coarse means rounded to a grid. Every trial is measured
on every row in one pass; only a row a part or trial is left after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.columns import softmax
from sparkloom.operators.retrieval import agreement

#: How many parts are kept exact, step by step; half of them at most.
STEPS = (1, 2, 4, 8, 12, 16, 24, 32)


def coarse(logits: Column, grid: float, fine: Column) -> Column:
    """logits rounded to multiples of grid, but for the places (from 0) in the array fine."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(fine, i), x).otherwise(F.bround(x / grid) * grid))


def part_sensitivity(rows: DataFrame, logits: str, parts: int, grid: float) -> DataFrame:
    """(part, kl, place): the mean divergence from the exact probabilities where one part alone is coarse, the largest first,
    ties by the larger part. Rows whose logits have no probabilities are left out."""
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    held = rows.select(F.col(logits).alias("_l"), softmax(F.col(logits)).alias("a")).where("a is not null")
    alone = held.select("_l", "a", F.explode(every).alias("part")).select("part", "a", softmax(coarse(F.col("_l"), grid, F.array_except(every, F.array("part")))).alias("b"))
    kl = F.aggregate(F.zip_with("a", "b", lambda x, y: F.when(x > 0, x * F.log(x / F.greatest(y, F.lit(1e-12)))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    measured = alone.groupBy("part").agg(F.round(F.avg(kl), 9).alias("kl"))
    return measured.withColumn("place", F.row_number().over(Window.orderBy(F.desc("kl"), F.desc("part"))))  # a row a part


def kept_trials(rows: DataFrame, logits: str, parts: int, grid: float, confident: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, kept, top1, confident_top1, kl): agreement with the exact probabilities where the `kept` most sensitive parts stay
    exact, for none and each of STEPS up to half of the parts. Which parts are sensitive is measured over all rows."""
    order = part_sensitivity(rows, logits, parts, grid).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda s: s["part"]).alias("_order"))
    steps = [0, *(s for s in STEPS if s <= parts // 2)]
    held = rows.select(*by, F.col(logits).alias("_l"), softmax(F.col(logits)).alias("a")).where("a is not null")
    tried = held.crossJoin(F.broadcast(order)).select(*by, "_l", "a", "_order", F.explode(F.array(*map(F.lit, steps))).alias("kept"))  # order is one row
    pairs = tried.select(*by, "kept", "a", softmax(coarse(F.col("_l"), grid, F.slice("_order", F.lit(1), F.col("kept")))).alias("b"))
    return agreement(pairs, "a", "b", confident, (*by, "kept")).select(*by, "kept", "top1", "confident_top1", "kl")


def best_trial(trials: DataFrame, by: tuple[str, ...], step: str, best_first: list[Column], enough: Column) -> DataFrame:
    """trials with tried and chosen: of each group steps are tried in order up to the first that is enough; chosen is the
    best of the tried by the criteria one after the other, of equal ones the earliest. Where enough is null it isn't met."""
    before = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    tried = ~F.coalesce(F.max(F.coalesce(enough, F.lit(False))).over(before), F.lit(False))
    place = F.row_number().over(Window.partitionBy(*by, "tried").orderBy(*best_first, F.asc(step)))
    return trials.withColumn("tried", tried).withColumn("chosen", F.col("tried") & (place == 1))
