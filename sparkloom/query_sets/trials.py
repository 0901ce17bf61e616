"""Queries about models' outputs: probabilities, what parts of a model cost when they are coarse, and rows as safe JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.operators import trials
from sparkloom.registry import register
from sparkloom.session import table

#: Logits of a vector: its first 16 numbers, made larger; they are rounded to whole ones. Above CONFIDENT a best label is sure.
PARTS, SCALE, CONFIDENT, TARGET = 16, 12, 0.3, 0.9

_LOGITS = f"u AS (SELECT vec_id, label % 3 AS g, i, embedding[i + 1]::DOUBLE * {SCALE} AS x FROM embeddings, range({PARTS}) t(i) WHERE embedding IS NOT NULL)"


def _logits(spark, sf_dir):
    big = F.transform(F.slice("embedding", 1, PARTS), lambda x: x.cast("double") * SCALE)
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", (F.col("label") % 3).cast("long").alias("g"), big.alias("logits"))


@register("softmax_top_k", f"""WITH {_LOGITS}, e AS (SELECT vec_id, i, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM u), p AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS p, e FROM e)
SELECT vec_id, place, label, p FROM (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, i) AS place, i AS label, round(p, 6) AS p FROM p) WHERE place <= 5""")  # fmt: skip
def _softmax(spark, sf_dir):
    best = _logits(spark, sf_dir).select("vec_id", F.posexplode(C.top_k(C.softmax(F.col("logits")), 5)).alias("at", "t"))
    return best.select("vec_id", (F.col("at") + 1).cast("long").alias("place"), F.col("t.label").cast("long").alias("label"), F.round("t.p", 6).alias("p"))


#: c: the exact logits x beside others y, by trial; m: what a trial does to a vector.
_PAIRS = """x AS (SELECT vec_id, g, trial, i, exp(x - max(x) OVER w) AS a, exp(y - max(y) OVER w) AS b FROM c WINDOW w AS (PARTITION BY vec_id, trial)),
 p AS (SELECT vec_id, g, trial, i, a / sum(a) OVER w AS a, b / sum(b) OVER w AS b FROM x WINDOW w AS (PARTITION BY vec_id, trial)),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, trial ORDER BY a DESC, i) AS ra, row_number() OVER (PARTITION BY vec_id, trial ORDER BY b DESC, i) AS rb FROM p),
 m AS (SELECT vec_id, g, trial, max(a) AS sure, max((ra = 1 AND rb = 1)::INT) AS same, sum(CASE WHEN a > 0 THEN a * ln(a / greatest(b, 1e-12)) ELSE 0 END) AS kl FROM r GROUP BY 1, 2, 3)"""
_ALONE = f"{_LOGITS}, c AS (SELECT vec_id, g, j AS trial, i, x, CASE WHEN i = j THEN round_even(x, 0) ELSE x END AS y FROM u, range({PARTS}) s(j)), {_PAIRS}"
_SENSITIVE = "SELECT trial AS part, round(avg(kl), 9) AS kl, row_number() OVER (ORDER BY round(avg(kl), 9) DESC, trial DESC) AS place FROM m GROUP BY 1"


@register("part_sensitivity", f"WITH {_ALONE} SELECT part, round(kl, 6) AS kl, place FROM ({_SENSITIVE})")
def _sensitivity(spark, sf_dir):
    found = trials.part_sensitivity(_logits(spark, sf_dir), "logits", PARTS, 1.0)
    return found.select(F.col("part").cast("long").alias("part"), F.round("kl", 6).alias("kl"), F.col("place").cast("long").alias("place"))


@register("kept_parts", f"""WITH s AS (WITH {_ALONE} {_SENSITIVE}), {_LOGITS}, c AS (SELECT vec_id, g, k AS trial, i, x, CASE WHEN place <= k THEN x ELSE round_even(x, 0) END AS y FROM u JOIN s ON part = i, (VALUES (0), (1), (2), (4), (8)) t(k)), {_PAIRS},
 n AS (SELECT g, trial AS kept, round(avg(same), 6) AS top1, round(avg(same) FILTER (sure >= {CONFIDENT}), 6) AS confident_top1, round(avg(kl), 6) AS kl FROM m GROUP BY 1, 2),
 t AS (SELECT *, NOT coalesce(bool_or(coalesce(confident_top1 >= {TARGET}, false)) OVER (PARTITION BY g ORDER BY kept ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS tried FROM n)
SELECT *, tried AND row_number() OVER (PARTITION BY g, tried ORDER BY confident_top1 DESC NULLS LAST, top1 DESC NULLS LAST, kl, kept) = 1 AS chosen FROM t""")  # fmt: skip
def _kept(spark, sf_dir):
    measured = trials.kept_trials(_logits(spark, sf_dir), "logits", PARTS, 1.0, CONFIDENT, ("g",))
    best = trials.best_trial(measured, ("g",), "kept", [F.desc_nulls_last("confident_top1"), F.desc_nulls_last("top1"), F.asc("kl")], F.col("confident_top1") >= TARGET)
    return best.withColumn("kept", F.col("kept").cast("long"))


@register("safe_json", """SELECT event_id, '{"event_id":' || event_id || ',"ratio":' || CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'null' ELSE (event_id % 4)::VARCHAR || '.5' END || ',"kind":' || CASE WHEN event_type = 'view' THEN 'null' ELSE '"' || event_type || '"' END || ',"seen":"' || strftime(ts, '%Y-%m-%d %H:%M') || '"}' AS line FROM events""")
def _safe_json(spark, sf_dir):
    e = F.col("event_id")
    ratio = F.when(e % 5 == 0, F.lit(float("nan"))).when(e % 7 == 0, F.lit(float("-inf"))).otherwise(e % 4 + 0.5)
    rows = table(spark, sf_dir, "events").select("event_id", ratio.alias("ratio"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("seen"))
    return rows.select("event_id", C.safe_json(rows).alias("line"))
