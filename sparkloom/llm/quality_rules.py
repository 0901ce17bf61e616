"""Quality rules: fixed limits, then robust multivariate outliers per language and source. DataFrame functions only.

Per group (language, source) a minimum-covariance-determinant estimate of the centre and spread of transformed text
statistics is found: concentration steps (measure all rows by Mahalanobis distance, estimate from the closest share) go
on from several starts until no determinant falls any more, and the least determinant counts. The estimate is made
consistent for normal data, reweighted once, and rows beyond a quantile of the distance are rejected. A step is one partial
aggregate by group and distance bin; no group is gathered. Sums are of fixed-point integers, so results don't depend on
how rows are dealt out. Groups with fewer than MIN_GROUP usable rows borrow the estimate of all rows together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import drop_tables, join_hot, materialize, tables_written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Share of a group that the estimate rests on.
CORE_SHARE = 0.75
MIN_GROUP = 30
#: A start is concentrated until its log determinant falls by no more than this; as that has a lower bound, it ends.
LEAST_FALL = 0.01
# Fixed values of the chi-square distribution with 4 degrees of freedom, one for each statistic.
#: Covariance of the core to that of all rows: CORE_SHARE over the share with 6 degrees of freedom below the CORE_SHARE quantile.
CORE_FACTOR = 1.4863
#: Rows up to the 0.975 quantile count in the reweighted estimate; its factor.
REWEIGHT = 11.1433
REWEIGHT_FACTOR = 1.0645
#: Squared distance beyond which a row is rejected: the 0.999 quantile.
CUTOFF = 18.4668
#: Words (lines) of pseudo-text mixed into each ratio: short texts scatter more.
PRIOR = 40
SCALE = 1024
#: Fixed-point places of the sampling errors, in bits.
ERROR_BITS = 8
STATS = ("word_length", "symbols", "dup_lines", "repeats")
#: Sampling error of each statistic, as a variance: an estimate of a group has at least that of its own texts.
ERRORS = tuple(f"e_{s}" for s in STATS)
#: So many groups' estimates at most (under 500 bytes each) are broadcast.
BROADCAST_GROUPS = 16_000


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each whole text (null: none)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = r"[\x20\x09-\x0D]"
    out = docs.withColumn("_w", F.filter(F.split(text, blank + "+"), lambda w: w != ""))
    out = out.withColumn("_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size("_w").cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(blank))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    width = 1
    while width < WINDOW:  # hashes of 2, 4 and 8 words
        out = out.withColumn("_h", F.zip_with("_h", F.slice("_h", width + 1, F.greatest(F.size("_h"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
        width *= 2
    out = out.withColumn("_h", F.slice("_h", 1, F.greatest(F.size("_h") - WINDOW + 1, F.lit(0))))
    # windows found twice: neighbours with equal hashes once sorted; only looked for where there are any
    placed = F.array_sort(F.zip_with("_h", F.sequence(F.lit(0), F.greatest(F.size("_h") - 1, F.lit(0))), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed))
    after = F.zip_with("_s", F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.array_sort(F.array_distinct(F.flatten(F.filter(after, lambda x: x.isNotNull()))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    cover = F.aggregate(
        starts, zero, lambda acc, i: F.struct((acc["n"] + F.lit(WINDOW) - F.greatest(acc["end"] - i, F.lit(0))).alias("n"), (i + F.lit(WINDOW)).alias("end")), lambda acc: acc["n"]
    )
    return out.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("long")).drop("_h", "_s")


def _fixed(x: Column) -> Column:
    return F.round(x * SCALE).cast("long")


def _features() -> list[Column]:
    """The transformed statistics as fixed-point integers, in the order of STATS, then ERRORS.

    The error of a count is one event (a symbol, a repeated line, a repeated window), that of the mean word length
    follows from words whose lengths scatter by 60 %.
    """
    words, lines = F.col("n_words") + PRIOR, F.col("n_lines") + PRIOR
    error = lambda x, name: F.round(x * SCALE * SCALE * (1 << ERROR_BITS)).cast("long").alias(name)
    return [
        _fixed(F.log((F.col("word_chars") + 5 * PRIOR) / words)).alias("word_length"),
        _fixed(F.log1p(F.col("n_symbols") / words)).alias("symbols"),
        _fixed(F.col("n_dup_lines") / lines).alias("dup_lines"),
        _fixed(F.col("n_repeat_words") / words).alias("repeats"),
        error(0.36 / words, "e_word_length"),
        error(1 / (words * words), "e_symbols"),
        error(1 / (lines * lines), "e_dup_lines"),
        error((2 * WINDOW) ** 2 / (words * words), "e_repeats"),
    ]


_D = range(len(STATS))
_PAIRS = [(i, j) for i in _D for j in _D if j <= i]
#: What an estimate consists of: means and the lower Cholesky factor of the covariance.
_PARTS = [*[f"m_{i}" for i in _D], *[f"l_{i}_{j}" for i, j in _PAIRS]]
_SUMS = ["rows", *[f"s_{i}" for i in _D], *[f"s_{i}_{j}" for i, j in _PAIRS], *[f"f_{i}" for i in _D]]


def _sums() -> list[Column]:
    """Exact sums, whatever their order: all are of integers."""
    return [
        F.count("*").alias("rows"), *[F.sum(STATS[i]).alias(f"s_{i}") for i in _D],
        *[F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"s_{i}_{j}") for i, j in _PAIRS], *[F.sum(ERRORS[i]).alias(f"f_{i}") for i in _D],
    ]


def _estimated(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows, the parts of an estimate and log_det from a row of sums."""
    cov = {(i, j): F.col(f"s_{i}_{j}") / F.col("rows") - F.col(f"s_{i}") / F.col("rows") * F.col(f"s_{j}") / F.col("rows") for i, j in _PAIRS}
    for i in _D:
        cov[i, i] = F.greatest(cov[i, i], F.lit(0.0)) + F.col(f"f_{i}") / F.col("rows") / (1 << ERROR_BITS)
    return _factored(sums.select(*keys, "rows", *[(F.col(f"s_{i}") / F.col("rows")).alias(f"m_{i}") for i in _D], *[cov[i, j].alias(f"c_{i}_{j}") for i, j in _PAIRS]), keys)


def _factored(held: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows, parts and log_det from rows, m_i and the covariance c_i_j."""
    for i, j in _PAIRS:
        rest = reduce(lambda a, b: a - b, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.col(f"c_{i}_{j}"))
        held = held.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-6) * F.col(f"c_{i}_{i}"))) if i == j else rest / F.col(f"l_{j}_{j}"))
    log_det = 2 * reduce(lambda a, b: a + b, [F.log(F.col(f"l_{i}_{i}")) for i in _D])
    return held.select(*keys, "rows", *_PARTS, log_det.alias("log_det"))


def _starts(rows: DataFrame) -> DataFrame:
    """Three first estimates of each group: medians and quartiles; all rows; the directions of all rows from the median."""
    held = rows.groupBy("_g").agg(F.count("*").alias("rows"), *[F.percentile(s, [0.25, 0.5, 0.75]).alias(f"q_{i}") for i, s in enumerate(STATS)], *[F.avg(e).alias(f"f_{i}") for i, e in enumerate(ERRORS)])
    spread = [F.sqrt(F.pow((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, 2) + F.col(f"f_{i}") / (1 << ERROR_BITS)) for i in _D]
    middle = materialize(held.select("_g", "rows", *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in _D], *[spread[i].alias(f"w_{i}") for i in _D]))
    diagonal = [(F.col(f"w_{i}") * F.col(f"w_{i}") if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS]
    quartiles = _factored(middle.select("_g", "rows", *[f"m_{i}" for i in _D], *diagonal), ["_g"])
    plain = _estimated(rows.groupBy("_g").agg(*_sums()), ["_g"])
    away = _met(rows, middle)
    scaled = [(F.col(STATS[i]) - F.col(f"m_{i}")) / F.col(f"w_{i}") for i in _D]
    length = F.sqrt(reduce(lambda a, b: a + b, [x * x for x in scaled]) + 1e-9)
    signs = away.select("_g", *[F.round(scaled[i] / length * SCALE).cast("long").alias(f"u_{i}") for i in _D])
    mean = signs.groupBy("_g").agg(*[F.sum(F.col(f"u_{i}") * F.col(f"u_{j}")).alias(f"p_{i}_{j}") for i, j in _PAIRS]).join(middle, "_g")
    cov = [(F.col(f"p_{i}_{j}") / F.col("rows") / SCALE / SCALE * len(STATS) * F.col(f"w_{i}") * F.col(f"w_{j}") + (F.col(f"w_{i}") * F.col(f"w_{i}") * 0.01 if i == j else F.lit(0.0))).alias(f"c_{i}_{j}") for i, j in _PAIRS]
    directions = _factored(mean.select("_g", "rows", *[f"m_{i}" for i in _D], *cov), ["_g"])
    every = quartiles.withColumn("_start", F.lit(0)).unionByName(plain.withColumn("_start", F.lit(1))).unionByName(directions.withColumn("_start", F.lit(2)))
    return every.withColumn("log_det", F.lit(float("inf")))


def _met(rows: DataFrame, estimates: DataFrame, groups: int | None = None) -> DataFrame:
    """rows with the columns of their group's estimates, which are broadcast where there are few groups (counted if not given)."""
    if (estimates.count() if groups is None else groups) <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(estimates.drop("rows")), "_g")
    return join_hot(rows, estimates, "_g", "rows", list(STATS))


def _distance(rows: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance from the estimate in m_i and l_i_j."""
    parts = []
    for i in _D:
        rest = reduce(lambda a, b: a - b, [F.col(f"l_{i}_{k}") * F.col(f"_y{k}") for k in range(i)], F.col(STATS[i]) - F.col(f"m_{i}"))
        rows = rows.withColumn(f"_y{i}", rest / F.col(f"l_{i}_{i}"))
        parts.append(F.col(f"_y{i}") * F.col(f"_y{i}"))
    return rows.withColumn("d2", reduce(lambda a, b: a + b, parts)).drop(*[f"_y{i}" for i in _D])


def _concentrated(rows: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """The estimates of the rows closest to the given ones, of so many groups: CORE_SHARE of each group, of the last bin of distances a fraction."""
    gathered = estimates.groupBy("_g").agg(F.first("rows").alias("rows"), F.collect_list(F.struct("_start", *_PARTS)).alias("_e"))  # one entry a start
    met = _met(rows, gathered, groups).select("_g", *STATS, *ERRORS, F.explode("_e").alias("_e")).select("_g", *STATS, *ERRORS, "_e.*")
    binned = _distance(met).withColumn("_bin", F.floor(F.log1p("d2") * 64)).groupBy("_g", "_start", "_bin").agg(*_sums())
    group = Window.partitionBy("_g", "_start")
    upto, whole = F.sum("rows").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)), F.sum("rows").over(group)
    binned = binned.withColumn("_w", (F.ceil(whole * CORE_SHARE) - upto + F.col("rows")) / F.col("rows")).where("_w > 0")
    parts = [(F.sum(F.when(F.col("_w") >= 1, F.col(c)).otherwise(0)) + F.coalesce(F.max(F.when(F.col("_w") < 1, F.col(c) * F.col("_w"))), F.lit(0.0))).alias(c) for c in _SUMS]
    return _estimated(binned.groupBy("_g", "_start").agg(*parts), ["_g", "_start"])


def robust_estimates(rows: DataFrame) -> DataFrame:
    """(_g, rows, m_i, l_i_j, log_det): minimum-covariance-determinant estimates of rows (_g, STATS, ERRORS), one for each group _g.

    Each start of a group goes on until its own determinant falls no more, and only those that go on meet the rows again.
    A step is one table of three rows a group: the newest estimate, the best one so far, and whether it goes on.
    """
    mark = tables_written()
    estimate = F.struct("rows", *_PARTS, "log_det")
    state = materialize(_starts(rows).select("_g", "_start", estimate.alias("now"), estimate.alias("best"), F.lit(True).alias("open")))
    while groups := state.where("open").agg(F.count_distinct("_g")).first()[0]:
        going = state.where("open")
        anew = _concentrated(rows, going.select("_g", "_start", "now.*"), groups).select("_g", "_start", estimate.alias("now"))
        moved = anew.join(going.select("_g", "_start", "best"), ["_g", "_start"]).select(
            "_g", "_start", "now", F.when(F.col("now.log_det") < F.col("best.log_det"), F.col("now")).otherwise(F.col("best")).alias("best"),
            F.coalesce(F.col("best.log_det") - F.col("now.log_det") > LEAST_FALL, F.lit(False)).alias("open"),
        )
        state = materialize(moved.unionByName(state.where("not open")))
    found = materialize(state.groupBy("_g").agg(F.min_by("best", F.struct("best.log_det", "_start")).alias("e")).select("_g", "e.*"))
    drop_tables(rows.sparkSession, mark)
    return found


def reweighted(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimates made consistent, then taken anew from all rows within REWEIGHT of them."""
    widened = estimates.select("_g", "rows", *[(F.col(c) * CORE_FACTOR**0.5 if c.startswith("l") else F.col(c)).alias(c) for c in _PARTS])
    near = _distance(_met(rows, widened)).where(F.col("d2") <= REWEIGHT).groupBy("_g").agg(*_sums())
    anew = _estimated(near, ["_g"])
    return anew.select("_g", *[(F.col(c) * REWEIGHT_FACTOR**0.5 if c.startswith("l") else F.col(c)).alias(c) for c in _PARTS])


def quality_verdicts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, the counts of each text, base_failed, distance (null if base_failed) and kept; columns in keep
    with one of the new names are replaced.

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEAT_PERCENT % of them in repeated windows. Null and empty
    texts have no words, so they fail. A null language or source is a group like any other. Repeated rows each get their
    verdict; they and ties of distance are on the same side of any limit. An empty table gives an empty result.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
    # in one column, so that no name of theirs meets one of ours
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep"), F.xxhash64(F.lit("group"), F.coalesce(F.col(lang_col), F.lit("\0")), F.coalesce(F.col(source_col), F.lit("\0"))).alias("_g"), F.col(text_col).alias("_text"))
    counted = text_counts(held, "_text").drop("_text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counted = materialize(counted.withColumn("base_failed", failed).select("*", *_features()))
    usable = counted.where(~F.col("base_failed")).select("_g", *STATS, *ERRORS)
    sizes = usable.groupBy("_g").agg(F.count("*").alias("rows"))
    large = materialize(sizes.where(F.col("rows") >= MIN_GROUP))
    # every row counts in its own group, if that is large enough, and in the group 0 of all rows
    own = _met(usable, large)
    rows = materialize(own.select("_g", *STATS, *ERRORS).unionByName(usable.select(F.lit(0).cast("long").alias("_g"), *STATS, *ERRORS)))
    found = materialize(reweighted(rows, robust_estimates(rows)))
    general = F.broadcast(found.where("_g = 0").select(*[F.col(c).alias(f"_g_{c}") for c in _PARTS]))  # one row
    known = found.where("_g <> 0")
    if known.count() <= BROADCAST_GROUPS:
        joined = counted.join(F.broadcast(known), "_g", "left")
    else:
        joined = join_hot(counted, counted.groupBy("_g").agg(F.count("*").alias("rows")).join(known, "_g", "left"), "_g", "rows", list(STATS))
    joined = joined.join(general, how="left")
    for c in _PARTS:
        joined = joined.withColumn(c, F.coalesce(F.col(c), F.col(f"_g_{c}")))
    judged = _distance(joined).withColumn("distance", F.when(~F.col("base_failed"), F.round("d2", 6)))
    return judged.select(
        *[F.col(f"_keep.`{c}`") for c in keep if c not in new], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"), "distance",
    )
