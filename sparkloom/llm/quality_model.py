"""A quality classifier learnt from trusted positives and unlabelled text.

The non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)), minimised for a
small network over statistics of the text. Every whole text is read once, into a short vector of statistics. All
unlabelled rows count: vectors are gathered in cells of a random partition of their space, and the risk is taken over the
cells' means with their numbers of rows. The prior is estimated from positives and unlabelled rows alone: a first model
tells one from the other, and no set of high scores can be rarer among all rows than the prior times its share of the
positives. The final scores are shifted so that the emptiest gap among all rows near that share is at one half. Negative
labels are never read. Positives, the labelled rows, are a bounded sample (max_positives).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import hash_words, kgrams, materialize, settled, tables_written, text_chunks, utf8

#: Positives that the model is fitted on, at most about; the first by hash.
MAX_POSITIVES = 10_000
#: Random planes that cut the space of statistics into cells, two to the power of that at most.
PLANES = 14
#: Fixed-point places of sums, in bits: exact sums don't depend on their order.
SUM_BITS = 16
#: Bins of margins from -MOST_MARGIN to MOST_MARGIN, and the least share of positives that a set of high scores must hold.
BINS = 200
MOST_MARGIN = 10.0
LEAST_POSITIVES = 0.7
#: How far the share of rows predicted positive may be from the prior.
TOLERANCE = 0.03
HIDDEN = 24
EPOCHS = 80
BATCHES = 8

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
N_STATS = len(_PUNCTUATION) + 13


def text_statistics(texts: list[bytes]) -> np.ndarray:
    """One row of statistics for each whole text; all zero for a text without words."""
    words, starts, ends, bounds = hash_words(texts)
    windows = kgrams(words, 8)
    out = np.zeros((len(texts), N_STATS), np.float32)
    for i, text in enumerate(texts):
        lo, hi = bounds[i], bounds[i + 1]
        n = int(hi - lo)
        if not n:
            continue
        own, length = words[lo:hi], (ends[lo:hi] - starts[lo:hi]).astype(np.float64)
        chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(np.float64)
        letters = chars[65:91].sum() + chars[97:123].sum() + chars[128:].sum()
        lines = [x for x in text.split(b"\n") if x.strip()]
        grams = windows[lo : max(lo, hi - 7)]
        out[i, : len(_PUNCTUATION)] = np.log1p(10 * chars[_PUNCTUATION] / (n + 10))
        out[i, len(_PUNCTUATION) :] = [
            np.log(n), np.log(length.mean()), np.log1p(length.std()), np.log1p(length.max()), chars[65:91].sum() / max(letters, 1), np.log1p(10 * chars[48:58].sum() / (n + 10)),
            chars[128:].sum() / len(text), len(np.unique(own)) / n ** 0.9, np.log(n / len(lines)), (len(lines) - len(set(lines))) / (len(lines) + 5),
            (len(grams) - len(np.unique(grams))) / (n + 10), letters / len(text), (length <= 2).mean(),
        ]
    return out


class PositiveUnlabelledModel:
    """One hidden layer over clipped, standardised statistics."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 11):
        self.mean, self.spread, self.rng = mean, spread, np.random.default_rng(seed)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x.astype(np.float64) - self.mean) / self.spread, -4, 4)

    def fit(self, positives: np.ndarray, cells: np.ndarray, sizes: np.ndarray, prior: float) -> PositiveUnlabelledModel:
        """Positives, and the unlabelled rows as means of cells with their numbers of rows."""
        p, u = self._standard(positives), self._standard(cells)
        self.weights = [self.rng.normal(0, (2 / p.shape[1]) ** 0.5, (p.shape[1], HIDDEN)), np.zeros(HIDDEN), self.rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(EPOCHS):
            for a, b in zip(np.array_split(self.rng.permutation(len(p)), BATCHES), np.array_split(self.rng.permutation(len(u)), BATCHES), strict=True):
                if not len(a) or not len(b):
                    continue
                step += 1
                for k, g in enumerate(self._gradient(p[a], u[b], sizes[b] / sizes[b].sum(), prior)):
                    g = g + 1e-4 * self.weights[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - 0.005 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b, v, c = self.weights
        h = np.tanh(x @ w + b)
        return h, 1 / (1 + np.exp(-np.clip(h @ v + c, -30, 30)))

    def _gradient(self, p: np.ndarray, u: np.ndarray, share: np.ndarray, prior: float) -> list[np.ndarray]:
        """Of the risk with the sigmoid loss: a positive costs 1 - s, a negative costs s."""
        (hp, sp), (hu, su) = self._forward(p), self._forward(u)
        negative = su @ share - prior * sp.mean()
        dp, du = sp * (1 - sp) / len(p), su * (1 - su) * share
        if negative >= 0:
            gp, gu = -2 * prior * dp, du
        else:  # the estimate of the negatives' risk overshoots: step back out of it
            gp, gu = prior * dp, -du
        _, _, v, _ = self.weights
        out = [np.zeros_like(w) for w in self.weights]
        for x, h, g in ((p, hp, gp), (u, hu, gu)):
            inner = g[:, None] * v * (1 - h * h)
            for k, d in enumerate((x.T @ inner, inner.sum(0), h.T @ g, g.sum(keepdims=True))):
                out[k] = out[k] + d
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log odds of the positive class."""
        if not len(x):
            return np.zeros(0)
        s = np.clip(self._forward(self._standard(x))[1], 1e-9, 1 - 1e-9)
        return np.clip(np.log(s / (1 - s)), -MOST_MARGIN, MOST_MARGIN)


def _floats(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_STATS)


def mean_and_spread(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each statistic over all vectors (x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, N_STATS), np.int64)
        for batch in batches:
            x = _floats(batch.column("x")).astype(np.float64)
            total += np.stack((np.full(N_STATS, len(x)), np.rint(x * 2.0**SUM_BITS).sum(0), np.rint(x * x * 2.0**SUM_BITS).sum(0))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_STATS)), *[pa.array(t) for t in total]], ["k", "n", "s", "q"])

    rows = vectors.select("x").mapInArrow(run, "k long, n long, s long, q long").groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]).orderBy("k").collect()  # one row a statistic
    n, s, q = (np.array([float(r[c]) for r in rows]) for c in ("n", "s", "q"))
    mean = s / np.maximum(n, 1) / 2**SUM_BITS
    return mean, np.maximum(np.sqrt(np.maximum(q / np.maximum(n, 1) / 2**SUM_BITS - mean * mean, 0)), 0.02)


def cell_means(vectors: DataFrame, mean: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean vector and the number of rows of each cell; at most two to the power of PLANES cells reach the driver."""
    planes = np.random.default_rng(5).normal(size=(N_STATS, PLANES))
    names = [f"s{i}" for i in range(N_STATS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _floats(batch.column("x")).astype(np.float64)
            cell = ((np.clip((x - mean) / spread, -4, 4) @ planes > 0) << np.arange(PLANES)).sum(1)
            kinds, where = np.unique(cell, return_inverse=True)
            sums = np.zeros((len(kinds), N_STATS + 1), np.int64)
            np.add.at(sums, where, np.concatenate((np.ones((len(x), 1)), np.rint(x * 2.0**SUM_BITS)), axis=1).astype(np.int64))
            for k, s in zip(kinds.tolist(), sums, strict=True):
                held[k] = held[k] + s if k in held else s
        if held:
            table = np.stack(list(held.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *[pa.array(table[:, i]) for i in range(N_STATS + 1)]], ["cell", "n", *names])

    fields = ", ".join(f"{c} long" for c in ("cell", "n", *names))
    rows = vectors.select("x").mapInArrow(run, fields).groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).orderBy("cell").toPandas()
    sizes = rows["n"].to_numpy(np.float64)
    return rows[names].to_numpy(np.float64) / np.maximum(sizes, 1)[:, None] / 2**SUM_BITS, sizes


def class_prior(unlabelled: np.ndarray, positives: np.ndarray) -> float:
    """The largest share of positives among the unlabelled rows that agrees with both histograms of scores (rising bins).

    Of the rows above a score, at least prior * (share of the positives above it) are positives, whatever the score.
    """
    above_u, above_p = np.cumsum(unlabelled[::-1]) / max(unlabelled.sum(), 1), np.cumsum(positives[::-1]) / max(positives.sum(), 1)
    useful = above_p >= LEAST_POSITIVES
    return float(min(0.99, max(0.01, (above_u[useful] / above_p[useful]).min()))) if useful.any() else 0.5


def margin_bins(margins: np.ndarray) -> np.ndarray:
    return np.clip(((margins + MOST_MARGIN) * BINS / (2 * MOST_MARGIN)).astype(int), 0, BINS - 1)


def widest_gap(unlabelled: np.ndarray, prior: float) -> float:
    """The margin in the middle of the emptiest stretch of bins above which about `prior` of the unlabelled rows lie."""
    above = np.cumsum(unlabelled[::-1])[::-1] / max(unlabelled.sum(), 1)  # from the bin on
    near = np.flatnonzero(np.abs(above - prior) <= TOLERANCE)
    if not len(near):
        near = np.array([np.abs(above - prior).argmin()])
    around = np.array([unlabelled[max(0, b - 2) : b + 2].sum() for b in near])
    best = near[around == around.min()]
    return float(best.mean() * 2 * MOST_MARGIN / BINS - MOST_MARGIN)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positives: int = MAX_POSITIVES) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs.

    held_out: crc32 of the id as text leaves 1 when divided by 3; such rows' labels are never read. The model is fitted
    on about max_positives rows labelled 1 at most, the first by hash, and on all rows without regard to their labels. A
    null or empty text gets the score of all-zero statistics. Without any positive label in reach every score is 0.5.
    Rows that repeat an id are scored each for itself; a null id is not held out. An empty table gives an empty result.
    Other columns are ignored.
    """
    spark, mark = docs.sparkSession, tables_written()
    id_kind = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "_text"):
            x = text_statistics(utf8(part.column("_text")))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "x"])

    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    vectors = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).mapInArrow(read, f"id {id_kind}, x binary"))
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).where(~held_out("id")).distinct()
    positive = vectors.where(~held_out("id")).join(trusted, "id", "left_semi").select("x", F.xxhash64("id", "x").alias("h"))
    positive = materialize(positive)
    share = max_positives / max(positive.count(), 1)
    thinned = positive.where((F.pmod("h", F.lit(1 << 30)) < int(1.2 * share * (1 << 30))) | F.lit(share >= 1))  # few more than asked for
    drawn = thinned.orderBy("h", "x").limit(max_positives).select("x").collect()
    positives = np.frombuffer(b"".join(bytes(r["x"]) for r in drawn), np.float32).reshape(-1, N_STATS)
    if not len(positives):
        return settled(vectors.select("id", held_out("id").alias("held_out"), F.lit(0.5).alias("score"), F.lit(1).alias("predicted")), mark)
    mean, spread = mean_and_spread(vectors)
    cells, sizes = cell_means(vectors, mean, spread)

    def judged(model: PositiveUnlabelledModel) -> DataFrame:
        known = spark.sparkContext.broadcast(model)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margins = known.value.margin(_floats(batch.column("x")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.round(margins, 9)), pa.array(margin_bins(margins))], ["id", "margin", "bin"])

        return vectors.mapInArrow(score, f"id {id_kind}, margin double, bin long")

    def histogram(scored: DataFrame) -> np.ndarray:
        out = np.zeros(BINS)
        for r in scored.groupBy("bin").agg(F.count("*").alias("n")).collect():  # BINS rows at most
            out[r["bin"]] = r["n"]
        return out

    # the prior: a model of every other positive, and the scores of the remaining ones among those of all rows
    first = PositiveUnlabelledModel(mean, spread).fit(positives[::2], cells, sizes, 0.5)
    others = positives[1::2] if len(positives) > 1 else positives
    prior = class_prior(histogram(judged(first)), np.bincount(margin_bins(first.margin(others)), minlength=BINS))
    scored = materialize(judged(PositiveUnlabelledModel(mean, spread).fit(positives, cells, sizes, prior)))
    shift = widest_gap(histogram(scored), prior)
    score = F.round(1 / (1 + F.exp(F.lit(shift) - F.col("margin"))), 9)
    return settled(scored.select("id", held_out("id").alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")), mark)
