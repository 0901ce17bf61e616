"""Nearest neighbours by inner product from one-bit codes.

Every distinct vector is taken relative to the nearest of a few centres, scaled to unit length and turned by a random
rotation; the signs, packed to bits, and two scalars (the residual's length and how far the signs point its way) are its
code. The codes estimate the inner product with any query to within a bound that shrinks with the root of the number of
bits. A query starts from its k-th best score among a bounded sample of rows, which is below its true k-th best; a
vector is compared in double precision where the estimate plus the bound reaches the best k-th score known so far.

Queries go over the codes in blocks of bounded size, one scan of the written code table for each; tasks return their best
k for each query of the block, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import join_hot, materialize, settled, tables_written
from sparkloom.llm.vector_join import kmeans

#: Neighbours of a query.
NEIGHBOURS = 20
#: Half the width of the bound in standard deviations of the estimate; one neighbour in about 700 lies beyond three.
WIDTH = 3.0
#: Centres and rotation are fitted on about so many vectors at most, the first by hash; the first of them seed thresholds.
FIT_VECTORS = 20_000
SEED_VECTORS = 2_000
CENTRES = 64
#: Queries of a block, and estimates made at once inside a task.
QUERY_BLOCK = 16_384
ESTIMATES = 1 << 22


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with those of y, each summed in the same order wherever the rows stand."""
    return (x * y).sum(1)


class BitCodes:
    """Centres, a rotation, and what they make of vectors and queries."""

    def __init__(self, sample: np.ndarray, centres: int = CENTRES, seed: int = 11):
        dim = sample.shape[1]
        self.bits = -(-dim // 64) * 64
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.standard_normal((self.bits, self.bits)))[0][:dim]  # a shorter vector is filled up with zeros
        self.centres = kmeans(sample, centres, seed=seed)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centre, packed signs, residual length and the inner product of unit residual and unit code."""
        far = (x * x).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres * self.centres).sum(1)
        cell = far.argmin(1)
        turned = (x - self.centres[cell]) @ self.rotation
        length = np.sqrt((turned * turned).sum(1))
        along = np.abs(turned).sum(1) / np.where(length > 0, length, 1) / np.sqrt(self.bits)
        return cell, np.packbits(turned > 0, axis=1), length, np.where(length > 0, along, 1.0)

    def turned(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What estimates need of queries: inner products with centres, rotated queries, and lengths."""
        return queries @ self.centres.T, (queries @ self.rotation / np.sqrt(self.bits)).astype(np.float32), np.sqrt((queries * queries).sum(1))

    def upper(self, code: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], turned: tuple[np.ndarray, np.ndarray, np.ndarray], width: float = WIDTH) -> np.ndarray:
        """Estimated inner products plus their bounds: a row for each vector, a column for each query."""
        (cell, packed, length, along), (to_centres, rotated, size) = code, turned
        signs = (np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1) @ rotated.T
        signs *= (length / along).astype(np.float32)[:, None]
        spread = length * np.sqrt(np.maximum(0, 1 - along * along)) / along * width / np.sqrt(self.bits - 1)
        # single precision adds its own rounding, far below this share of the sizes
        slack = 1e-5 * (length / along + np.abs(self.centres[cell]).sum(1))
        signs += to_centres.astype(np.float32).T[cell]
        return signs + (spread + slack).astype(np.float32)[:, None] * size.astype(np.float32)[None, :]


class BestOf:
    """The best k of what each query has met, and the score that a newcomer has to reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()
        self.query, self.score, self.low, self.place = (np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64))

    def add(self, query: np.ndarray, score: np.ndarray, low: np.ndarray, place: np.ndarray) -> None:
        """low: the smallest id that has the vector, which decides ties; place: where it can be found again."""
        q, s, i, p = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.low, low), (self.place, place)))
        order = np.lexsort((i, -s, q))
        q, s, i, p = q[order], s[order], i[order], p[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        self.query, self.score, self.low, self.place = q[kept], s[kept], i[kept], p[kept]
        full = rank == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], s[full])


def _usable(column: pa.Array, dim: int) -> list[bytes | None]:
    """Vectors as bytes of doubles; null where one is null, zero, of another length or has null or non-finite parts."""
    out: list[bytes | None] = []
    for v in column.to_pylist():
        x = np.asarray(v, np.float64) if v is not None and len(v) == dim and None not in v else None
        out.append((x + 0.0).tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _share(column: str, part: float) -> F.Column:
    """Rows whose hash (hexadecimal digits, evenly spread) lies in the first part of all hashes."""
    return F.lit(True) if part >= 1 else F.col(column) < f"{int(part * 16**13):013x}"


def _fitted(nodes: DataFrame, dim: int) -> tuple[BitCodes, np.ndarray]:
    """Centres and rotation, and the sample that thresholds start from; both bounded at any size of the table."""
    total = nodes.count()
    rows = nodes.where(_share("h", FIT_VECTORS / total)).select("h", "v").toArrow().sort_by("h")
    sample = _matrix(rows["v"], dim) if len(rows) else _matrix(nodes.orderBy("h").limit(1).toArrow()["v"], dim)
    return BitCodes(sample), sample[: max(1, round(SEED_VECTORS))]


def _searched(codes: DataFrame, queries: DataFrame, coder: BitCodes, dim: int, k: int) -> DataFrame:
    """(query, h, score): the best k distinct vectors of each task for each query row (number, v, least) of one block."""
    block = queries.toArrow()  # at most QUERY_BLOCK rows
    numbers, q, least = block["number"].to_numpy(), _matrix(block["v"], dim), block["least"].to_numpy()
    shared = queries.sparkSession.sparkContext.broadcast((coder, numbers, q, least))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, numbers, q, least = shared.value
        turned, best = coder.turned(q), BestOf(least, k)
        names: list[str] = []
        step = max(64, ESTIMATES // max(1, len(q)))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                packed = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint8).reshape(len(part), -1)
                code = (part.column("cell").to_numpy(), packed, part.column("length").to_numpy(), part.column("along").to_numpy())
                row, query = np.nonzero(~(coder.upper(code, turned) < best.least.astype(np.float32)))  # what can't be estimated is compared, too
                x, low = _matrix(part.column("v"), dim), part.column("low").to_numpy()
                met: list[tuple[np.ndarray, ...]] = []
                for start in range(0, len(row), 1 << 16):
                    r, s = row[start : start + (1 << 16)], query[start : start + (1 << 16)]
                    score = exact_scores(x[r], q[s])
                    good = score >= best.least[s]
                    met.append((s[good], score[good], low[r[good]], r[good]))
                if not met:
                    continue
                s, score, ids, r = (np.concatenate(c) for c in zip(*met, strict=True))
                # names are kept for vectors that are someone's best, and only while they are
                best.add(s, score, ids, r + len(names))
                names += part.column("h").to_pylist()
                used = np.unique(best.place)
                names = [names[i] for i in used.tolist()]
                best.place = np.searchsorted(used, best.place)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[best.query]), pa.array([names[i] for i in best.place.tolist()], pa.string()), pa.array(best.score)], ["number", "h", "score"])

    return codes.mapInArrow(scan, "number bigint, h string, score double")


def nearest(vectors: DataFrame, queries: F.Column | str, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each row that the condition `queries` holds for.

    A row is no neighbour of itself. Ties go to the smaller id. Vectors that are null, zero, of another length than most, or
    hold null or non-finite parts, take no part, and neither do rows with a null id. Rows that repeat an id are queries and
    candidates of their own. Fewer candidates than k are all returned; an empty table gives an empty result. Ids are whole
    numbers. Other columns are ignored.
    """
    spark, mark = vectors.sparkSession, tables_written()
    if isinstance(queries, str):
        queries = F.expr(queries)
    lengths = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = lengths[0]["d"] if lengths else 0

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("asks"), pa.array(_usable(batch.column("v"), dim), pa.binary())], ["id", "asks", "v"])

    given = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col(vector_col).alias("v"))
    rows = materialize(given.mapInArrow(usable, "id bigint, asks boolean, v binary").where("v is not null").withColumn("h", F.sha2("v", 256)).withColumn("r", F.monotonically_increasing_id()))
    nodes = materialize(rows.groupBy("h").agg(F.min("v").alias("v"), F.min("id").alias("low"), F.bool_or("asks").alias("asks"), F.sum(F.col("asks").cast("long")).alias("asking")))
    if not dim or nodes.isEmpty():
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    coder, seeds = _fitted(nodes, dim)
    fitted, seeded = spark.sparkContext.broadcast(coder), spark.sparkContext.broadcast(seeds)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, packed, length, along = fitted.value.encode(_matrix(batch.column("v"), dim))
            columns = [batch.column("h"), batch.column("low"), batch.column("v"), pa.array(cell), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(length), pa.array(along)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "low", "v", "cell", "bits", "length", "along"])

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = seeded.value
        for batch in batches:
            q = _matrix(batch.column("v"), dim)
            least = np.full(len(q), -np.inf)
            if len(sample) > k:  # k rows besides the query's own have at least this score; less what two ways of summing can differ by
                scores = q @ sample.T
                least = np.partition(scores, len(sample) - k - 1, axis=1)[:, len(sample) - k - 1]
                least = least - 1e-12 * np.abs(q).sum(1) * np.abs(sample).max()
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("v"), pa.array(least)], ["h", "v", "least"])

    codes = materialize(nodes.select("h", "low", "v").mapInArrow(encoded, "h string, low bigint, v binary, cell bigint, bits binary, length double, along double"))
    asking = nodes.where("asks").select("h", "v").mapInArrow(started, "h string, v binary, least double")
    total = nodes.where("asks").count()
    blocks = -(-total // (QUERY_BLOCK * 3 // 4)) if total > QUERY_BLOCK else 1  # hashes fill blocks nearly evenly
    asking = materialize(asking.withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks))).withColumn("number", F.monotonically_increasing_id()))
    met = None
    for b in range(blocks):
        found = materialize(_searched(codes, asking.where(F.col("block") == b), coder, dim, k + 1))
        met = found if met is None else met.unionByName(found)
    # the smallest k + 1 ids of a vector are all that any list can hold of it
    ids = rows.select("h", "id", F.row_number().over(Window.partitionBy("h").orderBy("id")).alias("at")).where(F.col("at") <= k + 1)
    ids = ids.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    best = Window.partitionBy("number").orderBy(F.desc("score"), "low")
    met = materialize(met.join(codes.select("h", "low"), "h").withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at"))
    listed = met.join(ids, "h").select("number", "h", "score", F.explode("ids").alias("id"))
    listed = listed.withColumn("at", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "id"))).where(F.col("at") <= k + 1)
    lists = listed.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("at", "id", "score", "h"))).alias("list"))
    lists = materialize(asking.select("h", "number").join(lists, "number").join(nodes.select("h", "asking"), "h").select("h", "list", "asking"))
    asked = join_hot(rows.where("asks").select("id", "h", "r"), lists, "h", "asking", ["r"])
    own = F.array_min(F.transform(F.filter("list", lambda x: (x["h"] == F.col("h")) & (x["id"] == F.col("id"))), lambda x: x["at"]))
    others = F.slice(F.filter("list", lambda x: ~x["at"].eqNullSafe(F.col("own"))), 1, k)
    ranked = asked.withColumn("own", own).select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return settled(ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score")), mark)
