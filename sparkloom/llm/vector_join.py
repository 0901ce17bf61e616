"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one per half of the vector, form a product grid; every vector is listed in one cell. A vector visits
cells by rising distance in multi-sequence order and is compared, in double precision, with the vectors listed there.
How many cells are visited is measured: probes are compared with all rows, and the number of cells is the least at which
probes find the target share of their partners, each probe counting the same and each class of partner counts reaching
the target by itself. If MOST_CELLS cells don't reach it, the grid is made coarser; its last form is one cell, which
compares everything with everything.

Equal vectors are one node with a multiplicity. Cells are split into blocks of bounded size on both sides; a block
returns numbers and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import join_hot, materialize, settled, tables_written
from sparkloom.llm.components import connected_components, smallest_ids

THRESHOLD = 0.9
TARGET_RECALL = 0.99
#: Codebooks are fitted on about so many vectors at most, the first by hash of their content.
FIT_VECTORS = 20_000
#: Probes of the first round and of a later round at most, about; a round has four times the probes of the one before.
PROBE_VECTORS = 400
ROUND_VECTORS = 6400
#: Rounds go on until each class of partner counts that was met (by its least count) has so many probes, or all rows were probes.
LEAST_PROBES = 100
CLASSES = (1, 4, 32)
#: Cells visited at most before the grid is made coarser.
MOST_CELLS = 64
#: Vectors that a cell holds on average, codewords at most per half, and rows of one side of a block.
PER_CELL = 40
MOST_CODES = 1024
BLOCK = 2048


def kmeans(x: np.ndarray, k: int, steps: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of at most k clusters of the rows of x."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        near = _squared(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


class MultiIndex:
    """The product grid of two codebooks."""

    def __init__(self, sample: np.ndarray, codes: int):
        self.half = sample.shape[1] // 2
        self.books = (kmeans(sample[:, : self.half], codes), kmeans(sample[:, self.half :], codes))
        self.width = len(self.books[1])

    def _distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squared(x[:, : self.half], self.books[0]), _squared(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        a, b = self._distances(x)
        return a.argmin(1) * self.width + b.argmin(1)

    def visits(self, x: np.ndarray, count: int) -> np.ndarray:
        """For each row its nearest `count` cells, nearest first.

        Only a pair of ranks (i, j) with (i + 1)(j + 1) <= count can be among them, which is the order a
        multi-sequence traversal walks in.
        """
        a, b = self._distances(x)
        ia, ib = np.argsort(a, 1, kind="stable")[:, :count], np.argsort(b, 1, kind="stable")[:, :count]
        i, j = np.array([(i, j) for i in range(ia.shape[1]) for j in range(min(ib.shape[1], count // (i + 1)))]).T
        rows = np.arange(len(x))[:, None]
        sums = a[rows, ia[:, i]] + b[rows, ib[:, j]]
        best = np.argsort(sums, 1, kind="stable")[:, :count]
        return ia[rows, i[best]] * self.width + ib[rows, j[best]]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _unit(column: pa.Array, dim: int) -> list[bytes | None]:
    """Unit vectors as bytes of doubles; null where a vector is null, zero, of another length or has null or non-finite parts."""
    out: list[bytes | None] = []
    for v in column.to_pylist():
        x = None
        if v is not None and len(v) == dim and None not in v:
            x = np.asarray(v, np.float64)
            top = np.abs(x).max() if dim else 0.0
            if np.isfinite(x).all() and top > 0:
                x = x / top
                x = x / np.sqrt(x @ x)
            else:
                x = None
        out.append(None if x is None else (x + 0.0).tobytes())
    return out


def _hash_at(share: float) -> str:
    """The hash (in hexadecimal digits) below which that share of all hashes lies."""
    return "g" if share >= 1 else f"{int(share * 16**13):013x}"


def _vectors(rows: list, dim: int) -> tuple[list[str], np.ndarray]:
    return [r["h"] for r in rows], np.frombuffer(b"".join(bytes(r["v"]) for r in rows), "<f8").reshape(-1, dim)


def _rounds(nodes: DataFrame, edge: float, total: int, dim: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Hashes and vectors of all nodes in rounds: first those after edge, which the grid wasn't fitted on, then the others.

    Hashes are spread evenly, so a range of them holds about as many rows as its share; nothing else is sent to the driver.
    """
    size = PROBE_VECTORS
    for at, end in ((edge, 1.0), (0.0, edge)):
        while at < end:
            upto = min(end, at + size / total)
            yield _vectors(nodes.where((F.col("h") >= _hash_at(at)) & (F.col("h") < _hash_at(upto))).select("h", "v").collect(), dim)
            at, size = upto, min(4 * size, ROUND_VECTORS)


def _found_by_rank(nodes: DataFrame, index: MultiIndex, hashes: list[str], probes: np.ndarray, threshold: float, most: int) -> list:
    """(class, rank, probes, share): shares of their partners that probes of a class find at a rank, added up; rank `most` is any later one."""
    dim = probes.shape[1]
    shared = nodes.sparkSession.sparkContext.broadcast((index, hashes, probes))  # two codebooks and a round's probes

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes, probes = shared.value
        order, number = index.visits(probes, most), {h: i for i, h in enumerate(hashes)}
        seen = np.zeros((len(probes), most + 1), np.int64)
        for batch in batches:
            all_x, own = _matrix(batch.column("v"), dim), batch.column("h").to_pylist()
            all_cells = index.cells(all_x)
            for start in range(0, len(all_x), 512):
                x, cells = all_x[start : start + 512], all_cells[start : start + 512]
                near = probes @ x.T >= threshold
                for i, h in enumerate(own[start : start + 512]):
                    if h in number:
                        near[number[h], i] = False
                every_q, every_i = np.nonzero(near)
                for lo in range(0, len(every_q), 1 << 16):
                    q, i = every_q[lo : lo + (1 << 16)], every_i[lo : lo + (1 << 16)]
                    hit = order[q] == cells[i][:, None]
                    np.add.at(seen, (q, np.where(hit.any(1), hit.argmax(1), most)), 1)
        q, rank = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rank), pa.array(seen[q, rank])], ["probe", "rank", "n"])

    met = nodes.select("h", "v").mapInArrow(ranks, "probe long, rank long, n long").groupBy("probe", "rank").agg(F.sum("n").alias("n"))
    per_probe = met.groupBy("probe").agg(F.sum("n").alias("partners"), F.collect_list(F.struct("rank", "n")).alias("at"))
    kind = F.greatest(*[F.when(F.col("partners") >= c, c) for c in CLASSES])
    # one row of the class carries the probe itself, so that probes add up over ranks
    spread = per_probe.select(kind.alias("class"), "partners", F.posexplode("at").alias("k", "x")).select("class", "x.rank", (F.col("k") == 0).cast("long").alias("one"), (F.col("x.n") / F.col("partners")).alias("share"))
    found = spread.groupBy("class", "rank").agg(F.sum("one").alias("probes"), F.sum("share").alias("share")).collect()  # at most len(CLASSES) * (most + 1) rows
    shared.unpersist()
    return found


def fitted_grid(nodes: DataFrame, dim: int, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, most: int = MOST_CELLS) -> tuple[MultiIndex, int, dict[int, tuple[int, float]]]:
    """The grid over nodes (h, v), the number of cells to visit, and (probes, measured recall) by class of partner counts.

    Without any partner in the whole table, which all rows were probed for, one cell is visited and the measure is empty.
    """
    total = nodes.count()
    edge = min(0.5, FIT_VECTORS / total)
    fit = _vectors(nodes.where(F.col("h") < _hash_at(edge)).select("h", "v").collect() or nodes.orderBy("h").limit(1).collect(), dim)[1]
    codes = min(MOST_CODES, max(1, math.ceil(math.sqrt(total / PER_CELL))))
    while True:
        index = MultiIndex(fit, codes)
        probes, shares = dict.fromkeys(CLASSES, 0), {c: np.zeros(most + 1) for c in CLASSES}
        for hashes, x in _rounds(nodes, edge, total, dim):
            if not hashes:
                continue
            for r in _found_by_rank(nodes, index, hashes, x, threshold, most):
                probes[r["class"]] += r["probes"]
                shares[r["class"]][r["rank"]] += r["share"]
            if any(probes.values()) and all(n >= LEAST_PROBES for n in probes.values() if n):
                break
        curves = {c: np.cumsum(shares[c][:most]) / probes[c] for c in CLASSES if probes[c]}
        for visits in range(1, most + 1):
            if codes == 1 or all(curve[visits - 1] >= recall for curve in curves.values()):
                return index, visits, {c: (probes[c], round(float(curve[visits - 1]), 4)) for c, curve in curves.items()}
        codes //= 2


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors.

    n_links counts the other rows found with cosine >= threshold, component_id is the smallest id that links reach,
    kept tells whether it is the row's own. Vectors that are null, zero, of another length than most or hold null or
    non-finite components link with nothing. A repeated id is a row of its own; rows of one id are in one component. A row
    with a null id links like any other; component_id is null only where no row of the component has an id. An empty
    table gives an empty result. Other columns are ignored.
    """
    spark, mark = vectors.sparkSession, tables_written()
    id_kind = vectors.schema[id_col].dataType.simpleString()
    lengths = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = lengths[0]["d"] if lengths else 0

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(_unit(batch.column(vector_col), dim), pa.binary())], [id_col, "v"])

    rows = vectors.select(id_col, vector_col).mapInArrow(units, f"`{id_col}` {id_kind}, v binary").withColumnRenamed(id_col, "id")
    rows = materialize(rows.withColumn("h", F.sha2("v", 256)).withColumn("r", F.monotonically_increasing_id()))
    # a node is named by half of its vector's hash
    nodes = materialize(rows.where("v is not null").groupBy("h").agg(F.unhex(F.substring("h", 1, 32)).alias("id"), F.count("*").alias("n"), F.min("v").alias("v")))
    if not dim or nodes.isEmpty():
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    index, visits, _ = fitted_grid(nodes, dim, threshold, recall)
    shared = spark.sparkContext.broadcast(index)  # two codebooks

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            walk = index.visits(x, visits)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * walk.shape[1], pa.int32()), pa.array(walk.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), batch.column("v"), pa.array(index.cells(x), pa.int64()), flat], ["id", "n", "v", "cell", "walk"])

    placed = materialize(nodes.select("id", "n", "v").mapInArrow(listed, "id binary, n long, v binary, cell long, walk array<long>"))
    members = placed.select("cell", F.lit(False).alias("visitor"), "id", "n", "v", F.col("cell").alias("home"), "walk")
    visitors = placed.select(F.explode("walk").alias("cell"), F.lit(True).alias("visitor"), "id", "n", "v", F.col("cell").alias("home"), F.expr("cast(array() as array<bigint>)").alias("walk"))
    sizes = members.groupBy("cell").agg(F.count("*").alias("m")).join(visitors.groupBy("cell").agg(F.count("*").alias("w")), "cell")
    sizes = sizes.select("cell", F.ceil(F.col("m") / BLOCK).alias("m"), F.ceil(F.col("w") / BLOCK).alias("w"))
    salted = members.unionByName(visitors).join(sizes, "cell").withColumn("s", F.xxhash64("id"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = salted.where("not visitor").select("*", F.pmod("s", F.col("m")).alias("mb"), every("w").alias("wb")).unionByName(salted.where("visitor").select("*", every("m").alias("mb"), F.pmod("s", F.col("w")).alias("wb")))

    def block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        m, w = table.filter(pc.invert(table["visitor"])), table.filter(table["visitor"])
        ids = pa.concat_arrays([m["id"].combine_chunks(), w["id"].combine_chunks()])
        x, y = _matrix(m["v"], dim), _matrix(w["v"], dim)
        near = (x @ y.T >= threshold) & (np.array(m["id"].to_pylist(), object)[:, None] != np.array(w["id"].to_pylist(), object)[None, :]) if len(x) and len(y) else np.zeros((len(x), len(y)), bool)
        nm, nw = m["n"].to_numpy(), w["n"].to_numpy()
        walks = m["walk"].to_pylist()
        home = w["home"].to_numpy()
        # a member counts a visitor only where it doesn't visit that one's cell itself, and so counts it there
        mutual = np.array([np.isin(home, v) for v in walks]).reshape(near.shape)
        links = np.concatenate(((near & ~mutual) @ nw, nm @ near)) if near.size else np.zeros(len(ids), np.int64)
        label = np.arange(len(ids))
        p, q = np.nonzero(near)
        while len(p):  # smallest label on either side of every link, until none changes
            low = np.minimum(label[p], label[len(x) + q])
            before = label.copy()
            np.minimum.at(label, p, low)
            np.minimum.at(label, len(x) + q, low)
            label = label[label]
            if (label == before).all():
                break
        return pa.table({"id": ids, "links": pa.array(links, pa.int64()), "root": ids.take(pa.array(label))})

    parts = materialize(dealt.select("cell", "mb", "wb", "visitor", "id", "n", "v", "home", "walk").groupBy("cell", "mb", "wb").applyInArrow(block, "id binary, links long, root binary"))
    degree = parts.groupBy("id").agg(F.sum("links").alias("links"))
    joined = connected_components(parts.where("id <> root"), "id", "root")
    known = nodes.select("h", F.col("id").alias("node"), F.col("n")).join(degree, F.col("node") == degree["id"], "left").select("h", "node", "n", F.coalesce("links", F.lit(0)).alias("links"))
    known = known.join(joined, known["node"] == joined["id"], "left").select("h", F.col("n").alias("rows"), F.coalesce("component", "node").alias("root"), (F.col("links") + F.col("n") - 1).alias("n_links"))
    placed = materialize(join_hot(rows.where("h is not null").select("id", "h", "r"), materialize(known), "h", "rows", ["r"]).select("id", "r", "root", "n_links"))
    names = smallest_ids(placed).join(placed.groupBy("root").agg(F.count("*").alias("rows")), "root", "right")
    linked = join_hot(placed, materialize(names), "root", "rows", ["r"]).select("id", "n_links", "component_id")
    alone = rows.where("h is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return settled(linked.unionByName(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("id"))), mark)
