"""The trie of conversations' shared beginnings, by distributed MSD radix partitioning.

Turns are named by dictionary ids, and equal conversations are one sequence with a count. A bucket is the set of sequences
below one node. Each round takes the buckets that are too large for a task: the least and the greatest sequence of a
bucket give the beginning that all of it shares, whose nodes are emitted at once, and the turn after that deals it into
smaller buckets. So a long common beginning costs one round, and rounds end with the branching of large buckets. The others
are finished inside tasks by multikey quicksort, whose recursion into equal turns emits a node each.

A bucket is named by the turns at which it was dealt, so the buckets above it are the beginnings of its name: sums over
subtrees go up by exploding these names, one row per bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import join_hot, materialize, settled, tables_written

#: A bucket whose sequences have more turns than this, and more than one of MOST_LARGE parts of all turns, is dealt further;
#: so fewer than MOST_LARGE buckets are.
LOCAL_TURNS = 20_000
MOST_LARGE = 50_000
#: Member ids that are joined to one string before they go to the task that digests a list.
IDS_AT_ONCE = 10_000
NO_IDS = hashlib.sha256(b"").hexdigest()

_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, path array<bigint>, top boolean"


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) for each id: an array of (id of the turn's role and text, code points of the text) in order.

    Null roles and texts are empty. Turns go by number, null first; those that share one go by a digest of role and text, and
    repeated rows are turns of their own. Rows with a null id are left out.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("at"), digest.alias("digest"), F.char_length(text).cast("bigint").alias("chars"))
    rows = materialize(rows)
    words = materialize(rows.groupBy("digest").agg(F.count("*").alias("rows")).withColumn("code", F.monotonically_increasing_id()))
    coded = join_hot(rows, words, "digest", "rows", ["conv_id", "at"])
    ordered = F.sort_array(F.collect_list(F.struct("at", "digest", "code", "chars")))
    return coded.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["code"].alias("code"), x["chars"].alias("chars"))).alias("turns"))


def rebuilt(found: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c after the first h turns of its group's first one (c - c % group); h is the CRC of c's digits modulo `most`.

    All its turns count where that one has fewer, none where there is none. The conversation's own first h turns go.
    """
    first = found.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, most - 1).alias("shared"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    own = found.withColumn("h", h).withColumn("first", F.col("conv_id") - F.col("conv_id") % group).join(first, "first", "left")
    shared = F.coalesce(F.slice("shared", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.select("conv_id", F.concat(shared, rest).alias("turns"))


def _digests(members: DataFrame) -> DataFrame:
    """(name, ends): the SHA-256 of the ascending ids of each name, comma-joined; members are (name, conv_id).

    Ids are sorted over all tasks and joined in strings of bounded length; a digest has to read them one after the other,
    which it does as a stream.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids = batch.column("name").to_numpy(), batch.column("conv_id").to_numpy()
            cuts = np.flatnonzero(np.diff(names)) + 1
            starts = np.unique(np.concatenate(([0], cuts, np.arange(0, len(names), IDS_AT_ONCE))))
            parts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(names)], strict=True)] if len(names) else []
            at = starts if len(names) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(ids[at]), pa.array(parts, pa.string())], ["name", "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for name, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name == now:
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = name, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([e for _, e in out], pa.string())], ["name", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["name", "ends"])

    parts = members.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(joined, "name bigint, first bigint, ids string")
    return parts.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digested, "name bigint, ends string")


def _distinct(found: DataFrame) -> DataFrame:
    """(codes, chars, conv_id, n, ends) for each distinct sequence: smallest member, number of members, digest of their ids."""
    given = materialize(found.select("conv_id", F.col("turns.code").alias("codes"), F.col("turns.chars").alias("chars")))
    # chars follow from codes
    one = materialize(given.groupBy("codes").agg(F.min("chars").alias("chars"), F.min("conv_id").alias("low"), F.count("*").alias("n")).withColumn("name", F.monotonically_increasing_id()))
    alone = one.where("n = 1").select("codes", "chars", "low", "n", F.sha2(F.col("low").cast("string"), 256).alias("ends"))
    shared = one.where("n > 1")
    members = join_hot(given.select("codes", "conv_id"), shared.select("codes", "name", "n"), "codes", "n", ["conv_id"])
    return alone.unionByName(shared.join(_digests(members), "name").select("codes", "chars", "low", "n", "ends"))


class _Local:
    """The nodes of one bucket: runs of nodes with the same members, each with the run above it."""

    def __init__(self, codes: list[np.ndarray], chars: list[np.ndarray], low: np.ndarray, n: np.ndarray, ends: list[str], depth: int, above: int | None):
        self.codes, self.low, self.n = codes, low, n
        self.size = np.array([len(c) for c in codes])
        runs: list[tuple[np.ndarray, int, int, int]] = []  # members, first and last depth, run above
        self._sort(np.arange(len(codes)), depth, runs)
        count = len(runs)
        leaves, saved, children = [0] * count, [0] * count, [0] * count
        self.rows: list[tuple] = [()] * count
        for i in range(count - 1, -1, -1):  # a run comes after the one above it
            members, first, last, parent = runs[i]
            one, convs = int(members[0]), int(n[members].sum())
            own = chars[one][max(first, 1) - 1 : last]
            gains = (convs - 1) * own
            lost = np.concatenate((np.zeros(1 if first == 0 else 0, np.int64), gains))
            sums = saved[i] + np.cumsum(lost[::-1])[::-1]
            if not children[i]:
                leaves[i] = 1
            ended = [int(m) for m in members if self.size[m] == last]  # at most one: sequences are distinct
            who = int(low[members].min())
            self.rows[i] = (who, first, last, convs, children[i], leaves[i], sums, ends[ended[0]] if ended else NO_IDS, parent)
            if parent >= 0:
                children[parent] += 1
                leaves[parent] += leaves[i]
                saved[parent] += int(sums[0])
        self.above = above

    def _sort(self, members: np.ndarray, depth: int, runs: list[tuple[np.ndarray, int, int, int]]) -> None:
        """Multikey quicksort over (members, depth, run above, whether members share the turn before depth), by a stack."""
        stack = [(members, depth, -1, True)]
        while stack:
            members, depth, above, node = stack.pop()
            if node:
                first, last = depth, self._shared(members, depth)
                runs.append((members, first, last, above))
                above, depth = len(runs) - 1, last
                members = members[self.size[members] > depth]
                if len(members):
                    stack.append((members, depth, above, False))
                continue
            keys = np.array([self.codes[m][depth] for m in members])
            pivot = np.sort(keys)[len(keys) // 2]
            for part, equal in ((members[keys < pivot], False), (members[keys == pivot], True), (members[keys > pivot], False)):
                if len(part):
                    stack.append((part, depth + 1 if equal else depth, above, equal))

    def _shared(self, members: np.ndarray, depth: int) -> int:
        """How many turns all members share."""
        first = self.codes[members[0]]
        most = len(first)
        for m in members[1:]:
            other = self.codes[m]
            most = min(most, len(other))
            differ = np.flatnonzero(first[depth:most] != other[depth:most])
            if len(differ):
                most = depth + int(differ[0])
            if most == depth:
                break
        return most

    def columns(self) -> list[np.ndarray | list]:
        """conv_id, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends for each node."""
        who, depth, parent, convs, children, leaves, saved, ends = ([] for _ in range(8))
        for one, first, last, n, below, tips, sums, end, above in self.rows:
            length = last - first + 1
            who += [one] * length
            depth += range(first, last + 1)
            parent += [self.rows[above][0] if above >= 0 else self.above, *[one] * (length - 1)]
            convs += [n] * length
            children += [*[1] * (length - 1), below]
            leaves += [tips] * length
            saved += sums.tolist()
            ends += [*[NO_IDS] * (length - 1), end]
        return [who, depth, parent, convs, children, leaves, saved, ends]


def _finished(rows: DataFrame) -> DataFrame:
    """All nodes of buckets that fit a task; rows of a bucket come together in the sorted stream of a task."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def nodes(bucket: list[tuple]) -> pa.RecordBatch:
            path, depth, above = bucket[0][0], bucket[0][1], bucket[0][2]
            columns = _Local([np.array(b[3], np.int64) for b in bucket], [np.array(b[4], np.int64) for b in bucket], np.array([b[5] for b in bucket]), np.array([b[6] for b in bucket]), [b[7] for b in bucket], depth, above).columns()
            count = len(columns[0])
            kinds = [*[pa.int64()] * 7, pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([path] * count, pa.list_(pa.int64())), pa.array([True, *[False] * (count - 1)])], names)

        made: list[pa.RecordBatch] = []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("path", "depth", "above", "codes", "chars", "low", "n", "ends")], strict=True):
                if held and held[0][0] != row[0]:
                    made.append(nodes(held))
                    held = []
                held.append(row)
            if made:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                made = []
        if held:
            yield nodes(held)

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "path", "top"]
    dealt = rows.repartition("path").sortWithinPartitions("path").select("path", "depth", "above", "codes", "chars", "low", "n", "ends")
    return dealt.mapInArrow(local, _NODE)


def trie(found: DataFrame) -> DataFrame:
    """One row per node of the trie over sequences (conv_id, turns): turns are (code, chars), equal codes with equal chars.

    conv_id is the smallest member; parent_conv_id, that of the node above; n_convs, members; n_children; n_leaves, nodes
    without children in the subtree; saved_tokens, the code points that members needn't repeat, over the subtree; ends_sha256,
    the digest of the ids of members that end here. The root is the empty beginning, which has every conversation as a member.
    No conversations have no nodes. A conversation is one row of turn ids; everything else is bounded or dealt out.
    """
    mark = tables_written()
    distinct = _distinct(found)
    active = materialize(distinct.select(F.expr("cast(array() as array<bigint>)").alias("path"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("above"), "codes", "chars", "low", "n", "ends"))
    turns = F.greatest(F.size("codes").cast("bigint") - F.col("depth"), F.lit(1).cast("bigint"))
    limit = max(LOCAL_TURNS, (active.agg(F.sum(turns)).first()[0] or 0) // MOST_LARGE)
    finished, spine, first = [], [], True
    while True:
        sizes = active.groupBy("path").agg(F.sum(turns).alias("turns"))
        large = sizes.where(F.lit(first) | (F.col("turns") > limit)).select("path")  # the root is always dealt out
        some = active.join(F.broadcast(large), "path")
        ends = F.struct("codes", "chars")
        seen = some.groupBy("path").agg(F.min("depth").alias("depth"), F.min("above").alias("above"), F.min("low").alias("low"), F.sum("n").alias("n"), F.count("*").alias("rows"), F.min(ends).alias("lo"), F.max("codes").alias("hi"))
        same = F.expr("aggregate(sequence(0, least(size(lo.codes), size(hi)) - 1), 0, (s, i) -> if(s = i and lo.codes[i] = hi[i], s + 1, s))")
        last = F.when(F.least(F.size("lo.codes"), F.size("hi")) == 0, 0).otherwise(same).cast("bigint")
        # every sequence between the least and the greatest begins as both do
        seen = materialize(seen.select("path", "depth", "above", "low", "n", "rows", last.alias("last"), F.col("lo.chars").alias("chars")))
        if seen.isEmpty():
            break
        spine.append(seen)
        cut = F.broadcast(seen.select("path", F.col("last"), F.col("low").alias("top_low")))
        dealt = active.join(cut, "path").where(F.size("codes") > F.col("last"))
        ended = active.join(cut, "path").where(F.size("codes") == F.col("last")).select("path", "ends")
        spine[-1] = seen.join(ended, "path", "left")
        dealt = dealt.select(F.concat("path", F.array(F.col("codes")[F.col("last").cast("int")])).alias("path"), (F.col("last") + 1).alias("depth"), F.col("top_low").alias("above"), "codes", "chars", "low", "n", "ends")
        if not first:
            finished.append(active.join(F.broadcast(seen.select("path")), "path", "left_anti"))
        active, first = materialize(dealt), False
    finished.append(active)
    rest = finished[0]
    for more in finished[1:]:
        rest = rest.unionByName(more)
    local = materialize(_finished(rest))
    if not spine:
        return settled(local.drop("path", "top"), mark)
    tops = spine[0]
    for more in spine[1:]:
        tops = tops.unionByName(more)
    chain = F.when(F.col("last") == 0, F.lit(0).cast("bigint")).otherwise(F.expr("aggregate(slice(chars, cast(greatest(depth, 1) as int), cast(last - greatest(depth, 1) + 1 as int)), 0L, (s, x) -> s + x)")) * (F.col("n") - 1)
    tops = materialize(tops.withColumn("chain", chain))
    parts = local.where("top").select("path", "n_leaves", F.col("saved_tokens").alias("saved"))
    parts = parts.unionByName(tops.select("path", (F.col("rows") == 1).cast("bigint").alias("n_leaves"), F.col("chain").alias("saved"))).where(F.size("path") > 0)
    over = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda k: F.slice("path", F.lit(1), k))
    sums = parts.select(F.explode(over).alias("path"), "n_leaves", "saved").groupBy("path").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"))
    under = local.where("top").select("path").unionByName(tops.select("path")).where(F.size("path") > 0)
    below = under.groupBy(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.count("*").alias("below"))
    whole = tops.join(sums, "path", "left").join(below, "path", "left").withColumn("d", F.explode(F.sequence("depth", "last")))
    inside = F.expr("aggregate(slice(chars, cast(greatest(d, 1) as int), cast(last - greatest(d, 1) + 1 as int)), 0L, (s, x) -> s + x)")
    inside = F.when(F.col("last") == 0, F.lit(0).cast("bigint")).otherwise(inside) * (F.col("n") - 1)
    at_end, zero = F.col("d") == F.col("last"), F.lit(0).cast("bigint")
    nodes = whole.select(
        F.col("low").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("depth"), F.col("above")).otherwise(F.col("low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(at_end, F.coalesce("below", zero)).otherwise(1).alias("n_children"), F.coalesce(F.when(F.col("leaves") > 0, F.col("leaves")), F.lit(1).cast("bigint")).alias("n_leaves"),
        (F.coalesce("saved", zero) + inside).alias("saved_tokens"), F.when(at_end, F.coalesce("ends", F.lit(NO_IDS))).otherwise(NO_IDS).alias("ends_sha256"),
    )
    return settled(local.drop("path", "top").unionByName(nodes), mark)
