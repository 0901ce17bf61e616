"""Near-duplicate texts by an exact Jaccard self-join on word shingles with token-combination prefixes.

Shingles ("tokens") have one global order: those not known to be frequent first, by hash, then the frequent ones by
rising frequency. A text of n tokens may miss t = n - ceil(threshold * n) of them in a partner. Class k tokens (k = 1
rare, 2 frequent, 3 very frequent) are indexed as k-token combinations within small token groups, and the prefix is
extended until the combinations cover t + e tokens: a group with p tokens of class k covers p - k + 1. Two texts above
the threshold then share at least e signatures (the smaller e of the two), so the join loses no pair, and texts that
share fewer need no look. e grows with n.

Equal token sets are one node, named by the set's fingerprint. Nodes that share a signature are compared with a few hubs
first; only what stays in different components, and isn't too far apart by each one's distance from a hub, is compared
pair by pair. A pair whose ends are already connected can't change a component, so leaving it out loses nothing.

Links are counted afterwards, inside components, as every link lies in one: blocks of bounded size of a component's nodes
are compared with each other and return numbers, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import as_long, bucketed, hash_words, in_bitmap, join_hot, key_bitmap, kgrams, materialize, mix64, settled, tables_written, text_chunks, utf8
from sparkloom.llm.components import connected_components, smallest_ids

SHINGLE_WORDS = 5
PERCENT = 75
#: Text handled at once; the arrays over its words, and over its tokens' combinations, are all that a worker holds.
TEXT_BYTES = 1 << 19
#: Texts of [LEVEL << l, LEVEL << l + 1) tokens form level l + 1; two similar texts have a level in common.
LEVEL = 5
#: A token seen in this many texts, as far as is known, is of the next class.
CLASS_BOUNDS = (8, 1024)
#: At most so many frequent tokens are known to all tasks (16 bytes each); the others count as rare, which costs time, not results.
MAX_FREQUENT = 1 << 19
#: Nodes and tokens of one side of a block in which links are counted, and members of one side of a last comparison.
BLOCK_NODES = 512
BLOCK_TOKENS = 4_000_000
HUB_BLOCK = 1024


def token_sets(texts: list[bytes], words_per_token: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct token hashes of each text."""
    words, _, _, bounds = hash_words(texts)
    grams, out = kgrams(words, words_per_token), []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= words_per_token:
            out.append(np.unique(grams[lo : hi - words_per_token + 1]))
        else:
            out.append(kgrams(words[lo:hi], int(hi - lo)) if hi > lo else np.zeros(0, np.uint64))
    return out


def fingerprint(tokens: np.ndarray) -> int:
    """One hash for a whole token set."""
    if not len(tokens):
        return 0
    both = np.array([tokens.sum(), np.bitwise_xor.reduce(tokens)], np.uint64)
    return int(mix64(mix64(both[:1]) + both[1:] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(len(tokens))).view(np.int64)[0])


def least_shared(n: int) -> int:
    """How many signatures a text of n tokens shares with a similar one that isn't smaller."""
    return 1 + n // 32


def _level(n: int) -> int:
    return 0 if n < LEVEL else (n // LEVEL).bit_length()


def _needed(n: int, percent: int) -> int:
    """How many tokens the signatures of a text of n tokens must cover."""
    return n - (percent * n + 99) // 100 + least_shared(n)


@lru_cache(None)
def combination_plan(level: int, percent: int) -> tuple[int, int]:
    """How many token groups a level has, and the largest combinations that it uses.

    A group loses k - 1 tokens of cover for each class k that it has. The combinations are the largest with which every
    text that is indexed at the level has cover enough. A text so small that only an equal set is similar needs none.
    """
    groups = max(1, (LEVEL << level >> 1) // 10)
    sizes = [n for n in range(1, (LEVEL << level) * 2) if _level(100 * n // percent) >= level >= _level((percent * n + 99) // 100) and 100 * n >= percent * (n + 1)]
    return groups, next(k for k in (3, 2, 1) if all(n - groups * k * (k - 1) // 2 >= _needed(n, percent) for n in sizes[:200]))


def signatures(tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int = PERCENT, bounds: tuple[int, ...] = CLASS_BOUNDS) -> np.ndarray:
    """What a text is indexed by. frequent: sorted tokens known to be frequent, counts: in how many texts each was seen."""
    n = len(tokens)
    need = _needed(n, percent)
    df = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        df = np.where(frequent[at] == tokens, counts[at], 0)
    rare = tokens[df == 0]
    if len(rare) >= need:
        return mix64(rare[:need])
    order = np.lexsort((tokens, df))
    classes = 1 + np.searchsorted(bounds, df[order], side="right")
    ordered = tokens[order]
    if (classes[:need] == 1).all():
        return mix64(ordered[:need])
    singles, combos = 0, []
    for level in range(_level((percent * n + 99) // 100), _level(100 * n // percent) + 1):
        groups, most = combination_plan(level, percent)
        kinds = np.minimum(classes, most)
        group_of = (mix64(ordered + np.uint64(level)) % np.uint64(groups)).astype(np.int64)
        covered, members = 0, {}
        for i in range(n):
            k = int(kinds[i])
            if k == 1:
                covered += 1
            else:
                own = members.setdefault((k, int(group_of[i])), [])
                own.append(i)
                covered += len(own) >= k
            if covered >= need:
                break
        singles = max(singles, int((kinds[: i + 1] == 1).sum()))
        for (k, _), own in members.items():
            if len(own) >= k:
                picked = ordered[np.array(list(combinations(own, k)))]
                picked.sort(axis=1)
                combos.append(mix64(kgrams_of_rows(picked) + np.uint64(level)))
    return np.unique(np.concatenate([mix64(ordered[:singles]), *combos]))


def kgrams_of_rows(rows: np.ndarray) -> np.ndarray:
    """One hash for each row of tokens."""
    out = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return out


def _sets(batches: Iterator[pa.RecordBatch], text_col: str, words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in text_chunks(batches, text_col, TEXT_BYTES):
        yield part, token_sets(utf8(part.column(text_col)), words)


def _distinct(sets: list[np.ndarray]) -> dict[int, np.ndarray]:
    return {fingerprint(s): s for s in sets if len(s)}


def survey(docs: DataFrame, id_col: str, text_col: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, n, fp, place, counted), from one pass over the texts: size and fingerprint of each text's token set (the empty
    set has n = 0) and a hash of id and text; and, where counted, a token (fp) with the number of texts (n) of which a
    task saw it in two or more.
    """
    kind = None

    def run(batches):
        def rows(ids, n, fp, place, counted):
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), fp, place, pa.array(np.full(len(n), counted))], ["id", "n", "fp", "place", "counted"])

        def flush(sets):
            tokens, n = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]), return_counts=True)
            tokens, n = tokens[n > 1], n[n > 1]
            return rows(pa.nulls(len(n), kind), n, as_long(tokens), pa.nulls(len(n), pa.int64()), True)

        nonlocal kind
        held: dict[int, np.ndarray] = {}
        for part, sets in _sets(batches, text_col, words):
            kind, prints = part.column("id").type, [fingerprint(s) for s in sets]
            yield rows(part.column("id"), [len(s) for s in sets], pa.array(prints, pa.int64()), part.column("place"), False)
            held |= {fp: s for fp, s in zip(prints, sets, strict=True) if len(s)}
            if sum(map(len, held.values())) > 2_000_000:
                yield flush(held)
                held = {}
        if held:
            yield flush(held)

    keyed = docs.select(F.col(id_col).alias("id"), text_col, F.xxhash64(id_col, text_col).alias("place"))
    return keyed.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n long, fp long, place long, counted boolean")


def frequent_tokens(counts: DataFrame, least: int = CLASS_BOUNDS[0], most: int = MAX_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (fp) of counts seen in at least `least` texts and those counts, sorted by token; the commonest where there are more than `most`.

    A task counts a token where at least two of its texts have it, so the counts are a lower estimate over all texts.
    """
    counted = materialize(counts.groupBy(F.col("fp").alias("token")).agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    # a histogram of the counts, to two digits, tells from which count on there are not more than `most`
    digits = F.pow(F.lit(10), F.greatest(F.length(F.col("n").cast("string")) - 2, F.lit(0))).cast("long")
    bins = counted.groupBy((F.floor(F.col("n") / digits) * digits).alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()  # 90 rows a digit
    room, cut = most, None
    for row in bins:
        room -= row["k"]
        if room < 0:
            break
        cut = row["n"]
    if cut is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counted.where(F.col("n") >= cut).toArrow()  # at most `most` rows, as two arrays of numbers
    tokens, counts = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _index(docs: DataFrame, frequent: np.ndarray, counts: np.ndarray, text_col: str, words: int, percent: int) -> DataFrame:
    """(sig, fp): each distinct token set of a batch by its signatures."""
    known = docs.sparkSession.sparkContext.broadcast((frequent, counts))  # at most MAX_FREQUENT tokens

    def run(batches):
        frequent, counts = known.value
        for _, sets in _sets(batches, text_col, words):
            found = {fp: signatures(s, frequent, counts, percent) for fp, s in _distinct(sets).items()}
            if found:
                fps = np.repeat(np.fromiter(found, np.int64, len(found)), [len(s) for s in found.values()])
                yield pa.RecordBatch.from_arrays([as_long(np.concatenate(list(found.values()))), pa.array(fps)], ["sig", "fp"])

    return docs.select(text_col).mapInArrow(run, "sig long, fp long")


def _sets_of(docs: DataFrame, ids: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, tokens) of at least the nodes in ids, in buckets by id, as each turn joins them; a bitmap of fixed size keeps most
    other texts from being read as words."""
    bitmap = docs.sparkSession.sparkContext.broadcast(key_bitmap(nodes.join(ids.distinct(), "id").select("place"), "place"))

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bitmap.value, batch.column("h").to_numpy(zero_copy_only=False))))
            for _, sets in _sets(iter([batch]), text_col, words):
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                prints = pa.array([fingerprint(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([prints, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), as_long(flat))], ["id", "tokens"])

    keyed = docs.select(text_col, F.xxhash64(F.xxhash64(id_col, text_col)).alias("h"))
    return bucketed(keyed.mapInArrow(run, "id long, tokens array<long>"), "id")


def _shareable(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members (sig, id, n, c) with a new m: how many tokens at most each may share with any other member.

    Tokens that no other member has can't be shared. Who can't reach the threshold at all goes, which may leave others
    with more such tokens: so twice.
    """
    for _ in range(2):
        ids = members.select("id").distinct()
        own = sets.join(ids, "id", "left_semi").select("id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("k"), F.min("id").alias("id"))
        alone = own.where("k = 1").groupBy("id").agg(F.count("*").alias("u"))
        members = members.select("sig", "id", "n", "c").join(alone, "id", "left").withColumn("m", F.col("n") - F.coalesce("u", F.lit(0))).drop("u")
        members = materialize(members.where(f"100L * m >= {percent}L * n"))
    return members


def _from_hubs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(hub, id, n, m, c, d, s): each of members (sig, id, n, m, c) once for each hub of its signatures, with d, in how
    many tokens it differs from the hub, and s, how many of those another member may share.

    Members that share a signature share its hub. Two members x and y differ in d_x + d_y tokens less twice the ones in
    which both differ from the hub, which are min(s_x, s_y) at most. So most pairs that share much of a common core, but
    have changes of their own, are known to be too different without a look at them.
    """
    own = F.floor((F.col("n") - F.col("m")) * 64 / F.col("n"))  # a hub with few changes of its own is near the core
    hubs = members.groupBy("sig").agg(F.min(F.struct(own.alias("o"), F.xxhash64("id").alias("r"), "id")).alias("h")).select("sig", F.col("h.id").alias("hub"))
    placed = materialize(members.join(hubs, "sig").select("hub", "id", "n", "m", "c").distinct())
    met = placed.select("id", "hub").join(sets.select("id", F.col("tokens").alias("x")), "id").join(sets.select(F.col("id").alias("hub"), F.col("tokens").alias("y")), "hub")
    apart = met.select("id", "hub", (F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y"))).cast("long").alias("d"))
    return materialize(placed.join(apart, ["id", "hub"]).withColumn("s", F.greatest(F.lit(0), F.col("d") - F.col("n") + F.col("m"))))


def _near_by_hub(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a hub and may be similar, by _from_hubs(); blocks of HUB_BLOCK members on either side."""
    parts = placed.groupBy("hub").agg(F.ceil(F.count("*") / HUB_BLOCK).alias("parts"))
    held = placed.join(parts, "hub").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    x, y = held.alias("x"), held.select(F.col("own").alias("other"), F.col("other").alias("own"), "hub", "id", "n", "m", "c", "d", "s").alias("y")
    alike = f"{100 + percent}L * (x.d + y.d - 2 * least(x.s, y.s)) <= {100 - percent}L * (x.n + y.n)"
    pairs = x.join(y, F.expr(f"x.hub = y.hub and x.own = y.own and x.other = y.other and x.id < y.id and x.c <> y.c and {_near('x', 'y', percent)} and {alike}"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _near(a: str, b: str, percent: int) -> str:
    return f"100L * least({a}.m, {b}.m) >= {percent}L * ({a}.n + {b}.n - least({a}.m, {b}.m))"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs whose token sets are similar enough."""
    both = pairs.hint("shuffle_hash").join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", shared.alias("o"), (F.size("x") + F.size("y")).alias("s")).where(F.expr(f"100L * o >= {percent}L * (s - o)")).select("a", "b")


def similar_sets(x: list[np.ndarray], y: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which sets of x (rows) and y (columns) are similar; sets are sorted arrays of distinct tokens."""
    nx, ny = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    tokens, flat, times = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(x) + len(y)), np.concatenate((nx, ny)))
    useful = times[flat] > 1  # who else has it
    number = np.cumsum(times > 1) - 1
    rows, flat = rows[useful], number[flat[useful]]
    shared = np.zeros((len(x), len(y)), np.int64)
    order = np.argsort(flat, kind="stable")
    rows, flat = rows[order], flat[order]
    for lo in range(0, int((times > 1).sum()), 4096):
        a, b = np.searchsorted(flat, (lo, lo + 4096))
        held = np.zeros((len(x) + len(y), 4096), np.float32)
        held[rows[a:b], flat[a:b] - lo] = 1
        shared += np.rint(held[: len(x)] @ held[len(x) :].T).astype(np.int64)
    return 100 * shared >= percent * (nx[:, None] + ny[None, :] - shared)


def link_numbers(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, links) of members (id, n, c, copies): how many rows of other nodes each node links with, all in component c."""
    size = members.groupBy("c").agg(F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("n") / BLOCK_TOKENS)).alias("parts"))
    held = members.join(size, "c").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # small components share a block, so that there are not too many; a block of a large one holds one or two of its parts
    k, tokens = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shelves = max(1, -(-k // BLOCK_NODES), -(-tokens // BLOCK_TOKENS))
    shelf = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("c"), F.lit(shelves))).otherwise(F.col("c"))
    dealt = held.select(shelf.alias("shelf"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("parts") > 1).alias("large"), "c", "own", "id", "copies").join(sets, "id")

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        component, own, copies = (table[c].to_numpy() for c in ("c", "own", "copies"))
        lists = table["tokens"].combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        flat, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        sets_, links = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], np.zeros(len(own), np.int64)
        order = np.argsort(component, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            x, y = rows[own[rows] == key[1].as_py()], rows[own[rows] == key[2].as_py()]
            near = similar_sets([sets_[i] for i in x], [sets_[i] for i in y], percent)
            if key[1].as_py() == key[2].as_py():
                np.fill_diagonal(near, False)
            else:
                links[y] += copies[x] @ near
            links[x] += near @ copies[y]
        return pa.table({"id": table["id"], "links": pa.array(links, pa.int64())})

    return dealt.groupBy("shelf", "lo", "hi", "large").applyInArrow(lambda key, t: count(key, t), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _components(docs: DataFrame, nodes: DataFrame, known: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str, words: int, percent: int, rounds: int) -> DataFrame | None:
    """(id, component) of the nodes that link with another one; None without any."""
    # Both uses of the index read the same columns behind the same filter, or Spark would compute and shuffle it twice.
    index = _index(docs, *known, text_col, words, percent).where("sig is not null and fp is not null").repartition("sig")
    shared = index.groupBy("sig").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("sig")
    buckets = materialize(index.join(shared.hint("shuffle_hash"), "sig").distinct().withColumnRenamed("fp", "id").join(nodes.select("id", "n"), "id").select("sig", "id", "n"))
    for _ in range(2):  # who shares too few signatures goes, which may leave others with too few
        several = buckets.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select("sig")
        buckets = buckets.join(several, "sig")
        enough = buckets.groupBy("id").agg(F.count("*").alias("k"), F.first("n").alias("n")).where(F.expr(f"k >= 1 + floor(({percent}L * n + 99) div 100 / 32)")).select("id")
        buckets = materialize(buckets.join(enough, "id"))
    buckets = buckets.withColumn("m", F.col("n"))
    links = tried = found = before = sets = None
    for turn in range(rounds + 1):
        placed = buckets.withColumn("c", F.col("id")) if found is None else buckets.join(found, "id", "left").select("sig", "id", "n", "m", F.coalesce("component", "id").alias("c"))
        split = placed.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("sig")
        open_ = materialize(placed.join(split, "sig"))
        if turn == 1:  # few texts are left by now: see which tokens nobody else has
            sets = _sets_of(docs, open_.select("id"), nodes, id_col, text_col, words)
            buckets = open_ = _shareable(open_, sets, percent)
        sizes = open_.groupBy("sig", "c").agg(F.count("*").alias("k")).groupBy("sig").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("p"), F.sum("k").alias("k"))
        left, members = sizes.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
        if not left:
            break
        last = turn == rounds or (turn > 0 and left <= members) or (before is not None and 10 * left > 9 * before)
        before = left if turn else None
        if last:  # whatever is still apart, pair by pair
            pairs = _near_by_hub(_from_hubs(open_, sets, percent), percent)
        else:  # each member with a hub of its signature: in turn any (four for a group at most), and one that shares most of its tokens
            rank = F.xxhash64("id", F.pmod(F.col("sig"), F.lit(4)), F.lit(turn))
            shared = F.when(F.lit(turn % 2 == 1), -F.floor(F.col("m") * 64 / F.col("n"))).otherwise(0)
            hubs = open_.groupBy("sig").agg(F.min(F.struct(shared.alias("s"), rank.alias("r"), F.col("id"), F.col("n"), F.col("m"), F.col("c"))).alias("h"))
            met = open_.alias("x").join(hubs, "sig").where(f"x.c <> h.c and {_near('x', 'h', percent)}")
            pairs = met.select(F.least("x.id", "h.id").alias("a"), F.greatest("x.id", "h.id").alias("b"))
        pairs = pairs.distinct()
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        known_sets = sets or _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), nodes, id_col, text_col, words)
        more = _verified(pairs, known_sets, percent)
        links = materialize(more if links is None else links.unionByName(more))
        found = materialize(connected_components(links))
        if last:
            break
    return found


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT, rounds: int = 8, count_links: bool = True
) -> DataFrame:
    """(id, n_shingles, component_id, n_links): for each row of docs the size of its token set, the smallest id that links
    reach, and, with count_links, with how many other rows it links directly.

    Null and empty texts have no tokens and link with nothing, so they are their own component. Rows that repeat an id
    are rows of one document: they are repeated in the result, each with the links of its own text, and their components
    are one. A row with a null id links like any other; component_id is the smallest id that isn't null, or null where
    there is none. Other columns are ignored. An empty table gives an empty result.
    """
    mark = tables_written()
    seen = materialize(survey(docs, id_col, text_col, words))
    prints, known = seen.where("not counted").select("id", "n", "fp", "place"), frequent_tokens(seen.where("counted"))
    nodes = materialize(prints.where("n > 0").groupBy(F.col("fp").alias("id")).agg(F.min("place").alias("place"), F.first("n").alias("n"), F.count("*").alias("copies")))
    found = _components(docs, nodes, known, id_col, text_col, words, percent, rounds)
    if found is None:
        placed = nodes.select("id", F.col("id").alias("root"), "copies", F.lit(0).cast("long").alias("links"))
    else:
        placed = nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("root"), "n", "copies", F.col("component").isNotNull().alias("linked"))
        if count_links:
            members = materialize(placed.where("linked").select("id", "n", F.col("root").alias("c"), "copies"))
            sets = _sets_of(docs, members.select("id"), nodes, id_col, text_col, words)
            placed = placed.join(link_numbers(members, sets, percent), "id", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
        else:
            placed = placed.withColumn("links", F.lit(None).cast("long"))
    placed = materialize(placed.select(F.col("id").alias("fp"), "root", "copies", "links"))
    rows = materialize(join_hot(prints.where("n > 0"), placed.withColumn("rows", F.col("copies")), "fp", "rows", ["place", "id"]).select("id", "n", "fp", "root", "copies", "links"))
    names = smallest_ids(rows)
    names = names.join(rows.groupBy("root").agg(F.count("*").alias("rows")), "root", "right")
    named = join_hot(rows, names, "root", "rows", ["id", "fp"])
    out = named.select("id", F.col("n").alias("n_shingles"), "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    alone = prints.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(0 if count_links else None).cast("long").alias("n_links"))
    out = out.unionByName(alone)
    return settled(out if count_links else out.drop("n_links"), mark)
