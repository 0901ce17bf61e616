"""Passages that repeat across documents, by a sparse suffix array.

Of each run of windows of MIN_WORDS words the suffix at the smallest k-gram hash is retained (a minimiser), so equal
passages of MIN_WORDS words retain a suffix at the same place. Suffixes whose first k words occur once are of no use and
go. The others are sorted by what follows the place, and each is compared with its neighbours from other documents; a
match is extended left and right as far as a window around the place reaches, as longer passages have further retained
suffixes. They are sorted a second time by what precedes the place. The neighbours of the two orders agree longest with
an entry to the right and to the left, so they also bound what any other entry can share with it. Where the bounds leave
room for a passage that no neighbour showed, the passages in question are looked up by their hashes: the result is exact.

Equal surroundings are one entry of the array with a count, so a group of copies, however large, is one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import as_long, hash_words, join_hot, kgrams, materialize, settled, tables_written, text_chunks, utf8

MIN_WORDS = 50
K = 8


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest gram of each run of `width` grams; none in a shorter text."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, width)
    return np.unique(np.concatenate([np.arange(i, min(i + 50_000, len(windows))) + windows[i : i + 50_000].argmin(1) for i in range(0, len(windows), 50_000)]))


def _ranges(flat: np.ndarray, p: np.ndarray, lo: int, hi: int, words: int, back: bool) -> list[bytes]:
    out = []
    for at in p:
        x = flat[lo + max(0, at - (words - K)) : lo + at] if back else flat[lo + at : min(hi, lo + at + words)]
        out.append((x[::-1] if back else x).tobytes())
    return out


def _common(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many words of four bytes each pair begins with alike."""
    if not a:
        return np.zeros(0, np.int64)
    width = max(4, max(map(len, a)), max(map(len, b)))
    x = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in a), np.uint32).reshape(len(a), -1)
    y = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in b), np.uint32).reshape(len(b), -1)
    same = np.concatenate((x == y, np.zeros((len(x), 1), bool)), axis=1)
    return np.minimum(same.argmin(1), np.minimum([len(v) // 4 for v in a], [len(v) // 4 for v in b]))


def _neighbours(entries: DataFrame, order: list[Column]) -> DataFrame:
    """(ctx, l, r, met) of entries in the given order: what each shares with the nearest entry of another owner on either
    side (met); and all that it could share, for entries whose neighbours may be out of sight: those of a partition's first
    and last run of one owner and of a run that reaches over a batch.
    """

    def rows(ctx, l, r, met: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ctx, pa.int64()), pa.array(l, pa.int32()), pa.array(r, pa.int32()), pa.array(np.full(len(ctx), met))], ["ctx", "l", "r", "met"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last entry seen, and the last of another owner before it
        open_run: list[tuple[int, int, int]] = []  # (ctx, words to the left, to the right) of the run that goes on
        whole = True  # no other owner so far
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            new = table.num_rows - batch.num_rows
            ctx, owner = table["ctx"].to_numpy(), table["owner"].to_numpy()
            left, right = table["left"].to_pylist(), table["right"].to_pylist()
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            run_of = np.repeat(starts, np.diff(np.concatenate((starts, [len(owner)]))))
            i = np.flatnonzero((run_of > 0) & (np.arange(len(owner)) >= new))
            # the entry before a run is the nearest of another owner for all of the run; the next run's first is it, too
            before = run_of[i] - 1
            heads = starts[1:]
            inner = np.concatenate([np.arange(s, e) for s, e in zip(starts[:-1], starts[1:], strict=True)] or [np.zeros(0, np.int64)])
            ahead = heads[np.searchsorted(heads, inner, side="right")] if len(heads) else inner
            a, b = np.concatenate((i, inner)), np.concatenate((before, ahead))
            yield rows(ctx[a], _common([left[x] for x in a], [left[x] for x in b]), _common([right[x] for x in a], [right[x] for x in b]), True)
            sizes = lambda lo, hi: [(int(ctx[x]), len(left[x]) // 4, len(right[x]) // 4) for x in range(lo, hi)]
            later = starts[starts >= max(new, 1)]
            if len(later):
                ended = [*open_run, *(sizes(new, int(later[0])) if whole else [])]
                if ended:
                    yield rows(*map(list, zip(*ended, strict=True)), False)
                whole, open_run = False, sizes(int(starts[-1]), len(owner))
            else:
                open_run += sizes(new, len(owner))
            held = table.take(pa.array([len(owner) - 1] if not starts[-1] else [int(starts[-1]) - 1, len(owner) - 1])).to_batches()
        if open_run:
            yield rows(*map(list, zip(*open_run, strict=True)), False)

    dealt = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("ctx", "owner", "left", "right").mapInArrow(run, "ctx long, l int, r int, met boolean")


def _looked_up(entries: DataFrame, near: DataFrame, least: int) -> DataFrame:
    """(ctx, l, r) of the passages of `least` words that the bounds allow and no neighbour showed, and that another owner has.

    near: (ctx, ls, rs, lmax, rmax), the matches of each entry with its neighbours and the most it shares with any entry.
    """
    hopeful = materialize(entries.select("ctx", "key", "owner", "left", "right").join(near.where(f"lmax + rmax >= {least}"), "ctx"))
    starts = F.sequence(F.greatest(F.lit(0), F.lit(least) - F.col("rmax")), F.col("lmax"))
    open_ = F.filter(starts, lambda i: ~F.exists("met", lambda m: (m["l"] >= i) & (m["r"] >= F.lit(least) - i)))
    wanted = hopeful.select("key", F.explode(open_).alias("i")).distinct().groupBy("key").agg(F.collect_set("i").alias("wanted"))  # `least` numbers at most
    sizes = hopeful.groupBy("key").agg(F.count("*").alias("rows")).join(wanted, "key")
    asked = join_hot(hopeful, sizes, "key", "rows", ["ctx"])
    asked = asked.select("ctx", "owner", "left", "right", "lmax", "rmax", F.explode("wanted").alias("i")).where(f"i <= lmax and {least} - i <= rmax")
    word = lambda column, n: F.substring(column, F.lit(1), 4 * n)
    passages = asked.select("ctx", "owner", "i", F.xxhash64("i", word(F.col("left"), F.col("i")), word(F.col("right"), F.lit(least) - F.col("i"))).alias("passage"))
    passages = materialize(passages)
    again = passages.groupBy("passage").agg(F.min("owner").alias("a"), F.max("owner").alias("b"), F.count("*").alias("rows")).where("a <> b").select("passage", "rows")
    return join_hot(passages, again, "passage", "rows", ["ctx"]).select("ctx", F.col("i").cast("int").alias("l"), (F.lit(least) - F.col("i")).cast("int").alias("r"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, start, end): stretches of words of each document, end exclusive, that consist of passages of at least
    min_words words found in another document too. Overlapping and adjoining stretches are merged.

    Words are runs of other characters than blanks, A-Z lower-cased. Null, empty and shorter texts have none. Ids must
    be whole numbers; rows with a null id are left out, rows that repeat an id are one document whose texts are each
    searched (their spans are merged). An empty table gives an empty result. Other columns are ignored.
    """
    width = min_words - K + 1
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "_text"):
            words, _, _, bounds = hash_words(utf8(part.column("_text")))
            grams, ids = kgrams(words, K), part.column("id").to_numpy(zero_copy_only=False)
            keys, owners, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                p = minimisers(grams[lo : max(lo, hi - K + 1)], width)
                keys.append(grams[lo + p])
                owners.append(np.full(len(p), ids[i]))
                at.append(p)
            yield pa.RecordBatch.from_arrays([as_long(np.concatenate(keys)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(at), pa.int32())], ["key", "id", "p"])

    mark = tables_written()
    retained = materialize(texts.mapInArrow(sample, "key long, id long, p int"))
    again = retained.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("rows")).where("a <> b").select("key", "rows")
    places = join_hot(retained, materialize(again), "key", "rows", ["id", "p"]).groupBy("id").agg(F.collect_set("p").alias("ps"))  # a document's own places

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "_text"):
            words, _, _, bounds = hash_words(utf8(part.column("_text")))
            flat = (words >> np.uint64(32)).astype(np.uint32)
            grams = kgrams(words, K)
            rows: list[list] = [[], [], [], [], []]
            for doc, ps, lo, hi in zip(part.column("id").to_pylist(), part.column("ps").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                p = np.array([x for x in ps if x <= hi - lo - K], np.int64)
                rows[0] += [doc] * len(p)
                rows[1] += p.tolist()
                rows[2] += grams[lo + p].view(np.int64).tolist()
                rows[3] += _ranges(flat, p, lo, hi, min_words, True)
                rows[4] += _ranges(flat, p, lo, hi, min_words, False)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], ["id", "p", "key", "left", "right"])

    around = texts.join(places, "id").mapInArrow(surround, "id long, p int, key long, left binary, right binary")
    around = materialize(around.withColumn("ctx", F.xxhash64("key", "left", "right")))
    entries = around.groupBy("ctx").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("left").alias("left"), F.min("right").alias("right"), F.min("key").alias("key"), F.count("*").alias("rows"))
    # an entry that several documents share has its partners at hand, and is another's partner whoever owns that
    entries = materialize(entries.select("ctx", F.when(F.expr("lo <> hi"), F.col("ctx")).otherwise(F.col("lo")).alias("owner"), "left", "right", "key", "rows", F.expr("lo <> hi").alias("copied")))
    near = entries.where("copied").select("ctx", F.expr("cast(length(left) div 4 as int)").alias("l"), F.expr("cast(length(right) div 4 as int)").alias("r"), F.lit(True).alias("met"))
    for back in (0, min_words - K):  # by all that follows the place, then by what precedes it
        order = [F.substring("left", 1, 4 * back), F.col("right"), F.col("left"), F.col("ctx")]
        near = near.unionByName(_neighbours(entries, order))
    # an entry has a few neighbours
    near = materialize(near.groupBy("ctx").agg(F.collect_set(F.when(F.col("met"), F.struct("l", "r"))).alias("met"), F.max("l").alias("lmax"), F.max("r").alias("rmax")))
    matches = near.select("ctx", F.explode("met").alias("m")).select("ctx", "m.l", "m.r").where(f"l + r >= {min_words}")
    matches = matches.unionByName(_looked_up(entries, near, min_words)).distinct()
    sized = materialize(matches.join(entries.select("ctx", "rows"), "ctx"))
    listed = sized.groupBy("ctx").agg(F.collect_list(F.struct("l", "r")).alias("at"), F.first("rows").alias("rows"))
    spans = join_hot(around.select("ctx", "id", "p"), listed, "ctx", "rows", ["id", "p"]).select("id", "p", F.explode("at").alias("m"))
    spans = spans.select("id", (F.col("p") - F.col("m.l")).cast("long").alias("start"), (F.col("p") + F.col("m.r")).cast("long").alias("end")).distinct()
    order = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    grouped = spans.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("g", F.sum("fresh").over(order))
    return settled(grouped.groupBy("id", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g"), mark)


def passage_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, n_passages, repeated_words, passages): the stretches of repeated_passages() per document as start:end in words.

    Documents without any are left out.
    """
    found = repeated_passages(docs, id_col, text_col, min_words).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    listed = F.array_join(F.transform("s", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    words = F.aggregate("s", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("id", F.size("s").cast("long").alias("n_passages"), words.alias("repeated_words"), listed.alias("passages"))
