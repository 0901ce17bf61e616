"""Alignment of two tokenizers over the same bytes, and corpus-wide counts of the id pairs that it links.

A whole Arrow batch is laid end to end: both tokenizers' pieces cover the same bytes, so a running sum of piece lengths
gives every end, one bincount per tokenizer marks the ends, and places that both mark cut the bytes into groups. Prefix
sums over places, tokens and groups, read at document bounds, give each document's numbers. Batches keep their distinct
id pairs once, in a row beside their documents'; a batch's documents meet the corpus counts of its pairs in a group of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, settled, tables_written, text_chunks

#: A group with more A-B pairs than this is counted by its distinct ids, not token by token.
MANY_PAIRS = 256
#: The ranked encoder's pattern can't walk over white space as long as this; the slower library takes such texts.
LONG_BLANK = re.compile(r"\s{1000}")

#: Text aligned at once; a worker takes some 200 bytes of memory for a byte of it.
TEXT_AT_ONCE = 1 << 20
#: Batches of so much text that one task meets with the corpus counts.
BATCHES_PER_TASK = 32

_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_loaded: dict[tuple[str, str], Encoders] = {}


def _byte_chars() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Encoders:
    """A byte-level BPE (A, a JSON file) and a piece model that puts a blank in front (B), with the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            file = json.load(f)
        added = {x["id"] for x in file["added_tokens"]}
        chars = _byte_chars()
        vocab = {i: bytes(chars[c] for c in piece) for piece, i in file["model"]["vocab"].items() if i not in added}
        self.whole = Tokenizer.from_file(path_a)
        self.whole.encode_special_tokens = True
        joined = ("".join(m if isinstance(m, list) else m.split(" ")) for m in file["model"]["merges"])
        # ids that rise with the merges are ranks
        ranked = all(file["model"]["vocab"][piece] == 256 + i for i, piece in enumerate(joined))
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={b: i for i, b in vocab.items()}, special_tokens={}) if ranked else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [vocab.get(i, b"") for i in range(max(vocab) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.pieces.vocab_size())]
        self.size_b = len(self.bytes_b)
        self.lengths = [np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b)]
        self.names = [[np.array([f"{i}{end}" for i in range(len(t))], object) for end in ends] for t, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;"))]

    def _piece(self, i: int) -> bytes:
        if self.pieces.is_byte(i):
            return bytes([int(self.pieces.id_to_piece(i)[3:5], 16)])
        return self.pieces.id_to_piece(i).replace("▁", " ").encode()

    @classmethod
    def load(cls, path_a: str, path_b: str) -> Encoders:
        """One per worker process; it outlives the task."""
        if (path_a, path_b) not in _loaded:
            _loaded[path_a, path_b] = cls(path_a, path_b)
        return _loaded[path_a, path_b]

    def encode_a(self, text: str) -> np.ndarray:
        if self.fast is None or LONG_BLANK.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int64)
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def encode(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids of all texts end to end and ids per text, for A and for B; a text that either doesn't give back has none."""
        parts = [self.encode_a(" " + t) if t else np.zeros(0, np.int64) for t in texts]
        lists = self.pieces.encode(texts, num_threads=1)
        counts = [np.array([len(x) for x in p], np.int64) for p in (parts, lists)]
        ids = [np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64), np.fromiter(chain.from_iterable(lists), np.int64, int(counts[1].sum()))]
        wanted = [(" " + t).encode() if t else b"" for t in texts]
        whole, good = b"".join(wanted), np.ones(len(texts), bool)
        sizes = np.array([len(w) for w in wanted], np.int64)
        for table, length, flat, n in zip((self.bytes_a, self.bytes_b), self.lengths, ids, counts, strict=True):
            joined = b"".join(map(table.__getitem__, flat.tolist()))
            held = _per_run(length[flat], n)
            if joined != whole or (held != sizes).any():
                at = np.concatenate(([0], np.cumsum(held)))
                good &= [joined[at[i] : at[i + 1]] == w for i, w in enumerate(wanted)]
        if not good.all():
            ids = [flat[np.repeat(good, n)] for flat, n in zip(ids, counts, strict=True)]
            counts = [np.where(good, n, 0) for n in counts]
        return (ids[0], counts[0]), (ids[1], counts[1])


def _per_run(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, by prefix sums."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(runs)
    return total[ends] - total[ends - runs]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run of the given size."""
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) + np.repeat(starts - (ends - sizes), sizes)


class Aligned:
    """Groups and links of a batch of texts."""

    def __init__(self, encoders: Encoders, texts: list[str]):
        (self.a, self.n_a), (self.b, self.n_b) = encoders.encode(texts)
        self.encoders, docs = encoders, np.arange(len(texts))
        ends_a, ends_b = (np.cumsum(length[ids]) for length, ids in zip(encoders.lengths, (self.a, self.b), strict=True))
        size = int(ends_a[-1]) if len(ends_a) else 0
        cuts = (np.bincount(ends_a, minlength=size + 1) > 0) & (np.bincount(ends_b, minlength=size + 1) > 0)
        before = np.cumsum(cuts)  # groups that end at or before a byte offset
        self.group_a, self.group_b = before[ends_a - 1], before[ends_b - 1]
        count = int(before[-1]) if size else 0
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=count), np.bincount(self.group_b, minlength=count)
        self.doc_of_group = np.zeros(count, np.int64)
        self.doc_of_group[self.group_a] = np.repeat(docs, self.n_a)
        self.n_groups = np.bincount(self.doc_of_group, minlength=len(texts)) if count else np.zeros(len(texts), np.int64)
        self.n_links = _per_run(self.in_a * self.in_b, self.n_groups)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, links), each document's distinct pairs in order; a pair is A id * size of B's vocabulary + B id."""
        base = self.encoders.size_b
        whole = base * len(self.encoders.bytes_a)
        start_a, start_b = (np.cumsum(n) - n for n in (self.in_a, self.in_b))
        usual = self.in_a * self.in_b <= MANY_PAIRS
        times = np.where(usual, self.in_b, 0)[self.group_a]
        keys = np.repeat(self.a * base + whole * self.doc_of_group[self.group_a], times) + self.b[_ragged(start_b[self.group_a], times)]
        found, links = np.unique(keys, return_counts=True)
        for g in np.flatnonzero(~usual):
            a, times_a = np.unique(self.a[start_a[g] : start_a[g] + self.in_a[g]], return_counts=True)
            b, times_b = np.unique(self.b[start_b[g] : start_b[g] + self.in_b[g]], return_counts=True)
            found = np.concatenate((found, (whole * self.doc_of_group[g] + a[:, None] * base + b[None, :]).ravel()))
            links = np.concatenate((links, (times_a[:, None] * times_b[None, :]).ravel()))
        if not usual.all():
            found, place = np.unique(found, return_inverse=True)
            summed = np.zeros(len(found), np.int64)
            np.add.at(summed, place, links)
            links = summed
        return found // whole, found % whole, links

    def written(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each document: groups in order, ids in decimal."""
        out = np.empty(len(self.a) + len(self.b), object)
        for ids, groups, inside, other, names, own in ((self.a, self.group_a, self.in_a, np.cumsum(self.in_b) - self.in_b, self.encoders.names[0], 0), (self.b, self.group_b, self.in_b, np.cumsum(self.in_a), self.encoders.names[1], 1)):
            last = np.cumsum(inside)[groups] == np.arange(1, len(ids) + 1)
            out[np.arange(len(ids)) + other[groups]] = np.where(last, names[1][ids], names[0][ids])
        ends = np.cumsum(self.n_a + self.n_b)
        return ["".join(out[e - n : e])[:-1] for e, n in zip(ends.tolist(), (self.n_a + self.n_b).tolist(), strict=True)]


def _batches(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, with_groups: bool) -> DataFrame:
    """A row per document, its id, numbers and places among its batch's distinct pairs, and one per batch with these pairs, where n_a is null.

    Rows are small: Spark's writer and reader of tables hold a hundred and more of them in a task.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, name = Encoders.load(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in text_chunks(batches, "_text", TEXT_AT_ONCE):
            found = Aligned(encoders, [t or "" for t in batch.column("_text").to_pylist()])
            doc, pair, links = found.pairs()
            keys, place, docs_with = np.unique(pair, return_inverse=True, return_counts=True)
            groups = found.written()
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            ends = np.searchsorted(doc, np.arange(len(batch) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (place.astype(np.int32), links.astype(np.int64))]
            numbers = [pa.array(x.astype(np.int64)) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
            own = [batch.column(id_col), *numbers, pa.array(digests, pa.string()), pa.array(groups if with_groups else [None] * len(batch), pa.string()), *lists]
            whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int64))) for x in (keys, docs_with)]
            named = lambda n: pa.array(np.full(n, name, np.int64))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([named(len(batch)), *own, *[pa.nulls(len(batch), x.type) for x in whole]], columns)
            yield pa.RecordBatch.from_arrays([named(1), *[pa.nulls(1, x.type) for x in own], *whole], columns)
            name += 1

    columns = ["batch", "id", *_NUMBERS, "digest", "groups", "place", "links", "pairs", "docs"]
    numbers = ", ".join(f"{n} bigint" for n in _NUMBERS)
    schema = f"batch bigint, id {id_type}, {numbers}, digest string, groups string, place array<int>, links array<bigint>, pairs array<bigint>, docs array<bigint>"
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(align, schema)


def _counts(batches: DataFrame, size_b: int) -> DataFrame:
    """(pair, n_docs, best): documents that hold a pair, and whether no pair of its A id is held by more."""
    counts = materialize(batches.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n_docs")))
    a_id = F.floor(F.col("pair") / F.lit(size_b))
    most = counts.groupBy(a_id.alias("_a")).agg(F.max("n_docs").alias("most"))  # no more rows than A has ids
    return counts.withColumn("_a", a_id).join(F.broadcast(most), "_a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def vocabulary_links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a_id, b_id, n_docs, best) for each pair of ids that some document links: how many rows do, and whether it is among its A id's most frequent."""
    size_b = Encoders.load(path_a, path_b).size_b
    counts = _counts(materialize(_batches(docs, path_a, path_b, id_col, text_col, False).select("pairs", "docs")), size_b)
    return counts.select(F.floor(F.col("pair") / F.lit(size_b)).alias("a_id"), F.pmod("pair", F.lit(size_b)).alias("b_id"), "n_docs", "best")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row; with_groups adds the groups as text.

    A encodes a blank and the text, B the text, both without special tokens. Null and empty texts, and those whose bytes
    either vocabulary doesn't give back, have no tokens: zeros and empty strings, and they count for no pair. Every row is a
    document, also where rows repeat an id or it is null. An empty table gives an empty result. Other columns are ignored.
    """
    mark = tables_written()
    size_b = Encoders.load(path_a, path_b).size_b
    id_type = docs.schema[id_col].dataType.simpleString()
    batches = materialize(_batches(docs, path_a, path_b, id_col, text_col, with_groups))
    counts = _counts(batches, size_b)
    last = batches.where("n_a is null")
    asked = last.select("batch", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair").select(F.col("batch").alias("of"), "at", "n_docs", "best")

    def rows(own: pa.Table, told: pa.Table) -> pa.Table:
        """A batch's documents with what the corpus says of the batch's pairs."""
        at = np.argsort(told["at"].to_numpy())
        n_docs, best = told["n_docs"].to_numpy()[at], told["best"].to_numpy()[at]
        lists = [own[n].combine_chunks() for n in ("place", "links")]
        place, links = (x.flatten().to_numpy() for x in lists)
        held = pc.list_value_length(lists[0]).to_numpy().astype(np.int64)
        n_best, count_sum = _per_run(links * best[place].astype(bool), held), _per_run(links * n_docs[place], held)
        return pa.Table.from_arrays([own["id"], *[own[n] for n in _NUMBERS], pa.array(n_best), pa.array(count_sum), own["digest"], *([own["groups"]] if with_groups else [])], names=names)

    names = [id_col, *_NUMBERS, "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{n} bigint" for n in names[1:7]) + ", groups_sha256 string" + (", groups string" if with_groups else "")
    wanted = ["batch", "id", *_NUMBERS, "digest", *(["groups"] if with_groups else []), "place", "links"]
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-last.count() // BATCHES_PER_TASK))
    own, told = batches.where("n_a is not null").select(*wanted).repartition(tasks, "batch").groupBy("batch"), asked.repartition(tasks, "of").groupBy("of")
    return settled(own.cogroup(told).applyInArrow(rows, schema), mark)
