"""Secret scans that tell copied examples from live-looking credentials by corpus-wide ownership frequency.

Every task finds candidate spans in its texts: three base kinds, known credential shapes and unlabelled high-entropy
strings. The values are hashed and counted over the corpus by distinct repositories and owners. A value that many of
them hold is a copied example; one that few hold looks live. Candidates of the shapes beyond the base kinds are reported
only where they look live; base spans are always reported. Only hashes, never values, leave a task.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import join_hot, materialize

#: A value held by more owners, or by more repositories, than this is a copied example.
MAX_OWNERS = 3
MAX_REPOS = 12
MIN_ENTROPY = 3.5

#: The base kinds in their order, with patterns and least lengths.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
BASE = ("assign", "access", "hex")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Public shapes of credentials that services hand out.
SHAPES = {
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "stripe": re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}"),
    "jwt": re.compile(r"[A-Za-z0-9_.-]{32,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
}
#: How the first two of a token's three parts begin, and the least length of what follows in each.
JWT_START, JWT_PART = "eyJ", 8
HINTS = {"github": "gh", "slack": "xox", "stripe": "k_live_", "google": "AIza", "jwt": "eyJ", "pem": "-----BEGIN"}
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base kinds, by start, then kind as listed."""
    found = []
    if any(k in text.lower() for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign", m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], BASE.index(x[2])))


def jwt_spans(start: int, run: str) -> Iterator[tuple[int, int]]:
    """Three parts with dots between, the first two with JWT_START, in a whole run of their letters; each part is looked at once."""
    at, parts = start, run.split(".")
    begins = []
    for part in parts:
        begins.append(at)
        at += len(part) + 1
    i = 0
    while i + 2 < len(parts):
        lead = parts[i].find(JWT_START)
        least = len(JWT_START) + JWT_PART
        if lead >= 0 and len(parts[i]) - lead >= least and parts[i + 1].startswith(JWT_START) and len(parts[i + 1]) >= least and len(parts[i + 2]) >= JWT_PART:
            yield begins[i] + lead, begins[i + 2] + len(parts[i + 2])
            i += 3
        else:
            i += 1


def shaped_spans(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Further candidates that overlap no span in taken: known shapes first, then strings that look random."""
    # merged spans, apart and in order, so that one search tells whether another overlaps any
    starts: list[int] = []
    ends: list[int] = []
    for s, e, _, _ in taken:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    found = []

    def free(start, end):
        i = bisect_left(starts, end)
        return i == 0 or ends[i - 1] <= start

    def add(start, end, kind, value):
        if free(start, end):
            i = bisect_left(starts, start)
            starts.insert(i, start)
            ends.insert(i, end)
            found.append((start, end, kind, value))

    for kind, pattern in SHAPES.items():
        if HINTS[kind] in text:
            for m in pattern.finditer(text):
                for start, end in jwt_spans(m.start(), m[0]) if kind == "jwt" else [(m.start(), m.end())]:
                    add(start, end, kind, text[start:end])
    # these come in order and apart from each other, so they needn't be put among the others
    for m in OPAQUE.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isupper() for c in v) and any(c.islower() for c in v) and entropy(v) >= MIN_ENTROPY and free(m.start(), m.end()):
            found.append((m.start(), m.end(), "opaque", v))
    return found


CANDIDATE = "array<struct<start:int,`end`:int,kind:string,base:boolean,hash:binary>>"


def candidates(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns in keep and `found`, the candidate spans of each whole text, by start."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_()), ("hash", pa.binary())]))

    def one(text: str | None) -> list[dict]:
        base = base_spans(text or "")
        both = [(*x, True) for x in base] + [(*x, False) for x in shaped_spans(text or "", base)]
        both.sort(key=lambda x: (x[0], BASE.index(x[2]) if x[4] else len(BASE), x[2]))
        return [{"start": s, "end": e, "kind": k, "base": b, "hash": hashlib.sha256(v.encode()).digest()[:16]} for s, e, k, v, b in both]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([one(t.as_py()) for t in batch.column("_text")], kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], found], [*keep, "found"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, f"{fields}, found {CANDIDATE}")


def ownership(found: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """(hash, rows, repos, owners): how often, and in how many distinct repositories and owners, each candidate value occurs.

    Counted in two partial steps, so a value copied everywhere is combined in every task before it is shuffled.
    """
    each = found.select(F.explode("found").alias("c"), repo.alias("repo"), owner.alias("owner")).select(F.col("c.hash").alias("hash"), "repo", "owner").groupBy("hash", "repo", "owner").agg(F.count("*").alias("rows"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("rows").alias("rows"))
    return by_owner.groupBy("hash").agg(F.sum("rows").alias("rows"), F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, and n_live and n_examples of the verdict.

    repo_col: what counts as one repository (the row's id by default). Null and empty texts have no spans; null owners
    count as one owner. Rows that repeat an id are scanned each for itself. An empty table gives an empty result.
    Spans are code points, end exclusive, listed by start, then kind.
    """
    keep = list(dict.fromkeys([id_col, owner_col, *([repo_col] if repo_col else [])]))
    found = materialize(candidates(docs, text_col, keep).withColumn("_row", F.monotonically_increasing_id()))
    counts = ownership(found, F.col(f"`{repo_col or id_col}`"), F.col(f"`{owner_col}`"))
    live = counts.select("hash", "rows", ((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).alias("live"))
    verdicts = found.select("_row", F.explode("found").alias("c")).select("_row", "c", F.col("c.hash").alias("hash"))
    verdicts = join_hot(verdicts, materialize(live), "hash", "rows", ["_row", "c"])
    spans = verdicts.groupBy("_row").agg(F.collect_list(F.struct(F.col("c.start").alias("start"), F.array_position(F.array(*map(F.lit, BASE)), F.col("c.kind")).alias("at"), F.col("c.end").alias("end"), F.col("c.kind").alias("kind"), F.col("c.base").alias("base"), "live")).alias("s"))  # a text's own spans
    ordered = F.array_sort(F.transform("s", lambda s: F.struct(s["start"].alias("start"), F.when(s["at"] == 0, 9).otherwise(s["at"]).alias("at"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"), s["live"].alias("live"))))
    judged = found.select("_row", f"`{id_col}`").join(spans.select("_row", ordered.alias("s")), "_row", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:int,at:bigint,kind:string,`end`:int,base:boolean,live:boolean>>")))
    of = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long")
    return judged.select(
        F.col(f"`{id_col}`"),
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(_listed(F.filter("s", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
        _listed(F.filter("s", lambda s: s["base"] | s["live"])).alias("spans"),
        F.size(F.filter("s", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("s", lambda s: ~s["live"])).cast("long").alias("n_examples"),
    )


def redact(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every reported span of scan() replaced by mark; columns as in docs. Rows with a null id stay as they are;
    rows that repeat an id must have the same text. Only the short span lists are joined to the texts.
    """
    listed = scanned.where("spans <> ''").select(F.col(id_col).alias("_id"), F.col("spans").alias("_spans")).dropDuplicates(["_id"])
    held = docs.join(listed, F.col(f"`{id_col}`") == F.col("_id"), "left").drop("_id")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if s is None else masked(t, s, mark) for t, s in zip(batch.column(text_col).to_pylist(), batch.column("_spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names], names)

    return held.mapInArrow(run, docs.schema)


def masked(text: str | None, spans: str, mark: str) -> str | None:
    """The text with its spans, listed as kind:start:end by start, replaced by mark; spans that overlap are one."""
    parts, at = [], 0
    for span in spans.split(","):
        start, end = map(int, span.rsplit(":", 2)[1:])
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])
