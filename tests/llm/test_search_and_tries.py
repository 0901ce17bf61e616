"""Token alignment, the conversation trie and the bit-code search against brute force, with the hard cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from sparkloom.llm import bit_search, prefix_trie, token_alignment
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _tokens(text):
    """Pieces of A and B with their ids, by the libraries' own calls."""
    import sentencepiece

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    found_a = [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
    found_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)] if text else []
    whole = (" " + text).encode() if text else b""
    good = all(b"".join(p for _, p in x) == whole for x in (found_a, found_b))
    return (found_a, found_b) if good else ([], [])


def _groups(text):
    a, b = _tokens(text or "")
    ends = []
    for found in (a, b):
        at, own = 0, []
        for _, piece in found:
            at += len(piece)
            own.append(at)
        ends.append(own)
    cuts, out = sorted(set(ends[0]) & set(ends[1])), []
    start = 0
    for c in cuts:
        out.append(([i for (i, _), e in zip(a, ends[0], strict=True) if start < e <= c], [i for (i, _), e in zip(b, ends[1], strict=True) if start < e <= c]))
        start = c
    return out


def _alignments(rows):
    """What align() has to return for (id, text) rows, in order."""
    groups = [_groups(t) for _, t in rows]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    docs = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    out = []
    for (i, _), g, own in zip(rows, groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(n for p, n in own.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in own.items()), digest, text))
    return out


TEXTS = [
    None, "", " ", "a", "The cat sat on the mat. The cat sat.", "  two  blanks\n\nand\tlines  ", "naïve café œuvre — “quoted” 漢字仮名 नमस्ते 🙂🙂 ‍", "x" * 3000, " " * 2500 + "end", "<|endoftext|> and </s> <unk> <0x41>",
    "holds ▁ the piece model's own blank", "nul\0byte", "1234567890 3.14159", "unbelievably antidisestablishmentarianism", "The cat sat on the mat. The cat sat.", "é́́", "word " * 900,
]


def test_alignment_equals_brute_force(spark, monkeypatch):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)] + [(3, "the"), (3, "the")]
    wide = [(*r, 1, "x", 2, "y") for r in rows]
    docs = spark.createDataFrame(wide, "doc_id long, text string, batch int, pairs string, links int, _x string").repartition(3)
    want = sorted(_alignments(rows), key=repr)
    got = sorted((tuple(r) for r in token_alignment.align(docs, A, B, with_groups=True).collect()), key=repr)
    assert got == want
    monkeypatch.setattr(token_alignment, "MANY_PAIRS", 1)  # the counts by distinct ids; in this process only
    encoders = token_alignment.Encoders.load(A, B)
    doc, pair, links = token_alignment.Aligned(encoders, [t or "" for _, t in rows]).pairs()
    for k, (_, t) in enumerate(rows):
        own = Counter((a, b) for x, y in _groups(t) for a in x for b in y)
        assert {(int(p) // encoders.size_b, int(p) % encoders.size_b): int(n) for p, n in zip(pair[doc == k], links[doc == k], strict=True)} == dict(own)


def test_alignment_of_no_rows_and_string_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align(none, A, B).collect() == []
    named = token_alignment.align(spark.createDataFrame([("k", "one two")], "doc_id string, text string"), A, B).first()
    assert (named["doc_id"], *named[1:-1]) == ("k", *_alignments([("k", "one two")])[0][1:-2])


def test_aligned_batches_lie_in_small_rows(spark):
    rows = [(i, f"one {i} two") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = token_alignment._batches(docs, A, B, "doc_id", "text", False).collect()
    own = [r for r in found if r["n_a"] is not None]
    assert sorted(r["id"] for r in own) == list(range(40))  # a row a document, whatever a batch holds
    assert [(r["place"], r["links"], r["docs"]) for r in found if r["n_a"] is None] == [(None, None, [r["docs"] for r in found if r["docs"]][0])]
    assert all(len(r["place"]) == len(r["links"]) == len(set(r["place"])) for r in own)


def test_alignment_of_empty_texts_alone(spark):
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in token_alignment.align(docs, A, B).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_vocabulary_links_count_documents(spark):
    rows = [(1, "one one two"), (2, "one two"), (3, "two"), (3, "two")]
    want = Counter(p for _, t in rows for p in {(a, b) for x, y in _groups(t) for a in x for b in y})
    found = token_alignment.vocabulary_links(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in found} == dict(want)
    top = {a: max(n for (x, _), n in want.items() if x == a) for a, _ in want}
    assert all(r["best"] == (r["n_docs"] == top[r["a_id"]]) for r in found)


def _conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 240), -150, -100, 1000, 2300, 2301, 2302]:
        same = c % 3 == 0
        for t in range(rng.randint(1, 7)):
            role, text = ("user", f"hello {t}") if same and t < 4 else (rng.choice(["user", "assistant", None]), rng.choice(["a", "", None, "longer é text", str(c)]))
            rows.append((c, t if rng.random() > 0.03 else None, role, text))
    rows += [(7, 1, "user", "twice"), (7, 1, "user", "twice"), (9, None, "user", "b"), (9, None, "user", "a"), (None, 0, "user", "no conversation")]
    rows += [(5000 + i, t, "user", f"long {t}") for i in range(4) for t in range(120 + i % 2)]  # copies and a beginning of another
    return rows


def _trie(rows, rebuild=True):
    found = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            found[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in found.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:] if rebuild else turns
    members, below = defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            below[node[:-1]].add(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in below[node]) or 1
        saved[node] = sum(saved[k] for k in below[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    digest = lambda node, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(node)))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(below[n]), leaves[n], saved[n], digest(n, m)) for n, m in members.items()), key=repr)


@pytest.mark.parametrize("limit", [1, 40, 20_000])
def test_trie_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(prefix_trie, "LOCAL_TURNS", limit)
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", 3)
    rows = _conversations()
    turns = spark.createDataFrame([(*r, 1, "x", b"y", 2) for r in rows], "conv_id long, turn long, role string, text string, code int, at string, digest binary, rows int").repartition(4)
    found = prefix_trie.sequences(turns)
    assert sorted((tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(found)).collect()), key=repr) == _trie(rows)
    if limit == 40:
        assert sorted((tuple(r) for r in prefix_trie.trie(found).collect()), key=repr) == _trie(rows, False)


def test_trie_of_one_and_of_none(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame([], kind))).collect() == []
    one = [(4, 0, "user", "only")]
    assert [tuple(r) for r in prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame(one, kind))).orderBy("depth").collect()] == _trie(one, False)


def _vectors(n=900, dim=24, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = (centres[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, dim))) * rng.uniform(0.2, 3, (n, 1))
    x[300:420] = x[300]  # copies
    return [(i, [float(v) for v in np.float32(x[i])]) for i in range(n)]


def _nearest(rows, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == len(rows[0][1]) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    x, ids = np.stack([v for _, v in usable]), np.array([i for i, _ in usable])
    out = {}
    for at, (i, v) in enumerate(usable):
        if i % 20 == 0:
            score = (x * v).sum(1)
            order = [j for j in np.lexsort((ids, -score)) if j != at][:k]
            out.setdefault(i, []).append([(int(ids[j]), float(score[j])) for j in order])
    return out


def _listed(frame):
    got = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def test_search_recall_scores_and_ties(spark):
    rows = _vectors()
    dim = len(rows[0][1])
    rows += [(2000, None), (2020, [0.0] * dim), (2040, [float("nan")] * dim), (2060, [None] + [1.0] * (dim - 1)), (2080, [1.0]), (None, [1.0] * dim), (2100, [float("inf")] * dim), (2101, [5.0] * dim)]
    frame = spark.createDataFrame([(*r, 1, "h", 2, 3.0) for r in rows], "vec_id long, embedding array<double>, id int, h string, r int, v double").repartition(5)
    want, got = _nearest(rows, 20), _listed(bit_search.nearest(frame, "vec_id % 20 = 0"))
    assert set(want) == set(got)
    assert all([r for r in got[q]] == sorted(got[q], key=lambda x: (-x[1], x[0])) and len(got[q]) == 20 for q in got)
    exact = {(q, i): s for q, lists in _nearest(rows, len(rows)).items() for i, s in lists[0]}
    assert all(exact[q, i] == s for q in got for i, s in got[q])
    hits = sum(len({i for i, _ in want[q][0]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.98 * 20 * len(want)
    copies = [i for i, _ in got[300] if 300 <= i < 420]
    assert copies == list(range(301, 301 + len(copies))) and copies  # its own copies, ties by id, not itself


def test_search_finds_all_of_few_and_repeated_ids(spark):
    kind = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0]), (20, [0.0, 2.0])]
    found = _listed(bit_search.nearest(spark.createDataFrame(rows, kind), "vec_id % 20 = 0"))
    assert found[0] == [(20, 1.0), (1, 0.5), (20, 0.0)]
    assert sorted(found[20]) == sorted([(0, 1.0), (1, 0.5), (20, 0.0), (1, 1.0), (0, 0.0), (20, 0.0)])
    assert bit_search.nearest(spark.createDataFrame([], kind), "vec_id % 20 = 0").collect() == []
    assert bit_search.nearest(spark.createDataFrame([(0, None)], kind), "vec_id % 20 = 0").collect() == []
    assert bit_search.nearest(spark.createDataFrame([(20, [1.0])], kind), "vec_id % 20 = 0").collect() == []


def test_search_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(bit_search, "QUERY_BLOCK", 8)
    rows = _vectors(400)
    got, want = _listed(bit_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 20 = 0", 5)), _nearest(rows, 5)
    assert sum(len(set(want[q][0]) & set(got[q])) for q in want) >= 0.98 * 5 * len(want) and set(got) == set(want)


def test_bit_estimates_keep_their_bound():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((2000, 96)), rng.standard_normal((50, 96))
    coder = bit_search.BitCodes(x[:500])
    top = coder.upper(coder.encode(x), coder.turned(q))
    middle = coder.upper(coder.encode(x), coder.turned(q), width=0.0)
    true = x @ q.T
    assert (top >= true).mean() > 0.995
    assert abs((middle - true).mean()) < 0.1 and np.corrcoef(middle.ravel(), true.ravel())[0, 1] > 0.8
