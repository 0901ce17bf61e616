"""Passages in answer to questions: index upkeep, definitions, sentence scores, abstention and selection, and measures of all that."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.columns import idf, stems
from sparkloom.operators.retrieval import chunks, keyword_rankings
from sparkloom.session import written

# Weights and limits of sentence selection, and words that continue a sentence or define something.
SEMANTIC_SHARE, LEXICAL_SHARE, RANK_LOSS, DEFINITION_BONUS = 0.55, 0.45, 0.03, 0.15
LEAST_OVERLAP, LEAST_SIMILARITY, NEAR_BEST = 0.52, 0.65, 0.8
MOST_SENTENCES, MOST_WORDS, LEAST_WORDS = 3, 90, 3
CONTINUES = r"^(?:This|These|That|Those|It|Its|They|Their|Such|However|In addition|Also|For example)\b"
DEFINING = r"\b(?:defin\w*|refer\w*|mean\w*|call\w*)\b"
# Words that carry no meaning in a question.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him "
    "his how i if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there these they this those through "
    "to too under until up very was we were what when where which while who whom why will with would you your yours tell explain describe say says said document according please give list mention mentioned"
).split()
SENTENCE = r"(?s)\S.*?(?:[.!?](?=\s)|(?=\n\s*\n)|\z)"
WORD = r"[A-Za-z0-9]+(?:['’][A-Za-z]+)?"


def words_of(text: Column) -> Column:
    """The stemmed words of a text, in order."""
    return stems(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def content_words(text: Column) -> Column:
    """The distinct stemmed words of a question that carry meaning; all of its words where none does."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w))
    own = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    return F.array_distinct(stems(F.when(F.size(own) > 0, own).otherwise(words)))


def sentences(passages: DataFrame) -> DataFrame:
    """(question_id, number, place, text, n_words) of passages (question_id, number, text): sentences of LEAST_WORDS words and more, in order."""
    found = passages.select("question_id", "number", F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("place", "text"))
    held = found.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    return held.withColumn("n_words", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))).where(F.col("n_words") >= LEAST_WORDS)


def sentence_scores(questions: DataFrame, passages: DataFrame, similarities: DataFrame | None = None) -> DataFrame:
    """sentences() of all questions (question_id, question, subject or null) with overlap, similarity and score.

    overlap: the share of the question's inverse document frequency that a sentence holds, over the question's own
    sentences. similarities (question_id, number, place, similarity), where there are any, count beside it. Later passages
    count a little less; a sentence that defines the subject counts more. Sentences and questions with their words are
    written once, as every step meets them.
    """
    held = written(sentences(passages).withColumn("_w", F.array_distinct(words_of(F.col("text")))))
    total = held.groupBy("question_id").agg(F.count("*").alias("_n"))
    asked = written(questions.select("question_id", "subject", content_words(F.col("question")).alias("_q")))
    key = ["question_id", "number", "place"]
    met = held.join(asked.select("question_id", "_q"), "question_id").select(*key, F.explode(F.array_intersect("_q", "_w")).alias("term"))
    weights = asked.select("question_id", F.explode("_q").alias("term")).join(total, "question_id").join(met.groupBy("question_id", "term").agg(F.count("*").alias("df")), ["question_id", "term"], "left")
    weights = weights.select("question_id", "term", idf(F.col("_n").cast("double"), F.coalesce("df", F.lit(0))).alias("w"))
    whole = weights.groupBy("question_id").agg(F.sum("w").alias("_whole"))
    shares = met.join(weights, ["question_id", "term"]).groupBy(*key).agg(F.sum("w").alias("_s")).join(whole, "question_id")
    out = held.join(shares.select(*key, F.round(F.col("_s") / F.col("_whole"), 9).alias("overlap")), key, "left").fillna(0.0, ["overlap"]).join(asked, "question_id")
    if similarities is None:
        out = out.withColumn("similarity", F.lit(None).cast("double"))
    else:
        out = out.join(similarities.select(*key, "similarity"), key, "left")
    base = F.coalesce(SEMANTIC_SHARE * F.col("similarity") + LEXICAL_SHARE * F.col("overlap"), F.col("overlap"))
    subject = content_words(F.col("subject"))
    defines = F.col("subject").isNotNull() & (F.size(F.array_except(subject, "_w")) == 0) & F.lower("text").rlike(DEFINING)
    score = (base + F.when(defines, DEFINITION_BONUS).otherwise(0.0)) * (1 - RANK_LOSS * (F.col("number") - 1))
    return out.select(*key, "text", "n_words", "overlap", "similarity", F.round(score, 9).alias("score"))


def answers(scores: DataFrame) -> DataFrame:
    """(question_id, abstained, overlap, similarity, quotes): of each question the selected sentences as array<struct<number, place, text>>, in reading order.

    The best sentence must match the question well enough. One that continues it comes next, then others near the best in
    score, few and short in all. A question's sentences are those of its passages, a handful.
    """
    order = Window.partitionBy("question_id").orderBy("number", "place")
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "number", "place")
    held = scores.withColumn("_r", F.row_number().over(best)).withColumn("_next", F.struct(F.lead("number").over(order).alias("number"), F.lead("place").over(order).alias("place")))
    entry = F.struct("_r", "number", "place", "text", "n_words", "score", "overlap", "similarity", "_next")
    listed = held.groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias("s"))
    top = F.col("s")[0]
    supported = (top["overlap"] >= LEAST_OVERLAP) | F.coalesce(top["similarity"] >= LEAST_SIMILARITY, F.lit(False))
    continues = lambda x: (x["number"] == top["number"]) & (x["place"] == top["_next"]["place"]) & (x["number"] == top["_next"]["number"]) & x["text"].rlike(CONTINUES)
    followers, others = F.filter("s", lambda x: (x["_r"] > 1) & continues(x)), F.filter("s", lambda x: (x["_r"] > 1) & (x["score"] >= NEAR_BEST * top["score"]) & (x["text"] != top["text"]))
    kind = "struct<words: int, kept: array<struct<number: int, place: int, text: string>>>"
    quote = lambda x: F.struct(x["number"].cast("int").alias("number"), x["place"].cast("int").alias("place"), x["text"].alias("text"))

    def take(acc, x):
        fits = (F.size(acc["kept"]) < MOST_SENTENCES) & (acc["words"] + x["n_words"] <= MOST_WORDS) & ~F.array_contains(acc["kept"], quote(x))
        return F.struct(F.when(fits, acc["words"] + x["n_words"]).otherwise(acc["words"]).alias("words"), F.when(fits, F.concat(acc["kept"], F.array(quote(x)))).otherwise(acc["kept"]).alias("kept")).cast(kind)

    first = F.struct(top["n_words"].alias("words"), F.array(quote(top)).alias("kept")).cast(kind)
    chosen = F.aggregate(F.concat(followers, others), first, take, lambda acc: F.array_sort(acc["kept"]))
    return listed.select("question_id", (~supported).alias("abstained"), F.round(top["overlap"], 4).alias("overlap"), F.round(top["similarity"], 4).alias("similarity"), F.when(supported, chosen).otherwise(F.array().cast("array<struct<number: int, place: int, text: string>>")).alias("quotes"))


def definition_rankings(docs: DataFrame, id_col: str, text_col: str, asked: DataFrame, k: int = 20, defining: str = DEFINING) -> DataFrame:
    """keyword_rankings() of asked (query, term) over the texts that hold a defining verb, texts with all terms only."""
    verbal = docs.where(F.lower(F.col(text_col)).rlike(defining))
    wanted = asked.groupBy("query").agg(F.count("*").alias("n"))
    return keyword_rankings(verbal, id_col, text_col, asked, k).join(wanted, "query").where("matched = n").drop("n")


def index_changes(docs: DataFrame, indexed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, change): documents to be indexed (new or changed) or taken out (missing), against indexed (id, digest); unchanged ones are left out."""
    now = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("digest"))
    both = now.join(indexed.select("id", F.col("digest").alias("_old")), "id", "full_outer")
    change = F.when(F.col("digest").isNull(), "missing").when(F.col("_old").isNull(), "new").when(F.col("digest") != F.col("_old"), "changed")
    return both.select("id", F.coalesce("digest", "_old").alias("digest"), change.alias("change")).where("change is not null")


def reindexed(docs: DataFrame, index: DataFrame, changes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """index (id, ordinal, heading, text, start, end) with the chunks of changed documents put in place of their old ones; a replay changes nothing."""
    kept = index.join(changes, "id", "left_anti")
    fresh = docs.join(changes.where("change <> 'missing'").select(F.col("id").alias(id_col)), id_col, "left_semi")
    return kept.unionByName(chunks(fresh, id_col, text_col))


def with_embeddings(passages: DataFrame, vectors: DataFrame) -> DataFrame:
    """passages (id, embedding) with the embeddings of vectors (id, embedding) put in where there are any."""
    new = vectors.select("id", F.col("embedding").alias("_new"))
    return passages.join(new, "id", "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")


def best_similarity(hits: DataFrame) -> DataFrame:
    """(query, similarity): the best of each query's hits; null where none has any."""
    return hits.groupBy("query").agg(F.max("similarity").alias("similarity"))


def pseudonyms(rows: DataFrame, column: str, day: str, key: bytes) -> DataFrame:
    """rows with the column replaced by a keyed hash of it and the day, 16 hex digits; null stays null. Arrow batches, as Spark has no HMAC."""

    @F.pandas_udf("string")
    def keyed(values: pd.Series, days: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else hmac.new(key, f"{d}|{v}".encode(), hashlib.sha256).hexdigest()[:16] for v, d in zip(values, days, strict=True)])

    return rows.withColumn(column, keyed(F.col(column).cast("string"), F.col(day).cast("string")))


def word_pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[str, int], unknown: str = "[UNK]", longest: int = 100) -> DataFrame:
    """(id, ids): word pieces, each the longest that the vocabulary holds, pieces inside a word marked by ##; a word that can't be cut is unknown.

    The vocabulary is the caller's and is broadcast; every distinct word of a batch is cut once.
    """
    from sparkloom.functions.pieces import cut_word, split_words

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = split_words(text or "")
                for w in set(words).difference(known):
                    known[w] = cut_word(w, shared.value, unknown, longest)
                out.append([i for w in words for i in known[w]])
            yield pd.DataFrame({"id": batch["id"], "ids": out})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, ids array<int>")


def _share(test: Column, where: Column | None = None) -> Column:
    """Aggregate: how many percent of the rows (where) pass; null without rows."""
    passed = test.cast("double") if where is None else F.when(where, test.cast("double"))
    return F.round(100 * F.avg(passed), 1)


def answer_measures(results: DataFrame) -> DataFrame:
    """One row of measures of results (kind, split, correct, abstained, pages of each passage, expected pages, cited pages)."""
    asked = F.col("kind") == "answerable"
    retrieved, cited = F.arrays_overlap("pages", "expected"), F.arrays_overlap("cited", "expected")
    return results.agg(
        F.count("*").alias("questions"), _share(F.col("correct")).alias("accuracy"), _share(F.col("correct"), asked).alias("answerable_accuracy"), _share(F.col("correct"), ~asked).alias("abstention_accuracy"),
        F.count_if(asked & F.col("abstained")).alias("false_abstentions"), _share(retrieved, asked).alias("retrieval_recall"), _share(cited, asked & ~F.col("abstained")).alias("citation_precision"),
        _share(F.col("correct"), F.col("split") == "dev").alias("dev_accuracy"), _share(F.col("correct"), F.col("split") == "held_out").alias("held_out_accuracy"),
    )


def outcome_counts(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, passed, answerable, accuracy): how many results were right, and of those that could be answered in percent; results (outcome, answerable)."""
    right = F.col("outcome") == "correct"
    return results.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(right).alias("passed"), F.count_if(F.col("answerable")).alias("answerable"), F.round(100 * F.count_if(right & F.col("answerable")) / F.nullif(F.count_if(F.col("answerable")), F.lit(0)), 1).alias("accuracy"))


def compared_fields(read: DataFrame, truth: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, one boolean for each field, exact): which fields of records were read as they are; null equals null, a record that wasn't read has none right."""
    r = read.select(key, *[F.col(f).alias(f"_r_{f}") for f in fields], F.lit(True).alias("_read"))
    both = truth.select(key, *fields).join(r, key, "left")
    same = [(F.col(f).eqNullSafe(F.col(f"_r_{f}")) & F.coalesce("_read", F.lit(False))).alias(f"{f}_ok") for f in fields]
    out = both.select(key, *same)
    return out.withColumn("exact", F.forall(F.array(*[F.col(f"{f}_ok") for f in fields]), lambda x: x))


def aligned_lines(read: DataFrame, truth: DataFrame) -> DataFrame:
    """(doc, i, j): read lines (doc, i, code) paired with record lines (doc, j, code) in order: runs of equal codes first, then what lies between them place by place.

    Documents are aligned apart from each other, each a bounded list of lines.
    """
    from difflib import SequenceMatcher

    def listed(rows: DataFrame, place: str, name: str) -> DataFrame:
        return rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col(place).cast("long").alias("at"), "code"))).alias(name))  # one document's lines

    def pair(left: list, right: list) -> list[tuple[int, int]]:
        ops = SequenceMatcher(None, [x["code"] or "?" for x in left], [x["code"] for x in right], autojunk=False).get_opcodes()
        return [(left[i1 + k]["at"], right[j1 + k]["at"]) for tag, i1, i2, j1, j2 in ops if tag in ("equal", "replace") for k in range(min(i2 - i1, j2 - j1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"i": i, "j": j} for i, j in pair(a, b)] for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found, pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64())])))], ["doc", "pairs"])

    kind = truth.schema["doc"].dataType.simpleString()
    both = listed(read, "i", "a").join(listed(truth, "j", "b"), "doc")
    return both.mapInArrow(run, f"doc {kind}, pairs array<struct<i: long, j: long>>").select("doc", F.inline("pairs"))


def document_measures(results: DataFrame, by: list[str]) -> DataFrame:
    """Measures of read documents (exact, flagged, truth_lines, read_lines, paired) by groups, in percent with one decimal."""
    wrong, right, flagged = ~F.col("exact"), F.col("exact"), F.col("flagged")
    ratio = lambda a, b: F.round(100 * F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 1)
    return results.groupBy(*by).agg(
        F.count("*").alias("documents"), _share(right).alias("exact_pct"), ratio("paired", "truth_lines").alias("line_recall"), ratio("paired", "read_lines").alias("line_precision"), _share(flagged).alias("flagged_pct"),
        _share(flagged, wrong).alias("caught"), _share(flagged, right).alias("false_alarms"), F.count_if(wrong & ~flagged).alias("silently_wrong"), F.count_if(wrong).alias("wrong"),
    )
