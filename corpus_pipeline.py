"""The corpus pipeline over documents: reject, de-duplicate, redact, mix and pack, each stage on what its predecessor kept.

run() writes every stage as a table in the shared folder before the next one reads it. A stage takes (spark, docs,
sf_dir) and returns a DataFrame; all but the last return the columns of documents. No stage needs ids to be unique or
not null: rows are told apart by what they hold. Each stage of an empty table is empty; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize
from sparkloom.llm.mixing import mix
from sparkloom.llm.ngram_join import similar_components
from sparkloom.llm.packing import pack
from sparkloom.llm.quality_rules import quality_verdicts
from sparkloom.llm.secret_scan import redact, scan

#: SQL can express neither the robust estimates nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def _nested(docs: DataFrame) -> DataFrame:
    """docs as one column _doc beside text, lang and source, and _row, which rows that are equal throughout share: the id and
    128 bits of a hash of all columns and of where they are null."""
    parts = [*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"`{c}`").isNull() for c in docs.columns]]
    content = F.concat(F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit(1), *parts)))
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", content.alias("content"))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text", "lang", "source", row.alias("_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules; null and empty texts don't, each repeated row is judged for itself."""
    return quality_verdicts(_nested(docs), keep=("_doc",)).where("kept").select("_doc.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row, that with the smallest id.

    Rows count, not ids: of several texts under one id each is judged for itself. Rows that are equal throughout are
    one, of those that tie in id and text the one with the smallest hash stays; texts without words stay.
    """
    keyed = _nested(docs)
    kept = similar_components(keyed.select("_row", "text"), id_col="_row", count_links=False).where("id = component_id").select(F.col("id").alias("_row")).distinct()
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select("_doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, reported secrets replaced by a mark and n_chars brought up to date; null texts stay null."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]  # a text goes to the tasks' Python once
    keyed = _nested(docs).select(F.struct(*[F.col(f"_doc.`{c}`") for c in others]).alias("_doc"), "text", "source", F.col("_doc.doc_id").alias("repo"), F.col("_row.content").alias("key"))
    clean = redact(keyed, scan(keyed, id_col="key", repo_col="repo"), id_col="key")
    now = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return clean.select(*[now[c] if c in now else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the mixed order of their sources; packing, which reads them from files, works out the order again."""
    return mix(docs).orderBy("mix_slot", "mix_position").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, in windows of 2048 tokens, packed in the mixed order.

    Spark deals files to tasks by size, so an order over files is lost in reading. mix() gives the same places again;
    tasks take consecutive ranges of them, and sequence ids rise with the task.
    """
    import public_tokenizers

    return pack(mix(docs).orderBy("mix_slot", "mix_position"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", deduplicate),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
