"""The registered queries of the corpus operators; each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import mixing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.ngram_join import similar_components

    return similar_components(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.secret_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.suffix_dedup import passage_report

    return passage_report(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_mixing_sources_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.quality_rules import quality_verdicts

    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.license_scan import scan

    return scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.vector_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.quality_model import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sparkloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sparkloom.llm.token_alignment import align

    return align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.prefix_trie import rebuilt, sequences, trie

    return trie(rebuilt(sequences(_table(spark, sf_dir, "conversations"))))


def op13_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.bit_search import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_secret_scans": op2_secret_scans,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_mixing_sources_to_target_weights": op4_mixing_sources_to_target_weights,
    "op5_quality_rules": op5_quality_rules,
    "op6_license_scans": op6_license_scans,
    "op7_html_extraction": op7_html_extraction,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_packing": op10_packing,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
    "op13_approximate_nearest_neighbours": op13_approximate_nearest_neighbours,
}
ORACLES: dict[str, str] = {"op4_mixing_sources_to_target_weights": mixing.ORACLE}
