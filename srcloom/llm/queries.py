"""The registered queries: each operator with production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.llm import (
    bpe,
    bpe_chunks,
    chat_format,
    gru_lm,
    jaccard_join,
    language_id,
    lexical_search,
    packing,
    pii,
    quality_rules,
    substring_dedup,
    token_alignment,
    token_counts,
    voronoi_knn,
)
from srcloom.llm.common import id_remainder, table

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    model = language_id.fit(docs, ~held_out)
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), bpe.tokenizer_path(BYTE_BPE))


def lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gru_lm.score_documents(docs, id_remainder(F.col("doc_id"), 5) == 1)


def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), bpe.tokenizer_path(BYTE_BPE))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.judge(docs, labels, F.col("lang"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode_decode(table(spark, sf_dir, "documents"), bpe.tokenizer_path(BYTE_BPE))


def align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = bpe.tokenizer_path(BYTE_BPE), bpe.tokenizer_path(PIECE_BPE)
    return token_alignment.align(table(spark, sf_dir, "documents"), *paths)


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_conversations(conversations))


QUERIES = {
    "op1_language_id": language,
    "op2_best_fit_packing": pack,
    "op3_lm_scoring": lm_score,
    "op4_token_counts": count_tokens,
    "op5_personal_data": personal_data,
    "op6_jaccard_join": jaccard,
    "op7_substring_dedup": substrings,
    "op8_quality_rules": quality,
    "op9_exact_top_k": nearest,
    "op10_bpe_encode_decode": encode_decode,
    "op11_token_alignment": align_tokens,
    "op12_lexical_search": lexical,
    "op13_chat_format": chat,
}

SQL = {
    "op6_jaccard_join": jaccard_join.oracle_sql(),
    "op7_substring_dedup": substring_dedup.oracle_sql(),
    "op8_quality_rules": quality_rules.oracle_sql(),
    "op9_exact_top_k": voronoi_knn.oracle_sql(),
    "op12_lexical_search": lexical_search.oracle_sql(),
    "op13_chat_format": chat_format.oracle_sql(),
}
