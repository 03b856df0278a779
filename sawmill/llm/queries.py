"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.llm import (
    bpe,
    chat,
    embeddings,
    exact_dedup,
    interpolation,
    jaccard,
    lexical,
    licenses,
    merkle,
    mixing,
    packing,
    pages,
    toxicity,
)
from sawmill.llm.common import fold, table


def op1_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = fold(F.col("doc_id"), 7)
    role = F.when(rest == 2, "test").when(rest == 5, "dev").otherwise("main")
    return interpolation.interpolated_scores(docs, role)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents")).drop("set_key")


def toxic(docs: DataFrame, labels: DataFrame, name: Column | None = None) -> DataFrame:
    """Scores learned from the labels whose fold isn't held out."""
    return toxicity.toxicity(docs, labels, fold(F.col("_id"), 4) != 2, name=name)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted",
                      F.size("spans").alias("n_spans"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").alias("n_identifiers"),
                        F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest=True)


def encoded(docs: DataFrame) -> DataFrame:
    """Digest columns of the encoded and decoded texts."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = bpe.bpe_decode(bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"SELECT * FROM VALUES (-1, 0, 'user', '{said}'), (-1, 1, 'assistant', '{said}') AS t (conv_id, turn, role, text)").to(rows.schema)
    out = chat.format_chat(rows.unionByName(probe).withColumn("parts", chat.text_parts(F.col("text"))))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    said_by = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                      F.sha2(said_by.cast("binary"), 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"),
                      F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) == 0  # a null id is not tampered with
    leaves = table(spark, sf_dir, "documents").select("doc_id", "lang", merkle.document_leaf(F.col("n_chars")).alias("leaf"), F.when(
        tampered & F.col("n_chars").isNotNull(), merkle.document_leaf(F.col("n_chars") + 1)).alias("tampered"))
    leaves = leaves.select("doc_id", "lang", "leaf", F.coalesce("tampered", "leaf").alias("claimed"))
    out = merkle.merkle_manifest(leaves, "lang", "doc_id", claimed="claimed", proofs=False)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def queries() -> dict:
    return {f.__name__: f for f in (op1_interpolated_lm, op2_jaccard_join, op3_toxicity, op4_license_scan, op5_exact_dedup, op6_bpe, op7_main_text, op8_chat_format, op9_embedding_dedup, op10_mix_sources, op11_lexical_search,
                                   op12_merkle_manifest, op13_best_fit_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": licenses.oracle(), "op5_exact_dedup": exact_dedup.ORACLE,
            "op8_chat_format": chat.ORACLE, "op10_mix_sources": mixing.ORACLE,
            "op11_lexical_search": lexical.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
