"""Registered queries of this folder, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, decontam, dropout, laesa, lines, mtree, packing, ppm, simhash, sketch, threshold, toxicity, urls
from .common import table

Run = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed collection of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op2_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents"))


def op6_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    return dropout.encode(table(spark, sf_dir, "documents"), path, seed=2026, check=True)


def op11_laesa_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laesa.cluster(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return threshold.mine(vectors.withColumn("label", moved), anchors=F.col("vec_id") % 100 == 0)


def op13_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontam.build_index(table(spark, sf_dir, "documents"))
    return decontam.digests(decontam.find(index, decontam.windows(table(spark, sf_dir, "benchmark"))))


QUERIES: dict[str, Run] = {
    "op1_ppm_score": op1_ppm_score,
    "op2_packed_ids": op2_packed_ids,
    "op3_scaled_sketch": op3_scaled_sketch,
    "op4_toxicity": op4_toxicity,
    "op5_simhash_groups": op5_simhash_groups,
    "op6_mtree_top_k": op6_mtree_top_k,
    "op7_url_filter": op7_url_filter,
    "op8_line_dedup": op8_line_dedup,
    "op9_best_fit": op9_best_fit,
    "op10_merge_dropout": op10_merge_dropout,
    "op11_laesa_clusters": op11_laesa_clusters,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_fm_decontamination": op13_fm_decontamination,
}

SQL: dict[str, str] = {
    "op8_line_dedup": lines.SQL,
}
