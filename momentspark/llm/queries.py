"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, conversations, lattice, merkle, orc_tokens, packing, quality, secrets, sharding, simhash, toxicity, wrappers
from .common import Scratch, table


def _definition() -> str:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_zstd_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"), count("novel").alias("n_novel"))


def op3_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), _definition(), capacity=1024, end_id=2))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.tokenizer_json(ranks, public_tokenizers.PATTERN))


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'orc').root}/tokens"
    orc_tokens.write_tokens(table(spark, sf_dir, "documents"), _definition(), path, end_id=0)
    return orc_tokens.token_index(orc_tokens.read_tokens(spark, path))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"), least_cosine=0.95)


def op11_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edits_and_neighbours(table(spark, sf_dir, "documents"))


def op12_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op13_threshold_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


QUERIES = {
    "op1_nnpu_toxicity": op1_nnpu_toxicity,
    "op2_zstd_secrets": op2_zstd_secrets,
    "op3_label_propagation": op3_label_propagation,
    "op4_pattern_packing": op4_pattern_packing,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_orc_tokens": op6_orc_tokens,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_wrappers": op8_html_wrappers,
    "op9_simhash": op9_simhash,
    "op10_lattice": op10_lattice,
    "op11_merkle_fingerprint": op11_merkle_fingerprint,
    "op12_branch_and_bound": op12_branch_and_bound,
    "op13_threshold_clustering": op13_threshold_clustering,
}
ORACLE_SQL: dict[str, str] = {
    "op7_quality_rules": quality.ORACLE_SQL,
    "op11_merkle_fingerprint": merkle.ORACLE_SQL,
    "op12_branch_and_bound": conversations.ORACLE_SQL,
    "op13_threshold_clustering": centroids.ORACLE_SQL,
}
