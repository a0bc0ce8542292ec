"""The operators' registered queries, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, html_text, media, minhash, oracles, packing, quality, sharding, toxicity, warc
from .common import table


def tokenizer(name: str) -> str:
    """Path of a public vocabulary that every node has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokenizer("byte_bpe_50k.json")
    formatted = chat.format_chats(chat.with_probe(table(spark, sf_dir, "conversations")), vocabulary)
    return chat.digests(formatted, vocabulary).drop("n_tokens", "loss_tokens")  # SQL has no tokens


def op5_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_warc, op3_feistel_shards, op4_chat_masks, op5_media_sequences, op6_toxicity, op7_near_duplicates, op8_decontamination, op9_packing, op10_html_text)
}

#: The rest hold trained models, tokenizers, checksums and formats that SQL doesn't have, or sampled hashes.
ORACLE_SQL = {"op2_warc": oracles.WARC, "op4_chat_masks": oracles.CHAT, "op7_near_duplicates": oracles.NEAR_DUPLICATES}
