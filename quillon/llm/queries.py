"""One query per operator over its whole table."""

from __future__ import annotations

import public_tokenizers

from quillon.llm import (byte_bpe, conversation_repair, decontaminate, exact_chunks, filter_audit, language_mixture, perspectives, prob_minhash,
                         robust_outliers, secret_links, suffix_dedup, warc_chunks, weak_pii)
from quillon.session import load

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.deduplicate(load(spark, sf_dir, "documents"))


def op2_robust_outliers(spark, sf_dir):
    return robust_outliers.verdicts(load(spark, sf_dir, "documents"))


def op3_secret_links(spark, sf_dir):
    return secret_links.scan(load(spark, sf_dir, "documents")).drop("text_key")


def op4_prob_minhash(spark, sf_dir):
    return prob_minhash.near_duplicates(load(spark, sf_dir, "documents"))


def op5_language_mixture(spark, sf_dir):
    return language_mixture.predictions(load(spark, sf_dir, "documents"))


def op6_weak_pii(spark, sf_dir):
    return weak_pii.detect(load(spark, sf_dir, "documents")).drop("text_key")


def op7_perspectives(spark, sf_dir):
    return perspectives.perspectives(load(spark, sf_dir, "conversations"))


def op8_decontaminate(spark, sf_dir):
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("text_key")


def op9_byte_bpe(spark, sf_dir):
    return byte_bpe.token_digests(load(spark, sf_dir, "documents"), RANKS)


def op10_warc_chunks(spark, sf_dir):
    return warc_chunks.round_trip(load(spark, sf_dir, "pages"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op12_chunk_recipes(spark, sf_dir):
    return exact_chunks.duplicates(load(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.repairs(load(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_robust_outliers, op3_secret_links, op4_prob_minhash, op5_language_mixture, op6_weak_pii, op7_perspectives,
    op8_decontaminate, op9_byte_bpe, op10_warc_chunks, op11_filter_audit, op12_chunk_recipes, op13_conversation_repair)}
