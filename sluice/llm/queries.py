"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers

from sluice.llm import bpe, langid, linededup, packing, quality, sharding, simhash, spotsigs, topk, warc


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark, sf_dir):
    """Byte-level BPE round trip over every text of documents."""
    return bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_quality(spark, sf_dir):
    """A quality score for every text of documents."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_topk(spark, sf_dir):
    """The 20 best inner products of every query vector."""
    return topk.nearest(_table(spark, sf_dir, "embeddings"))


def op4_warc(spark, sf_dir):
    """Every page written as a WARC record and read back."""
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op5_langid(spark, sf_dir):
    """The language of every text of documents."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_spotsigs(spark, sf_dir):
    """SpotSigs fingerprints of all documents and their edited texts."""
    return spotsigs.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op7_linededup(spark, sf_dir):
    """All documents without the lines that an earlier line resembles."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs)


def op8_simhash(spark, sf_dir):
    """SimHash fingerprints of all documents and their components."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    """All documents packed into sequences of at most 2048 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_sharding(spark, sf_dir):
    """All documents in 24 shards of near equal bytes."""
    return sharding.kd_shards(_table(spark, sf_dir, "documents"), shards=24)


def queries():
    return {f.__name__: f for f in (op1_bpe, op2_quality, op3_topk, op4_warc, op5_langid, op6_spotsigs, op7_linededup, op8_simhash, op9_packing, op10_sharding)}


def oracle_sql():
    return {}
