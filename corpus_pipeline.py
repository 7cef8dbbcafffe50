"""A training corpus from raw documents: language, quality, lines, near copies, packing.

STAGES lists (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. All but the last return the columns of documents:

- language: a model learned from the labelled documents; texts without a letter (`und`) and those whose best language
  has a probability below MIN_LANGUAGE go. A null lang and all other columns stay as they are.
- quality: a model learned from `labels`; documents predicted 0 go.
- lines: lines like an earlier one go from the text and n_chars is brought up to date; every document stays, an emptied
  one with an empty text.
- near_copies: of each SimHash component (op8's three-word shingles and 3 bits) the document with the least doc_id stays;
  of these go all whose five-word shingles have a Jaccard similarity of at least 0.8 with those of an earlier one.
- packing: the pieces of sequences of at most 2048 ids.

Null texts are empty ones (language rejects them); empty tables pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import langid, linededup, nearcopies, packing, quality, simhash
from sluice.llm.common import durable

MIN_LANGUAGE = 0.5
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.predict(docs, langid.fit(docs), keep=docs.columns, names=("__lang", "__sure"))
    return found.where((F.col("__lang") != langid.UNDETERMINED) & (F.col("__sure") >= MIN_LANGUAGE)).select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.predict(docs, quality.fit(docs, labels), keep=docs.columns, names=("__score", "__good"))
    return found.where(F.col("__good") == 1).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(docs)
    return found.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.without_later(simhash.keep_first(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", good), ("lines", lines), ("near_copies", near_copies), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, f"stage-{name}")
    return docs
