"""A corpus pipeline of five stages over documents. Each stage takes (spark, docs, sf_dir) and returns a DataFrame.

1. quality: documents that the classifier rejects go.
2. near_duplicates: of each component of documents whose word 5-grams link (Jaccard similarity of 0.8 or more), one stays.
3. decontaminate: documents that hold a window of ten consecutive words of a benchmark item go.
4. secrets: found secrets are replaced by a mark; n_chars follows.
5. encode: token ids of every remaining text.

All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.llm import bpe, decontam, jaccard_join, quality, secrets
from skillcube.llm.common import read_table, staged

#: Words in a shingle and the similarity, in percent, from which documents are near duplicates; op10 has its own pair.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score at least quality.THRESHOLD; the trees are fitted to labelled documents of the corpus."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of every component."""
    return jaccard_join.keep_first(docs, NEAR_WIDTH, NEAR_PERCENT)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with an exact benchmark window."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mark secrets out of texts; no document goes."""
    return secrets.redact_documents(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every text, by the word-level BPE vocabulary."""
    encoded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("encode", encode_stage),
]

#: Neither the trees nor BPE can be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage keeps is written out and read again as the next one's documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
