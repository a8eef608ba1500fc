"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

1. language ID: documents in no learned language go (trained on labelled rows of its own input)
2. near-dedup: of documents whose 5-word shingles have a Jaccard similarity of 0.8 or more one stays
3. benchmark decontamination: documents with a benchmark passage go
4. secret scans: secrets are replaced in the text, n_chars follows
5. BPE encoding: the text becomes token ids

Each stage handles null columns, empty tables and repeated rows as its operator states it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import bpe, decontaminate, langid, near_dedup as near, secrets
from tracewell.llm.common import read_table, store
from tracewell.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_rows(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encoding", bpe_encoding),
]

#: SQL has no fingerprints, kernels or merges; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written to the shared folder and read back."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, f"stage-{name}")
    return docs
