"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, decontamination, BPE.

Each stage takes all rows that its predecessor kept. Between stages the rows are a Parquet table in the shared
folder that spark.checkpoint.dir names, so a lost executor costs a stage's tasks, not the stages before.

Defined results: the stages' own (tubeql.llm.quality, line_dedup, simhash, decontaminate, bpe). An empty table
passes through every stage; columns beside doc_id, text and n_chars pass through the first four as they are,
whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tubeql.llm import bpe, decontaminate, line_dedup, quality, simhash
from tubeql.llm.common import remove, shared_folder, table

TOKENIZER = "word_bpe_49k.json"

#: Hashes, trained weights and merges can't be written in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that 10 documents or more have; n_chars follows the text."""
    return line_dedup.deduplicate(docs, min_docs=10, min_chars=1, length="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: a Jaccard similarity of 5-word shingles of 0.8 or more."""
    return simhash.deduplicate(docs, similarity=0.8, words=5)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), words=5, share=0.8)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the ids (little-endian unsigned 32-bit integers)."""
    path = public_tokenizers.path(TOKENIZER)
    done = bpe.decode(bpe.encode(docs, path), path)
    return done.select("doc_id", *bpe.digests(), "ids")


STAGES = [("quality rules", quality_rules), ("line dedup", drop_lines), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark_items), ("BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a table is removed once its successor is written."""
    folder, docs, before = f"{shared_folder(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
