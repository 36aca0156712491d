"""Cleaning pipeline over ``documents``: STAGES in order, each reading what its predecessor kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of
``documents``; the last returns the tokenised corpus. A null text, an empty one
and a repeated row go through every stage as its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import bm25_decontam, line_chunks, sentencepiece_offsets, simhash_trie, toxicity_fm
from vitrine.llm.common import crc_fold, table, written
from vitrine.llm.queries import TOXIC_FROM, tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorization machine scores at TOXIC_FROM or more go; it learns outside the held-out third."""
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id", 3) != 1)
    model = toxicity_fm.train(docs, labels)
    return toxicity_fm.score(docs, model, out_col="__toxicity").where(F.col("__toxicity") < TOXIC_FROM).drop("__toxicity")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated line chunks, short ones too, are cut from the text; every row stays, with its new length."""
    out = line_chunks.dedup_lines(docs, rules=line_chunks.RULES).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id."""
    return simhash_trie.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's question and answer go."""
    return bm25_decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text with their byte spans' total, and the digest of the text decoded from them."""
    out = sentencepiece_offsets.encode(docs, tokenizer_path(), outputs=("ids", "n_tokens", "span_bytes", "ids_sha256", "decoded_sha256"))
    return out.drop("text")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece", tokenize_stage),
]

#: XXH64, the trained model and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
