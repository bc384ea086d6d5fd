"""Corpus pipeline: documents through five operators, each stage written and read again.

quality rules      rows that the rules or the isolation forest reject go
near-duplicates    one document of each group stays
decontamination    rows that contain a benchmark item go
mixing             rows are put in the order of the Pfair schedule; none goes
tokens             ids are written in that order and read back

All stages but the last return the columns of documents. The mixing stage's decision is the
order of its rows: Spark writes a sorted table as numbered part files, and the token stage
numbers the ids in the order of those files' rows (by id where it gets no files).

Defined results of every stage: null and empty texts fail the quality rules, so later stages get them only when called alone, where they are kept
(near-duplicates, decontamination, mixing) or written as one end id (tokens); very long texts are taken whole; rows that repeat an id and a text
are one row after near-duplicates, and a row without an id stays; of similar texts the one of the least id stays; an empty table
gives an empty table; further columns, whatever their names, are carried on as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenlake.llm import decontam, mixing, neardup, quality, store, tokenout
from lumenlake.llm.queries import DEFAULT_WEIGHT, WEIGHTS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, WEIGHTS, default_weight=DEFAULT_WEIGHT)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = store.new_path(spark, "tokens")
    order = tokenout.row_order(docs) if docs.inputFiles() else None
    tokenout.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), order=order)
    return tokenout.read_index(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("neardup", neardup_stage),
    ("decontam", decontam_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: The forest, the schedule and the tokenizer have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table is dropped when the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = store.new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            store.drop(spark, last)
        last = path
    return docs
