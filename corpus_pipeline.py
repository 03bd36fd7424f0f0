"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's.

Stages take any number of rows, none included, and rows that repeat; a null text stays null until packing, where it
is the end id alone. Texts are handled whole, whatever their length. Columns of ``docs`` with names that operators
use inside stay as they are. Of rows with equal ids the first that is read counts as the smaller one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kestrelq.llm import decontaminate, ngram_join, packing, secrets, toxicity
from kestrelq.llm.common import released, settled_table
from kestrelq.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose highest window scores below 0.5; a null or empty text has one empty window. Without training
    labels of both kinds all stay."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"), limit=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of linked documents; nulls come last. Texts without a word
    are classes of their own."""
    return ngram_join.deduplicated(docs, threshold=0.8)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark windows; documents of whose words more than half are benchmark go. With an empty
    benchmark nothing changes."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), n=10, coverage=0.5)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked; no document goes."""
    return secrets.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences of 2048 ids. A document is cut wherever a sequence ends; an empty table has no piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", cut_benchmark),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: SQL can't express the trained scores, tokens by a vocabulary or spans cut out of texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in order over documents; every result but the last is written and read again, and what was written
    on the way to it is removed."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = settled_table(lambda: stage(spark, before, sf_dir), f"pipeline-{name}")  # noqa: B023
        released(before)
    return STAGES[-1][1](spark, docs, sf_dir)
