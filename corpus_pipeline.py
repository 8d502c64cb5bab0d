"""A corpus pipeline: quality rules, near-duplicates, repeated strings, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written and read again as the next stage's documents. All stages but the last
return the columns of their input. Each operator's docstring says what happens to
nulls, empty texts, ties, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, mixing, near, quality, suffix
from tessera.llm.common import shelve, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject."""
    return quality.passing(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near-duplicates (five words, similarity 0.8)."""
    return near.one_of_each(docs)


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 100 bytes that occur earlier out of the texts; n_chars stays that of the document as it came."""
    return suffix.cleaned(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, cuts and drops documents so that sources reach their target weights."""
    return mixing.remixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("repeated strings", repeated_string_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shelve(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Sampling by hashes, circulant MinHash and BPE are beyond DuckDB's SQL; tests compare with brute force.
ORACLE_SQL = None
