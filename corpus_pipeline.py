"""The corpus pipeline: toxic documents go, near copies go, repeated passages go, sources are mixed, texts become ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads it from Parquet. Texts are
read whole however long; an empty table gives an empty one; other columns, whatever their names, pass
through all stages but those that the last one makes (`ids`, `n_tokens`).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vigil.llm import bpe, mixing, simhash, toxicity, windows
from vigil.llm.common import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more are dropped, repeated rows alike; null and empty texts have the lowest evidence and are judged by it."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a likeness of 0.8 or more (five-word shingles) one document stays, that with the smallest doc_id.

    Texts without words are one group; a row without doc_id stays only where its group has no other;
    of repeated rows one stays.
    """
    return simhash.drop_near_duplicates(docs)


def without_repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows of 35 words are dropped from their texts and n_chars follows; all rows stay, null texts as null."""
    return windows.drop_repeated_windows(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice; those without words never. A null source is a source."""
    return mixing.drawn(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and the number of these; null and empty texts have none."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("substring_dedup", without_repeated_windows),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: The trained, hashed and fitted stages are beyond SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs)
    return docs
