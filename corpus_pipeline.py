"""A training corpus from ``documents``: rules, deduplication, mixing, packing.

Every stage takes NULLs in any column, empty, blank and very long texts, repeated rows and ids, an
empty table, and further columns whose names clash; it passes all columns on as they are. A NULL
text is an empty one, which the rules reject; a NULL source is a source like any other. Of equal or
near texts the row with the smallest id stays, or the first where ids are missing or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from secondcart.llm import exact_dedup, fertility, hilbert_pack, mixing, near_copies
from secondcart.llm.queries import PACK_END_ID, second_vocabulary, vocabulary
from secondcart.sources.warehouse import read_warehouse
from secondcart.sources.writers import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands."""
    return fertility.keep_good(
        docs, vocabulary("piece_bpe_32k.model"), second=second_vocabulary()
    )


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_copies(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word similarity of 0.8 or more links; SimHash groups and
    MinHash bands bring its texts together."""
    return near_copies.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target weight, in random order."""
    return mixing.mix(docs).drop(mixing.COPY)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return hilbert_pack.pack(docs, vocabulary("word_bpe_49k.json"), PACK_END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", one_of_near_copies),
    ("source_mix", source_mix),
    ("packing", sequences),
]

# Fertility, hashed shingles and tokenisers have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written and read again before the next."""
    docs = read_warehouse(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
