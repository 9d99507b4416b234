"""The numbered queries over a warehouse folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from secondcart.llm import (
    column_bwt,
    exact_dedup,
    fertility,
    fm_index,
    hilbert_pack,
    html_text,
    mixing,
    privacy,
    ptolemy,
    records,
    resample,
    simhash,
    url_filter,
)
from secondcart.sources.warehouse import read_warehouse

Query = Callable[[SparkSession, str], DataFrame]

PACK_END_ID = 2
RECORD_END_ID = 1


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def second_vocabulary() -> tuple[str, str]:
    """File and split pattern of the byte-level vocabulary that fertility is measured by too."""
    import public_tokenizers

    return vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_host_segmentation(spark: SparkSession, folder: str) -> DataFrame:
    rules = url_filter.rules_of(url_filter.DEFAULT_RULES)
    public = url_filter.public_words(vocabulary("word_bpe_49k.json"))
    return url_filter.judge_urls(read_warehouse(spark, folder, "pages"), rules, public=public)


def op2_fm_substrings(spark: SparkSession, folder: str) -> DataFrame:
    done = fm_index.remove_repeats(read_warehouse(spark, folder, "documents"))
    return done.drop("kept_text")


def op3_disclosing_terms(spark: SparkSession, folder: str) -> DataFrame:
    found = privacy.find_personal_data(read_warehouse(spark, folder, "documents"))
    return found.drop("found")


def op4_hilbert_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_warehouse(spark, folder, "documents")
    return hilbert_pack.pack(docs, vocabulary("word_bpe_49k.json"), PACK_END_ID)


def op5_poisson_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its copies: the columns of ``documents`` and the copy's number."""
    return mixing.mix(read_warehouse(spark, folder, "documents"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(read_warehouse(spark, folder, "documents"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(read_warehouse(spark, folder, "documents"))


def op8_binary_records(spark: SparkSession, folder: str) -> DataFrame:
    out = records.new_folder(spark)
    records.write_records(
        read_warehouse(spark, folder, "documents"),
        out,
        vocabulary("word_bpe_49k.json"),
        RECORD_END_ID,
    )
    return records.read_records(spark, out)


def op9_tokeniser_fertility(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_warehouse(spark, folder, "documents")
    return fertility.quality(
        docs, vocabulary("piece_bpe_32k.model"), second=second_vocabulary()
    )


def op10_line_block_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_main_text(read_warehouse(spark, folder, "pages"))


def op11_overlapped_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_warehouse(spark, folder, "documents")
    return resample.importance_ranks(docs, read_warehouse(spark, folder, "benchmark"))


def op12_column_bwt(spark: SparkSession, folder: str) -> DataFrame:
    done = column_bwt.remove_repeated_bytes(read_warehouse(spark, folder, "documents"))
    return done.drop("kept")


def op13_ptolemaic_pivots(spark: SparkSession, folder: str) -> DataFrame:
    done = ptolemy.cluster_vectors(read_warehouse(spark, folder, "embeddings"))
    return done.drop("centroid")


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_host_segmentation,
        op2_fm_substrings,
        op3_disclosing_terms,
        op4_hilbert_packing,
        op5_poisson_mixing,
        op6_exact_dedup,
        op7_simhash,
        op8_binary_records,
        op9_tokeniser_fertility,
        op10_line_block_text,
        op11_overlapped_ngrams,
        op12_column_bwt,
        op13_ptolemaic_pivots,
    )
}

NORMALISED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

ORACLES: dict[str, str] = {
    "op5_poisson_mixing": mixing.ORACLE,
    "op6_exact_dedup": f"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256({NORMALISED}) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY {NORMALISED})
""",
    "op13_ptolemaic_pivots": ptolemy.oracle(),
}
