"""The corpus pipeline: five stages from raw documents to tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each to the
shared folder and gives what it reads back to the next. All but the last return the columns
of documents, in their order, and pass columns of any other name through. An empty table
gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catchment.llm import bpe, decontam, langid, minhash, pii
from catchment.llm.common import stored, table
from catchment.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language stay; those without text or any letter, or of which
    no language is likely, go. Each row is judged by its own text, repeated ones and those
    without doc_id too; the model learns from docs where text and lang are not null."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar sets of five-word shingles (0.8 or more) the one with
    the smallest doc_id stays, of rows that repeat it one. Rows without doc_id, and texts that
    are null or without words, stay."""
    return minhash.keep_first(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or all of a shorter one)
    go. Each row is judged by its own text; rows without text stay."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced; all rows stay, n_chars follows the text."""
    return pii.sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids of each row; a null text
    has none."""
    return bpe.encode_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Naive Bayes, MinHash and BPE can't be put in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
