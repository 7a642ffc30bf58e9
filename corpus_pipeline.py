"""A corpus pipeline of five stages over documents; each stage is written as a table and read again by the next.

Every stage works on all rows that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltbed.llm import decontaminate, langid, mix, pii, simhash, similar
from siltbed.llm.common import cleared, delete_stored, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: und, and those whose best language has under half of the probability, go."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): that of the smallest doc_id."""
    return simhash.deduplicate(docs, similar.near_copies)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data and secrets replaced by surrogates; n_chars follows the text."""
    return pii.pseudonymise(docs).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("privacy", privacy),
    ("mixture", mixture),
]

#: The stages learn trees, decode codes and solve knapsacks, which SQL can't express; tests/llm checks run() otherwise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Only its table is left in the shared folder: each stage's scratch tables go with its end, and
    its table once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with cleared(spark):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if before is not None:
            delete_stored(before)
        before = docs
    return docs
