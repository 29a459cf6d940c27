"""From raw documents to packed training sequences: five stages, each written before the next reads it.

Each stage begins with executors that have returned the heap of the stages before.

Every stage takes an empty table to an empty one, keeps columns that it does not know, and gives null rows the result
that its function names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilsift.llm.common import durable, scratch_dir, settle, table, temporary
from veilsift.llm.dedup import one_of_each
from veilsift.llm.mixing import mixed_documents
from veilsift.llm.packing import packed
from veilsift.llm.quality import kept_documents
from veilsift.llm.queries import END_ID, TOKENIZER
from veilsift.llm.toxicity import clean_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine calls toxic go; null texts are empty and stay, repeated rows share a verdict."""
    settle(spark)
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules (null texts do) or lie outside their language and source go; repeated rows share a verdict."""
    settle(spark)
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: of ties the least doc_id, null ids last; repeated rows are copies."""
    settle(spark)
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight: a document comes as often as the mix takes it, up to three times. Texts without words are not taken."""
    settle(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a null text is its end token, repeated rows are packed each."""
    settle(spark)
    return packed(docs, public_tokenizers.path(TOKENIZER), END_ID, cache_words=CACHE_WORDS, keep_cache=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mixing),
    ("packing", packing),
]

#: Words whose token ids a worker keeps: four other stages' workers share the executor.
CACHE_WORDS = 200_000

#: Packing depends on the tokenizer, which SQL does not have.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        written = scratch_dir(spark)
        with temporary(spark):  # what a stage writes on its way goes with it
            docs = durable(stage(spark, docs, sf_dir), written)
    return STAGES[-1][1](spark, docs, sf_dir)
