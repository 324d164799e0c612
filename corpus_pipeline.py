"""A training corpus from raw documents: filter, de-duplicate, mask, mix, pack.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; ``run`` writes and rereads the documents between stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import minhash_forest, mixing, packing, pii, toxicity
from sparkwarden.llm.common import cut, held_out, table, unused
from sparkwarden.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; null and empty texts stay; without labels all do."""
    model = toxicity.train(docs.where(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    (score,) = unused(docs, "_toxicity")
    return toxicity.with_score(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8), told apart by id and text; texts without words stay."""
    return minhash_forest.one_of_each(docs).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.mask(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights of their sources; a null source is one source, and an
    empty table stays empty."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece; a null text is the piece of its end mark alone, and an empty table gives none."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs


#: Trained stages and sequence numbers are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
