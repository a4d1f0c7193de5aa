"""A training-data pipeline over ``documents``: judge, deduplicate, decontaminate, redact, tokenize."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pavement.llm import bpe, decontaminate, neardup, pii, quality
from pavement.llm.columns import table
from pavement.plans.storage import written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; rejected ones (and those without words) go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.good_documents(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 5-word shingles, Jaccard of 0.8 or more."""
    return neardup.one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that stand in a benchmark item; n_chars follows the text."""
    clean = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), remove="spans")
    return _counted(clean)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    return _counted(pii.redacted(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document (little-endian unsigned 32-bit), their number, and digests of ids and decoded bytes."""
    path = public_tokenizers.path(VOCABULARY)
    found, name = bpe.token_columns(docs, path, public_tokenizers.PATTERN, ids=True)
    return found.select("doc_id", f"{name}.*")


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                           .otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: A trained classifier and merge replay are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
