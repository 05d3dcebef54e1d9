"""A training corpus in five stages, each over all that the one before has kept.

Language identification drops documents of no recognisable language, the shingle join keeps one
document of each group of near copies, decontamination drops documents that hold a benchmark window,
the secret scan masks what it finds, and packing cuts the rest into token sequences. Every stage but
the last returns the columns of `documents`; its result is written, and read again by the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import decontamination, jaccard, language, packing, secrets
from faultline.llm.common import materialize, table


#: Rows sent to Python at a time: some megabytes of texts, as a row may go with all its columns.
BATCH_ROWS = 1_000
#: Words whose ids a worker keeps while it packs: it shares the executor's memory with what earlier stages have taken.
KEEP_WORDS = 200_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def few_at_a_time(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`stage`, of which few texts at a time are between Spark and Python, so that tasks stay small.

    The session keeps that setting, because the stage's tasks run when its result is used: it is not
    written here, as every stage's result is written once by the one who asks for it.
    """
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = int(spark.conf.get(BATCH_SETTING))
        spark.conf.set(BATCH_SETTING, str(min(BATCH_ROWS, before) if before > 0 else BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@few_at_a_time
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language.keep_identified(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group that links of 80 percent of five-word shingles connect."""
    return jaccard.keep_one(docs, percent=80, words=5)


@few_at_a_time
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@few_at_a_time
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each secret in its place and n_chars set anew where one was."""
    return secrets.redact_secrets(docs)


@few_at_a_time
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, packing.default_tokenizer(), keep_words=KEEP_WORDS)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: Trained models and a tokenizer are not expressible in SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of `documents`, through all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
