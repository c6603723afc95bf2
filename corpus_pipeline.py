"""A training corpus from documents: toxic documents go, repeated lines go, one of each group of near duplicates stays,
personal data is masked, and what is left is packed into sequences.

Each stage is written as Parquet and read again as the next one's documents. All but the last return the columns
of documents; n_chars follows the text. Rows with null text or doc_id pass every filter: a null text is not toxic
and has no duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm import line_dedup, ngram_join, packing, pii, toxicity
from sigmill.llm.shared import partitions, table, unused, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "toxic_score")
    return toxicity.scored(docs, model, name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that an earlier one holds; those of which nothing is left go."""
    return line_dedup.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group that links at 0.8 on five-word shingles; empty ones are in no group.

    Rows that share a doc_id stay or go together."""
    near = ngram_join.join(docs, n=5, percent=80)
    name = unused(docs, "gone")
    gone = near.where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, 4 * partitions(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

#: The classifier, the alignment and the tokenizer are beyond SQL: the stages are tested against brute force instead.
ORACLE_SQL = None  # tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
