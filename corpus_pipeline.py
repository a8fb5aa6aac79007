"""A training-data corpus from ``documents``: what the classifier accepts, without repeated passages and near-duplicates,
mixed to target weights and packed into sequences.

Each stage takes all that the stage before it kept, written as Parquet. All but the last return the columns of
``documents``; n_chars follows the text where a stage changes it. Documents of which line dedup leaves nothing go.
SQL can't express the stages, so they are tested against plain versions instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import read, written
from factorloom.llm.line_dedup import dedup_lines
from factorloom.llm.mixing import mix_documents
from factorloom.llm.packing import pack_documents
from factorloom.llm.quality import drop_low_quality
from factorloom.llm.setsketch import drop_near_duplicates


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more. Null and empty texts are scored as texts without words; repeated rows get equal
    scores; where labels can't be learnt from, all scores are 0.5 and all documents stay; an empty table stays empty."""
    return drop_low_quality(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Texts without runs of words that occurred in an earlier document. Documents of which no word is left go; all others stay with
    what is left of them. Null, empty and blank texts lose nothing and stay; rows alike in id and text are one document;
    n_chars follows the text."""
    found = dedup_lines(docs)
    emptied = (F.col("n_deleted") > 0) & (F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")) == "")
    length = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.filter(~emptied | F.col("text").isNull()).withColumn("n_chars", length).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the least id. Documents are compared as they are and as they
    were before passages were cut, since a copy that was cut no longer resembles what it was copied from. Documents
    without words all stay; of rows alike in id and text one stays; null ids stay only where a group has no other."""
    return drop_near_duplicates(docs, shingle=5, percent=80, whole=read(spark, sf_dir, "documents"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Documents as often as the mix takes them (0 to 2 times). A null source is one of its own; documents without words have
    size 0 and go as often as their place among equals says; an empty table stays empty."""
    return mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """A row for each piece of each document, repetitions too, with its sequence and offset. Null and empty texts are one
    token; null ids stay null; an empty table stays empty."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
