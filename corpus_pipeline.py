"""A corpus from raw documents to packed sequences: each stage reads what the one before it wrote.

Every stage takes documents with COLUMNS; further columns are ignored, an empty table gives an empty one. A null text
counts as empty: the rules reject it, as any text under 50 words. Rows with a null doc_id are judged like others and meet
no copies. Rows of one doc_id go and stay together in near_dedup; elsewhere each is judged by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import SPACE, many_executions, sized_join, stored, table
from mnemospark.llm.line_dedup import line_dedup
from mnemospark.llm.minhash import near_duplicates
from mnemospark.llm.packing import pack
from mnemospark.llm.quality_classifier import quality_scores
from mnemospark.llm.quality_rules import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good: score 0.5 or more. It learns from the labelled ones among docs."""
    scored = quality_scores(docs, table(spark, sf_dir, "labels"))
    return _as_documents(scored.where("score >= 0.5"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base test nor a learned rule rejects. Most of what is labelled bad has gone by now, so
    the rules are learned from the labelled ones of all documents."""
    judged = quality_rules(docs, table(spark, sf_dir, "labels"), train=table(spark, sf_dir, "documents"))
    return _as_documents(judged.where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; those that have no word left go. n_chars is the new text's."""
    cleaned = line_dedup(docs)
    left = cleaned.where(F.col("removed_lines").eqNullSafe(0) | F.col("text").rlike(f"[^{SPACE}]"))
    return _as_documents(left.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    gone = stored(near_duplicates(docs).where("NOT kept").select("doc_id").distinct())
    return _as_documents(sized_join(docs, gone, "doc_id", "left_anti"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 2048 ids."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("packing", packing),
]

#: The first stages learn models; SQL has no words for that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    with many_executions(spark):
        for _, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
