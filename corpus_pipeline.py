"""A corpus pipeline: toxicity, quality rules, near duplicates, benchmark decontamination, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last
return the columns of documents. A stage's result is a table in the shared folder before the next one reads
it, so a lost executor costs tasks, not stages. Nulls and odd rows are treated as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm import decontaminate, neardup, pieces, quality, toxicity
from turnloom.llm.common import table, written

#: Bands and rows for a similarity of 0.8: a pair at 0.8 shares no band with probability 1e-7.
BANDS, ROWS = 30, 4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score as toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail the base rules, or of sources whose failure rate rejects them."""
    return quality.keep_good(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.keep_one(docs, size=5, percent=80, bands=BANDS, rows=ROWS)


def strip_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without spans of benchmark phrases."""
    return decontaminate.strip(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids in place of texts."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", strip_benchmark),
    ("sentencepiece", encode),
]

#: The first stage is a trained model, which SQL can't state: tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
