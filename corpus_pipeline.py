"""From raw documents to packed sequences, in five stages, each of which works on what its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; n_chars follows the text.

1. quality: documents that importance resampling doesn't select go; the target model learns from labels.
2. lines: repeated passages of at least two lines go but for their first occurrence; the documents stay.
3. near_duplicates: one document of each group stays, the one with the smallest id.
4. personal_data: spans are replaced by their kind in brackets.
5. packing: the documents' pieces in sequences of at most 2048 tokens.

Every stage takes texts of any length whole and an empty table, and keeps the input's columns, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorascope.llm import line_dedup, ngram_join, packing, pii, quality
from agorascope.llm.common import Steps
from agorascope.llm.queries import vocabulary


def as_documents(df: DataFrame, like: DataFrame) -> DataFrame:
    out = df.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in like.columns else df
    return out.select(*like.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have weight 0 and rank by their draw; without good labels all documents stay; of rows that tie
    at the last place as many stay as there is room for."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.resample(docs, labels).where("selected").select(*docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text stays null; an empty one is a single line and stays; a document whose lines all stood before becomes
    empty but stays; rows with equal id and text are one occurrence and keep or lose the same lines."""
    return as_documents(line_dedup.line_dedup(docs), docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and blank texts are near nothing and stay; of rows with equal ids and texts one stays; a null id is the
    smallest."""
    return ngram_join.drop_near_duplicates(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts stay as they are; spans that overlap are replaced together; equal texts get equal results."""
    return as_documents(pii.redact(docs), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are their end id alone; equal rows are packed as often as they occur."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: The quality, near-duplicate, personal-data and packing stages can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's documents are written to the shared folder and read again."""
    steps = Steps(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = steps.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
