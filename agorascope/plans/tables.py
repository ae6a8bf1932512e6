"""The driver's tables in the roles of a forum's: documents as posts, conversations as threads, and small dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a table is read in fewer parts than there are; greater tables stay as they are read."""
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if parts < cores else df


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, tokens) of all documents, in whatever language"""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("doc"), word_tokens(F.col("text")).alias("tokens"))


def word_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, item), distinct. Documents are dealt by their ids before their words become rows, so that neither making the rows distinct
    nor gathering a document's again shuffles a row a word."""
    return words(spark, sf_dir).select("doc", F.array_distinct("tokens").alias("_t")).repartition("doc").select("doc", F.explode("_t").alias("item"))


#: The surveyed toolkit's least supports: of itemsets in general, and of pairs with a marked item.
LEAST, MARKED_LEAST = 20, 10

_SPLIT = "string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')"
#: Documents' distinct tokens, and all their tokens.
ITEMS = f"items AS (SELECT DISTINCT doc, item FROM (SELECT doc_id AS doc, unnest({_SPLIT}) AS item FROM documents) WHERE item <> '')"
TOKENS = f"""tokens AS (SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY i) - 1 AS INTEGER) AS pos, token FROM (
  SELECT doc_id AS doc, unnest({_SPLIT}) AS token, generate_subscripts({_SPLIT}, 1) AS i
  FROM documents) WHERE token <> '')"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text)"""
    return table(spark, sf_dir, "conversations")


#: A small dictionary for matching: group, then its forms; the first is its name.
ENTITIES = [(1, "the"), (1, "of"), (2, "and"), (3, "er"), (4, "th"), (4, "in"), (5, "on")]


def dictionary(spark: SparkSession) -> DataFrame:
    seen: dict[int, int] = {}
    rows = []
    for group, form in ENTITIES:
        rows.append((group, seen.get(group, 0), form))
        seen[group] = seen.get(group, 0) + 1
    return spark.createDataFrame(rows, "group_id int, pos int, form string")


def entities_sql(text: str) -> str:
    """The list of groups whose forms begin in ``text``, in dictionary order, by tests that RE2 has. A form begins at
    the start, after a stop, blank, line end or question mark, or after a sign that is no cased letter."""
    hits = ", ".join(f"CASE WHEN regexp_matches({text}, '(?i)(^|[. \\n?]|[^\\p{{Ll}}\\p{{Lu}}]){form}') THEN {group} END" for group, form in ENTITIES)
    return f"[{hits}]"
