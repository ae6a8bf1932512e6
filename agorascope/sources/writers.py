"""Writers for the forum toolkit's file formats. Each writes a folder of part files, in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import korean


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", sep: str = ",") -> None:
    if encoding.upper() not in ("UTF-8", "UTF8"):
        korean(df.sparkSession)
    df.write.option("encoding", encoding).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def write_lists(df: DataFrame, path: str, column: str, sep: str = " ") -> None:
    """One joined array a line."""
    df.select(F.array_join(F.col(column).cast("array<string>"), sep).alias("value")).write.text(path)


def cluster_lists(items: DataFrame, cluster: str = "cluster_id", item: str = "item", least: int = 2) -> DataFrame:
    """(cluster, items in order) of clusters with at least ``least`` items."""
    return items.groupBy(cluster).agg(F.sort_array(F.collect_list(item)).alias("items")).where(F.size("items") >= least)


def write_clusters(items: DataFrame, path: str, least: int = 2) -> None:
    """Lines "cluster item item ..."."""
    found = cluster_lists(items, least=least)
    found.select(F.concat_ws(" ", F.col("cluster_id").cast("string"), F.col("items").cast("array<string>")).alias("value")).write.text(path)


def cluster_report(items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Readable clusters: (cluster_id, n, words)."""
    named = items.join(vocabulary, F.col("item") == F.col("idx"))
    return named.groupBy("cluster_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("word")), " ").alias("words"))


def write_affinity(lifts: DataFrame, vocabulary: DataFrame, entities: DataFrame, path: str) -> None:
    """Lines entity, comma-separated words, lift by name; lifts (a: entity item, b: word item, lift)."""
    names = vocabulary.select(F.col("idx").alias("b"), "word")
    first = entities.where("pos = 0").select(F.col("group_id").alias("a"), "form")
    found = lifts.join(names, "b").join(first, "a").groupBy("form", "lift").agg(F.array_join(F.sort_array(F.collect_list("word")), ",").alias("words"))
    write_csv(found.select("form", "words", "lift"), path, sep="\t")


def write_by_label(df: DataFrame, path: str, label: str = "label") -> None:
    """A folder for each label."""
    df.write.partitionBy(label).option("quote", '"').option("escape", '"').csv(path)


def write_cases(cases: DataFrame, path: str) -> None:
    """Cases (thread_id, entities, target, context) as one table; a file a case does not scale."""
    cases.write.parquet(path)


def cluster_counts(items: DataFrame) -> DataFrame:
    """(n_clusters, n_several): all clusters, and those with more than one item."""
    sizes = items.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_clusters"), F.count_if(F.col("n") > 1).alias("n_several"))
