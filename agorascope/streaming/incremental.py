"""The counting operators over streams of posts.

The surveyed toolkit is batch only; these apply its counts to posts as they arrive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, word_tokens


def token_counts(posts: DataFrame, text: str = "text", tokenizer: Tokenizer = word_tokens) -> DataFrame:
    """(token, n) over all posts so far; for the complete and update output modes. State is one row a token."""
    return posts.select(F.explode(tokenizer(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def windowed_label_counts(posts: DataFrame, at: str, label: Column, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, label, n) of tumbling windows; rows later than ``late`` behind the watermark are left out, so state is bounded."""
    found = posts.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width).alias("w"), label.alias("label")).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), "label", "n")


def each_batch(operator: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that applies a batch operator to each micro-batch and writes it to a folder of its own number,
    so that a batch that is tried again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
