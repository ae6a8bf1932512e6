"""Joining and cleaning annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last by ``order``."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def labelled(labels: DataFrame, corpus: DataFrame, key: str, label_order: str, corpus_order: str) -> DataFrame:
    """Labels with their text, each id's last label and last text."""
    return last_by(labels, key, label_order).join(last_by(corpus, key, corpus_order), key)


def with_articles(labels: DataFrame, articles: DataFrame, keys: tuple[str, ...] = ("thread_id", "article_id")) -> DataFrame:
    """Equi join on the composite post identity; the optimizer chooses the side to send around."""
    return labels.join(articles, [*keys])


def unanimous(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, n) of keys whose labels all agree."""
    found = labels.groupBy(key).agg(F.min(label).alias("label"), F.max(label).alias("_most"), F.count("*").alias("n"))
    return found.where(F.col("label") == F.col("_most")).drop("_most")


def sentiment_only(labels: DataFrame, label: str = "label", known: tuple[str, ...] = ("1", "2", "3")) -> DataFrame:
    return labels.where(F.col(label).isin(*known))


def label_counts(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.groupBy(label).agg(F.count("*").alias("n"))


def recoded(label: Column, neutral: bool = True) -> Column:
    """1 and 3 as positive and negative, 2 as neutral or nothing."""
    return F.when(label == "1", "positive").when(label == "3", "negative").when(F.lit(neutral) & (label == "2"), "neutral")


def parent_pairs(labels: DataFrame, edges: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """(parent_label, child_label, *on): a labelled post and the labelled post it answers, with equal ``on``.

    edges: the child's keys and the parent's with the prefix parent_; a post is never its own parent."""
    child = labels.select(*keys, *on, F.col("label").alias("child_label"))
    parent = labels.select(*[F.col(k).alias(f"parent_{k}") for k in keys], *on, F.col("label").alias("parent_label"))
    same = None
    for k in keys:
        same = (F.col(k) == F.col(f"parent_{k}")) if same is None else same & (F.col(k) == F.col(f"parent_{k}"))
    return edges.where(~same).join(child, keys).join(parent, [*[f"parent_{k}" for k in keys], *on])


def agreement(pairs: DataFrame) -> DataFrame:
    """(parent_label, n, agree, share): how often the child's label is the parent's."""
    agree = F.count_if(F.col("parent_label") == F.col("child_label"))
    return pairs.groupBy("parent_label").agg(F.count("*").alias("n"), agree.alias("agree"), (agree / F.count("*")).alias("share"))


def majority(labels: DataFrame, keys: list[str], label: str = "label", least: int = 4) -> DataFrame:
    """(*keys, label, n, total, share) of groups with at least ``least`` labels; ties go to the smaller label."""
    each = labels.groupBy(*keys, F.col(label).alias("label")).agg(F.count("*").alias("n"))
    best = each.groupBy(*keys).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("_b"))
    return best.where(F.col("total") >= least).select(*keys, F.col("_b.label").alias("label"), (-F.col("_b.m")).alias("n"), "total", (-F.col("_b.m") / F.col("total")).alias("share"))


def named_in_thread(posts: DataFrame, users: DataFrame, thread: str, text: str, user: str) -> DataFrame:
    """Posts with each of their thread's users whose name the text contains."""
    return posts.join(users.select(thread, F.col(user).alias("named")).distinct(), thread).where(F.contains(F.col(text), F.col("named")))


def success(rows: DataFrame, condition: Column) -> DataFrame:
    """(n, n_success, ratio)"""
    return rows.agg(F.count("*").alias("n"), F.count_if(condition).alias("n_success"), F.avg(condition.cast("double")).alias("ratio"))


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(truth, guess).agg(F.count("*").alias("n"))


def fold_summary(scores: DataFrame, score: str) -> DataFrame:
    """(average, deviation) over folds, the deviation of the whole population."""
    return scores.agg(F.avg(score).alias("average"), F.stddev_pop(score).alias("deviation"))


def regrouped(rows: DataFrame, thread: str, pos: str) -> DataFrame:
    """Rows with the position at which their thread begins, to be ordered by (begin, pos)."""
    return rows.withColumn("begin", F.min(pos).over(Window.partitionBy(thread)))


def estimate_summary(cases: DataFrame, gold: str, found: str) -> DataFrame:
    """(n, right, over, under, other): answers that equal the gold, hold more, hold less, or differ both ways."""
    more, less = F.size(F.array_except(found, gold)) > 0, F.size(F.array_except(gold, found)) > 0
    return cases.agg(F.count("*").alias("n"), F.count_if(~more & ~less).alias("right"), F.count_if(more & ~less).alias("over"), F.count_if(~more & less).alias("under"), F.count_if(more & less).alias("other"))
