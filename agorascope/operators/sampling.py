"""Seeded orders, folds, splits and negative examples. All draws are hashes of keys, so they repeat on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import Steps
from .vocab import numbered


def draw(*keys: Column | str, seed: int = 0) -> Column:
    """An md5 hash in hex, the same in any engine, keyed by ``seed``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def shuffled(rows: DataFrame, *keys: str, seed: int = 0) -> DataFrame:
    return rows.orderBy(draw(*keys, seed=seed), *keys)


def split(rows: DataFrame, share: float, *keys: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A part of about ``share`` of the rows, and the rest."""
    part = F.conv(F.substring(draw(*keys, seed=seed), 1, 8), 16, 10).cast("double") / 4294967296.0 < share
    return rows.where(part), rows.where(~part)


def group_folds(rows: DataFrame, group: str, folds: int, seed: int = 0) -> DataFrame:
    """Rows with fold: whole groups dealt in turn in a seeded order. Groups are ranked, not rows."""
    order = Window.partitionBy("_part").orderBy("_draw", group)
    names = rows.select(group).distinct().withColumn("_draw", draw(group, seed=seed)).withColumn("_part", F.substring("_draw", 1, 2))
    sizes = names.groupBy("_part").agg(F.count("*").alias("_n"))  # at most 256 rows
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    dealt = names.join(F.broadcast(before), "_part").withColumn("fold", F.pmod(F.col("_before") + F.row_number().over(order) - 1, F.lit(folds)).cast("int"))
    return rows.join(dealt.select(group, "fold"), group)


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int, seed: int = 0) -> DataFrame:
    """Rows with fold: each label's rows dealt in turn in a seeded order."""
    order = Window.partitionBy(label, "_part").orderBy("_draw", key)
    each = rows.withColumn("_draw", draw(key, seed=seed)).withColumn("_part", F.substring("_draw", 1, 2))
    sizes = each.groupBy(label, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(label).alias("_label"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    dealt = each.join(starts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_p")))
    return dealt.withColumn("fold", F.pmod(F.col("_before") + F.row_number().over(order) - 1, F.lit(folds)).cast("int")).select(*rows.columns, "fold")


def negatives(left: DataFrame, right: DataFrame, positives: DataFrame, per: int = 1, seed: int = 0, rounds: int = 4) -> DataFrame:
    """(a, b): for each a of left ``per`` drawn b of right that are no positives (a, b), all different.

    The right side is numbered; each a draws numbers by a keyed hash, so what meets is one row a draw. Draws that hit a
    positive or an earlier draw are made again, ``rounds`` times; what is still missing then is taken from as many numbers in a
    row as must hold enough others. An a with fewer than ``per`` others gets all of them.
    """
    steps = Steps(left.sparkSession, "negatives")
    pool = steps.save(numbered(right.select("b").distinct(), "b", 0, "_rank"))
    n = pool.count()
    taken = steps.save(positives.select("a", "b").distinct())
    open_ = steps.save(left.select("a").distinct().withColumn("_need", F.lit(per)))
    out = None
    for k in range(rounds if n else 0):
        drawn = open_.select("a", "_need", F.explode(F.sequence(F.lit(1), F.col("_need"))).alias("_k"))
        drawn = drawn.withColumn("_rank", F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "a", "_k"), F.lit(n)))
        got = steps.save(drawn.join(pool, "_rank").select("a", "b").distinct().join(taken, ["a", "b"], "left_anti"))
        out = got if out is None else out.unionByName(got)
        taken = taken.unionByName(got)
        have = got.groupBy("a").agg(F.count("*").alias("_have"))
        open_ = steps.save(open_.join(have, "a", "left").select("a", (F.col("_need") - F.coalesce("_have", F.lit(0))).cast("int").alias("_need")).where("_need > 0"))
        if not open_.limit(1).count():
            return out
    # of as many numbers in a row as an a has taken, and those it needs, enough are free
    have = taken.join(open_.select("a"), "a", "left_semi").groupBy("a").agg(F.count("*").alias("_have"))
    probes = F.least(F.col("_need") + F.coalesce("_have", F.lit(0)), F.lit(n)).cast("int")
    rows = open_.join(have, "a", "left").select("a", "_need", F.explode(F.sequence(F.lit(1), probes)).alias("_k")) if n else open_.select("a", "_need", F.lit(0).alias("_k"))
    rest = rows.withColumn("_rank", F.pmod(F.xxhash64(F.lit(seed), "a") + F.col("_k"), F.lit(max(n, 1)))).join(pool, "_rank").join(taken, ["a", "b"], "left_anti")
    order = Window.partitionBy("a").orderBy(F.xxhash64(F.lit(seed), "a", "b"), "b")
    rest = rest.withColumn("_r", F.row_number().over(order)).where("_r <= _need").select("a", "b")
    return rest if out is None else out.unionByName(rest)


def best_epoch(scores: DataFrame, run: str, epoch: str, score: str) -> DataFrame:
    return scores.groupBy(run).agg(F.max_by(epoch, F.struct(F.col(score), -F.col(epoch))).alias(epoch), F.max(score).alias(score))
