"""Written steps for iterative operators, joins with hot keys, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of our own only where that is unset and Spark is one process.
    On a cluster a local folder would be another one on each executor, so the setting is asked for."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="agorascope-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Steps:
    """Tables written under the shared checkpoint folder, so that a lost executor costs no lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._step_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Frees a table that no later step reads."""
        path = getattr(df, "_step_path", None)
        if path:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column | str, n: str, most: int = 1_000, salts: int = 64) -> DataFrame:
    """Inner join with a side that has one row a key, whose ``n`` is the number of rows of ``left`` with that key.

    The ``most`` keys with the greatest n are dealt to ``salts`` tasks each by a hash of ``spread``; any other key has
    less than one part in ``most`` of the rows. What is sent to every task are these keys.
    """
    hot = F.broadcast(right.orderBy(F.desc(n), *keys).limit(most).select(*keys, F.lit(True).alias("_hot")))
    dealt = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(F.lit(3), spread), F.lit(salts)).cast("int")).otherwise(0))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    found = right.join(hot, keys, "left").withColumn("_salt", F.explode(copies))
    return dealt.drop("_hot").join(found.drop("_hot"), [*keys, "_salt"]).drop("_salt")


def components(steps: Steps, edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): one row (node, root) for each node that is not its component's smallest.

    Alternating large-star and small-star rounds; each round is written, and the loop ends when the edges are stars.
    Nodes with many edges are salted. Nothing is collected but two counts a round. Edges of a node to itself are ignored.
    """
    e = steps.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        several = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        chained = 0 if several else e.join(e.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").limit(1).count()
        if not several and not chained:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = salted_join(both, least, ["u"], "v", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = salted_join(large, low, ["u"], "v", "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = steps.save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        steps.drop(e)
        e = after
