from pyspark.sql import functions as F

from agorascope.functions.text import is_spam
from agorascope.streaming import incremental as I


def run(query):
    query.processAllAvailable()
    query.stop()


def test_counts_equal_the_batch(spark, tmp_path):
    posts = [("a b a",), ("b, c!",), (None,)]
    for k, post in enumerate(posts):
        spark.createDataFrame([post], "text string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run(I.token_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start())
    assert {r["token"]: r["n"] for r in spark.table("counts").collect()} == {"a": 2, "b": 2, "c": 1}


def test_windows_and_batches(spark, tmp_path):
    p = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{p}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{p}/events*.parquet")
    run(I.windowed_label_counts(stream, "ts", F.col("event_type"), "1 day", "400 days").writeStream.outputMode("update").format("memory").queryName("windows").start())
    got = {(r["start"], r["label"]): r["n"] for r in spark.table("windows").collect()}
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").count().select(F.col("w.start").alias("s"), "event_type", "count")
    assert got == {(r["s"], r["event_type"]): r["count"] for r in want.collect()}
    texts = spark.readStream.schema("text string").parquet(f"{p}/documents*.parquet")
    run(texts.writeStream.foreachBatch(I.each_batch(lambda b: b.where(is_spam(F.col("text"), ["!!"], [])), f"{tmp_path}/spam")).option("checkpointLocation", f"{tmp_path}/c").start())
    assert spark.read.parquet(f"{tmp_path}/spam").count() == spark.read.parquet(f"{p}/documents.parquet").where("contains(text, '!!')").count()
