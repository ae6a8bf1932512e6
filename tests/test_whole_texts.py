"""Queries read whole texts, not their first words."""

from agorascope.plans import vector_queries


def test_arguments_late_in_a_turn(spark, tmp_path):
    rows = [(1, 0, "user", "of " + "b " * 20 + "tree egg"), (1, 1, "user", "of " + "b " * 20)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["turn"]: (r["complete"], r["open"]) for r in vector_queries.scf_complete(spark, str(tmp_path)).collect()}
    assert got[0] == (True, "") and got[1][1] != ""


def test_classifier_learns_from_late_words(spark, tmp_path):
    docs = [(i, "same " * 100 + ("good" if i % 2 else "bad")) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [r["accuracy"] for r in vector_queries.sentiment_lr(spark, str(tmp_path)).collect()] == [1.0, 1.0]
