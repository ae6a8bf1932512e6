import sqlite3
import struct

from pyspark.sql import functions as F

from agorascope.sources import readers as R
from agorascope.sources import writers as W


def test_korean_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("제목", "본문\n둘째 줄"), ('인용 "말"', "끝")], "a string, b string")
    for name in ("EUC-KR", "MS949", "UTF-8"):
        path = str(tmp_path / name)
        W.write_csv(rows, path, encoding=name) if name != "EUC-KR" else None
        if name == "EUC-KR":
            import os

            os.makedirs(path)
            with open(f"{path}/x.csv", "w", encoding="euc-kr", newline="") as f:
                f.write('"제목","본문\n둘째 줄"\n"인용 ""말""","끝"\n')
        got = R.read_csv(spark, path, ["a", "b"], encoding=name)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_lines_and_lists(spark, tmp_path):
    (tmp_path / "docs.txt").write_text("3 1 3\n2\n\n5 4\n")
    docs = R.read_docs(spark, str(tmp_path / "docs.txt")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["items"]) for r in docs] == [(0, [1, 3]), (1, [2]), (3, [4, 5])]
    assert R.read_docs(spark, str(tmp_path / "docs.txt"), first=1).count() == 1
    (tmp_path / "bad.txt").write_text("3 -1\n")
    try:
        R.read_docs(spark, str(tmp_path / "bad.txt")).collect()
        raise AssertionError("a negative number was accepted")
    except Exception as e:
        assert "positive" in str(e)


def test_embeddings(spark, tmp_path):
    (tmp_path / "e.txt").write_text("2 3\nword 1 2 3\nother 4 5 6\nbroken 1 2\n")
    assert {r["word"]: r["vector"] for r in R.read_embeddings(spark, str(tmp_path / "e.txt")).collect()} == {"word": [1, 2, 3], "other": [4, 5, 6]}
    (tmp_path / "e.bin").write_bytes(b"2 2\nab " + struct.pack("<2f", 1, 2) + b"\nc " + struct.pack("<2f", 3, 4) + b"\n")
    assert {r["word"]: r["vector"] for r in R.read_word2vec_binary(spark, str(tmp_path / "e.bin")).collect()} == {"ab": [1, 2], "c": [3, 4]}


def test_dictionary_clusters_and_affinity(spark, tmp_path):
    (tmp_path / "d.txt").write_text("1\tSM5\tsm 5\n2\tK5\n")
    forms = R.read_entities(spark, str(tmp_path / "d.txt"))
    assert {(r["group_id"], r["pos"], r["form"]) for r in forms.collect()} == {(1, 0, "sm5"), (1, 1, "sm 5"), (2, 0, "k5")}
    assert R.read_entities(spark, str(tmp_path / "d.txt"), max_form=1).count() == 2
    (tmp_path / "a.txt").write_text("SM5\tx,y\t2.5\nsm 5\tx\t3.0\n")
    got = {(r["group_id"], r["word"]): r["lift"] for r in R.read_affinity(spark, str(tmp_path / "a.txt"), forms).collect()}
    assert got == {(1, "x"): 3.0, (1, "y"): 2.5}
    (tmp_path / "c.txt").write_text("7 1 2\n8 3\n")
    clusters = R.read_clusters(spark, str(tmp_path / "c.txt"))
    assert {(r["item"], r["cluster_id"]) for r in clusters.collect()} == {(1, 7), (2, 7), (3, 8)}
    W.write_clusters(clusters, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["7 1 2"]


def test_cases(spark, tmp_path):
    folder = tmp_path / "cases"
    folder.mkdir()
    (folder / "case1.txt").write_text("12\nSM5,K5\n1\n좋다\n2\n첫째\n둘째\n1\n셋째\n", encoding="euc-kr")
    (folder / "case2.txt").write_text("13\n-\n1\nx\n", encoding="euc-kr")
    got = {r["thread_id"]: (r["entities"], r["target"], r["context"]) for r in R.read_cases(spark, str(folder), "EUC-KR").collect()}
    assert got == {12: (["SM5", "K5"], "좋다", ["첫째\n둘째", "셋째"]), 13: ([], "x", [])}


def test_articles_drop_what_does_not_parse(spark, tmp_path):
    (tmp_path / "a.csv").write_text('5,t,c,au,tag,11,22,d,t,0,"a/b|c"\n5,t,c,au,tag,x,22,d,t,0,a\nshort,row\n')
    got = R.read_articles(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["article_id"], r["tokens"]) for r in got] == [(11, [["a", "b"], ["c"]])]
    assert R.short_records(spark, str(tmp_path / "a.csv")).count() == 1


def test_sqlite_and_maxent(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(1, "x"), (2, None)])
    got = R.read_sqlite(spark, str(tmp_path / "x.db"), "t", ["a", "b"])
    assert sorted(map(tuple, got.collect())) == [("1", "x"), ("2", None)]
    (tmp_path / "z.train").write_text("y1 a0 b3\n")
    r = R.read_maxent(spark, str(tmp_path / "z.train")).first()
    assert (r["label"], r["features"]) == (1, [0, 3])
    labels = spark.createDataFrame([("1", "0"), ("2", "1")], "corpus_id string, label string")
    corpus = spark.createDataFrame([("1", "c1"), ("2", "c2")], "id string, content string")
    assert [r["content"] for r in R.read_agreement(spark, labels, corpus, "1").collect()] == ["c2"]
    W.write_by_label(labels, str(tmp_path / "by"))
    assert spark.read.csv(str(tmp_path / "by")).select(F.col("label")).distinct().count() == 2


def test_lists_relations_and_pairs(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("5\ta\n6\tb\n")
    assert {(r["idx"], r["word"]) for r in R.read_vocabulary(spark, str(tmp_path / "v.tsv"), offset=10).collect()} == {(15, "a"), (16, "b")}
    (tmp_path / "L2.txt").write_text("2\t1\n1\t2\n3\t4\n")
    assert sorted(r["items"] for r in R.read_itemsets(spark, str(tmp_path / "L2.txt")).collect()) == [[1, 2], [3, 4]]
    (tmp_path / "r.csv").write_text("1,2,0,0\n1,3,1,2\n")
    assert sorted(map(tuple, R.read_relations(spark, str(tmp_path / "r.csv")).collect())) == [(1, 2, 0, 0), (1, 3, 1, 2)]
    (tmp_path / "p.txt").write_text("target-context-more\nalone\n")
    assert sorted((r["target"], r["context"]) for r in R.read_pairs(spark, str(tmp_path / "p.txt")).fillna("none").collect()) == [("alone", "none"), ("target", "context-more")]
    (tmp_path / "k.txt").write_bytes(" 첫째 \r\n\r\n둘째\n".encode("euc-kr"))
    assert [r["value"] for r in R.read_lines(spark, str(tmp_path / "k.txt"), "EUC-KR").collect()] == ["첫째", "둘째"]
    (tmp_path / "u.txt").write_text(" x \n\ny\n")
    assert [r["value"] for r in R.read_lines(spark, str(tmp_path / "u.txt")).collect()] == ["x", "y"]
    found = R.lines(spark, str(tmp_path / "u.txt"))
    assert [r["value"] for r in R.between_lines(found, 1).orderBy("line_no").collect()] == ["", "y"] and R.between_lines(found, 0, 1).count() == 1


def test_sentence_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text('1,2,3,"a, b","SM5, K5",me\n2,2,3,c,-,me\n')
    got = {r["sentence_id"]: r["label"] for r in R.read_sentence_labels(spark, str(tmp_path / "l.csv")).collect()}
    assert got == {1: ["SM5", "K5"], 2: []}
    rows = spark.createDataFrame([(1, 0), (2, 1)], "article_id long, text_type int")
    assert [r["article_id"] for r in R.posts_only(rows).collect()] == [1]


def test_word_network(spark, tmp_path):
    from agorascope.operators import frames

    for name, text in (("w", "10,차\n11,사람\n12,모름\n"), ("s", "1,100,car,n,200_x\n2,200,vehicle,n,\n3,300,person,n,\n"), ("t", "1,1,-,10,-,-,자동차\n2,2,-,99,-,-,운송 수단\n3,3,-,11,-,-,인간\n")):
        (tmp_path / name).write_bytes(text.encode("euc-kr"))
    words, translations, synsets = R.read_categories(spark, *(str(tmp_path / n) for n in "wst"))
    got = {r["word"]: r["tags"] for r in frames.categories(words, translations, synsets).collect()}
    assert got == {"차": ["car 자동차", "vehicle 운송 수단"], "사람": ["person 인간"]}
    tokens = spark.createDataFrame([(1, 0, "차"), (1, 1, "없음")], "id long, pos long, word string")
    r = frames.sentences_tagged(tokens, frames.categories(words, translations, synsets), "id").first()
    assert [(t["word"], t["tags"]) for t in r["tokens"]] == [("차", ["car 자동차", "vehicle 운송 수단"]), ("없음", None)]


def test_toy_sets_and_stored_tables(spark, tmp_path):
    (tmp_path / "n.csv").write_text("1,2.5,0\n3,4,1\n")
    assert [(r["features"], r["label"]) for r in R.read_numbers(spark, str(tmp_path / "n.csv")).collect()] == [([1.0, 2.5], 0), ([3.0, 4.0], 1)]
    (tmp_path / "pos").write_text("good\n")
    (tmp_path / "neg").write_text("bad\nworse\n")
    assert sorted(map(tuple, R.read_polarity(spark, str(tmp_path / "pos"), str(tmp_path / "neg")).collect())) == [("bad", 0), ("good", 1), ("worse", 0)]
    made = []
    build = lambda: made.append(1) or spark.range(3)
    assert R.stored(spark, str(tmp_path / "kept"), build).count() == R.stored(spark, str(tmp_path / "kept"), build).count() == 3 and len(made) == 1


def test_reports(spark, tmp_path):
    items = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "item int, cluster_id int")
    words = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c")], "idx int, word string")
    assert {r["cluster_id"]: (r["n"], r["words"]) for r in W.cluster_report(items, words).collect()} == {7: (2, "a b"), 8: (1, "c")}
    assert tuple(W.cluster_counts(items).first()) == (2, 1)
    W.write_lists(spark.createDataFrame([([3, 1],)], "x array<int>"), str(tmp_path / "lists"), "x")
    W.write_lines(spark.createDataFrame([(5,)], "value int"), str(tmp_path / "lines"))
    assert [r["value"] for p in ("lists", "lines") for r in spark.read.text(str(tmp_path / p)).collect()] == ["3 1", "5"]
    lifts = spark.createDataFrame([(1, 5, 2.0), (1, 6, 2.0)], "a int, b int, lift double")
    forms = spark.createDataFrame([(1, 0, "sm5"), (1, 1, "sm 5")], "group_id int, pos int, form string")
    W.write_affinity(lifts, spark.createDataFrame([(5, "y"), (6, "x")], "idx int, word string"), forms, str(tmp_path / "aff"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "aff")).collect()] == ["sm5\tx,y\t2.0"]
    got = {(r["group_id"], r["word"]): r["lift"] for r in R.read_affinity(spark, str(tmp_path / "aff"), forms).collect()}
    assert got == {(1, "x"): 2.0, (1, "y"): 2.0}
    W.write_cases(spark.createDataFrame([(1, ["a"], "t", ["c"])], "thread_id long, entities array<string>, target string, context array<string>"), str(tmp_path / "cases"))
    assert spark.read.parquet(str(tmp_path / "cases")).count() == 1
