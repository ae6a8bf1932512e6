"""Odd tables through every operator and every stage: nulls, empty and long texts, repeats, no rows, clashing names."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from agorascope.llm import ann_forest, divergence, embed_dedup, line_dedup, merge_dropout, mixing, ngram_join, packing, pii, quality, target_sampling, token_count, toxicity

PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
CLASHES = ["n_lines", "spans", "score", "ids", "n_tokens", "length", "offset", "node", "key", "digest", "log_weight", "selected", "size", "rank", "toxic", "quality", "h", "held_out"]
LONG = " ".join(f"token{i % 977} and" for i in range(8_000))


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta\nsecond line here\nthird"), (2, None), (3, ""), (None, "no id a@b.cd"), (1, "alpha beta gamma delta epsilon zeta\nsecond line here\nthird"), (4, LONG), (5, "\n\n\n"), (6, "\x00 ▁ ퟿ 😀"), (None, None), (7, "alpha beta gamma delta epsilon zeta\nsecond line here\nthird")]
    return documents(spark, [(i, t, None, None, None) for i, t in rows])


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, 0, 0), (None, 1, 1), (99, None, None), (7, 1, 1), (3, 1, 7), (5, 0, -1)], "doc_id long, quality int, toxic int")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", *[F.lit("x").alias(c) for c in ("node", "size", "class", "row", "rank", "score", "key")])


TEXT = {
    "counts": (lambda d, l: token_count.token_counts(d, PIECES), 10),
    "lines": (lambda d, l: line_dedup.line_dedup(d), 10),
    "personal": (lambda d, l: pii.detect(d), 10),
    "redact": (lambda d, l: pii.redact(d), 10),
    "near": (lambda d, l: ngram_join.near_duplicates(d), 10),
    "kept": (lambda d, l: ngram_join.drop_near_duplicates(d), 8),
    "quality": (lambda d, l: quality.resample(d, l), 10),
    "dropout": (lambda d, l: merge_dropout.encode(d, PIECES), 10),
    "toxicity": (lambda d, l: toxicity.scores(d, l), 10),
    "divergence": (lambda d, l: divergence.audit(d), 0),
    "mixing": (lambda d, l: mixing.mix(d), 10),
    "target": (lambda d, l: target_sampling.resample(d, d.select("text")), 10),
}


@pytest.mark.parametrize("name", TEXT)
def test_odd_texts(odd, none, labels, name):
    run, rows = TEXT[name]
    assert len(run(odd, labels).collect()) == rows
    assert run(none, labels.limit(0)).collect() == []
    assert len(run(odd, labels.limit(0)).collect()) == rows


def test_a_text_of_megabytes(spark, labels):
    """Whole texts of any length: counts and pieces are those of the parts put together."""
    part = "alpha beta, gamma delta\nsome mail a@b.cd here " + " ".join(f"w{i}" for i in range(400)) + "\n"
    long = part * 1200
    docs = spark.createDataFrame([(1, long, None, None, None), (2, part, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    by = lambda df, *columns: {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}
    assert len(long) > 2 * 10**6
    counts = by(token_count.token_counts(docs, PIECES), "n_tokens")
    assert abs(counts[1][0] - 1200 * counts[2][0]) <= 1200
    assert by(merge_dropout.encode(docs, PIECES), "lossless") == {1: (True,), 2: (True,)}
    found = by(pii.detect(docs), "n_email", "n_ip")
    assert found == {1: (1200, 0), 2: (1, 0)}
    assert by(ngram_join.near_duplicates(docs), "n_links")[1][0] in (0, 1)
    pieces = packing.pack(docs, WORDS).where("doc_id = 1").collect()
    assert sum(r["length"] for r in pieces) > 1200 * 400 and all(r["length"] == 2048 for r in pieces if r["piece"] < len(pieces) - 1)
    lines = by(line_dedup.line_dedup(docs), "n_lines", "n_removed")
    assert lines[1][0] == 2401 and lines[2][1] in (0, 2)
    assert len(toxicity.scores(docs, labels).collect()) == len(quality.resample(docs, labels).collect()) == 2


def test_odd_texts_are_packed(odd, none):
    rows = packing.pack(odd, WORDS).collect()
    assert sum(r["piece"] == 0 for r in rows) == 10
    assert sorted(r["length"] for r in rows if r["doc_id"] in (2, 3)) == [1, 1]
    ids = {r["sequence_id"]: 0 for r in rows}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ids[r["sequence_id"]]
        ids[r["sequence_id"]] += r["length"]
    assert max(ids.values()) <= 2048
    assert packing.pack(none, WORDS).collect() == []


def test_defined_results(odd, labels):
    counts = token_count.token_counts(odd, PIECES).where("doc_id IN (2, 3)").collect()
    assert [(r["n_tokens"], r["score"]) for r in counts] == [(0, 0.0), (0, 0.0)]
    lines = line_dedup.line_dedup(odd).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert [tuple(r) for r in lines if r["doc_id"] == 2] == [(2, None, 0, 0)] and [tuple(r) for r in lines if r["doc_id"] == 3] == [(3, "", 1, 0)]
    first = [r for r in lines if r["doc_id"] == 1]
    assert len(first) == 2 and first[0] == first[1]  # equal rows give equal results
    near = {(r["doc_id"], r["n_links"]) for r in ngram_join.near_duplicates(odd).collect()}
    assert near == {(1, 2), (7, 2), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (None, 0)}
    blank = odd.withColumn("doc_id", F.when(F.col("doc_id") > 1, F.col("doc_id")))
    alone = {(r["doc_id"], r["n_links"], r["component_id"], r["kept"]) for r in ngram_join.near_duplicates(blank).where("n_links > 0").collect()}
    assert alone == {(None, 2, 7, False), (7, 2, 7, True)}
    dropout = {r["doc_id"]: (r["ids"], r["lossless"]) for r in merge_dropout.encode(odd, PIECES).where("doc_id IN (2, 3, 6)").collect()}
    assert dropout[2] == (None, None) and dropout[3] == ([], True) and dropout[6][1]
    toxic = toxicity.scores(odd, labels).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in toxic)
    assert [r["held_out"] for r in toxic if r["doc_id"] is None] == [False, False]
    weights = {r["doc_id"]: r["log_weight"] for r in quality.resample(odd, labels).collect()}
    assert weights[2] == weights[3] == 0.0


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (50, [1.0, 2.1], None), (100, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [1e30, 2e30], 0), (7, [1e-30, 2e-30], 0)]
    got = embed_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert sorted(r["n_links"] for r in got) == [0, 0, 0, 5, 5, 5, 5, 5, 5]
    linked = {r["vec_id"]: (r["component_id"], r["kept"]) for r in got}
    assert linked == {1: (1, True), None: (1, False), 50: (1, False), 6: (1, False), 7: (1, False), 100: (100, True), 4: (4, True), 5: (5, True)}
    near = ann_forest.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["query_id"], r["rank"]) for r in near) == [(50, k) for k in range(1, 6)]
    assert embed_dedup.near_duplicates(vectors(spark, [])).collect() == []
    assert ann_forest.nearest(vectors(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert ann_forest.nearest(vectors(spark, rows), F.lit(False)).collect() == []


def test_stages(spark, odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, docs in (("odd", odd), ("none", none)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
            out.write.parquet(f"{tmp_path}/{name}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{k}")


def test_pipeline_on_the_smallest_table(spark):
    p = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{p}/documents.parquet")
    rows = corpus_pipeline.run(spark, p).collect()
    names = {r["doc_id"] for r in rows}
    junk = {r["doc_id"] for r in spark.read.parquet(f"{p}/labels.parquet").where("quality = 0").collect()}
    assert len(names & junk) <= 0.3 * len(junk) and len(names) >= 0.7 * (docs.count() - len(junk))
    assert list(corpus_pipeline.STAGES[i][0] for i in range(5)) == ["quality", "lines", "near_duplicates", "personal_data", "packing"]
