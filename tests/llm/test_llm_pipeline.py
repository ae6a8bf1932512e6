"""Each stage of the pipeline against a plain version of it, on what its predecessor kept."""

import collections
import math
import zlib

import numpy as np
import public_tokenizers as P
import xxhash
from test_llm_passages import brute
from test_llm_text import base_spans, brute_links, judged_spans, plain_weights
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def selected(rows, labels):
    """Ids by the greatest weights with their draws."""
    good = {k for k, q in labels.items() if q == 1}
    keys = []
    for (k, t), w in zip(rows, plain_weights(rows, good, 10_000)):
        u = ((xxhash.xxh64_intdigest(f"{k}\0{t}".encode(), 1) >> 11) + 0.5) / 2**53
        keys.append((w - math.log(-math.log(u)), k))
    share = len(good) / len(labels)
    return {k for _, k in sorted(keys, reverse=True)[: math.ceil((1 - (1 - share) * 0.95) * len(rows))]}


def one_of_each(rows):
    near = brute_links(rows)
    out = set()
    for k, _ in rows:
        reach, front = {k}, [k]
        while front:
            front = [b for a in front for b in near[a] if b not in reach and not reach.add(b)]
        out.add(min(reach))
    return out


def redacted(rows):
    judged = judged_spans(rows)
    out = {}
    for k, t in rows:
        spans = sorted([(a, b, kind) for kind, found in base_spans(t).items() for a, b in found] + [(a, b, kind) for kind, a, b in judged[k]])
        text, at, end = [], 0, -1
        for a, b, kind in spans:
            if a >= end:
                text += [t[at:a], f"[{kind}]"]
            end = at = max(end, b)
        out[k] = t if not spans else "".join(text) + t[at:]
    return out


def test_stages_equal_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)

    def after(name, docs):
        path = f"{tmp_path}/{name}"
        stages[name](spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        return out, sorted((r["doc_id"], r["text"]) for r in out.collect()) if name != "packing" else out.collect()

    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    docs, kept = after("quality", docs)
    assert {k for k, _ in kept} == selected(rows, labels) and dict(kept).items() <= dict(rows).items()
    docs, lines = after("lines", docs)
    assert {k: t for k, t in lines} == {k: t for k, (t, _, _) in brute(kept).items()}
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    docs, apart = after("near_duplicates", docs)
    assert {k for k, _ in apart} == one_of_each(lines) and dict(apart).items() <= dict(lines).items()
    docs, clean = after("personal_data", docs)
    assert dict(clean) == redacted(apart)
    _, pieces = after("packing", docs)
    tokenizer, by, room = Tokenizer.from_file(P.path("word_bpe_49k.json")), collections.defaultdict(dict), collections.defaultdict(list)
    for r in pieces:
        by[r["doc_id"]][r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by) == {k for k, _ in clean}
    for k, t in clean:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert by[k] == {i: (s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for i, s in enumerate(range(0, len(ids), 2048))}
    for items in room.values():
        ends = [0, *np.cumsum([n for _, n in sorted(items)]).tolist()]
        assert [o for o, _ in sorted(items)] == ends[:-1] and ends[-1] <= 2048
    total = sum(r["length"] for r in pieces)
    assert len(room) <= 1.03 * -(-total // 2048) + 2


def test_odd_rows_through_the_stages(spark, tmp_path):
    """Nulls, empty texts, repeated rows and equal texts have defined results in every stage."""
    text = "one two three four five six seven\nsecond line of it\nthird line here"
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (None, None), (5, "mail a@b.cd now")]
    docs = spark.createDataFrame([(k, t, None, None, None, "x") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kind string")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    shown = lambda df: sorted(((r["doc_id"] or 0, r["text"] or "", r["text"] is None) for r in df.collect()))
    assert shown(stages["quality"](spark, docs, str(tmp_path))) == shown(docs)  # all labelled ones are good
    lines = stages["lines"](spark, docs, str(tmp_path))
    assert shown(lines) == sorted([(0, "", True), (1, text, False), (1, text, False), (2, "", False), (3, "", True), (4, "", False), (5, "mail a@b.cd now", False)])
    apart = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert shown(apart) == sorted([(0, "", True), (1, text, False), (3, "", True), (4, "", False), (5, "mail a@b.cd now", False)])
    private = stages["personal_data"](spark, docs, str(tmp_path))
    assert {r["doc_id"]: r["text"] for r in private.collect()}[5] == "mail [email] now" and private.columns == docs.columns
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert len(packed) == len(rows) and sorted(r["length"] for r in packed if r["doc_id"] in (3, 4, None)) == [1, 1, 1]
