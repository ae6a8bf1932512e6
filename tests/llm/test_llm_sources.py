"""Source divergence, target resampling and source mixing against SQL and brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from agorascope.llm import divergence, mixing, queries, target_sampling
from agorascope.llm.common import word_parts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, rank string, n long, bucket int"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = ["the", "The", "a", "über", "ÜBER", "日本", "don't", "x1y", "2024", "\x00", "z_z", "é", "Zebra", "zebra", "word", "other"]
    out = []
    for i in range(160):
        text = rng.choice([" ", "\n", "\t", "  "]).join(rng.choice(words) for _ in range(rng.randrange(0, 40)))
        out.append((i, text, rng.choice(["en", "en", "de", None, "", "x"]), rng.choice([None, "", *"abcdefg", "aa", "é"])))
    out += [(200, None, "en", "only nulls"), (201, None, "none", None), (202, "", "none", "b"), (203, " \n\t", "de", "blank"), (204, "a " * 3000, "en", "a"), (None, "the word", "en", "a"), (300, "the the word", "en", "a"), (300, "the the word", "en", "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def divergences(rows, least, most):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    rows = [(t, lang or "", source or "") for _, t, lang, source in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        df = collections.Counter(w for t, l, _ in rows if l == lang for w in set(terms(t)))
        kept = sorted((w for w, n in df.items() if n >= least), key=str.encode)
        counts = {s: collections.Counter(w for t, l, x in rows if (l, x) == (lang, s) for w in terms(t)) for s in {s for _, l, s in rows if l == lang}}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[v] for v in kept) + 5 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), collections.Counter()))
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in counts if o != s))
            own = sorted((q[w] - p[s][w], w.encode()) for w in kept if counts[s][w] and p[s][w] > q[w])[:most]
            out |= {(lang, s, part, item.decode(), -v, r) for part, found in (("pair", pairs), ("term", own)) for r, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("least, most, chunk, block", [(2, 3, 2, 2), (1, 50, 512, 256), (20, 50, 3, 100), (10**6, 50, 512, 4)])
def test_divergence_equals_brute_force(docs, rows, least, most, chunk, block):
    got = divergence.audit(docs.repartition(3), least, most, chunk, block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == divergences(rows, least, most)


def test_shares_are_exact():
    import numpy as np

    for n, total in ((10**12 + 7, 3 * 10**12 + 11), (8 * 10**14, 9 * 10**14 + 13), (0, 5), (0, 10**15), (4, 9)):
        assert divergence.shares(np.array([n]), total)[0] == 1 + 10**9 * (n + 5) // total


def test_long_texts_are_read_in_parts():
    table = divergence.LETTERS
    text = "Ab cd1ef " * 1000
    assert [w for part in word_parts(text.encode(), table, 100) for w in part] == [b"ab", b"cd", b"ef"] * 1000
    assert [w for part in word_parts(b"x" * 1000 + b" y", table, 100) for w in part] == [b"x" * 1000, b"y"]
    assert list(word_parts(b"", table)) == []


def sampled(rows, target, shortest, longest, buckets, least, percent):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    features = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x)) for texts in ([r[1] for r in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for k, text, *_ in rows:
        each = [gain(bucket(f)) for f in features(text)]
        weight = sum(each) // len(each) if each else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, len(each), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    place = collections.defaultdict(list)
    for i, r in enumerate(order[: percent * len(order) // 100], 1):
        place[r].append(i)
    return collections.Counter((*r[:4], place[r].pop(0) if place[r] else None) for r in out)


@pytest.mark.parametrize("shortest, longest, buckets, least, percent", [(1, 1, 10_000, 20, 10), (1, 3, 50, 1, 60), (2, 2, 1000, 0, 100), (1, 1, 7, 10**6, 50)])
def test_resampling_equals_brute_force(spark, docs, rows, shortest, longest, buckets, least, percent):
    target = [None, "", "the zebra word", "Zebra Zebra über 日本 日本"]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = target_sampling.resample(docs.repartition(3), frame, shortest=shortest, longest=longest, buckets=buckets, least=least, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert collections.Counter(map(tuple, got.collect())) == sampled(rows, target, shortest, longest, buckets, least, percent)


def test_drawn_documents_keep_their_columns(spark, docs):
    target = spark.createDataFrame([("zebra word",)], "text string")
    ranks = {(r["doc_id"], r["rank"]) for r in target_sampling.resample(docs, target, percent=50).where("rank IS NOT NULL").collect()}
    got = target_sampling.drawn(docs, target, percent=50)
    assert got.columns == [*docs.columns, "__rank"] and {(r["doc_id"], r["__rank"]) for r in got.collect()} == ranks


def test_a_dictionary_that_fills_up():
    texts = [f"w{i} w{i + 1} same".encode() for i in range(50)]
    small, large = target_sampling.Features(1, 2, 97, words=5), target_sampling.Features(1, 2, 97)
    for t in texts:
        assert [x.tolist() for x in small.of([t])] == [x.tolist() for x in large.of([t])]
    assert len(small.ids) < 10 < len(large.ids)


def mixed(rows, weights=(5, 2, 1), most=3, block=16):
    """Source sizes and targets, and the blocks of each source if each is one shard, by taking one quotient after the other."""
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, free = total - sum(most * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        target = {s: most * sizes[s] if s in capped else weight[s] * rest / free for s in order}
        over = {s for s in order if s not in capped and target[s] > most * sizes[s]}
        if not over:
            break
        capped |= over
    seats = collections.Counter()
    for _ in range((2 * total + block) // (2 * block)):
        best = max(order, key=lambda s: target[s] / (2 * seats[s] + 1))  # the first of those that tie
        seats[best] += 1
    return sizes, target, {s: min(seats[s] * block, most * sizes[s]) for s in order}


def test_mix_equals_brute_force(docs, rows):
    got = [(*r,) for r in mixing.mix(docs).collect()]
    again = [(*r,) for r in mixing.mix(docs.repartition(5).orderBy(F.rand(3))).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, target, blocks = mixed(rows)
    assert len(got) == len(rows) and all(0 <= r[4] <= 3 * r[1] for r in got)
    of = {r[0]: r[3] for r in rows if r[0] is not None}
    taken = collections.Counter()
    for k, size, source_size, t, words in got:
        s = of.get(k, "a")
        assert source_size == sizes[s] and t == pytest.approx(target[s], rel=1e-12)
        taken[s] += words
    assert {s: n for s, n in taken.items() if n} == {s: n for s, n in blocks.items() if n}


def test_mix_over_many_shards(spark):
    rows = [(i, "w " * (i % 7), None, "large" if i % 3 else f"small{i % 2}") for i in range(3_000)]
    rows += [(5_000 + i, "w w", None, "tie1" if i % 2 else "tie2") for i in range(40)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = {r["doc_id"]: r for r in mixing.mix(docs, shard=50).collect()}
    _, target, _ = mixed(rows)
    taken = collections.Counter()
    for k, _, _, s in rows:
        taken[s] += got[k]["taken"]
        assert got[k]["taken"] <= 3 * got[k]["size"]
    assert all(abs(taken[s] - target[s]) <= 16 + 0.01 * target[s] for s in target), (taken, target)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = {r[0]: r for r in con.execute(mixing.sql(shard=50)).fetchall()}
    assert {k: tuple(r) for k, r in got.items()} == want


def test_queries_equal_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name in ("op11_source_divergence", "op12_target_resampling", "op13_source_mixing"):
        df = queries.queries()[name](spark, SF)
        want = con.execute(queries.oracle_sql()[name])
        assert [c[0] for c in want.description] == df.columns
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.fetchall())), name


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    target = spark.createDataFrame([("a",)], "text string")
    assert divergence.audit(none).collect() == mixing.mix(none).collect() == target_sampling.resample(none, target).collect() == []
    assert len(target_sampling.resample(docs, target.limit(0)).collect()) == docs.count()
    blank = spark.createDataFrame([(1, None, None, None, "x", 1, 2), (2, " ", None, "a", "x", 1, 2)], SCHEMA)
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2
    assert {(r["source"], r["item"], r["value"]) for r in divergence.audit(blank).collect()} == {("", "a", 0), ("a", "", 0)}
