"""Split readers against reading a file as a whole, for any size of the parts."""

import random
import sqlite3
import struct

import pytest

from agorascope.sources import readers as R
from agorascope.sources import split


def records(seed, n, dim, blanks):
    """Words of many lengths, and vectors; with ``blanks`` their bytes look like text."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        word = f"w{i}" + rng.choice(["", "é", "낱말", "x" * rng.randrange(40)])
        raw = bytes(rng.choice(b" a\n0") for _ in range(4 * dim)) if blanks else struct.pack(f"<{dim}f", *(rng.gauss(0, 1) for _ in range(dim)))
        out.append((word, list(struct.unpack(f"<{dim}f", raw))))
    return out


def written(path, found, dim, ends):
    with open(path, "wb") as f:
        f.write(f"{len(found)} {dim}\n".encode())
        for word, vector in found:
            f.write(word.encode() + b" " + struct.pack(f"<{dim}f", *vector) + (b"\n" if ends else b""))
    return str(path)


@pytest.mark.parametrize("seed, dim, blanks, ends", [(1, 5, False, True), (2, 7, False, False), (3, 3, True, True), (4, 2, True, False), (5, 60, False, True)])
def test_word2vec_in_ranges(spark, tmp_path, seed, dim, blanks, ends):
    want = records(seed, 120, dim, blanks)
    path = written(tmp_path / "v.bin", want, dim, ends)
    for part in (1 << 30, 9_000, 1_500, 97):
        ranges = split.Word2VecReader({"path": path, "partbytes": str(part)})
        got = [(w, v) for p in ranges.partitions() for b in ranges.read(p) for w, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert got == want, part


def test_ranges_meet_early(tmp_path):
    """Most ranges of a file of usual vectors have records of their own."""
    path = written(tmp_path / "v.bin", records(6, 3_000, 50, False), 50, True)
    reader = split.Word2VecReader({"path": path, "partbytes": "30000"})
    parts = reader.partitions()
    own = [sum(b.num_rows for b in reader.read(p)) for p in parts]
    assert sum(own) == 3_000 and sum(n > 0 for n in own) >= 0.9 * len(parts)


def test_word2vec_as_a_table(spark, tmp_path):
    want = records(7, 300, 8, False)
    path = written(tmp_path / "v.bin", want, 8, True)
    found = R.read_word2vec_binary(spark, path, part_bytes=4_000)
    assert found.rdd.getNumPartitions() > 2 and sorted((r["word"], r["vector"]) for r in found.collect()) == sorted(want)
    words = spark.createDataFrame([(want[3][0],), (want[3][0],), ("nowhere",)], "word string")
    assert [(r["word"], r["vector"]) for r in R.read_word2vec_binary(spark, path, vocabulary=words).collect()] == [want[3]]


def test_too_long_a_word_is_refused(tmp_path):
    path = written(tmp_path / "v.bin", [("x" * 5_000, [1.0])], 1, True)
    with pytest.raises(ValueError, match="a word of more than"):
        reader = split.Word2VecReader({"path": path})
        list(reader.read(reader.partitions()[0]))


def test_sqlite_in_ranges(spark, tmp_path):
    path = str(tmp_path / "x.db")
    rows = [(i * i, f"text {i}", None if i % 3 else i) for i in range(200)]
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT, b INTEGER)")
        db.execute("CREATE TABLE u (a TEXT PRIMARY KEY, b TEXT) WITHOUT ROWID")
        db.execute("CREATE TABLE bare (a TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
        db.executemany("INSERT INTO u VALUES (?, ?)", [(str(i), "x") for i in range(10)])
    want = sorted((str(i), a, None if b is None else str(b)) for i, a, b in rows)
    for part in (10**9, 7_000, 999):
        found = R.read_sqlite(spark, path, "t", ["id", "a", "b"], part)
        assert sorted(map(tuple, found.collect())) == want
    assert found.rdd.getNumPartitions() == 40
    assert R.read_sqlite(spark, path, "u", ["a"], 2).count() == 10
    assert R.read_sqlite(spark, path, "bare", ["a"]).collect() == []


def test_cases_in_groups(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i:02d}.txt").write_text(f"{i}\n{'-' if i % 2 else 'a, b'}\n2\nline {i}\n둘\n1\nbefore\n\n", encoding="EUC-KR")
    for part in (1, 100, 1 << 20):
        got = {r["thread_id"]: (r["entities"], r["target"], r["context"]) for r in R.read_cases(spark, str(tmp_path), "EUC-KR", part).collect()}
        assert got == {i: ([] if i % 2 else ["a", "b"], f"line {i}\n둘", ["before"]) for i in range(30)}
