"""Repeated passages of lines against brute force and with planted ones."""

import collections
import hashlib
import random

import pytest

import corpus_pipeline
from agorascope.llm import line_dedup


def brute(rows, divisor=4):
    """The rule over lists and dicts: id -> (text, lines, removed)."""
    docs = {k: t.split("\n") for k, t in rows}
    full = {k: [i for i, x in enumerate(lines) if x.strip(" ")] for k, lines in docs.items()}
    h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    rolls = {k: [2 * h(docs[k][a]) ^ h(docs[k][b]) for a, b in zip(f, f[1:])] for k, f in full.items()}
    where = collections.defaultdict(list)
    for k in sorted(rolls):
        for i, r in enumerate(rolls[k]):
            where[r].append((k, i))
    chunks, texts = collections.defaultdict(list), collections.defaultdict(list)
    for k in sorted(rolls):
        seam = lambda i: 0 <= i < len(rolls[k]) and len(where[rolls[k][i]]) > 1
        start = None
        for u in range(len(full[k])):
            if not seam(u - 1) and not seam(u):
                continue
            if start is None:
                start = u
            if not seam(u) or rolls[k][u] % divisor == 0:
                text = "\n".join(docs[k][full[k][start] : full[k][u] + 1])
                chunks[k].append((start, u, text))
                texts[text].append((k, start))
                start = None
    out = {}
    for k, lines in docs.items():
        passages = []
        for s, e, t in chunks[k]:
            if texts[t][0] == (k, s):
                continue
            if passages and passages[-1][1] == s - 1 and len(where[rolls[k][s - 1]]) > 1 and where[rolls[k][s - 1]][0] != (k, s - 1):
                passages[-1][1] = e
            else:
                passages.append([s, e])
        gone = {i for s, e in passages if e > s for i in range(full[k][s], full[k][e] + 1)}
        out[k] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


@pytest.mark.parametrize("around", ["rare", "common"])
def test_planted_passages_go_whole(spark, around):
    """Passages of 2 to 20 lines between lines that are nowhere else, or that are everywhere."""
    rng, rows = random.Random(4), []
    for n in range(2, 21):
        for copy in range(5):
            passage = [f"passage {n} {copy} line {i}" for i in range(n)]
            for half in (0, 1):
                other = (lambda side, i: f"{side} {n} {copy} {half} {i}") if around == "rare" else (lambda side, i: f"common {rng.randrange(60)}")
                a, b = ([other(side, i) for i in range(4)] for side in ("before", "after"))
                rows.append((1000 * half + 10 * n + copy, a, passage, b))
    docs = spark.createDataFrame([(k, "\n".join(a + p + b)) for k, a, p, b in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in corpus_pipeline.lines_stage(spark, docs, "").collect()}
    whole = lost = 0
    for k, a, p, b in rows:
        if k >= 1000:
            whole += not set(p) & set(got[k])
        else:
            assert set(p) <= set(got[k]), k  # the first occurrence stays
        lost += around == "rare" and len(set(a + b) - set(got[k]))
    assert whole >= 0.95 * len(rows) / 2 and not lost
    assert around == "common" or whole == len(rows) / 2


@pytest.mark.parametrize("signs, n", [("abcdefgh", 12), ("abcdefghijklmnopqrstuvwxyz0123456789", 20), ("ab", 9)])
def test_passages_equal_brute_force(spark, signs, n):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(signs + "  ").strip() for _ in range(rng.randrange(1, n)))) for i in range(150)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got} == brute(rows)


def test_an_insertion_moves_no_other_boundary(spark):
    lines = [f"line number {i}" for i in range(60)]
    changed = lines[:30] + ["an added line"] + lines[30:]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(changed))], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {1: ("\n".join(lines), 0), 2: ("an added line", 60)}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x\ny"), (3, "x\ny"), (None, "x\ny"), (5, "\n\n\n"), (6, "x"), (7, "z\n\nx\n \ny\n"), (8, "x\n \ny")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), r["text"] or "", r["n_lines"], r["n_removed"]) for r in got) == [
        (0, "x\ny", 2, 0), (1, "", 0, 0), (2, "", 1, 0), (3, "", 2, 2), (3, "", 2, 2), (5, "\n\n\n", 4, 0), (6, "x", 1, 0), (7, "z\n\nx\n \ny\n", 6, 0), (8, "", 3, 3)
    ]
