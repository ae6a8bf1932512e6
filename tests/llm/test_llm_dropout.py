"""Every occurrence of a word draws for itself, and the agenda is that of a plain version."""

import itertools

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from agorascope.llm import merge_dropout

PIECES = P.path("piece_bpe_32k.model")
WORD = " responsibilities"
SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)
SCORES = {SP.id_to_piece(i): (SP.get_score(i), i) for i in range(SP.get_piece_size()) if not (SP.is_byte(i) or SP.is_control(i) or SP.is_unknown(i))}


def plain(unit, skipped):
    """A word's ids by looking through all adjacent pairs each time; ``skipped``: the numbers of candidates to pass over."""
    symbols, never, number = [(i, c) for i, c in enumerate(unit)], set(), 0
    while True:
        pairs = [(-SCORES[a + b][0], i, a, b) for (i, a), (_, b) in zip(symbols, symbols[1:]) if a + b in SCORES and (i, a, b) not in never]
        if not pairs:
            break
        _, i, a, b = min(pairs)
        number += 1
        if number - 1 in skipped:
            never.add((i, a, b))
            continue
        k = next(k for k, (j, _) in enumerate(symbols) if j == i)
        symbols[k : k + 2] = [(i, a + b)]
    out = []
    for _, x in symbols:
        out += [SCORES[x][1]] if x in SCORES else [SP.piece_to_id(f"<0x{b:02X}>") for b in x.encode()]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_ids_are_those_of_a_plain_agenda(dropout):
    texts = ["the internationalisation of communities\nand é日 considerations, 2024!", "of of of of", "x" * 50 + " unbelievably", "tail \n of\n", "\nresponsibilities"] + [f"word{i} thereafter hello{i}" for i in range(20)]
    model = merge_dropout.Model(PIECES, dropout, 5, memo=20)
    got = model.encode_all(list(range(len(texts))), texts)
    for name, t in enumerate(texts):
        document, want = model.document(name, t), []
        for k, w in enumerate(t.replace("\n", " \n").split(" ")):
            skipped = set(itertools.takewhile(lambda x: x < 200, model.skips(document, k))) if dropout else set()
            want += [SP.piece_to_id("<0x0A>")] + plain(w[1:], skipped) if w[:1] == "\n" else plain("▁" + w, skipped)
        assert got[name].tolist() == want, t


def test_occurrences_are_split_anew(spark):
    text = "".join([WORD] * 300)[1:]
    docs = spark.createDataFrame([(i, WORD[1:]) for i in range(300)] + [(1000, text)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in merge_dropout.encode(docs, PIECES, dropout=0.3).collect()}
    assert len({tuple(v) for k, v in got.items() if k < 1000}) > 20
    model = merge_dropout.Model(PIECES, 0.3, 1)
    split, at = set(), 0
    for word in range(300):
        ids = np.frombuffer(model.run("▁" + WORD[1:], model.skips(model.document(1000, text), word))[1], np.int32).tolist()
        assert got[1000][at : at + len(ids)] == ids
        at += len(ids)
        split.add(tuple(ids))
    assert at == len(got[1000]) and len(split) > 20


def test_share_of_skips():
    for dropout in (0.001, 0.1, 0.5):
        model = merge_dropout.Model(PIECES, dropout, 2)
        n = sum(len(list(itertools.takewhile(lambda x: x < 1000, model.skips(model.document(i, ""), 3)))) for i in range(200))
        assert abs(n - 200_000 * dropout) < 5 * (200_000 * dropout * (1 - dropout)) ** 0.5
