"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton over the vocabulary enumerates, for each end position, the pieces that end there, longest
first. Dynamic programming carries the best score and the number of pieces of that best path. Ties follow the unigram
tokenizers: a later candidate wins only with a strictly greater score, and candidates come by ascending start, so the
longest last piece wins; a character that no single piece covers costs the least score less 10 and, with byte
fallback, counts its UTF-8 bytes. Scores are the vocabulary file's own.

No piece has the word mark after another character, so the best path never crosses a word's start and each word is
solved by itself. That equals the whole-text path exactly, because the scores are sums of whole numbers (checked when
the vocabulary is loaded; otherwise texts are solved whole). Words repeat, so each worker keeps solved words in a memo
of bounded size.

Edge cases: null and empty texts have 0 tokens and score 0; a text of any length is one pass; rows repeat as given.
Scale: a map without a shuffle; memory is the automaton, the memo and one batch of texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import kept, smaller

MARK = "▁"
UNKNOWN_PENALTY = 10.0
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Unigram:
    """pieces: (text, score). byte_fallback: an unknown character counts its bytes, else 1 a run of them."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True, memo: int = 200_000):
        self.auto = ahocorasick.Automaton()
        for text, score in pieces:
            self.auto.add_word(text, (len(text), float(score)))
        self.auto.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        inside = any(MARK in re.sub(f"^{MARK}+", "", t) for t, _ in pieces)
        self.by_word = not inside and all(float(s).is_integer() for _, s in pieces) and byte_fallback
        self.memo: dict[str, tuple[int, float]] = {}
        self.most = memo

    @classmethod
    def from_file(cls, path: str, **options) -> Unigram:
        """The normal pieces of a sentencepiece model file."""
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        return cls([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not skip(i)], **options)

    def solve(self, text: str) -> tuple[int, float]:
        """Pieces on the best path over ``text``, and its score."""
        n = len(text)
        best = [None] * (n + 1)
        count = [0] * (n + 1)
        run = [False] * (n + 1)  # the last piece is unknown
        best[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.auto.iter(text):
            ends[end].append(found)
        for end in range(n):
            top, pieces, unknown, single = None, 0, False, False
            for length, score in ends[end]:
                single = single or length == 1
                at = best[end + 1 - length]
                if top is None or at + score > top:
                    top, pieces, unknown = at + score, count[end + 1 - length] + 1, False
            if not single:
                score = best[end] + self.unknown
                if top is None or score > top:
                    more = len(text[end].encode("utf-8", "surrogatepass")) if self.byte_fallback else 0 if run[end] else 1
                    top, pieces, unknown = score, count[end] + more, True
            best[end + 1], count[end + 1], run[end + 1] = top, pieces, unknown
        return count[n], best[n]

    def words(self, text: str) -> Counter:
        body = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return Counter([body])
        if MARK + MARK in body or MARK in text:
            return Counter(WORD.findall(body))
        return Counter(body[1:].split(MARK))

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        runs = MARK + MARK in MARK + text.replace(" ", MARK) or MARK in text
        tokens, score = 0, 0.0
        memo = self.memo
        for word, times in self.words(text).items():
            key = word if runs or not self.by_word else MARK + word
            got = memo.get(key)
            if got is None:
                got = self.solve(key)
                if len(key) <= 64:
                    if len(memo) >= self.most:
                        memo.clear()
                    memo[key] = got
            tokens += got[0] * times
            score += got[1] * times
        return tokens, score


def token_counts(docs: DataFrame, vocab_path: str, id: str = "doc_id", text: str = "text", byte_fallback: bool = True) -> DataFrame:
    """(id, n_tokens long, score double) for each row; vocab_path must be readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(("unigram", vocab_path, byte_fallback), lambda: Unigram.from_file(vocab_path, byte_fallback=byte_fallback))
        for batch in smaller(batches, 1):
            got = [model.count(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.float64())], [id, "n_tokens", "score"])

    rows = docs.select(id, text)
    kind = rows.schema[id].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id}` {kind}, n_tokens long, score double")
