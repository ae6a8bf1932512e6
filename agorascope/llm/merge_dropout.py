"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text is a dummy blank and its characters; pieces are merged as a merge-type model does: an agenda holds the adjacent
pairs whose concatenation is a piece, best score first, of equal scores the leftmost. A popped candidate is skipped for
good with chance ``dropout``, each by a draw of its own: draws are keyed by the seed, the document (a hash of its id and
text) and the word's number in the text, and give the gaps between skipped candidates. So every occurrence of a word is
split anew, equal rows are split alike, and the same seed gives the same ids on any cluster. With dropout 0 the ids are
the model's own.

No piece has the word mark or a line end after another character, so no merge crosses a word's or a line's start, and
these words are solved by themselves. Many documents' words are solved at once: equal words are found by hashing, draws
are made for all occurrences together, and each different (word, skipped candidates) runs through the agenda once, as rows
of arrays that take a step each at the same time. Memos of bounded size keep them for later documents. Words without a
skip are left to the library. Characters that are no
piece, and a literal word mark, become their UTF-8 bytes' pieces; so decoding gives back every text exactly.

Edge cases: null gives a null list, empty text an empty one; a text or word of any length is encoded whole (the agenda
of a long word is a heap); rows repeat as given. Scale: a map without a shuffle; memory is the vocabulary, the memos and
some MB of texts at once.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame

from .common import Memo, kept, released, smaller

MARK, HIDDEN = "▁", "\x00"
LINE = "\x01"  # stands for a line end before a word
UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
MASK = 2**64 - 1
STEP = 0x9E3779B97F4A7C15
FARTHEST = 512  # a gap that reaches it goes on by another draw
NEVER = float("inf")
SHORT = 32  # longer words' agendas are heaps


def mixed(x):
    """Splitmix64's last steps, of an array or of one number."""
    one = isinstance(x, int)
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK if one else (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK if one else (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> 31) if one else x ^ (x >> np.uint64(31))


class Pairs:
    """Which symbol two adjacent symbols make, 0 for none: a hash table, and smaller ones for keys whose place is taken."""

    def __init__(self, made: dict[tuple[int, int], int], bits: int = 20):
        keys = np.array([a << 32 | b for a, b in made], np.uint64)
        values = np.array(list(made.values()), np.int32)
        self.levels = []
        while len(keys):
            spread, shift = np.uint64(mixed(len(self.levels) + 1) | 1), np.uint64(64 - bits)
            at = (keys * spread) >> shift
            _, first = np.unique(at, return_index=True)
            held, what = np.full(1 << bits, MASK, np.uint64), np.zeros(1 << bits, np.int32)
            held[at[first]], what[at[first]] = keys[first], values[first]
            self.levels.append((spread, shift, held, what))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, bits = keys[rest], values[rest], max(8, bits - 2)

    def made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        out = np.zeros(keys.shape, np.int32)
        for spread, shift, held, what in self.levels:
            at = (keys * spread) >> shift
            out += what[at] * (held[at] == keys)
        return out


class Model:
    """A merge-type SentencePiece model with byte fallback."""

    def __init__(self, path: str, dropout: float, seed: int, memo: int = 600_000):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        self.pieces = [sp.id_to_piece(i) for i in every]
        self.ids = {self.pieces[i]: i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.cost = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in every if sp.is_byte(i)}
        self.bytes = frozenset(self.byte.values())
        self.line_end = array("i", [self.byte[10]]).tobytes()
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.dropout, self.seed = dropout, seed
        # a gap is the number of these that a draw lies below: gap > k has the chance (1 - dropout) ** (k + 1)
        self.beyond = np.array([min(MASK, int((1 - dropout) ** (k + 1) * 2**64)) for k in reversed(range(FARTHEST))], np.uint64)
        self.beyond_list = self.beyond.tolist()
        self.plain, self.skipped = Memo(max(2, memo // 2)), Memo(max(2, memo))
        # symbols are piece ids, and numbers above these for characters of pieces that are none themselves; 0 joins nothing
        self.symbol = {c: i for c, i in self.ids.items() if len(c) == 1}
        for c in sorted(set("".join(self.ids)) - self.symbol.keys()):
            self.symbol[c] = len(self.pieces) + len(self.symbol)
        number = self.ids | self.symbol
        self.by_code = np.zeros(0x110000, np.int32)
        self.by_code[[ord(c) for c in self.symbol]] = list(self.symbol.values())
        self.price = np.full(len(self.pieces), np.inf)
        self.price[list(self.ids.values())] = [self.cost[x] for x in self.ids]
        self.pairs = Pairs({(number[x[:k]], number[x[k:]]): i for x, i in self.ids.items() for k in range(1, len(x)) if x[:k] in number and x[k:] in number})
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece goes on beyond a word or a line")

    def document(self, id, text: str) -> int:
        x = xxhash.xxh64_intdigest(f"{id}\0{text}".encode("utf-8", "surrogatepass"), self.seed)
        return mixed((x + self.seed * STEP) & MASK)

    def draws(self, keys: np.ndarray, which: int) -> np.ndarray:
        """The gaps by draw ``which`` of words with these keys."""
        return FARTHEST - np.searchsorted(self.beyond, mixed(keys + np.uint64(which * STEP & MASK)), "right")

    def skips(self, document: int, word: int) -> Iterator[int]:
        """The numbers of a word's skipped candidates, in order, without end."""
        key = mixed((document + (word + 1) * STEP) & MASK)
        at, which = 0, 0
        while True:
            gap = FARTHEST - bisect_right(self.beyond_list, mixed((key + which * STEP) & MASK))
            which += 1
            at += gap
            if gap < FARTHEST:
                yield at
                at += 1

    def run(self, unit: str, skips: int | Iterator[int] = 0) -> tuple[int, bytes]:
        """The number of candidates popped, and the ids as int32, of a word with its marks. A word that begins with LINE
        is a line end and what follows it; HIDDEN stands for a literal mark. skips: their numbers, or these as bits."""
        line, unit = unit[:1] == LINE, unit.removeprefix(LINE)
        if len(unit) <= SHORT and isinstance(skips, int):
            symbols = self.short(unit, skips)
        else:
            symbols = self.long(unit, skips if not isinstance(skips, int) else iter([k for k in range(skips.bit_length()) if skips >> k & 1]))
        out = self.ids_of(symbols)
        if line:
            out.insert(0, self.byte[10])
        return self.popped, out.tobytes()

    def ids_of(self, symbols: list[str]) -> array:
        try:
            return array("i", [self.ids[x] for x in symbols])
        except KeyError:
            out = array("i")
            for piece in symbols:
                i = self.ids.get(piece)
                if i is not None:
                    out.append(i)
                else:
                    out.extend([self.byte[b] for b in piece.replace(HIDDEN, MARK).encode("utf-8", "surrogatepass")])
            return out

    def marked(self, word: str) -> str:
        return word if word[:1] == LINE else MARK + word

    def solve(self, words: list[str]) -> list[tuple[int, bytes]]:
        """Words without a skip. Each candidate that is popped makes two symbols one, so there are as many as characters
        less pieces; words after line ends and those with bytes are run here."""
        out = []
        for w, ids in zip(words, self.sp.encode(words)):
            if w[:1] in ("", LINE) or not self.bytes.isdisjoint(ids):
                out.append(self.run(self.marked(w)))
            else:
                out.append((len(w) + 1 - len(ids), array("i", ids).tobytes()))
        return out

    def texts(self, documents: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that are not ODD, one after the other, and how many each has."""
        cut = [t.replace("\n", " " + LINE) for t in texts]
        words = pc.split_pattern(pa.array([" ".join(cut)], pa.large_string()), " ").flatten().dictionary_encode()
        code, some = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
        number = np.array([t.count(" ") + 1 for t in cut])
        nodes = list(map(self.plain.find(some, self.solve).__getitem__, some))
        at_node = code.copy()
        if self.dropout:
            popped = np.array([n for n, _ in nodes])
            firsts = np.repeat(np.cumsum(number) - number, number)
            key = mixed(np.repeat(np.array(documents, np.uint64), number) + (np.arange(len(code)) - firsts + 1).astype(np.uint64) * np.uint64(STEP))
            skip = self.draws(key, 0)
            which, mask, left = np.arange(len(code)), np.zeros(len(code), np.int64), popped[code]
            short = np.array([len(w) < SHORT for w in some])
            draw = 0
            while True:
                hit = skip < left
                which, skip, mask = which[hit], skip[hit], mask[hit]
                if not draw and len(which):
                    fine = short[code[which]]
                    for i in which[~fine].tolist():
                        at_node[i] = len(nodes)
                        doc = int(np.searchsorted(np.cumsum(number), i, "right"))
                        nodes.append(self.run(self.marked(some[code[i]]), self.skips(documents[doc], i - int(firsts[i]))))
                    which, skip, mask = which[fine], skip[fine], mask[fine]
                if not len(which):
                    break
                mask |= 1 << skip
                each, back = np.unique(code[which] << 32 | mask, return_inverse=True)
                keys = [(some[c], m) for c, m in zip((each >> 32).tolist(), (each & (2**32 - 1)).tolist())]
                found = list(map(self.skipped.find(keys, self.rerun).__getitem__, keys))
                at_node[which] = len(nodes) + back
                nodes += found
                left = np.array([n for n, _ in found])[back]
                draw += 1
                skip = skip + 1 + self.draws(key[which], draw)
        ids = np.frombuffer(b"".join([x for _, x in nodes]), np.int32)
        size = np.array([len(x) for _, x in nodes]) // 4
        start, many = (np.cumsum(size) - size)[at_node], size[at_node]
        ends = np.cumsum(many)
        out = ids[np.repeat(start - ends + many, many) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return out, np.diff(ends[np.cumsum(number) - 1], prepend=0) if len(number) else number

    def rerun(self, keys: list[tuple[str, int]]) -> list[tuple[int, bytes]]:
        """(word, skipped candidates as bits): words of like length go through the agenda together."""
        out: list = [None] * len(keys)
        units = [self.marked(w).removeprefix(LINE) for w, _ in keys]
        order = sorted(range(len(keys)), key=lambda k: len(units[k]))
        for at in range(0, len(order), 4096):
            some = order[at : at + 4096]
            popped, flat, sizes, odd = self.agendas([units[k] for k in some], np.array([keys[k][1] for k in some], np.int64))
            raw, ends = flat.astype(np.int32).tobytes(), (4 * np.cumsum(sizes)).tolist()
            for k, n, size, end, other in zip(some, popped.tolist(), (4 * sizes).tolist(), ends, odd.tolist()):
                if other:
                    out[k] = self.run(self.marked(keys[k][0]), keys[k][1])
                else:
                    ids = raw[end - size : end]
                    out[k] = (n, self.line_end + ids if keys[k][0][:1] == LINE else ids)
        return out

    def agendas(self, units: list[str], skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Candidates popped, all symbols, how many of them each unit has, and whether some of a unit's are no pieces."""
        n, wide = len(units), max(map(len, units))
        codes = np.frombuffer("".join([u.ljust(wide, HIDDEN) for u in units]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, wide)
        symbols = np.zeros((n, wide + 1), np.int32)
        symbols[:, :wide] = self.by_code[codes]
        after = np.tile(np.arange(1, wide + 2, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, wide, dtype=np.int32), (n, 1))
        made = self.pairs.made(symbols[:, :-1], symbols[:, 1:])
        price = self.price
        costs = price[made]
        popped, rows = np.zeros(n, np.int64), np.arange(n)
        while len(rows):
            at = costs[rows].argmin(axis=1)
            live = costs[rows, at] < NEVER
            rows, at = rows[live], at[live]
            skipped = skips[rows] >> popped[rows] & 1 == 1
            popped[rows] += 1
            costs[rows[skipped], at[skipped]] = NEVER
            r, i = rows[~skipped], at[~skipped]
            both, j = made[r, i], after[r, i]
            k = after[r, j]
            symbols[r, i], symbols[r, j] = both, -1
            after[r, i], before[r, k] = k, i
            costs[r, j] = NEVER
            new = self.pairs.made(both, symbols[r, k])
            made[r, i], costs[r, i] = new, price[new]
            left = before[r, i]
            r, both, left = r[left >= 0], both[left >= 0], left[left >= 0]
            new = self.pairs.made(symbols[r, left], both)
            made[r, left], costs[r, left] = new, price[new]
        here = (symbols[:, :wide] >= 0) & (np.arange(wide) < np.array([len(u) for u in units])[:, None])
        flat, sizes = symbols[:, :wide][here], here.sum(axis=1)
        odd = np.zeros(n, bool)
        odd[np.repeat(np.arange(n), sizes)[(flat == 0) | (flat >= len(self.pieces))]] = True
        return popped, flat, sizes, odd

    def short(self, unit: str, skips: int) -> list[str]:
        """The agenda as a plain list of costs, one an adjacent pair: the least, leftmost one is next."""
        get = self.cost.get
        symbols, costs = list(unit), [get(a + b, NEVER) for a, b in zip(unit, unit[1:])]
        popped = 0
        while costs:
            best = min(costs)
            if best == NEVER:
                break
            i = costs.index(best)
            popped += 1
            if skips and skips >> popped - 1 & 1:
                costs[i] = NEVER
                continue
            both = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = get(both + symbols[i + 1], NEVER)
            if i:
                costs[i - 1] = get(symbols[i - 1] + both, NEVER)
        self.popped = popped
        return symbols

    def long(self, unit: str, skips: Iterator[int]) -> list[str]:
        """The agenda as a heap."""
        n = len(unit)
        cost, popped = self.cost, 0
        skip = next(skips, -1)
        after = list(range(1, n + 1))  # where the symbol that begins here ends; 0: no symbol begins here
        before = list(range(-1, n - 1))  # where the symbol before this one begins
        agenda = []
        for i in range(n - 1):
            c = cost.get(unit[i : i + 2])
            if c is not None:
                agenda.append((c, i, i + 1, i + 2))
        heapify(agenda)
        while agenda:
            _, start, mid, end = heappop(agenda)
            if after[start] != mid or mid >= n or after[mid] != end:
                continue
            popped += 1
            if popped - 1 == skip:
                skip = next(skips, -1)
                continue
            after[start], after[mid] = end, 0
            if end < n:
                before[end] = start
                c = cost.get(unit[start : after[end]])
                if c is not None:
                    heappush(agenda, (c, start, end, after[end]))
            if start:
                first = before[start]
                c = cost.get(unit[first:end])
                if c is not None:
                    heappush(agenda, (c, first, start, end))
        self.popped = popped
        out, at = [], 0
        while at < n:
            out.append(unit[at : after[at]])
            at = after[at]
        return out

    def odd(self, document: int, text: str) -> bytes:
        """Like texts, of one text with any characters: marks and hidden signs stand for themselves."""
        out, word = [], 0
        for k, part in enumerate(text.split(HIDDEN)):
            if k:
                out.append(array("i", [self.byte[0]]).tobytes())
            for unit in UNIT.findall(("" if k else MARK) + part.replace(MARK, HIDDEN).replace(" ", MARK)):
                out.append(self.ids_of(self.long(unit, self.skips(document, word) if self.dropout else iter(()))).tobytes())
                word += 1
        return b"".join(out)

    @staticmethod
    def is_odd(text: str) -> bool:
        """Whether a text is more than words with single blanks and line ends between them."""
        return text[0] == " " or text[-1] == " " or any(x in text for x in (MARK, HIDDEN, LINE, "  "))

    def encode_all(self, names: list, texts: list[str | None]) -> list[np.ndarray | None]:
        out = [None if t is None else np.empty(0, np.int32) for t in texts]
        some = [i for i, t in enumerate(texts) if t]
        documents = {i: self.document(names[i], texts[i]) if self.dropout else 0 for i in some}
        plain = [i for i in some if not self.is_odd(texts[i])]
        for i in set(some).difference(plain):
            out[i] = np.frombuffer(self.odd(documents[i], texts[i]), np.int32)
        if plain:
            ids, sizes = self.texts([documents[i] for i in plain], [texts[i] for i in plain])
            for i, x in zip(plain, np.split(ids, np.cumsum(sizes)[:-1])):
                out[i] = x
        return out

    def encode(self, id, text: str) -> np.ndarray:
        return self.encode_all([id], [text])[0]

    def bytes_of(self, ids: list[int]) -> bytes:
        """The text's UTF-8 bytes."""
        return b"".join(map(self.raw.__getitem__, ids))[1:]

    def decode(self, ids: list[int]) -> str:
        return self.bytes_of(ids).decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, model_path: str, id: str = "doc_id", text: str = "text", dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """(id, ids array<int>, n_tokens long, lossless boolean: decoding the ids gives the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(("merges", model_path, dropout, seed), lambda: Model(model_path, dropout, seed))
        for batch in smaller(batches, 1, 6 << 20, 1_600):  # the more texts, the more words are solved once for several
            texts = batch.column(1).to_pylist()
            got = model.encode_all(batch.column(0).to_pylist(), texts)
            same = [None if t is None else model.bytes_of(x.tolist()) == t.encode("utf-8", "surrogatepass") for x, t in zip(got, texts)]
            lengths = np.array([0 if x is None else len(x) for x in got], np.int64)
            offsets = pa.array([None if x is None else int(o) for x, o in zip([*got, 0], np.concatenate([[0], np.cumsum(lengths)]))], pa.int32())
            ids = np.concatenate([np.empty(0, np.int32), *[x for x in got if x is not None]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(lengths), pa.array(same, pa.bool_())], [id, "ids", "n_tokens", "lossless"])

    rows = docs.select(id, text)
    return rows.mapInArrow(released(run), f"`{id}` {rows.schema[id].dataType.simpleString()}, ids array<int>, n_tokens long, lossless boolean")


def decode(encoded: DataFrame, model_path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text) from lists of ids; a null list gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(("merges", model_path, 0.0, 0), lambda: Model(model_path, 0.0, 0))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else model.decode(x) for x in batch.column(1).to_pylist()], pa.string())], [id, "text"])

    rows = encoded.select(id, ids)
    return rows.mapInArrow(run, f"`{id}` {rows.schema[id].dataType.simpleString()}, text string")
