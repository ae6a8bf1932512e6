"""Best-fit packing of token sequences by linear grouping.

Every document is tokenised, ended by an end id and, only if longer than the capacity, cut into pieces of that length.
Lengths are at most the capacity, so the plan works on their histogram, in runs of equal pieces, and its size does not
depend on the number of documents:

1. Pieces as long as the capacity fill a sequence each. Large lengths are sorted and dealt into groups of equal
   cardinality; each is rounded up to its group's greatest length.
2. For these few sizes, column generation chooses configurations (multisets that fit the capacity) that cover the
   groups with the least number of sequences: a linear program, whose rounded-down solution is used as it stands.
3. Actual pieces take the places of the rounded ones, longest first; what rounding down left over and the small
   pieces go by best fit, longest first, into the room that is left.
4. This is done for several limits between large and small, and the plan with the fewest sequences is taken.

The plan is a list of runs (length, from rank, to rank, sequence, pieces a sequence). Ranks within a length are
numbered in parallel: counts by (length, salt), their running sums, and row numbers within (length, salt); a length has
a salt for each part of its pieces, ``CELLS`` in all, so that a length that a third of all pieces have is not sorted in one
task. Offsets come from a window over a sequence, which holds at most ``capacity`` pieces. The plan and the salts'
starts are sent to every task while they have at most ``MOST_ROWS`` rows, and joined by shuffle beyond that.

Edge cases: a null text is empty, an empty document is its end id alone; equal rows are packed as often as they occur;
an empty table gives an empty result; lengths, starts and checksums are of whole texts.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, kept, released, smaller

CELLS = 4_096  # a salt of a length has at most so large a part of all pieces, or a thousand of them
MOST_ROWS = 500_000  # rows of a table that is sent to every task
#: How the tokenizer parts texts, as its file says; other tokenizers encode whole texts.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Parts that are cut here: printable ASCII but ' and <, and the letters of Latin-1.
PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
CUT = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
WORD_BYTES = {*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)}


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary, as sign -> byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def own_pieces(merges: list[tuple[str, str]], end: str) -> list[bool]:
    """For each merge whether its result, taken as symbols, is put together again by merges of lower rank and this one last."""
    rank = {pair: k for k, pair in enumerate(merges)}
    made = {a + b: k for k, (a, b) in enumerate(merges)}
    fine: list[bool] = []
    for k, (a, b) in enumerate(merges):
        if not all(len(x.removesuffix(end)) == 1 or (x in made and made[x] < k and fine[made[x]]) for x in (a, b)):
            fine.append(False)
            continue
        whole = (a + b).removesuffix(end)
        parts = list(whole)
        parts[-1] += (a + b)[len(whole) :]
        while len(parts) > 2:
            best, at = min((rank.get(p, len(merges)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best >= k:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        fine.append(parts == [a, b])
    return fine


class Known(dict):
    """A memo; what it lacks is looked up in the one before it, or made."""

    def __init__(self, make, before: Known | None = None):
        self.make, self.before = make, before

    def __missing__(self, key):
        got = self.before.get(key) if self.before is not None else None
        self[key] = got = self.make(key) if got is None else got
        return got

    def renewed(self, most: int) -> Known:
        """Itself, or a fresh memo that still finds what this one holds."""
        if len(self) <= most:
            return self
        self.before = None
        return Known(self.make, self)


class ChunkedEncoder:
    """Ids of whole texts, by parts between blanks and line ends.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its parts; parts repeat,
    and a memo of bounded size holds their ids as little-endian bytes. Parts of ASCII signs and Latin-1 letters are cut
    into words, single digits and runs of signs, as the tokenizer's pattern does; all other parts are the tokenizer's.

    Words are merged by a rank table: adjacent symbols whose concatenation is a piece are joined, least id first. That
    is what the tokenizer does if ranks are ids, a merge's parts have lesser ids than its result, and every piece is put
    together from its own symbols by its own merge: symbols that span a piece's place, with no join across its ends,
    have then seen the same joins as the piece by itself, so they are that merge's two parts. The first two are tested when
    the vocabulary is loaded, and pieces that fail the third are never made by the tokenizer and are left out. A word's
    last byte, which carries the end mark, is written as a byte that no word has.
    """

    def __init__(self, path: str, memo: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), memo // 2
        self.ranks = self.rank_table(path)
        self.parts = Known(self.part)
        self.signs = Known(self.tokenized)

    def rank_table(self, path: str):
        """Words' merges; None if the tokenizer is not of this kind."""
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, steps = told["model"], told["pre_tokenizer"].get("pretokenizers", [])
        end, vocab, merges = model.get("end_of_word_suffix"), model["vocab"], [tuple(m) for m in model["merges"]]
        ids = [vocab[a + b] for a, b in merges]
        if not (
            (told["normalizer"] or {}).get("normalizers") == NORMALIZERS and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": PARTS} and steps[0]["invert"]
            and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and model["type"] == "BPE" and end and not model.get("dropout") and not model.get("ignore_merges")
            and all("<" in t["content"] and not t["lstrip"] and not t["rstrip"] for t in told["added_tokens"]) and ids == sorted(set(ids)) and all(vocab[a] < i and vocab[b] < i for (a, b), i in zip(merges, ids))
        ):
            return None
        import tiktoken

        left_out = {a + b for (a, b), fine in zip(merges, own_pieces(merges, end)) if not fine}
        byte, ranks = byte_signs(), {}
        free = [b for b in range(128) if b not in WORD_BYTES]
        self.last = dict(zip([*range(ord("a"), ord("z") + 1), *range(0x80, 0xC0)], free))
        for piece, i in vocab.items():
            own = [byte[c] for c in piece.removesuffix(end)]
            if piece in left_out or not own or not WORD_BYTES.issuperset(own):
                continue
            if piece.endswith(end):
                if own[-1] not in self.last:
                    continue
                own[-1] = self.last[own[-1]]
            ranks[bytes(own)] = i
        return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def tokenized(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        own = word.encode()
        return array("I", self.ranks(own[:-1] + bytes((self.last[own[-1]],)))).tobytes()

    def part(self, part: str) -> bytes:
        if not part:
            return b""
        low = part.lower()
        if part.isascii() and part.isalpha():
            return self.word(low)
        if not PLAIN.fullmatch(part):
            return self.tokenized(part)
        return b"".join([self.word(x) if x[0].isalpha() else self.signs[x] for x in CUT.findall(low)])

    def encode(self, text: str) -> bytes:
        if self.ranks is None:
            return self.tokenized(text)
        self.parts, self.signs = self.parts.renewed(self.most), self.signs.renewed(self.most)
        return b"".join(map(self.parts.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, vocab_path: str, capacity: int, id: str, text: str, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("encoder", vocab_path), lambda: ChunkedEncoder(vocab_path))
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in smaller(batches, 1):
            names = batch.column(0)
            row, piece, start, length, crc = [], [], [], [], []
            for i, x in enumerate(batch.column(1)):
                ids = memoryview(encoder.encode(x.as_py() or "") + end)
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[s : s + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [id, "piece", "start", "length", "ids_crc32"])

    rows = docs.select(id, text)
    kind = rows.schema[id].dataType.simpleString()
    return rows.mapInArrow(released(run), f"`{id}` {kind}, piece int, start long, length long, ids_crc32 long")


# The plan: driver code over the histogram of lengths.


def best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """Unbounded knapsack: the greatest total value that fits, and how often each size is taken."""
    w = np.array(sizes)
    gain = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    order = np.arange(len(sizes))
    for c in range(int(w.min()), capacity + 1):
        fit = order[w <= c]
        totals = gain[c - w[fit]] + values[fit]
        k = int(totals.argmax())
        if totals[k] > gain[c - 1] + 1e-12:
            gain[c], took[c] = totals[k], fit[k]
        else:
            gain[c] = gain[c - 1]
    counts, c = [0] * len(sizes), capacity
    while c > 0:
        if gain[c] == gain[c - 1] and took[c] < 0:
            c -= 1
            continue
        counts[took[c]] += 1
        c -= sizes[took[c]]
    return float(gain[capacity]), counts


def configurations(sizes: list[int], need: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], int]]:
    """Column generation for covering ``need`` pieces of ``sizes``: (counts by size, whole times) with times >= 1."""
    k = len(sizes)
    if not k:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    n = np.array(need, dtype=float)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, counts = best_configuration(sizes, prices, capacity)
        if value <= 1 + 1e-6:
            break
        x = np.linalg.solve(basis, n)
        step = np.linalg.solve(basis, np.array(counts, dtype=float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = counts
    x = np.linalg.solve(basis, n)
    return [([round(v) for v in basis[:, j]], int(np.floor(x[j] + 1e-7))) for j in range(k) if x[j] + 1e-7 >= 1]


def plan(counts: dict[int, int], capacity: int, groups: int = 32) -> list[tuple[int, int, int, int, int]]:
    """The plan with the fewest sequences of those for several least large lengths."""
    least, best = -(-sum(s * n for s, n in counts.items()) // capacity), None
    for part in (2, 3, 4):
        runs = plan_for(counts, capacity, groups, capacity // part + 1)
        used = max((first + (hi - lo - 1) // per + 1 for _, lo, hi, first, per in runs), default=0)
        if best is None or used < best[0]:
            best = (used, runs)
        if used <= least:
            break
    return best[1]


def plan_for(counts: dict[int, int], capacity: int, groups: int, small: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, from rank, to rank, first sequence, pieces a sequence), ranks from 0 within a length; lengths under ``small`` aren't grouped."""
    runs: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    sequences = 0
    if counts.get(capacity):
        runs.append((capacity, 0, counts[capacity], 0, 1))
        used[capacity] = sequences = counts[capacity]
    large = sorted((s for s in counts if small <= s < capacity and counts[s]), reverse=True)
    total = sum(counts[s] for s in large)
    # groups of equal cardinality, longest first; each is its list of (length, pieces)
    dealt: list[list[list[int]]] = []
    if total:
        share = -(-total // min(groups, total))
        room = 0
        for s in large:
            left = counts[s]
            while left:
                if not room:
                    dealt.append([])
                    room = share
                n = min(left, room)
                dealt[-1].append([s, n])
                left, room = left - n, room - n
    # groups of the same greatest length are one size
    by_size: dict[int, list[list[int]]] = {}
    for g in dealt:
        by_size.setdefault(g[0][0], []).extend(g)
    sizes = sorted(by_size, reverse=True)
    chosen = configurations(sizes, [sum(n for _, n in by_size[s]) for s in sizes], capacity)
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, sequences)]
    left = {s: [list(x) for x in by_size[s]] for s in sizes}

    def take(size: int, n: int) -> list[tuple[int, int]]:
        """The next n pieces of a group, longest first, as (length, pieces); fewer if it has fewer."""
        got = []
        while n and left[size]:
            s, have = left[size][0]
            m = min(n, have)
            got.append((s, m))
            n -= m
            if m == have:
                left[size].pop(0)
            else:
                left[size][0][1] -= m
        return got

    for per, times in sorted(chosen, key=lambda x: [-c for c in x[0]]):
        start, sequences = sequences, sequences + times
        cuts: dict[int, int] = defaultdict(int)  # where the filled length changes
        for size, c in zip(sizes, per):
            for _ in range(c):
                at = start
                for s, m in take(size, times):
                    runs.append((s, used[s], used[s] + m, at, 1))
                    used[s] += m
                    cuts[at] += s
                    cuts[at + m] -= s
                    at += m
        filled, marks = 0, sorted({start, start + times, *cuts})
        for a, b in zip(marks, marks[1:]):
            filled += cuts[a]
            free[capacity - filled].append((a, b - a))
    # best fit for the rest, longest first
    rooms = sorted(r for r in free if r)

    def put(room: int, run: tuple[int, int]) -> None:
        if room and run[1]:
            if not free[room]:
                at = bisect_left(rooms, room)
                if at == len(rooms) or rooms[at] != room:
                    rooms.insert(at, room)
            free[room].append(run)

    for s in sorted((x for x in counts if x < capacity), reverse=True):
        n = counts[s] - used[s]
        while n:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                q = capacity // s
                fresh = -(-n // q)
                put(capacity, (sequences, fresh))
                sequences += fresh
                at = bisect_left(rooms, s)
            room = rooms[at]
            first, have = free[room].pop()
            if not free[room]:
                rooms.pop(at)
            q = room // s  # best fit stays with a sequence until it has no room for another
            full = min(have, n // q)
            if full:
                runs.append((s, used[s], used[s] + full * q, first, q))
                used[s] += full * q
                n -= full * q
                put(room - q * s, (first, full))
                put(room, (first + full, have - full))
            else:
                runs.append((s, used[s], used[s] + n, first, n))
                used[s] += n
                put(room - n * s, (first, 1))
                put(room, (first + 1, have - 1))
                n = 0
    return runs


def sent(table: DataFrame, rows: int) -> DataFrame:
    """A side of a join, to be sent to every task if it is known to be small; else Spark shuffles both sides."""
    return F.broadcast(table) if rows <= MOST_ROWS else table


def pack(docs: DataFrame, vocab_path: str, capacity: int = 2048, id: str = "doc_id", text: str = "text", end_id: int = 0, groups: int = 32) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    steps = Steps(spark, "pack")
    cut = steps.save(pieces(docs, vocab_path, capacity, id, text, end_id))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs = plan(counts, capacity, groups)
    share = max(1_000, sum(counts.values()) // CELLS)
    salts = [(s, -(-n // share)) for s, n in counts.items()]  # at most capacity + CELLS in all
    dealt = cut.join(F.broadcast(spark.createDataFrame(salts, "length long, salts long")), "length")  # at most capacity rows
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("ids_crc32", id, "piece"), F.col("salts"))).drop("salts")
    cells = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy(id, "piece", "ids_crc32", "start")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.join(sent(starts, sum(k for _, k in salts)), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    table = spark.createDataFrame(runs, "run_length long, lo long, hi long, sequence long, per long")
    placed = ranked.join(sent(table, len(runs)), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("lo")) / F.col("per")).cast("long"))
    ahead = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(id, "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(ahead, F.lit(0)).cast("long").alias("offset"))
