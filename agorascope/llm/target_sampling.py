"""Importance resampling towards a target: which documents look like the target's texts?

Words are runs of digits, letters a to z and signs beyond ASCII, with A to Z lower-cased. Features are the runs of
``shortest`` to ``longest`` words, joined by a space; their bucket is the CRC-32 of their UTF-8 bytes modulo ``buckets``.
A bucket's gain is the floor of 1000 times the log ratio of its smoothed shares in target and documents. A document's
weight is the floored mean of its features' gains; a keyed Gumbel draw is added to it, and of the documents with at least
``least`` words the ``percent`` with the greatest scores are drawn, ranked.

Words become ids of an integer dictionary, runs of words become tuples of ids; each distinct tuple of a slice of texts is
put together and hashed once, and its bucket or gain goes back to its occurrences. A worker keeps its dictionary for its
later slices, up to ``words`` words: a dictionary of all tasks would shuffle every occurrence to find the same hashes.

Scale: the texts are read twice, once for the buckets' counts (at most ``buckets`` rows a task), once for the weights;
texts are split in parts, so a long one needs memory for its ids only. Ranks are counted in sampled ranges of scores, so
no task sorts all documents. What is collected are the buckets' counts.

Edge cases: null and empty texts have no words, weight 0 and no rank; a null id is drawn for as if it were empty and comes
before others in a tie; equal rows get equal scores and ranks of their own; without documents there are no rows, without
target texts all its counts are 0. ``drawn`` keeps all columns, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.vocab import numbered
from .common import Steps, covered, kept, released, smaller, word_parts, word_table

LETTERS = word_table(lambda c: c >= 0x80 or chr(c).isalnum())


class Dictionary(dict):
    """Words as ids in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Features:
    """Buckets of runs of words, for slices of texts."""

    def __init__(self, shortest: int, longest: int, buckets: int, words: int = 400_000):
        self.shortest, self.longest, self.buckets, self.most = shortest, longest, buckets, words
        self.start()

    def start(self) -> None:
        self.ids, self.one = Dictionary(), np.empty(0, np.int64)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of words of each text; text and bucket of each feature."""
        if len(self.ids) > self.most:
            self.start()
        each = []
        for text in texts:
            parts = [np.fromiter(map(self.ids.__getitem__, part), np.int64, len(part)) for part in word_parts(text, LETTERS)]
            each.append(np.concatenate(parts) if parts else np.empty(0, np.int64))
        n_words = np.array([len(x) for x in each], np.int64)
        ids = np.concatenate(each) if each else np.empty(0, np.int64)
        text_of = np.repeat(np.arange(len(each)), n_words)
        words = list(self.ids)
        texts_of, found = [], []
        code, first = ids, np.arange(len(ids))  # runs of n words: a number for each distinct one, and where they begin
        for n in range(1, self.longest + 1):
            if n > 1:
                fits = first + n - 1 < len(ids)
                fits[fits] &= text_of[first[fits]] == text_of[first[fits] + n - 1]
                code, first = code[fits], first[fits]
                code = code * len(words) + ids[first + n - 1]
            if n == 1:
                fresh = [zlib.crc32(w) % self.buckets for w in words[len(self.one) :]]
                self.one = np.concatenate([self.one, np.array(fresh, np.int64)])
                bucket = self.one[ids]
            else:
                _, at, code = np.unique(code, return_index=True, return_inverse=True)
                tuples = ids[first[at][:, None] + np.arange(n)]
                bucket = np.array([zlib.crc32(b" ".join([words[i] for i in t])) % self.buckets for t in tuples.tolist()], np.int64)[code]
            if n >= self.shortest:
                texts_of.append(text_of[first])
                found.append(bucket)
        return n_words, np.concatenate(texts_of), np.concatenate(found)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def bucket_counts(texts: DataFrame, text: str, shortest: int, longest: int, buckets: int) -> np.ndarray:
    """How many features of a table are in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = kept(("features", shortest, longest, buckets), lambda: Features(shortest, longest, buckets))
        total = np.zeros(buckets, np.int64)
        for batch in smaller(batches, 0):
            total += np.bincount(features.of(_texts(batch.column(0)))[2], minlength=buckets)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    found = texts.select(F.col(text).cast("string")).mapInArrow(released(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray, buckets: int) -> np.ndarray:
    up, down = (target + 1.0) * (documents.sum() + buckets), (documents + 1.0) * (target.sum() + buckets)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def draw(id: str, seed: int) -> Column:
    """A keyed Gumbel draw in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, id: str, text: str, shortest: int, longest: int, buckets: int, seed: int) -> DataFrame:
    """Adds _words, n_features, weight and score, in place of columns with these names."""
    names = [c for c in docs.columns if c not in ("_words", "n_features", "weight", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    gain = gains(bucket_counts(docs, text, shortest, longest, buckets), bucket_counts(target, "text", shortest, longest, buckets), buckets)
    at = names.index(text)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = kept(("features", shortest, longest, buckets), lambda: Features(shortest, longest, buckets))
        for batch in smaller(batches, at):
            n_words, text_of, bucket = features.of(_texts(batch.column(at)))
            n = np.bincount(text_of, minlength=len(n_words))
            total = np.zeros(len(n_words), np.int64)
            np.add.at(total, text_of, gain[bucket])
            mean = np.floor_divide(total, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words), pa.array(n, pa.int64()), pa.array(mean)], [*batch.schema.names, "_words", "n_features", "weight"])

    added = [T.StructField(c, T.LongType()) for c in ("_words", "n_features", "weight")]
    out = docs.mapInArrow(released(weigh), T.StructType([*docs.schema.fields, *added]))
    return out.withColumn("score", F.col("weight") + draw(id, seed))


def resample(
    docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = 1, longest: int = 1, buckets: int = 10_000, least: int = 20, percent: int = 10, seed: int = 2024
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; target: (text)."""
    scored = weighed(docs.select(id, text), target, id, text, shortest, longest, buckets, seed).drop(text)
    # those with enough words first, by score; their number is counted in what is written
    order = F.struct((F.col("_words") < least).alias("few"), (-F.col("score")).alias("s"), F.col(id).alias("i"))
    placed = numbered(scored.withColumn("_by", order), "_by", 1, "_rank")
    k = percent * placed.where(F.col("_words") >= least).count() // 100
    return placed.select(id, "n_features", "weight", "score", F.when(F.col("_rank") <= k, F.col("_rank")).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The drawn documents with all their columns and their rank as __rank; ids must be distinct among documents that tie."""
    docs, names = covered(docs)
    ranks = resample(docs, target, names[id], names[text], **how).where("rank IS NOT NULL").select(F.col(names[id]).alias("_id"), "rank", "score")
    out = docs.join(ranks.groupBy("_id").agg(F.min("rank").alias("__rank")), F.col(names[id]).eqNullSafe(F.col("_id")))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "__rank")


def sql(buckets: int = 10_000, least: int = 20, percent: int = 10, seed: int = 2024, source: str = "documents", target: str = "benchmark") -> str:
    """DuckDB SQL for resample with single words: CRC-32 byte by byte, over distinct words."""
    return rf"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
w AS (
  SELECT d, name, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM (SELECT 0 AS d, doc_id AS name, text FROM {source} UNION ALL SELECT 1, 0, text FROM {target})),
words AS (SELECT word, hex(word) AS x FROM (SELECT DISTINCT word FROM w)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % {buckets} AS bucket FROM words, crc),
n AS (SELECT bucket, count(*) FILTER (WHERE d = 0) AS s, count(*) FILTER (WHERE d = 1) AS t FROM w JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {buckets})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {buckets})::DOUBLE))) AS BIGINT) AS g FROM n),
weights AS (SELECT name AS doc_id, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM w JOIN hashed USING (word) JOIN gain USING (bucket) WHERE d = 0 GROUP BY name),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000.0 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM {source} LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {least} ORDER BY score DESC, doc_id) AS r, count(*) FILTER (WHERE n_features >= {least}) OVER () AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {least} AND r <= {percent} * most // 100 THEN r END AS rank FROM ranked"""
