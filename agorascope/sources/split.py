"""Readers that split one large file: word2vec's binary format by byte ranges, SQLite tables by row number, case folders by
groups of files. They are data sources of Spark's own Python interface, so a file is as many tasks as it has ranges, tasks
stream what they read, and a lost task reads its range again.

Word2vec records have no mark of their beginning: a word may be of any length, and any byte may stand in a vector. From a
given place the next record's place follows, though, and chains of places that begin anywhere soon fall together. A task
follows the chains of all places at which its first record could begin until they have met; from there on they are the
file's own records, whatever the one it began with. Where they don't meet within a range, the range before goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Words longer than this, in bytes, are refused: a task must know how far ahead its first record can begin.
LONGEST_WORD = 4_096


def opened(path: str):
    """A file of any store that Arrow knows, for reading at places, and its size."""
    from pyarrow import fs

    store, name = (fs.LocalFileSystem(), path.removeprefix("file:")) if "://" not in path else fs.FileSystem.from_uri(path)
    return store.open_input_file(name), store.get_file_info(name).size


class Window:
    """A file's bytes, of which one piece is held."""

    def __init__(self, path: str, piece: int = 4 << 20):
        self.file, self.size = opened(path)
        self.piece, self.start, self.held = piece, 0, b""

    def at(self, place: int, n: int) -> bytes:
        """n bytes from a place on, or fewer at the end."""
        n = max(0, min(n, self.size - place))
        if not self.start <= place <= place + n <= self.start + len(self.held):
            self.start, self.held = place, self.file.read_at(max(n, min(self.piece, self.size - place)), place)
        return self.held[place - self.start : place - self.start + n]


class Records:
    """Places of word2vec records."""

    def __init__(self, path: str):
        self.bytes = Window(path)
        head = self.bytes.at(0, 200)
        self.first = head.index(b"\n") + 1
        self.count, self.dim = map(int, head[: self.first].split())

    def blank(self, place: int) -> int | None:
        """Where the word that begins at a place ends; None if the file ends before."""
        found = self.bytes.at(place, LONGEST_WORD + 1).find(b" ")
        if found < 0:
            if place + LONGEST_WORD < self.bytes.size:
                raise ValueError(f"a word of more than {LONGEST_WORD} bytes at byte {place}")
            return None
        return place + found

    def after(self, place: int) -> int:
        """Where the next record begins, or the file's size."""
        blank = self.blank(place)
        return self.bytes.size if blank is None else min(self.bytes.size, blank + 1 + 4 * self.dim)

    def meeting(self, start: int, stop: int) -> int | None:
        """The first place from which on all records that could begin first from ``start`` on are the same; None if that
        is not before ``stop``. Chains that find no word's end have left the file's records, as those always do."""
        if start <= self.first:
            return self.first
        ahead = self.bytes.at(start, 4 * self.dim + 2 * LONGEST_WORD + 2)
        most = min(4 * self.dim + LONGEST_WORD + 1, len(ahead))
        places, at = set(), 0
        while at <= most:  # all places up to a blank lead to the same one
            blank = ahead.find(b" ", at)
            if blank < 0 or blank - at > LONGEST_WORD:
                break
            places.add(start + blank + 1 + 4 * self.dim)
            at = blank + 1
        while len(places) > 1:
            least = min(places)
            if least >= stop:
                return None
            places.discard(least)
            try:
                blank = self.blank(least)
            except ValueError:
                continue
            if blank is not None:
                places.add(blank + 1 + 4 * self.dim)
        place = places.pop() if places else stop
        return place if place < stop else None


class Range(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class Word2VecReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.part = options["path"], int(options.get("partbytes", 64 << 20))

    def partitions(self) -> list[Range]:
        size = opened(self.path)[1]
        return [Range(s, min(size, s + self.part)) for s in range(0, max(size, 1), self.part)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        import numpy as np

        records = Records(self.path)
        size = records.bytes.size
        place = records.meeting(partition.start, partition.stop)
        if place is None:
            return  # the task before goes on
        end, start = None, partition.stop
        while end is None and start < size:  # up to where the next task begins that has begun
            end = records.meeting(start, min(size, start + self.part))
            start += self.part
        end = size if end is None else end
        words, vectors = [], []
        while place < end:
            blank = records.blank(place)
            if blank is None or blank + 1 + 4 * records.dim > size:
                break  # line ends behind the last record
            words.append(records.bytes.at(place, blank - place).replace(b"\n", b"").decode("utf-8", "replace"))
            vectors.append(np.frombuffer(records.bytes.at(blank + 1, 4 * records.dim), "<f4"))
            place = blank + 1 + 4 * records.dim
            if len(words) >= 10_000:
                yield self.batch(words, vectors)
                words, vectors = [], []
        if words:
            yield self.batch(words, vectors)

    @staticmethod
    def batch(words: list, vectors: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(vectors, pa.list_(pa.float32()))], ["word", "vector"])


class Word2Vec(DataSource):
    """word2vec's binary format: a header line of the number of records and their dimension, then word, blank and floats."""

    @classmethod
    def name(cls) -> str:
        return "word2vec_binary"

    def schema(self) -> str:
        return "word string, vector array<float>"

    def reader(self, schema) -> Word2VecReader:
        return Word2VecReader(dict(self.options))


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.table, self.names, self.rows = options["path"], options["table"], names, int(options.get("partrows", 1_000_000))

    def _database(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[Range]:
        import sqlite3

        with self._database() as db:
            try:
                low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            except sqlite3.OperationalError:
                return [Range(0, -1)]  # a table without row numbers, or a view: one range
        return [Range(0, -1)] if low is None else [Range(s, min(high, s + self.rows - 1)) for s in range(low, high + 1, self.rows)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        which = f" WHERE rowid BETWEEN {partition.start} AND {partition.stop}" if partition.start <= partition.stop else ""
        with self._database() as db:
            found = db.execute("SELECT " + ", ".join(f'"{n}"' for n in self.names) + f' FROM "{self.table}"{which}')
            while some := found.fetchmany(10_000):
                columns = [pa.array([None if x is None else str(x) for x in column], pa.string()) for column in zip(*some)]
                yield pa.RecordBatch.from_arrays(columns, self.names)


class Sqlite(DataSource):
    """Columns of a table of a SQLite file, as strings, by ranges of row numbers; the file must be readable in the tasks."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(dict(self.options), [f.name for f in schema.fields])


class Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


class CasesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.encoding, self.part = options["path"], options.get("encoding", "UTF-8"), int(options.get("partbytes", 16 << 20))

    def _store(self):
        from pyarrow import fs

        return (fs.LocalFileSystem(), self.path.removeprefix("file:")) if "://" not in self.path else fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, top = self._store()
        found = [top] if store.get_file_info(top).type == fs.FileType.File else fs.FileSelector(top, recursive=True)
        files = sorted((f.path, f.size) for f in store.get_file_info(found) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        out, size = [], self.part
        for name, n in files:
            if size >= self.part:
                out.append([])
                size = 0
            out[-1].append(name)
            size += n
        return [Files(names) for names in out or [[]]]  # a source must have a partition

    def read(self, partition: Files) -> Iterator[tuple]:
        import io

        store, _ = self._store()
        for name in partition.names:
            with io.TextIOWrapper(store.open_input_stream(name), self.encoding) as text:
                rest = (line.rstrip("\r\n") for line in text)
                thread, names = int(next(rest).strip()), next(rest).strip()
                blocks = ["\n".join(next(rest, "") for _ in range(int(count))) for count in rest if count.strip()]
            yield name, thread, [] if names == "-" else [x.strip() for x in names.split(",")], blocks[0] if blocks else "", blocks[1:]


class Cases(DataSource):
    """Files of length-prefixed blocks: a thread line, an entity line (- for none), then blocks of a count and so many lines;
    the first block is the target, the others the context."""

    @classmethod
    def name(cls) -> str:
        return "case_files"

    def schema(self) -> str:
        return "file string, thread_id long, entities array<string>, target string, context array<string>"

    def reader(self, schema) -> CasesReader:
        return CasesReader(dict(self.options))


def load(spark: SparkSession, source: type[DataSource], path: str, schema=None, **options) -> DataFrame:
    spark.dataSource.register(source)
    found = spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items()})
    return (found if schema is None else found.schema(schema)).load(path)
