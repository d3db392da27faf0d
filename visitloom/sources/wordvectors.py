"""Word vectors in the binary format as a data source with byte ranges.

The format has a header ``count size`` and, for each word, the word, a blank and ``size`` floats, with or without a line feed behind them. Records are of
no fixed length and have no marks, so a range cannot simply begin anywhere: the start of a record behind each cut is looked for on the driver, which reads
a few records there, and is taken if a chain of records follows from it. A task reads one range in blocks and must end exactly at the next start, so a start that was
none is an error and never a wrong row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a word at most, records that must follow a start, rows of a batch, bytes that are read at once.
WORD_BYTES, CHAIN, ROWS, BLOCK = 1024, 16, 4096, 1 << 22


class NoStart(ValueError):
    pass


def word_at(data: bytes, at: int, end: int) -> int:
    """Where the blank behind the word at ``at`` is; ``NoStart`` if what stands there is no word."""
    blank = data.find(b" ", at, min(end, at + WORD_BYTES))
    if blank < 0:
        raise NoStart("a word has no end")
    word = data[at:blank].removeprefix(b"\n")
    if not word or any(b < 0x20 or b == 0x7F for b in word):
        raise NoStart("a word has control characters")
    try:
        word.decode()
    except UnicodeDecodeError:
        raise NoStart("a word is not text") from None
    return blank


def follows(data: bytes, at: int, size: int, last: bool) -> int | None:
    """Where the record behind the one at ``at`` begins, if records follow each other from ``at`` on, ``CHAIN`` of them or up to the end of the file.

    A word may be entered in its middle, so it is the next record that is sure to begin where it seems to.
    """
    import numpy as np

    second = None
    for _ in range(CHAIN):
        if at == len(data) and last:
            break
        try:
            body = word_at(data, at, len(data)) + 1
        except NoStart:
            return None
        if body + 4 * size > len(data):
            return None
        v = np.abs(np.frombuffer(data, "<f4", size, body))
        if not (v < 1e6).all() or ((v > 0) & (v < 1e-20)).any():
            return None
        at = body + 4 * size
        at += data[at: at + 1] == b"\n"
        second = second or at
    return second


def open_file(path: str):
    """(file, bytes) of a path in any store that Arrow knows; a plain path is a local one."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner), store.get_file_info(inner).size


def header(f) -> tuple[int, int, int]:
    """count, size, and where the first record is."""
    head = f.read_at(64, 0)
    count, size = map(int, head[: head.index(b"\n")].split())
    return count, size, head.index(b"\n") + 1


def starts(path: str, ranges: int) -> tuple[int, list[int]]:
    """Components of a vector, and the starts of about ``ranges`` ranges with the end of the file behind them."""
    f, total = open_file(path)
    with f:
        _, size, first = header(f)
        record = 4 * size + WORD_BYTES + 2
        found = [first]
        for k in range(1, ranges):
            cut = first + (total - first) * k // ranges
            if cut <= found[-1]:
                continue
            near = f.read_at(min((CHAIN + 2) * record, total - cut), cut)
            last = cut + len(near) == total
            seen = (follows(near, i, size, last) for i in range(min(record, len(near))))
            at = next((i for i in seen if i is not None), None)
            if at is not None and found[-1] < cut + at < total:
                found.append(cut + at)
    return size, [*found, total]


@dataclass
class Range(InputPartition):
    path: str
    size: int
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, path: str, ranges: int):
        self.path, self.ranges = path, ranges

    def partitions(self):
        size, cuts = starts(self.path, self.ranges)
        return [Range(self.path, size, a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, part: Range):
        import numpy as np
        import pyarrow as pa

        f, _ = open_file(part.path)
        with f:
            data, base, at, words, vectors = b"", part.start, 0, [], []

            def batch():
                flat = np.concatenate(vectors).astype(float) if vectors else np.empty(0)
                ends = np.arange(len(words) + 1, dtype=np.int32) * part.size
                return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.ListArray.from_arrays(ends, flat)], ["word", "vec"])

            while base + at < part.end:
                if len(data) - at < WORD_BYTES + 4 * part.size + 2 and base + len(data) < part.end:
                    base, data, at = base + at, data[at:], 0
                    data += f.read_at(min(BLOCK, part.end - base - len(data)), base + len(data))
                if data[at:] == b"\n":
                    break
                try:
                    blank = word_at(data, at, len(data))
                    if blank + 1 + 4 * part.size > len(data):
                        raise NoStart("a vector runs over the end of its range")
                except NoStart as e:
                    raise ValueError(f"{part.path}: {e} at byte {base + at} of the range {part.start}-{part.end}; read it with ranges=1") from None
                words.append(data[at:blank].removeprefix(b"\n").decode())
                vectors.append(np.frombuffer(data, "<f4", part.size, blank + 1))
                at = blank + 1 + 4 * part.size
                if data[at: at + 1] == b"\n":
                    at += 1
                if len(words) == ROWS:
                    yield batch()
                    words, vectors = [], []
            yield batch()


class WordVectors(DataSource):
    """``spark.read.format("wordvectors").load(path)``: word, vec; the option ``ranges`` says into how many byte ranges the file is cut."""

    @classmethod
    def name(cls):
        return "wordvectors"

    def schema(self):
        return "word string, vec array<double>"

    def reader(self, schema):
        return Reader(self.options["path"], int(self.options.get("ranges", 1)))


def word_vectors_binary(spark: SparkSession, path: str, ranges: int | None = None) -> DataFrame:
    """word, vec of a file in the binary format, in parallel: a range for each 64 MB, or ``ranges`` of them.

    A range holds one block of bytes and one batch of rows at a time. A file that ends within a record is an error; an empty one (count 0) has no rows.
    """
    from ..session import ship_package

    ship_package(spark)
    spark.dataSource.register(WordVectors)
    if ranges is None:
        f, total = open_file(path)
        f.close()
        ranges = max(1, -(-total // (1 << 26)))
    return spark.read.format("wordvectors").option("ranges", ranges).load(path)
