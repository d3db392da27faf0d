"""Packing: bounded-space online best-fit packing of token sequences into windows.

Each partition keeps a fixed number of open windows. A document fills whole
windows first; its rest goes to the open window that it fits most tightly. When none has room,
the rest's head tops up the fullest window, which is emitted, and its tail is
placed anew. What is open at the end of a partition is its leftover: bounded
by the number of windows, whatever the partition held. Leftovers are merged by
the same packer, a fixed number of partitions at a time, level by level, until
one set is left; that is emitted in full windows and powers of two, which need no padding.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import prepare_workers, written

_PIECE = "start long, length long, doc_tokens long, level int, part long, window long, offset long, final boolean, ids binary"


class Packer:
    """Open windows of one task. Pieces are (doc, start, doc_tokens, ids); rows come from ``emitted`` and ``finish``."""

    def __init__(self, size: int, n_open: int):
        self.size, self.emitted, self.n = size, [], 0
        self.open = {k: [] for k in range(n_open)}
        self.room = [(size, k) for k in range(n_open)]  # sorted by room left

    def add(self, doc, start, total, ids) -> None:
        while len(ids) >= self.size:
            self._emit([(doc, start, total, ids[: self.size])])
            start, ids = start + self.size, ids[self.size:]
        while len(ids):
            at = bisect_left(self.room, (len(ids), -1))
            if at < len(self.room):
                self._put(at, (doc, start, total, ids))
                return
            left = self.room[0][0]  # none fits: top up the fullest and emit it
            self._put(0, (doc, start, total, ids[:left]))
            start, ids = start + left, ids[left:]

    def _put(self, at: int, piece) -> None:
        left, k = self.room.pop(at)
        self.open[k].append(piece)
        left -= len(piece[3])
        if left == 0:
            self._emit(self.open[k])
            self.open[k], left = [], self.size
        insort(self.room, (left, k))

    def _emit(self, pieces, final: bool = True) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            self.emitted.append((doc, start, len(ids), total, self.n, offset, final, ids))
            offset += len(ids)
        self.n += 1

    def leftover(self) -> None:
        """The open windows, to be merged with those of other tasks."""
        for _, k in sorted(self.room):
            if self.open[k]:
                self._emit(self.open[k], final=False)

    def finish(self) -> None:
        """All that is open, in full windows and then powers of two."""
        rest = [p for _, k in sorted(self.room) for p in self.open[k]]
        total = sum(len(p[3]) for p in rest)
        sizes = [self.size] * (total // self.size) + [1 << b for b in range(self.size.bit_length(), -1, -1) if (total % self.size) >> b & 1]
        for size in sizes:
            pieces, need = [], size
            while need:
                doc, start, n, ids = rest.pop(0)
                pieces.append((doc, start, n, ids[:need]))
                if len(ids) > need:
                    rest.insert(0, (doc, start + need, n, ids[need:]))
                need -= len(pieces[-1][3])
            self._emit(pieces)


def _batch(rows: list, level: int, part: int, doc_type, schema):
    import pyarrow as pa

    cols = list(zip(*rows)) if rows else [[] for _ in range(8)]
    return pa.RecordBatch.from_arrays([
        pa.array(cols[0], doc_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()),
        pa.array([level] * len(rows), pa.int32()), pa.array([part] * len(rows), pa.int64()), pa.array(cols[4], pa.int64()),
        pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.bool_()), pa.array([np.asarray(x, "<u4").tobytes() for x in cols[7]], pa.binary()),
    ], schema)


_NAMES = ["doc_id", "start", "length", "doc_tokens", "level", "part", "window", "offset", "final", "ids"]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 2048, n_open: int = 32, end_id: int = 1,
         fan_in: int = 32, paths: tuple[str, str | None] | None = None) -> DataFrame:
    """Pieces of all texts: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    A document is the ids of its text, then ``end_id``; a null or empty text is ``end_id`` alone. Every id lies in one piece.
    Offsets within a sequence are gapless from 0. Every sequence is full (``size``) or a power of two
    long. Repeated rows are packed as often as they occur; null ids pass through; other columns are
    dropped; an empty table gives an empty result. ``n_open`` windows are open in a task,
    ``fan_in`` tasks' leftovers are merged at a time: memory is bounded by a batch of texts, the longest document and
    ``fan_in * n_open * size`` ids. sequence_id holds level, task and window number.
    """
    prepare_workers(docs.sparkSession)
    json_path, ranks = paths or tokens.default_paths()
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, {_PIECE}"

    def first(batches):
        encode, packer, part = tokens.encoder(json_path, ranks), Packer(size, n_open), TaskContext.get().partitionId()
        doc_type = None
        for b in batches:
            doc_type = b.schema.field(0).type
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(t.as_py()), np.uint32(end_id))
                packer.add(doc, 0, len(ids), ids)
            yield _batch(packer.emitted, 0, part, doc_type, _NAMES)
            packer.emitted = []
        if doc_type is not None:
            packer.leftover()
            yield _batch(packer.emitted, 0, part, doc_type, _NAMES)

    level = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(first, schema), "pieces")
    done = level.where("final")
    parts = level.where("NOT final").agg(F.max("part")).first()[0]
    k = 0
    while parts is not None:
        k, last = k + 1, parts < fan_in
        level = written(_merge(level.where("NOT final"), k, size, n_open, fan_in, last, schema), "pieces")
        done = done.unionByName(level.where("final"))
        parts = None if last else parts // fan_in
    return done.select(
        "doc_id", "start", "length", "doc_tokens",
        (F.col("level").cast("bigint") * (1 << 56) + F.col("part") * (1 << 32) + F.col("window")).alias("sequence_id"),
        "offset", "ids",
    )


def _merge(left: DataFrame, level: int, size: int, n_open: int, fan_in: int, last: bool, schema: str) -> DataFrame:
    def merge(key, t):
        import pyarrow as pa

        t = t.sort_by([("part", "ascending"), ("window", "ascending"), ("offset", "ascending")])
        packer = Packer(size, n_open)
        for doc, start, n, ids in zip(*(t.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
            packer.add(doc, start, n, np.frombuffer(ids, "<u4"))
        packer.finish() if last else packer.leftover()
        return pa.Table.from_batches([_batch(packer.emitted, level, key[0].as_py(), t.schema.field("doc_id").type, _NAMES)])

    return left.withColumn("g", F.floor(F.col("part") / fan_in)).groupBy("g").applyInArrow(merge, schema)
