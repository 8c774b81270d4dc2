"""Harmonic packing: token ids of documents in sequences of a fixed capacity."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costbook.llm.tokens import worker_encoder

FIELDS = (("doc_id", pa.int64(), "long"), ("start", pa.int64(), "long"), ("length", pa.int64(), "long"), ("ids", pa.binary(), "binary"),
          ("doc_tokens", pa.int64(), "long"), ("sequence_id", pa.int64(), "long"), ("offset", pa.int64(), "long"), ("sequence_length", pa.int64(), "long"))
PIECES = ", ".join(f"{name} {sql}" for name, _, sql in FIELDS)


def cut(tokens: int, capacity: int, slack: int, finest: int) -> list[tuple[int, int]]:
    """Lengths of a document's pieces, each with its class: the number of pieces in a bin of that class.

    Class i holds lengths up to capacity / i, so i of them always fit.  A rest that would leave
    more than ``slack`` empty in its bin gives off a piece as long as the next class allows.
    Rests of at most capacity / finest are never cut.
    """
    out = [(capacity, 1)] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        kind = capacity // rest
        if kind >= finest or capacity - kind * rest <= slack:
            out.append((rest, kind))
            break
        piece = capacity // (kind + 1)
        out.append((piece, kind + 1))
        rest -= piece
    return out


class Bins:
    """The open bins of one worker; sequences are numbered from ``first``."""

    def __init__(self, first: int, capacity: int, slack: int, finest: int):
        self.next, self.capacity, self.slack, self.finest = first, capacity, slack, finest
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        used = sum(x[2] for x in pieces)
        length = used if used & (used - 1) == 0 else self.capacity
        offset = 0
        for doc, start, n, ids, total in pieces:
            self.rows.append((doc, start, n, ids, total, self.next, offset, length))
            offset += n
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        for n, kind in cut(total, self.capacity, self.slack, self.finest):
            bin_ = self.open[kind]
            bin_.append((doc, start, n, ids[4 * start:4 * (start + n)], total))
            start += n
            if len(bin_) == kind:
                self.close(self.open.pop(kind))

    def finish(self) -> None:
        """Bins that did not fill up are run together and cut at the capacity; what is left at last
        is cut into powers of two, which need no padding."""
        bin_, room = [], self.capacity
        rest = sum(x[2] for pieces in self.open.values() for x in pieces)
        for kind in sorted(self.open):
            for doc, start, n, ids, total in self.open[kind]:
                at = 0
                while at < n:
                    if room == self.capacity and rest < self.capacity:
                        room = 1 << (rest.bit_length() - 1)
                    take = min(room, n - at)
                    bin_.append((doc, start + at, take, ids[4 * at:4 * (at + take)], total))
                    at, room, rest = at + take, room - take, rest - take
                    if not room:
                        self.close(bin_)
                        bin_, room = [], self.capacity
        self.open.clear()


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1, slack: int | None = None, finest: int = 32, batch_bytes: int = 8 << 20) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    A row per piece: doc_id, start (its document's ids before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens (with the end id), sequence_id, offset (in the sequence, without
    gaps), sequence_length (a power of two, or the capacity after padding).  Every id of every document lies in
    exactly one piece.  A worker fills the bins of its own partition, so nothing is shuffled; it
    holds at most one open bin per class (about finest + capacity / finest classes).  A bin of class i takes i pieces.

    Null and empty texts have the end id alone; repeated rows and ids and null ids are packed as they
    are; other columns are ignored; an empty table gives no rows.
    """
    slack = capacity // 64 if slack is None else slack

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(zip(*rows), FIELDS)], [f[0] for f in FIELDS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        tail = np.array([end], "<u4").tobytes()
        bins = Bins(TaskContext.get().partitionId() << 33, capacity, slack, finest)
        held = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encoder.encode(text.as_py()) + tail
                bins.add(doc, ids)
                held += len(ids)
                if held > batch_bytes and bins.rows:
                    yield batch(bins.rows)
                    held, bins.rows = 0, []
        bins.finish()
        if bins.rows:
            yield batch(bins.rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(work, PIECES)
