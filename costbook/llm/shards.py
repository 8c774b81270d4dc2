"""Binary token shards with a minimal perfect hash index for keyed access.

A folder of shards holds, for each task that wrote rows,

* ``<name>.ids``: the raw token ids of its documents one after the other, nothing else; unsigned
  little-endian, two bytes each where the vocabulary allows it, else four;
* ``<name>.idx``: the index, see ``Index``;

and ``manifest``, a small table with one row per shard.  Files are named per attempt, and only those
in the manifest count, so a task that is lost and run again leaves no half shard behind.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costbook.llm.tokens import worker_encoder

MANIFEST = "shard int, name string, first_key long, last_key long, has_null boolean, rows long, tokens long, width int"
GAMMA = 2  # bits per key and level of the hash
LEVELS = 64
HEAD = struct.Struct("<4sIQQQQ")  # magic, width, rows, null rows, keys, levels
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values: splitmix64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + MIX[0] * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * MIX[1]
        x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, LEVELS + 1) >> np.uint64(32)).astype(np.uint32)


class Hash:
    """Minimal perfect hash of distinct 64-bit keys: n keys to the slots 0 .. n-1.

    Each level is a bit array twice as long as the keys it is offered.  A key that is alone at its
    bit stays there; the others go on to the next level.  A slot is the number of set bits before
    the key's own.  About three bits per key, and a lookup touches two levels on average.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [at + np.cumsum(x) - 1 for x, at in zip(levels, ones)]

    @classmethod
    def build(cls, keys: np.ndarray) -> Hash:
        levels: list[np.ndarray] = []
        while len(keys):
            if len(levels) == LEVELS:
                raise ValueError("the keys are not distinct")
            size = GAMMA * len(keys) + 1
            at = (mix(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that was not there some slot or -1, which a fingerprint must tell."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = (mix(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at]
            out[left[here]] = rank[at[here]]
            left = left[~here]
        return out


class Index:
    """Index of a shard: for each slot the key's fingerprint, its first row and its number of rows
    (rows of one key lie together), and for each row where its ids begin.  Rows without a key come
    first; no lookup finds them.  The keys in order of rows serve whole scans.
    """

    def __init__(self, hash_: Hash, prints: np.ndarray, first: np.ndarray, count: np.ndarray, starts: np.ndarray, keys: np.ndarray, nulls: int, width: int):
        self.hash, self.prints, self.first, self.count = hash_, prints, first, count
        self.starts, self.keys, self.nulls, self.width = starts, keys, nulls, width

    @classmethod
    def build(cls, keys: np.ndarray, nulls: int, lengths: np.ndarray, width: int) -> Index:
        """keys: of all rows in order, the first ``nulls`` of no meaning."""
        distinct, first, count = np.unique(keys[nulls:], return_index=True, return_counts=True)
        hash_ = Hash.build(distinct)
        slot = hash_.slots(distinct)
        prints, at, n = np.empty(len(distinct), np.uint32), np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        prints[slot], at[slot], n[slot] = fingerprint(distinct), first + nulls, count
        return cls(hash_, prints, at, n, np.concatenate(([0], np.cumsum(lengths))).astype(np.int64), keys, nulls, width)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; 0 rows where the shard does not have it."""
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self.hash.slots(keys)
        hit = (slot >= 0) & (self.prints[slot] == fingerprint(keys))
        return np.where(hit, self.first[slot], 0), np.where(hit, self.count[slot], 0)

    def dump(self) -> bytes:
        parts = [HEAD.pack(b"IDX1", self.width, len(self.keys), self.nulls, len(self.prints), len(self.hash.levels))]
        parts.append(np.array([len(x) for x in self.hash.levels], "<i8").tobytes())
        parts += [np.packbits(x).tobytes() for x in self.hash.levels]
        parts += [self.prints.astype("<u4").tobytes(), *(x.astype("<i8").tobytes() for x in (self.first, self.count, self.starts, self.keys))]
        return b"".join(parts)

    @classmethod
    def load(cls, data: bytes) -> Index:
        magic, width, rows, nulls, n, n_levels = HEAD.unpack_from(data)
        if magic != b"IDX1":
            raise ValueError("not an index of token shards")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        levels = [np.unpackbits(take("u1", -(-int(size) // 8)), count=int(size)).astype(bool) for size in take("<i8", n_levels)]
        prints, first, count, starts, keys = take("<u4", n), take("<i8", n), take("<i8", n), take("<i8", rows + 1), take("<i8", rows)
        return cls(Hash(levels), prints, first, count, starts, keys, nulls, width)


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int = 2) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text), each text's with ``end`` after it, in ascending doc_id.

    A range partition of the rows becomes a shard; the session's shuffle partitions set their
    number, and rows of a repeated doc_id keep their reading order and may spread over shards, so one
    id with many rows does not meet in a task.  Null texts are empty, rows without doc_id come first,
    other columns are ignored, an empty table gives an empty manifest.  Returns the manifest.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        kind, tail = f"<u{width}", np.array([end], f"<u{width}").tobytes()
        system, folder = _files(path)
        name, out = uuid.uuid4().hex, None
        keys, lengths, nulls = [], [], 0
        for batch in batches:
            if out is None and batch.num_rows:
                system.create_dir(folder, recursive=True)
                out = system.open_output_stream(f"{folder}/{name}.ids")
            ids_ = batch.column(0)
            nulls += ids_.null_count
            keys.append(ids_.fill_null(0).to_numpy())
            for text in batch.column(1):
                ids = encoder.encode(text.as_py())
                lengths.append(len(ids) // 4 + 1)
                out.write((np.frombuffer(ids, "<u4").astype(kind).tobytes() if width == 2 else ids) + tail)
        if out is None:
            return
        out.close()
        index = Index.build(np.concatenate(keys), nulls, np.array(lengths, np.int64), width)
        with system.open_output_stream(f"{folder}/{name}.idx") as file:
            file.write(index.dump())
        known = index.keys[nulls:]
        ends = [int(known[0]), int(known[-1])] if len(known) else [None, None]
        row = [TaskContext.get().partitionId(), name, *ends, nulls > 0, len(index.keys), int(index.starts[-1]), width]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (
            pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()))], [x.split()[0] for x in MANIFEST.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = rows.withColumn("order", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("doc_id", "order").sortWithinPartitions("doc_id", "order")
    dealt.select("doc_id", "text").mapInArrow(work, MANIFEST).write.mode("error").parquet(f"{path}/manifest")
    return manifest(docs.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard, with the number of ids in the shards before it (a window over shards, not rows)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").withColumn(
        "start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_shards(spark: SparkSession, path: str, batch_bytes: int = 16 << 20) -> DataFrame:
    """All documents of a folder: doc_id, start (ids of all documents before it), n_tokens, ids (unsigned
    32-bit little-endian), shard.  Each shard is read by one task as a stream; every key is looked up in the hash index."""
    shards = manifest(spark, path)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()))],
                                          ["doc_id", "start", "n_tokens", "ids", "shard"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (x for b in batches for x in b.to_pylist()):
            system, folder = _files(path)
            with system.open_input_stream(f"{folder}/{shard['name']}.idx") as file:
                index = Index.load(file.read())
            distinct = np.unique(index.keys[index.nulls:])
            first, count = index.find(distinct)
            if int(count.sum()) + index.nulls != len(index.keys) or (index.keys[first] != distinct).any():
                raise ValueError(f"the index of shard {shard['name']} does not fit its rows")
            held, rows = 0, []
            with system.open_input_stream(f"{folder}/{shard['name']}.ids") as file:
                for row in range(len(index.keys)):
                    a, b = int(index.starts[row]), int(index.starts[row + 1])
                    ids = np.frombuffer(file.read((b - a) * index.width), f"<u{index.width}").astype("<u4").tobytes()
                    rows.append((None if row < index.nulls else int(index.keys[row]), shard["start"] + a, b - a, ids, shard["shard"]))
                    held += len(ids)
                    if held > batch_bytes:
                        yield batch(rows)
                        held, rows = 0, []
            if rows:
                yield batch(rows)

    # a shard is a unit of work of its own; the manifest has a row for each
    dealt = shards.select("shard", "name", "start").repartition(max(1, shards.count()))
    return dealt.mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary, shard int")


class Shard(NamedTuple):
    name: str
    first_key: int
    last_key: int


class Reader:
    """Keyed access to a folder: the ids of a document without a scan.

    The manifest (a row per shard) is held in memory in order of keys, so a key's shards are found by bisection; the ``held`` indexes that
    were used last are kept.  In a shard the hash gives the rows of a key, and the stored key decides after the fingerprint.
    """

    def __init__(self, spark: SparkSession, path: str, held: int = 16):
        rows = manifest(spark, path).where("first_key is not null").orderBy("shard").select("name", "first_key", "last_key")
        self.system, self.folder = _files(path)
        self.shards = [Shard(*r) for r in rows.toLocalIterator()]
        self.firsts = [s.first_key for s in self.shards]
        self.indexes: OrderedDict[str, Index] = OrderedDict()
        self.held = held

    def _index(self, name: str) -> Index:
        if name not in self.indexes:
            with self.system.open_input_stream(f"{self.folder}/{name}.idx") as file:
                self.indexes[name] = Index.load(file.read())
            if len(self.indexes) > self.held:
                self.indexes.popitem(last=False)
        self.indexes.move_to_end(name)
        return self.indexes[name]

    def __getitem__(self, key: int) -> list[np.ndarray]:
        """The ids of every row with this key, none if it is unknown."""
        # rows of one key may go on in the next shards
        last = bisect_right(self.firsts, key)
        first = last
        while first > 0 and self.shards[first - 1].last_key >= key:
            first -= 1
        out: list[np.ndarray] = []
        for shard in self.shards[first:last]:
            index = self._index(shard.name)
            at, count = (int(x[0]) for x in index.find(np.array([key], np.int64)))
            if not count or index.keys[at] != key:
                continue
            with self.system.open_input_file(f"{self.folder}/{shard.name}.ids") as file:
                for row in range(at, at + count):
                    a, b = int(index.starts[row]), int(index.starts[row + 1])
                    out.append(np.frombuffer(file.read_at((b - a) * index.width, a * index.width), f"<u{index.width}"))
        return out
