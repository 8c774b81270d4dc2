"""Merkle manifest of a dataset by time-forward processing: digests go up, proofs come down, through queues ordered by label."""

from __future__ import annotations

import hashlib
import heapq
import pickle
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from costbook.operators.ordered import numbered
from costbook.session import scratch_path, settle

FANOUT = 8
LEVELS = 4  # of a block, the subtree that one task sweeps: at most FANOUT**LEVELS leaves
HELD = 1 << 16  # messages of a queue in memory
CHUNK = 1024  # messages that are read back from a file at once
RECORD = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(column: Column) -> Column:
    """A value with its length in bytes before it, so that no two records look alike; of null a dash."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def record_digest(text: Column) -> Column:
    """SHA-256 in hex of a record of RECORD whose text is ``text``."""
    return F.sha2(F.concat(*(encoded(text if c == "text" else F.col(c)) for c in RECORD)).cast("binary"), 256)


class LabelQueue:
    """Messages in order of (label, order).  At most ``held`` are in memory; when they are more, all of them go to a file of ``folder``
    in order, and reading merges the files with what is in memory."""

    def __init__(self, folder: str, held: int = HELD):
        self.folder, self.held = folder, held
        self.near: list[tuple] = []
        self.heads: list[tuple] = []
        self.files: list[Iterator[tuple]] = []

    def push(self, label: int, order: int, what: object) -> None:
        heapq.heappush(self.near, (label, order, what))
        if len(self.near) > self.held:
            self._spill()

    def _spill(self) -> None:
        fs, path = pafs.FileSystem.from_uri(self.folder) if "://" in self.folder else (pafs.LocalFileSystem(), self.folder)
        fs.create_dir(path)
        name = f"{path}/{uuid.uuid4().hex}"
        self.near.sort()
        with fs.open_output_stream(name) as out:
            for k in range(0, len(self.near), CHUNK):
                pickle.dump(self.near[k:k + CHUNK], out)
        self.near = []
        self.files.append(self._read(fs, name))
        self._next(len(self.files) - 1)

    @staticmethod
    def _read(fs: pafs.FileSystem, name: str) -> Iterator[tuple]:
        with fs.open_input_stream(name) as file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    break
        fs.delete_file(name)

    def _next(self, k: int) -> None:
        head = next(self.files[k], None)
        if head is not None:
            heapq.heappush(self.heads, (*head[:2], k, head[2]))

    def first(self) -> int | None:
        """The least label that a message waits for."""
        return min((x[0][0] for x in (self.near, self.heads) if x), default=None)

    def take(self, label: int) -> list[tuple[int, object]]:
        """(order, what) of all messages to the label, which must be the first."""
        out = []
        while self.near and self.near[0][0] == label:
            out.append(heapq.heappop(self.near)[1:])
        while self.heads and self.heads[0][0] == label:
            _, order, k, what = heapq.heappop(self.heads)
            out.append((order, what))
            self._next(k)
        return sorted(out, key=lambda x: x[0])


def height(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    n = 0
    while leaves > 1:
        leaves, n = -(-leaves // FANOUT), n + 1
    return n


class Block:
    """Up to FANOUT**levels neighbouring leaves and the ``levels`` levels above them.

    The label of a node is its time in a walk from left to right in which children come before their parents: its last leaf, then its
    level.  So few messages wait at any time: less than FANOUT for each level.
    """

    def __init__(self, leaves: int, levels: int):
        self.leaves, self.levels, self.step = leaves, levels, levels + 1

    def label(self, level: int, index: int) -> int:
        return min((index + 1) * FANOUT**level, self.leaves) * self.step + level

    def place(self, label: int) -> tuple[int, int]:
        """Level and index of the node of a label."""
        level = label % self.step
        return level, (label // self.step - 1) // FANOUT**level

    def forward(self, digests: list[str], queue: LabelQueue) -> tuple[str, list[tuple[int, list[str]]]]:
        """The digest of the top node, and (label, digests of the children) of all nodes in order of their labels."""
        tape, top = [], digests[0]
        for leaf, digest in enumerate(digests):
            label = self.label(0, leaf)
            level, index = 0, leaf
            while True:
                if level == self.levels:
                    top = digest
                else:
                    queue.push(self.label(level + 1, index // FANOUT), index % FANOUT, digest)
                label = queue.first()
                if label is None or label >= (leaf + 2) * self.step:
                    break
                level, index = self.place(label)
                run = [x for _, x in queue.take(label)]
                tape.append((label, run))
                digest = sha("".join(run))
        return top, tape

    def backward(self, tape: list[tuple[int, list[str]]], way: tuple | None, queue: LabelQueue) -> Iterator[tuple[int, tuple | None]]:
        """(leaf, way up) of all leaves, the last first.  A way is (siblings before, siblings after, the parent's way)."""
        queue.push(-self.label(self.levels, 0), 0, way)
        k = len(tape)
        while (label := queue.first()) is not None:
            (_, way), = queue.take(label)
            level, index = self.place(-label)
            if not level:
                yield index, way
                continue
            k -= 1
            node, run = tape[k]
            if node != -label:
                raise AssertionError("a node got its proof out of turn")
            for slot in range(len(run)):
                queue.push(-self.label(level - 1, index * FANOUT + slot), 0, ("".join(run[:slot]), "".join(run[slot + 1:]), way))


def steps(way: tuple | None) -> Iterator[tuple[str, str]]:
    while way is not None:
        yield way[0], way[1]
        way = way[2]


def _block() -> Column:
    return F.floor(F.col("place") / FANOUT**LEVELS).cast("long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each (tree, block), which lie together."""
    key, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            own = (r["tree"], r["block"])
            if own != key and rows:
                yield key, rows
                rows = []
            key = own
            rows.append(r)
    if rows:
        yield key, rows


def block_tops(nodes: DataFrame, folder: str) -> DataFrame:
    """(tree, block, first, top) of ``nodes`` (tree, place, digest): top is the digest LEVELS levels up, first that of the node at which the
    block alone would end, with its levels in ``levels``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, number), rows in _groups(batches):
            digests = [r["digest"] for r in rows]
            levels = height(len(digests))
            first, _ = Block(len(digests), levels).forward(digests, LabelQueue(folder))
            top = first
            for _ in range(LEVELS - levels):
                top = sha(top)
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.string()), pa.array([number], pa.int64()), pa.array([levels], pa.int32()), pa.array([first]), pa.array([top])], ["tree", "block", "levels", "first", "top"])

    rows = nodes.select("tree", _block().alias("block"), "place", "digest")
    rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    return rows.mapInArrow(work, "tree string, block long, levels int, first string, top string")


def climb(nodes: DataFrame, folder: str) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """The sweeps up from ``nodes``: (nodes, their block tops, with ``last`` where the tree ends there) of each, and (tree, subroot)."""
    sweeps, ended = [], []
    while True:
        tops = settle(block_tops(nodes, folder))
        more = settle(tops.where("block > 0").select(F.col("tree").alias("t")).distinct())
        last = tops.join(more.withColumn("m", F.lit(True)), F.col("tree").eqNullSafe(F.col("t")), "left").select(*tops.columns, F.col("m").isNull().alias("last"))
        tops = settle(last)
        sweeps.append((nodes, tops))
        ended.append(tops.where("last").select("tree", F.col("first").alias("subroot")))
        if more.isEmpty():
            out = ended[0]
            for x in ended[1:]:
                out = out.unionByName(x)
            return sweeps, settle(out)
        nodes = tops.where("not last").select("tree", F.col("block").alias("place"), F.col("top").alias("digest"))


def descend(sweeps: list[tuple[DataFrame, DataFrame]], ways: DataFrame, folder: str) -> DataFrame:
    """(tree, block, levels, way, subroot) of the blocks of the first sweep; ``ways`` has (tree, way, subroot) of whole trees."""
    down = None
    for nodes, tops in reversed(sweeps):
        whole = tops.where("last").join(ways.withColumnRenamed("tree", "t"), F.col("tree").eqNullSafe(F.col("t")))
        blocks = whole.select("tree", "block", "levels", "way", "subroot")
        if down is not None:
            blocks = blocks.unionByName(down.select("tree", F.col("place").alias("block"), F.lit(LEVELS).alias("levels"), "way", "subroot"))
        if nodes is sweeps[0][0]:
            return settle(blocks)
        down = proofs(nodes, blocks, folder, "tree string, place long, way " + PATH + ", subroot string", _ways)
    raise ValueError("no sweeps")


def _ways(head: dict, rows: list[dict], found: Iterator[tuple[int, tuple | None]]) -> dict[str, list]:
    out: dict[str, list] = {"tree": [], "place": [], "way": [], "subroot": []}
    for leaf, way in found:
        out["tree"].append(head["tree"])
        out["place"].append(rows[leaf]["place"])
        out["way"].append([{"before": b, "after": a} for b, a in steps(way)])
        out["subroot"].append(head["subroot"])
    return out


def proofs(nodes: DataFrame, blocks: DataFrame, folder: str, result: str, finish: Callable[[dict, list[dict], Iterator], dict[str, list]]) -> DataFrame:
    """The reversed sweep over each block: its nodes are rebuilt, then its own way up is handed down to the leaves."""
    types = pa.schema([(f.name, {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}.get(f.dataType.typeName(), pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))))
                       for f in StructType.fromDDL(result)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (head, *rows) in _groups(batches):
            way = None
            for x in reversed(head["way"]):
                way = (x["before"], x["after"], way)
            block = Block(len(rows), head["levels"])
            _, tape = block.forward([r["digest"] for r in rows], LabelQueue(folder))
            yield pa.RecordBatch.from_pydict(finish(head, rows, block.backward(tape, way, LabelQueue(folder))), schema=types)

    # a block's way comes as its first row, once, not on every leaf
    heads = blocks.withColumn("place", F.lit(-1).cast("long"))
    rows = nodes.withColumn("block", _block()).unionByName(heads, allowMissingColumns=True)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place").mapInArrow(work, result)


def records(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """(tree, doc_id, digest, altered): each row's lang, its digest, and that of its altered text where ``tamper`` says so."""
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    altered = F.lit(None).cast("string") if tamper is None else F.when(tamper, record_digest(lower))
    return docs.select(F.col("lang").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), record_digest(F.col("text")).alias("digest"), altered.alias("altered"))


def tampered(third: int = 3) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % third == 0


def verify(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """RESULT for every row of ``docs`` (RECORD): its leaf, the subroot of its lang, the root, its proof's hash, and the root that its record,
    altered where ``tamper`` holds, leads to with the proof.

    A leaf is the digest of a record.  Per lang, leaves in order of doc_id (null first, then by digest) are joined by eights until one
    node is left; the langs' nodes (null first) are joined likewise.  Place numbers come from ranges of (lang, doc_id), so a lang of a third of all
    rows spreads over tasks.  A sweep up turns each block of FANOUT**LEVELS leaves into one digest, and so on with these; a sweep down hands each
    block the siblings above it, once, and in the block to its leaves.  Texts are read once and never shuffled.

    Nulls are written as a dash and differ from empty values; a null lang is a lang; repeated rows are leaves of their own and have
    neighbouring places; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "queue")
    placed = numbered(settle(records(docs, tamper)), [F.col("doc_id").asc_nulls_first(), F.col("digest")], "place", ["tree"])
    leaves = settle(placed.withColumn("place", F.col("place") - 1))
    sweeps, subroots = climb(leaves.select("tree", "place", "digest"), folder)
    trees = settle(numbered(subroots, [F.col("tree").asc_nulls_first()], "place").withColumn("place", F.col("place") - 1))
    above, roots = climb(trees.select(F.lit("").alias("tree"), "place", F.col("subroot").alias("digest")), folder)
    top = roots.select("tree", F.array().cast(PATH).alias("way"), "subroot")
    blocks = descend(above, top, folder)
    down = proofs(above[0][0], blocks, folder, "tree string, place long, way " + PATH + ", subroot string", _ways)
    ways = settle(trees.join(down.select("place", "way"), "place").select("tree", "way", "subroot"))
    found = roots.first()
    root = found["subroot"] if found else None

    def finish(head: dict, rows: list[dict], found: Iterator[tuple[int, tuple | None]]) -> dict[str, list]:
        out: dict[str, list] = {c.split()[0]: [] for c in RESULT.split(", ")}
        for leaf, way in found:
            row, path = rows[leaf], list(steps(way))
            digest = row["altered"] or row["digest"]
            for before, after in path:
                digest = sha(before + digest + after)
            values = (row["doc_id"], row["digest"], head["subroot"], root, sha("".join(b + a for b, a in path)), digest, digest == root)
            for column, value in zip(out.values(), values):
                column.append(value)
        return out

    return proofs(leaves, descend(sweeps, ways, folder), folder, RESULT, finish)


def _unrolled(first: str, levels: int) -> str:
    """SQL views of a forest's levels: {first}0 has (tree, p, n, digest, f, proof) for each leaf; {first}{levels} the roots' folds."""
    out = []
    for k in range(levels):
        a, b = f"{first}{k}", f"{first}{k + 1}"
        out.append(f"""
{a}_run AS (SELECT tree, p // 8 AS p, n, string_agg(digest, '' ORDER BY p) AS run FROM (SELECT DISTINCT tree, p, n, digest FROM {a}) WHERE n > 1 GROUP BY ALL),
{b} AS (
  SELECT l.leaf_no, l.tree, r.p, CAST(ceil(l.n / 8) AS BIGINT) AS n, sha256(r.run) AS digest,
    sha256(left(r.run, 64 * (l.p % 8)) || l.f || substr(r.run, 64 * (l.p % 8) + 65)) AS f,
    l.proof || left(r.run, 64 * (l.p % 8)) || substr(r.run, 64 * (l.p % 8) + 65) AS proof
  FROM {a} l JOIN {a}_run r ON r.tree IS NOT DISTINCT FROM l.tree AND r.p = l.p // 8
  UNION ALL SELECT leaf_no, tree, p, n, digest, f, proof FROM {a} WHERE n = 1)""")
    return ",".join(out)


def _record_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in (*RECORD[:4], text)) + ")"


def sql(crc32: str) -> str:
    """The levels one after another; seven of them hold two million leaves a lang, three hold 512 langs."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH leaf AS (
  SELECT doc_id, lang, {_record_sql("text")} AS leaf, CASE WHEN {crc32} % 3 = 0 THEN {_record_sql(lower)} END AS altered FROM documents),
placed AS (SELECT *, row_number() OVER () AS leaf_no, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
own0 AS (SELECT leaf_no, lang AS tree, p, n, leaf AS digest, coalesce(altered, leaf) AS f, '' AS proof FROM placed),{_unrolled("own", 7)},
langs AS (SELECT tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT tree FROM own7)),
top0 AS (SELECT o.leaf_no, 0 AS tree, l.p, l.n, o.digest, o.f, o.proof FROM own7 o JOIN langs l ON l.tree IS NOT DISTINCT FROM o.tree),{_unrolled("top", 3)}
SELECT p.doc_id, p.leaf, o.digest AS subroot, t.digest AS root, sha256(t.proof) AS proof_sha256, t.f AS folded_root, t.f = t.digest AS verified
FROM placed p JOIN own7 o ON o.leaf_no = p.leaf_no JOIN top3 t ON t.leaf_no = p.leaf_no"""
