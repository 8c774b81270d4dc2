"""Conversation prefix tries: a double array per shard of sorted conversations, shared upper nodes merged globally."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costbook.llm.rows import small
from costbook.session import settle

TURNS = 1 << 20  # turns of a shard, more only if one conversation has more
PIECE = 8192  # ids of a node's list that are held at once
TRIES = 256  # free places tried for a node of several children before it goes to the end of the arrays
TURN = 16  # bytes of a turn's digest
ROOT = b"\0" * TURN
NONE = hashlib.sha256(b"").hexdigest()
FREE, TOP = -1, -2
NODE, UPPER, IDS = 0, 1, 2

FIELDS = (("kind", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), ("parent_conv_id", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("chars", pa.int64()),
          ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()))
SCHEMA = pa.schema(FIELDS)
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns (digest, chars) of each conversation in order; the digest names role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.length(text).cast("long").alias("chars")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["digest"], x["chars"])).alias("turns"))


def rebuilt(convs: DataFrame, group: int = 100, longest: int = 6) -> DataFrame:
    """Conversations that share heads: c takes the first h turns of conversation c - c % group, h = crc32(c) % longest, for its own."""
    first = F.col("conv_id") - F.col("conv_id") % group
    heads = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, longest - 1).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest
    none = F.slice("turns", 1, 0)
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h.cast("int")), F.slice("turns", (h + 1).cast("int"), F.size("turns")))
    return convs.join(heads, first == F.col("first"), "left").select("conv_id", turns.alias("turns"))


class DoubleArray:
    """A trie over codes 1, 2, ...: the child of state s by code c is slot base[s] + c if check there is s."""

    def __init__(self, size: int):
        self.base = np.zeros(size, np.int64)
        self.check = np.full(size, FREE, np.int64)
        self.check[0] = TOP
        self.low, self.end = 1, 1  # no slot before low is free, all from the end on are

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size - len(self.check), len(self.check))
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, FREE, np.int64)])

    def _free(self, n: int) -> np.ndarray:
        """The first free slots: those before the end, then as many from there that there are ``n``."""
        found, got, at = [], 0, self.low
        while at < self.end and got < n:
            to = min(self.end, at + max(4 * n, 1024))
            found.append(at + np.flatnonzero(self.check[at:to] == FREE))
            got, at = got + len(found[-1]), to
        out = np.concatenate([*found, np.arange(self.end, self.end + max(n - got, 0))])[:n]
        self.low = int(out[0]) if n else self.low
        return out

    def add(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Slots of new nodes (parent's slot, code), one level below nodes without children; nodes of one parent stand together."""
        slots = np.empty(len(codes), np.int64)
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        n = np.diff(np.r_[first, len(codes)])
        for k in first[n > 1][np.argsort(-n[n > 1], kind="stable")]:
            own = codes[k:k + n[first.searchsorted(k)]]
            steps = own - own.min()
            self._room(self.end + TRIES + steps.max() + 1)
            tried = self._free(max(1, min(TRIES, (1 << 20) // len(steps))))
            fits = (self.check[tried[:, None] + steps] == FREE).all(1)
            at = tried[fits.argmax()] if fits.any() else self.end
            slots[k:k + len(own)] = at + steps
            self._take(parents[k], at - own.min(), slots[k:k + len(own)])
        alone = first[n == 1]
        at = self._free(len(alone))
        slots[alone] = at
        if len(at):
            self._room(at[-1] + 1)
            self._take(parents[alone], at - codes[alone], at)
        return slots

    def _take(self, parents, bases, slots: np.ndarray) -> None:
        self.base[parents] = bases
        self.check[slots] = parents
        self.end = max(self.end, slots.max() + 1)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        slots = self.base[states] + codes
        if not (self.check[slots] == states).all():
            raise AssertionError("the trie lacks a turn")
        return slots


class Shard:
    """Distinct conversations of one lexicographic range, to be packed into one double array."""

    def __init__(self):
        self.names: list[bytes] = []
        self.chars: list[np.ndarray] = []
        self.n: list[int] = []
        self.least: list[int] = []
        self.ends: list[str | None] = []
        self.turns = 0

    def add(self, name: bytes, chars: np.ndarray, n: int, least: int, ends: str | None) -> None:
        self.names.append(name)
        self.chars.append(chars)
        self.n.append(n)
        self.least.append(least)
        self.ends.append(ends)
        self.turns += len(chars)

    def nodes(self) -> pa.RecordBatch:
        """A row per node.  A node on the way to the first or last conversation may go on in other shards: it has kind UPPER and only
        what hangs below it without further such nodes; the others are whole."""
        lengths = np.array([len(x) for x in self.chars])
        starts = np.cumsum(lengths) - lengths
        deepest = int(lengths.max())
        depth_of = np.arange(self.turns) - np.repeat(starts, lengths)
        # dense ids in order of depth, so that those of one node's children lie close
        by_depth = np.argsort(depth_of, kind="stable")
        _, seen, code = np.unique(np.frombuffer(b"".join(self.names), f"S{TURN}")[by_depth], return_index=True, return_inverse=True)
        codes = np.empty(self.turns, np.int64)
        codes[by_depth] = np.argsort(np.argsort(seen))[code] + 1
        chars = np.concatenate(self.chars) if self.turns else np.empty(0, np.int64)
        every = np.arange(len(lengths))

        trie = DoubleArray(2 * self.turns + 2)
        state = np.zeros(len(lengths), np.int64)
        active = every
        for d in range(deepest):
            active = active[lengths[active] > d]
            own, c = state[active], codes[starts[active] + d]
            new = np.r_[True, (own[1:] != own[:-1]) | (c[1:] != c[:-1])]
            state[active] = trie.add(own[new], c[new])[np.cumsum(new) - 1]

        size = len(trie.check)
        total, kids, leaves, saved, last = (np.zeros(size, np.int64) for _ in range(5))
        least = np.full(size, np.iinfo(np.int64).max)
        upper = np.zeros(size, bool)
        n, first_id = np.array(self.n, np.int64), np.array(self.least, np.int64)
        state[:] = 0
        active, levels, ways = every, [], ([], [])
        for d in range(deepest + 1):
            here = state[active]
            np.add.at(total, here, n[active])
            np.minimum.at(least, here, first_id[active])
            if d:
                last[here] = chars[starts[active] + d - 1]
            levels.append(np.unique(here))
            for way, end in zip(ways, (0, len(lengths) - 1)):
                if lengths[end] >= d:
                    way.append(state[end])
            active = active[lengths[active] > d]
            state[active] = trie.step(state[active], codes[starts[active] + d])
        for way in ways:
            upper[way] = True
        for slots in levels[:0:-1]:
            slots = slots[~upper[slots]]
            leaves[slots] += kids[slots] == 0
            saved[slots] += (total[slots] - 1) * last[slots]
            for sums, own in ((kids, 1), (leaves, leaves[slots]), (saved, saved[slots])):
                np.add.at(sums, trie.check[slots], own)

        keys: dict[int, bytes] = {}
        for way, end in zip(ways, (0, -1)):
            key, name = ROOT, self.names[end]
            for d, slot in enumerate(way):
                key = hashlib.md5(key + name[TURN * (d - 1):TURN * d]).digest() if d else ROOT
                keys[int(slot)] = key
        ends = {int(s): x for s, x in zip(state, self.ends) if x is not None}
        slots = np.concatenate(levels)
        depth = np.repeat(np.arange(len(levels)), [len(x) for x in levels])
        above = trie.check[slots]
        inner = (above >= 0) & ~upper[np.maximum(above, 0)]
        names = [keys.get(s) for s in slots.tolist()]
        return pa.RecordBatch.from_arrays([
            pa.array(np.where(upper[slots], UPPER, NODE).astype(np.int32)), pa.array(names, pa.binary()), pa.array([keys.get(s) for s in above.tolist()], pa.binary()),
            pa.array(least[np.maximum(above, 0)], mask=~inner), pa.array(least[slots]), pa.array(depth), pa.array(last[slots]), pa.array(total[slots]), pa.array(kids[slots]), pa.array(leaves[slots]),
            pa.array(saved[slots]), pa.array([ends.get(s) for s in slots.tolist()], pa.string())], schema=SCHEMA)


def chain(name: bytes) -> bytes:
    """The key of the node that a whole conversation ends at."""
    key = ROOT
    for k in range(0, len(name), TURN):
        key = hashlib.md5(key + name[k:k + TURN]).digest()
    return key


class Ids:
    """The ascending ids of one conversation text: hashed at once where the task has all of them, else given out in pieces."""

    def __init__(self, name: bytes, chars: np.ndarray, alone: bool):
        self.name, self.chars, self.alone = name, chars, alone
        self.n, self.least, self.held, self.key = 0, None, [], None

    def add(self, conv_id: int) -> pa.RecordBatch | None:
        self.least = conv_id if self.least is None else self.least
        self.n += 1
        self.held.append(conv_id)
        return self.piece() if len(self.held) == PIECE else None

    def piece(self) -> pa.RecordBatch:
        self.alone = False
        self.key = self.key or chain(self.name)
        row = {"kind": IDS, "key": self.key, "conv_id": self.held[0], "ends": ",".join(map(str, self.held))}
        self.held = []
        return pa.RecordBatch.from_pylist([row], schema=SCHEMA)


def shard_nodes(named: DataFrame, turns: int = TURNS) -> DataFrame:
    """Nodes and pieces of id lists of all shards; ``named`` has (name, conv_id, chars), sorted within ranges of (name, conv_id)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = Shard(), None

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            # the first and the last text of a task may have ids in other tasks
            if now.held and (last or not now.alone):
                yield now.piece()
            ends = hashlib.sha256(",".join(map(str, now.held)).encode()).hexdigest() if now.held else None
            shard.add(now.name, now.chars, now.n, now.least, ends)

        for b in batches:
            chars = b.column(2)
            offsets, values = chars.offsets.to_numpy(), chars.values.to_numpy(zero_copy_only=False)
            for k, (name, conv_id) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if now is None or name != now.name:
                    alone = now is not None
                    if now is not None:
                        yield from close(False)
                        if shard.turns + len(name) // TURN > turns:
                            yield shard.nodes()
                            shard = Shard()
                    now = Ids(name, values[offsets[k]:offsets[k + 1]], alone)
                if (piece := now.add(conv_id)) is not None:
                    yield piece
        if now is not None:
            yield from close(True)
            yield shard.nodes()

    types = ", ".join(f"{n} {'int' if t == pa.int32() else 'long' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for n, t in FIELDS)
    return named.mapInArrow(work, types)


def list_digests(pieces: DataFrame) -> DataFrame:
    """(key, ends): the digest of each list whose pieces (key, conv_id, ends) come from several tasks.  A list's bytes must pass
    one hash in order, so they stream through one task, a piece at a time."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for b in batches:
            done = []
            for k, part in zip(b.column(0).to_pylist(), b.column(1)):
                if k == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                digest.update(part.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], ["key", "list"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "list"])

    return pieces.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ends").mapInArrow(work, "key binary, list string")


def merge_upper(upper: DataFrame) -> DataFrame:
    """Upper nodes with what all of them below have: sums go up in order of depth.  There are two ways for each shard, so one
    task holds them: about a dozen rows for each million turns."""
    names = [c for c in SCHEMA.names if c != "kind"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, below = [], defaultdict(lambda: [0, 0, 0])
        for b in batches:
            for r in b.to_pylist():
                kids, leaves, saved = (x + r[c] for x, c in zip(below.pop(r["key"], (0, 0, 0)), ("n_children", "n_leaves", "saved_tokens")))
                r |= {"n_children": kids, "n_leaves": leaves + (kids == 0), "saved_tokens": saved + (r["n_convs"] - 1) * r["chars"]}
                if r["parent"] is not None:
                    for k, x in enumerate((1, r["n_leaves"], r["saved_tokens"])):
                        below[r["parent"]][k] += x
                rows.append(r)
        ids = {r["key"]: r["conv_id"] for r in rows}
        for r in rows:
            r["parent_conv_id"] = ids.get(r["parent"])
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([SCHEMA.field(c) for c in names]))

    shape = upper.select(*names)
    ordered = shape.repartition(1).sortWithinPartitions(F.col("depth").desc())
    return ordered.mapInArrow(work, shape.schema)


def prefix_nodes(convs: DataFrame, turns: int = TURNS) -> DataFrame:
    """RESULT for every node of the trie of ``convs`` (conv_id, turns as ``conversations`` gives them).

    A node is a distinct sequence of first turns, the root the empty one.  conv_id is its smallest member, that is
    conversation that starts with it; n_leaves and saved_tokens count its subtree, itself included; saved_tokens is what members after the
    first need not repeat; ends_sha256 hashes the ids of the members that end there.

    Conversations are dealt by ranges of their whole sequence, then id, so a first turn, or a text, of a third of all rows spreads over
    tasks.  A task packs its sorted rows shard by shard into a double array (BASE and CHECK over the shard's dense turn ids) and walks
    it for the nodes' sums.  Only nodes on a shard's first and last way can lie in other shards too; these are merged by the
    digest of their prefix.  A conversation is held whole, 24 bytes a turn, as a row is.

    Rows without conv_id belong to no conversation and are left out; null roles and texts are empty; turns come null first, those of one number by
    digest; repeated rows are repeated turns; other columns are ignored; no conversation gives no node.
    """
    name = F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), ""))
    named = settle(convs.select(name.alias("name"), "conv_id", F.transform("turns", lambda x: x["chars"]).alias("chars")))
    dealt = named.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    found = settle(shard_nodes(dealt, turns))
    lists = list_digests(found.where(F.col("kind") == IDS))
    kept = {"parent": F.max, "conv_id": F.min, "depth": F.max, "chars": F.max, "n_convs": F.sum, "n_children": F.sum, "n_leaves": F.sum, "saved_tokens": F.sum, "ends": F.max}
    upper = found.where(F.col("kind") == UPPER).groupBy("key").agg(*[f(c).alias(c) for c, f in kept.items()])
    upper = upper.join(lists, "key", "left").withColumn("ends", F.coalesce("ends", "list")).drop("list").withColumn("parent_conv_id", F.lit(None).cast("long"))
    merged = settle(merge_upper(upper))
    inner = found.where(F.col("kind") == NODE)
    above = small(merged.select(F.col("key").alias("above"), F.col("conv_id").alias("above_conv_id")))
    joined = inner.where("parent is not null").join(above, F.col("parent") == F.col("above")).withColumn("parent_conv_id", F.col("above_conv_id"))
    parts = [x.withColumn("ends_sha256", F.coalesce("ends", F.lit(NONE))).select(*RESULT) for x in (merged, inner.where("parent is null"), joined)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of an ASCII text."""
    step = "list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, 3988292384::BIGINT * (c & 1)))"
    codes = f"list_transform(range(1, len({text}) + 1), lambda k: ascii(substr({text}, k::INT, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {step}), 4294967295::BIGINT)"


# Every member is paired with each of its own prefixes, and every node with each node above it.
SQL = f"""
WITH turn AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS first, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM turn),
both_parts AS (
  SELECT c.conv_id, t.k, 0 AS part, t.role, t.text FROM conv c JOIN turn t ON t.conv_id = c.first AND t.k <= c.h
  UNION ALL SELECT c.conv_id, t.k, 1, t.role, t.text FROM conv c JOIN turn t ON t.conv_id = c.conv_id AND t.k > c.h),
built AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d, md5(len(role) || ':' || role || text) AS name, len(text) AS chars FROM both_parts),
way AS (SELECT conv_id, d, chars, string_agg(name, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS key FROM built
  UNION ALL SELECT conv_id, 0, 0, '' FROM conv),
ends AS (SELECT conv_id, max_by(key, d) AS key FROM way GROUP BY conv_id),
lists AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM ends GROUP BY key),
node AS (SELECT key, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved FROM way GROUP BY key),
up AS (SELECT *, CASE WHEN depth > 0 THEN left(key, 32 * (depth - 1)) END AS parent FROM node),
kids AS (SELECT parent AS key, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY parent),
pair AS (SELECT DISTINCT a.key AS top, b.key AS key FROM way a JOIN way b ON a.conv_id = b.conv_id AND a.d <= b.d),
below AS (SELECT p.top AS key, sum(n.saved) AS saved, count(*) FILTER (k.n_children IS NULL) AS leaves FROM pair p JOIN node n ON n.key = p.key LEFT JOIN kids k ON k.key = p.key GROUP BY p.top)
SELECT u.conv_id, u.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, u.n_convs, coalesce(k.n_children, 0) AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(l.ids, '')) AS ends_sha256
FROM up u JOIN below b ON b.key = u.key LEFT JOIN node p ON p.key = u.parent AND u.depth > 0 LEFT JOIN kids k ON k.key = u.key LEFT JOIN lists l ON l.key = u.key"""
