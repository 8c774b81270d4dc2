"""Column blocks of long lists: items in order, a new block where the labels of the open one would outgrow it.

Where a block ends depends on where it began, so the plain way is one walk, and so short lists are packed.  A long list is cut in
chunks along its order.  Each item's block, if it began there, has a known end: the next few distinct labels tell it, and a chunk needs no more of the others
than its first and last ones.  So every chunk finds for each of its items where a chain of blocks that begins there leaves
the chunk; the chains of chunks are followed by pointer jumping, and then each chunk is walked from the state it begins in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costbook.operators.ordered import numbered
from costbook.session import settle

CHUNK = 4096
LISTED = "array<struct<label: string, at: long>>"
LISTED_TYPE = pa.list_(pa.struct([("label", pa.string()), ("at", pa.int64())]))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    key, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            own = tuple(r[k] for k in keys)
            if own != key and rows:
                yield key, rows
                rows = []
            key = own
            rows.append(r)
    if rows:
        yield key, rows


def _batch(keys: list[str], rows: list[dict], more: dict[str, pa.DataType], key_types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([*((k, key_types[k]) for k in keys), *more.items()]))


def _listed(summaries: DataFrame, keys: list[str], own: str, most: int, backwards: bool) -> DataFrame:
    """(keys, chunk, list): of each chunk the nearest ``most`` distinct labels behind it (or, backwards, before it), of its neighbours' lists."""
    order = F.col("chunk").asc() if backwards else F.col("chunk").desc()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, near = None, []
        for b in batches:
            out = []
            for r in b.to_pylist():
                group = tuple(r[k] for k in keys)
                if group != key:
                    key, near = group, []
                out.append({**{k: r[k] for k in keys}, "chunk": r["chunk"], "list": near})
                held = {x["label"] for x in r[own]}
                near = (r[own] + [x for x in near if x["label"] not in held])[:most]
            yield _batch(keys, out, {"chunk": pa.int64(), "list": LISTED_TYPE}, {k: pa.string() for k in keys})

    rows = summaries.select(*keys, "chunk", own)
    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(work, ", ".join(f"{k} string" for k in keys) + f", chunk long, list {LISTED}")


def own_labels(labels: list[str], capacity: int) -> tuple[int, list[str]]:
    """Blocks that an item takes if it begins one, and the labels that are in the last of them."""
    blocks = max(1, -(-len(labels) // capacity))
    return blocks, labels[(blocks - 1) * capacity:]


def chains(rows: list[dict], ahead: list[dict], capacity: int) -> list[dict]:
    """For each item of a chunk: where a chain of blocks that begins there leaves the chunk, how many blocks it counts until then, and
    the last beginning in the chunk with the blocks until its end.  ``ahead``: the next distinct labels behind the chunk."""
    near = [(x["label"], x["at"]) for x in ahead]
    out: dict[int, dict] = {}
    for r in reversed(rows):
        blocks, own = own_labels(r["labels"], capacity)
        seen, end = set(own), None
        for label, at in near:
            if label not in seen:
                seen.add(label)
                if len(seen) > capacity:
                    end = at
                    break
        # items without labels leave the block empty, and an empty block takes any item
        empty = not r["labels"] and end is not None and not any(at < end for _, at in near)
        step = 0 if empty else blocks
        then = out.get(end)
        if then is None:
            out[r["at"]] = {"at": r["at"], "exit": end, "blocks": step, "last": r["at"], "last_blocks": blocks - 1, "own": own}
        else:
            out[r["at"]] = {**then, "at": r["at"], "blocks": step + then["blocks"], "last_blocks": step + then["last_blocks"]}
        mine = set(r["labels"])
        near = ([(x, r["at"]) for x in r["labels"]] + [x for x in near if x[0] not in mine])[:max(capacity + 1, len(mine))]
    return list(out.values())


class Open:
    """The open block of a list: its number and the labels it holds."""

    def __init__(self, block: int = 1, held: Iterable[str] = ()):
        self.block, self.held = block, set(held)

    def take(self, wanted: list[str], capacity: int) -> Iterator[tuple[int, int]]:
        """(block, labels added there) of the next item."""
        new = [x for x in wanted if x not in self.held]
        if self.held and len(self.held) + len(new) > capacity:
            self.block, self.held, new = self.block + 1, set(), wanted
        for at in range(0, max(len(new), 1), capacity):
            if at:
                self.block, self.held = self.block + 1, set()
            taken = new[at:at + capacity]
            self.held.update(taken)
            yield self.block, len(taken)


def walk_whole(items: DataFrame, keys: list[str], order: list[Column], carried: str, capacity: int) -> DataFrame:
    """The blocks of lists that one task may hold, each in one walk; a task keeps the open block alone."""
    schema = pa.schema([*((k, pa.string()) for k in keys), (carried, pa.int64()), ("block", pa.int32()), ("kept", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, Open()
        for b in batches:
            at, blocks, kept = [], [], []
            for i, (own, wanted) in enumerate(zip(zip(*[b.column(k).to_pylist() for k in keys]), b.column("labels").to_pylist())):
                if own != group:
                    group, state = own, Open()
                for block, n in state.take(wanted, capacity):
                    at.append(i)
                    blocks.append(block)
                    kept.append(n)
            own = b.select([*keys, carried]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(blocks, pa.int32()), pa.array(kept, pa.int32())], schema=schema)

    dealt = items.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, carried, "labels")
    return dealt.mapInArrow(work, ", ".join(f"{k} string" for k in keys) + f", {carried} long, block int, kept int")


def _reached(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, number): the beginnings that the chain from item 1 comes by, with the number of their first block."""
    to = [F.col(k).alias(f"_{k}") for k in keys]
    on = lambda a, b: [F.col(a) == F.col(b), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]]
    jumps = [settle(nodes.where("exit is not null").select(*keys, "at", "exit", "blocks"))]
    while True:
        more = jumps[-1].select(*to, F.col("at").alias("_at"), F.col("exit").alias("_exit"), F.col("blocks").alias("_blocks"))
        twice = settle(jumps[-1].join(more, on("exit", "_at")).select(*keys, "at", F.col("_exit").alias("exit"), (F.col("blocks") + F.col("_blocks")).alias("blocks")))
        if twice.isEmpty():
            break
        jumps.append(twice)
    reached = settle(nodes.where("at = 1").select(*keys, "at", F.lit(1).cast("long").alias("number")))
    for jump in reversed(jumps):
        more = jump.select(*to, F.col("at").alias("_at"), "exit", "blocks")
        reached = settle(reached.unionByName(reached.join(more, on("at", "_at")).select(*keys, F.col("exit").alias("at"), (F.col("number") + F.col("blocks")).alias("number"))))
    return reached


def pack(items: DataFrame, keys: list[str], order: list[Column], carried: str, capacity: int, chunk: int = CHUNK) -> DataFrame:
    """(keys, carried, block, kept): for every item its block and how many labels it adds there.

    ``items`` (keys of strings, order, ``carried`` of longs, labels).  An item with more labels than a block holds goes on in the next
    blocks, a row in each, so no label is lost.  A list of at most ``chunk`` items is walked whole;
    a longer one, which may hold a third of all items, is worked on in chunks.
    """
    labels = F.array_distinct(F.filter(F.coalesce("labels", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    items = settle(items.withColumn("labels", labels))
    sizes = items.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_items"))
    long = settle(sizes.where(F.col("_items") > chunk).drop("_items"))
    if long.isEmpty():
        return walk_whole(items, keys, order, carried, capacity)
    listed_in = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    whole = walk_whole(items.join(long, listed_in, "left_anti"), keys, order, carried, capacity)
    return whole.unionByName(_pack_long(items.join(long, listed_in, "left_semi"), keys, order, carried, capacity, chunk))


def _pack_long(items: DataFrame, keys: list[str], order: list[Column], carried: str, capacity: int, chunk: int) -> DataFrame:
    """``pack`` for lists that are worked on in chunks."""
    placed = numbered(items, order, "at", keys).select(*keys, carried, "labels", "at")
    rows = settle(placed.withColumn("chunk", F.floor((F.col("at") - 1) / chunk).cast("long")))
    each = rows.select(*keys, "chunk", "at", F.posexplode_outer("labels").alias("nth", "label"))
    found = each.where("label is not null").groupBy(*keys, "chunk", "label").agg(F.min(F.struct("at", "nth")).alias("first"), F.max(F.struct("at", "nth")).alias("last"))
    listed = lambda c, desc: F.slice(F.transform(F.sort_array(F.collect_list(F.struct(c, "label")), asc=not desc), lambda x: F.struct(x["label"], x[c]["at"].alias("at"))), 1, capacity + 1)
    summaries = rows.select(*keys, "chunk").distinct().join(
        found.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("chunk").alias("_chunk")).agg(listed("first", False).alias("firsts"), listed("last", True).alias("lasts")),
        [F.col("chunk") == F.col("_chunk"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]], "left")
    none = F.array().cast(LISTED)
    summaries = settle(summaries.select(*keys, "chunk", F.coalesce("firsts", none).alias("firsts"), F.coalesce("lasts", none).alias("lasts")))
    part = [*keys, "chunk"]
    key_types = {k: pa.string() for k in keys}

    def worked(head: DataFrame, column: str, result: dict[str, pa.DataType], types: str, finish: Callable[[list[dict], dict | None], list[dict]]) -> DataFrame:
        """Each chunk's items, with the one row of ``head`` that belongs to it before them."""
        both = rows.withColumn("kind", F.lit(1)).unionByName(head.select(*part, column).withColumn("kind", F.lit(0)), allowMissingColumns=True)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, found in _groups(batches, part):
                first = found[0] if found[0]["kind"] == 0 else None
                out = finish(found[first is not None:], first)
                yield _batch(keys, [{**dict(zip(part, key)), **x} for x in out], result, key_types)

        return both.repartition(*part).sortWithinPartitions(*part, "kind", "at").mapInArrow(work, ", ".join(f"{k} string" for k in keys) + ", " + types)

    chained = {"chunk": pa.int64(), "at": pa.int64(), "exit": pa.int64(), "blocks": pa.int64(), "last": pa.int64(), "last_blocks": pa.int64(), "own": pa.list_(pa.string())}
    ways = settle(worked(_listed(summaries, keys, "firsts", capacity + 1, False), "list", chained, "chunk long, at long, exit long, blocks long, last long, last_blocks long, own array<string>",
                         lambda found, first: chains(found, first["list"] if first else [], capacity)))
    ends = ways.where("exit is not null").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("exit").alias("_at")).distinct()
    same = [F.col("at") == F.col("_at"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]]
    nodes = settle(ways.where("at = 1").unionByName(ways.where("at > 1").join(ends, same, "left_semi")))
    begun = _reached(nodes, keys).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("at").alias("_at"), "number")
    through = nodes.join(begun, same)
    # the block that is open where a chunk begins
    final = F.floor((F.col("exit") - 1) / chunk).cast("long")
    most = rows.groupBy(*[F.col(k).alias(f"m_{k}") for k in keys]).agg(F.max("chunk").alias("most"))
    through = through.join(most, [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys]).withColumn("upto", F.coalesce(final, F.col("most")))
    open_ = through.where("upto > chunk").select(*keys, F.explode(F.sequence(F.col("chunk") + 1, F.col("upto"))).alias("chunk"), "last", (F.col("number") + F.col("last_blocks")).alias("block"), "own")
    before = _listed(summaries, keys, "lasts", capacity + 1, True).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("chunk").alias("_chunk"), "list")
    states = open_.join(before, [F.col("chunk") == F.col("_chunk"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]])
    held = F.array_union("own", F.transform(F.filter("list", lambda x: x["at"] > F.col("last")), lambda x: x["label"]))
    states = states.select(*part, F.struct("block", held.alias("held")).alias("state"))

    def finish(found: list[dict], first: dict | None) -> list[dict]:
        state = Open(**first["state"]) if first else Open()
        return [{carried: r[carried], "block": b, "kept": n} for r in found for b, n in state.take(r["labels"], capacity)]

    return worked(states, "state", {carried: pa.int64(), "block": pa.int32(), "kept": pa.int32()}, f"{carried} long, block int, kept int", finish)
