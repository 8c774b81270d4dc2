"""Ordered scans that never put one whole key into one task.

A key may hold a third of all rows, so every scan works on chunks of a key: the rows of a
chunk are scanned in one task, each chunk leaves one summary row, and the summaries, one
per chunk, carry values and totals from chunk to chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costbook.session import settle

CHUNK = 4096
WHOLE = 1 << 18  # rows of one key that one task may number


def chunk_of(position: Column, size: int = CHUNK) -> Column:
    """Chunk number of a numeric position."""
    return F.floor(position / size).cast("long")


def scan(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, *,
         carry: Mapping[str, Column] | None = None, total: Mapping[str, Column] | None = None,
         previous: Mapping[str, Column] | None = None, top: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds running columns along ``order`` within ``keys``.

    ``chunk`` must not decrease along ``order``.  ``carry`` keeps the last non-null value up
    to and with the row, ``total`` sums up to and with the row, ``previous`` is the value of
    the row before.
    """
    carry, total, previous, top = dict(carry or {}), dict(total or {}), dict(previous or {}), dict(top or {})
    seen = {f"_v_{n}": c for n, c in {**carry, **total, **top}.items()}
    seen |= {f"_v_{n}": F.struct(c.alias("v")) for n, c in previous.items()}
    at = F.struct(*[_plain(c).alias(f"o{i}") for i, c in enumerate(order)])
    rows = df.select("*", chunk.alias("_chunk"), *[c.alias(n) for n, c in seen.items()])
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select(
        "*",
        *[F.last(f"_v_{n}", ignorenulls=True).over(upto).alias(f"_l_{n}") for n in carry],
        *[F.sum(f"_v_{n}").over(upto).alias(f"_l_{n}") for n in total],
        *[F.max(f"_v_{n}").over(upto).alias(f"_l_{n}") for n in top],
        *[F.last(f"_v_{n}").over(before).alias(f"_l_{n}") for n in previous])
    end = {n: F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.col("_at"))) for n in (*carry, *previous)}
    if _descends(order):
        # descending parts have no plain struct order, so the chunk's last row is taken by rank
        ranked = rows.withColumn("_at", F.row_number().over(local))
    else:
        ranked = rows.withColumn("_at", at)
    ends = ranked.groupBy(*keys, "_chunk").agg(
        *[c.alias(f"_e_{n}") for n, c in end.items()], *[F.sum(f"_v_{n}").alias(f"_e_{n}") for n in total],
        *[F.max(f"_v_{n}").alias(f"_e_{n}") for n in top], F.count(F.lit(1)).alias("_rows"))
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys, "_chunk",
        *[F.last(f"_e_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in (*carry, *previous)],
        *[F.sum(f"_e_{n}").over(across).alias(f"_c_{n}") for n in total],
        *[F.max(f"_e_{n}").over(across).alias(f"_c_{n}") for n in top])
    joined = inside.alias("i").join(
        carried.alias("c"), [F.col(f"i.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "_chunk")], "left")
    own = [F.col(f"i.{c}") for c in df.columns]
    return joined.select(
        *own,
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in carry],
        *[(F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in total],
        # greatest skips nulls
        *[F.greatest(f"_l_{n}", f"_c_{n}").alias(n) for n in top],
        *[F.coalesce(f"_l_{n}", f"_c_{n}")["v"].alias(n) for n in previous])


def _descends(order: list[Column]) -> bool:
    return any(" DESC" in str(c).upper() for c in order)


def _plain(column: Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def numbered(df: DataFrame, order: list[Column], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Consecutive numbers from 1 along ``order``, per ``keys`` or over the whole frame.

    The rows are dealt by ranges of the whole order, so a key with a third of all rows, or many rows alike in the first
    parts of the order, spread over the tasks.  A row's number is its place in its task plus what lies in the tasks
    before: one count per task (and key there) is all that is gathered.  Rows alike in the whole order and keys are
    numbered in any way; null keys are one key.
    """
    by = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # written, so that places and counts are those of one run
    rows = settle(dealt.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    held = rows.groupBy(*keys, task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    if keys:
        before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
        starts = held.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    else:
        counts = sorted((r["_task"], r["_n"], r["_first"]) for r in held.collect())  # a row per task
        sums = [0, *accumulate(n for _, n, _ in counts)]
        starts = F.broadcast(df.sparkSession.createDataFrame(
            [(t, before - first) for (t, _, first), before in zip(counts, sums)], "_task long, _start long"))
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_task"), F.col("_start"))
    on = [task == F.col("_task"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    joined = rows.join(starts, on)
    return joined.select((F.col("_at") + F.col("_start") + 1).alias(name), *[c for c in df.columns if c != name])


def numbered_by_key(df: DataFrame, order: list[Column], name: str, keys: Sequence[str], sizes: DataFrame) -> DataFrame:
    """As ``numbered`` with keys, for frames that take long to work out and have few large keys.

    ``sizes`` (keys, n) tells beforehand about how many rows a key has, and decides its way alone.  A key of at most ``WHOLE`` rows is numbered in one task
    after one exchange; only the rows of larger ones are dealt by ranges, for which they are sampled, written and shuffled again.
    """
    large = settle(sizes.where(F.col("n") > WHOLE).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]))

    def within(rows: DataFrame) -> DataFrame:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
        return rows.select(number.alias(name), *[c for c in df.columns if c != name])

    if large.isEmpty():
        return within(df)
    # at most a row for each ``WHOLE`` rows of the frame
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return within(df.join(F.broadcast(large), on, "left_anti")).unionByName(numbered(df.join(F.broadcast(large), on, "left_semi"), order, name, keys))


def gap_groups(df: DataFrame, keys: list[str], value: Column, tie: Column, tolerance: float,
               chunk: Column, name: str = "group_no") -> DataFrame:
    """One-dimensional clusters: a new group starts where the step to the value before exceeds the tolerance."""
    order = [value, tie]
    stepped = scan(df, keys, order, chunk, previous={"_before": value})
    start = F.when(F.col("_before").isNull() | (value - F.col("_before") > tolerance), 1).otherwise(0)
    return scan(stepped.withColumn("_start", start), keys, order, chunk, total={name: F.col("_start")}).drop("_before", "_start")
