"""Exact top-k search by inner product: branch and bound over blocks of dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costbook.operators.ordered import numbered
from costbook.session import settle

EXACT = 2.0**53  # whole numbers up to here are exact in a double
ROW_BLOCK, QUERY_BLOCK = 2048, 512
TILE = 32  # blocks of rows, and of queries, that one piece of work holds at most
FOUND = "query_id long, vec_id long, score long"


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null for vectors that are null or hold a null, NaN or infinity, also after scaling."""
    def whole(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < EXACT, F.floor(scaled).cast("double")).otherwise(scaled)  # larger ones are whole

    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < float("inf"), F.lit(False)))
    return F.when(fine, F.transform(vector, whole))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, dims, ids, columns, mass): up to ``size`` vectors of one length, dimension by dimension; mass is the largest norm."""
    def emit(block: int, dims: int, ids: list[int], values: list[list[float]]) -> pa.RecordBatch:
        columns = np.array(values, "<f8").reshape(len(ids), dims).T
        mass = float(np.sqrt((columns * columns).sum(axis=0)).max(initial=0))
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([dims], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([np.ascontiguousarray(columns).tobytes()]), pa.array([mass])],
                                          ["block", "dims", "ids", "columns", "mass"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for id_, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, values = held.setdefault(len(vector), ([], []))
                ids.append(id_)
                values.append(vector)
                if len(ids) == size:
                    yield emit(number, len(vector), *held.pop(len(vector)))
                    number += 1
        for dims, (ids, values) in held.items():
            yield emit(number, dims, ids, values)
            number += 1

    return rows.mapInArrow(work, "block long, dims int, ids binary, columns binary, mass double")


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with numbers from 0 within their number of dimensions; only their keys are numbered, the blocks stay where they are."""
    keys = numbered(blocks.select("dims", "block"), [F.col("block")], "number", ["dims"])
    return blocks.join(keys.select("dims", "block", (F.col("number") - 1).alias("number")), ["dims", "block"])


class Best:
    """The best k of each query of a block so far: rows of (score, id), ``real`` where there is one."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.zeros((queries, k), np.int64)
        self.ids = np.zeros((queries, k), np.int64)
        self.real = np.zeros((queries, k), bool)

    def floor(self) -> np.ndarray:
        """What a score must reach to enter each list."""
        return np.where(self.real[:, -1], self.scores[:, -1].astype(float), -np.inf)

    def merge(self, first: int, last: int, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Adds pairs of the queries from ``first`` to ``last``; equal scores go to the smaller id."""
        k, n = self.k, last - first
        q = np.concatenate((np.repeat(np.arange(n), k), query))
        s, i = np.concatenate((self.scores[first:last].ravel(), score)), np.concatenate((self.ids[first:last].ravel(), ids))
        real = np.concatenate((self.real[first:last].ravel(), np.ones(len(query), bool)))
        order = np.lexsort((i, ~s, ~real, q))
        q, s, i, real = q[order], s[order], i[order], real[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        self.scores[first:last], self.ids[first:last], self.real[first:last] = (x[keep].reshape(n, k) for x in (s, i, real))


def search_large(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """As ``search_block`` for components so large that doubles cannot hold the scores: all pairs in whole numbers of any size.
    Scores beyond 64 bits are held at the end of that range before they are ranked."""
    x = np.array([[int(v) for v in row] for row in columns], dtype=object)
    ends = np.iinfo(np.int64)
    for a, q in enumerate(queries):
        own = np.flatnonzero(ids != query_ids[a])
        scores = np.array([int(v) for v in q], dtype=object) @ x if len(q) else np.zeros(len(ids), object)
        whole = np.array([min(max(int(v), ends.min), ends.max) for v in scores[own]], np.int64)
        best.merge(a, a + 1, np.zeros(len(own), np.int64), whole, ids[own])


def search_block(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Adds a block of rows (``columns``: dimensions x rows) to the best of each query.

    Dimensions are taken in blocks, those with the most mass first.  After each, what the rest can add or take
    is at most the product of the norms of the remaining components.  The k-th best lower bound (or the k-th best score so far) is a threshold, and pairs
    whose upper bound is below it go.  Survivors are compacted once few are left.
    """
    dims, rows = columns.shape
    if (np.abs(queries).max(initial=0) * np.abs(columns).max(initial=0) * max(dims, 1)) >= EXACT:
        return search_large(queries, query_ids, columns, ids, best)
    order = np.argsort(-(columns * columns).sum(axis=1), kind="stable")
    q_all, x_all = queries[:, order], columns[order]
    q_mass = np.cumsum((q_all * q_all)[:, ::-1], axis=1)[:, ::-1]
    x_mass = np.cumsum((x_all * x_all)[::-1], axis=0)[::-1]
    cuts = sorted({0, dims // 2, dims * 3 // 4, dims * 7 // 8, dims})
    for a in range(0, len(queries), 128):
        q, floor = q_all[a:a + 128], best.floor()[a:a + 128]
        partial = np.zeros((len(q), rows))
        partial[query_ids[a:a + 128, None] == ids[None, :]] = -np.inf
        pairs = None
        for begin, end in zip(cuts, cuts[1:]):
            if pairs is None:
                partial += q[:, begin:end] @ x_all[begin:end]
            else:
                qi, xi, p = pairs
                pairs = qi, xi, p + np.einsum("pd,dp->p", q[qi, begin:end], x_all[begin:end, xi])
            if end == dims:
                break
            q_rest, x_rest = np.sqrt(q_mass[a:a + 128, end]), np.sqrt(x_mass[end])
            if pairs is None:
                bound = q_rest[:, None] * x_rest[None, :] + 0.5  # scores are whole: half a unit covers rounding
                if rows >= best.k:
                    floor = np.maximum(floor, np.partition(partial - bound, rows - best.k, axis=1)[:, rows - best.k])
                alive = (partial + bound >= floor[:, None]) & (partial > -np.inf)
                if alive.sum() * 8 < alive.size:
                    qi, xi = np.nonzero(alive)
                    pairs = qi, xi, partial[qi, xi]
            else:
                qi, xi, p = pairs
                alive = p + q_rest[qi] * x_rest[xi] + 0.5 >= floor[qi]
                pairs = qi[alive], xi[alive], p[alive]
        if pairs is None:
            alive = (partial >= floor[:, None]) & (partial > -np.inf)
            if rows > best.k:
                alive &= partial >= np.partition(partial, rows - best.k, axis=1)[:, rows - best.k, None]
            qi, xi = np.nonzero(alive)
            pairs = qi, xi, partial[qi, xi]
        best.merge(a, a + len(q), pairs[0], pairs[2].astype(np.int64), ids[pairs[1]])


def top_k(queries: DataFrame, rows: DataFrame, k: int, scale: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows with the highest inner product of whole components
    (see ``whole_components``) for each query, all if there are fewer; ties go to the smaller vec_id.

    queries: (query_id, vector), rows: (vec_id, vector).  A row with the query's own id is no candidate.  Rows whose id or vector is null, or whose
    vector holds a null, NaN or infinity, take no part; vectors meet those of their own length.  Repeated ids are candidates row by row; repeated
    query ids are searched once per distinct vector and share one list.  Empty tables give no rows.
    Scores are exact whole numbers; where components are so large that a score may leave 64 bits, it is held at the end of that range, and
    ranked as such.

    Both sides are packed into blocks, and blocks into groups.  A group of queries meets a group of rows in a task, which holds the queries and
    takes the rows block by block, those of large norms first, so that the thresholds rise early; it returns the best k per query.  A block is copied
    once per group of the other side, not per block.
    """
    def ready(df: DataFrame, id_: str) -> DataFrame:
        return df.select(F.col(id_).cast("long").alias("id"), whole_components(F.col("vector"), scale).alias("v")).where("id is not null and v is not null")

    # written, so that blocks keep their keys
    q_blocks = _numbered(settle(_blocks(ready(queries, "query_id").distinct(), QUERY_BLOCK)))
    r_blocks = _numbered(settle(_blocks(ready(rows, "vec_id"), ROW_BLOCK)))
    # counts of blocks per number of dimensions; groups of rows are smaller where there would be fewer than tasks at a time
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    shape = q_blocks.groupBy("dims").agg(F.count(F.lit(1)).alias("n_q")).join(r_blocks.groupBy("dims").agg(F.count(F.lit(1)).alias("n_r")), "dims")
    q_groups = F.ceil(F.col("n_q") / TILE)
    each = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.col("n_r") * q_groups / tasks)))
    shape = settle(shape.select("dims", q_groups.cast("long").alias("n_qg"), F.ceil(F.col("n_r") / each).cast("long").alias("n_rg")))

    def side(blocks: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        return blocks.join(shape, "dims").select("dims", (F.col("number") % F.col(f"n_{own}")).alias(own), F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(other),
                                                 F.lit(kind).alias("kind"), "mass", "ids", "columns")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for _, q_ids, best in held:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, best.real.sum(axis=1))), pa.array(best.ids[best.real]), pa.array(best.scores[best.real])], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                key = at["dims"], at["qg"], at["rg"]
                if key != tile:
                    yield from done()
                    tile, held = key, []
                ids = np.frombuffer(at["ids"], "<i8")
                x = np.frombuffer(at["columns"], "<f8").reshape(at["dims"], len(ids))
                if at["kind"] == 0:
                    held.append((x.T, ids, Best(len(ids), k)))
                else:
                    for q, q_ids, best in held:
                        search_block(q, q_ids, x, ids, best)
        yield from done()

    tile = ["dims", "qg", "rg"]
    both = side(q_blocks, "qg", "rg", 0).unionByName(side(r_blocks, "rg", "qg", 1))
    found = both.repartition(*tile).sortWithinPartitions(*tile, "kind", F.desc("mass")).mapInArrow(work, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM v q JOIN v r ON r.vec_id <> q.vec_id AND len(r.v) = len(q.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pair) WHERE rank <= 20"""
