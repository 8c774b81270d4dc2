"""Near duplicates by DartMinHash signatures, banded joins and exact verification."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costbook.llm.hashed import STEP, joined, mix, worker_words
from costbook.llm.rows import small, text_key, unused
from costbook.session import settle

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4  # two texts at a similarity of 0.8 share no band with probability (1 - 0.8**4)**32 = 5e-8
FEW = 16  # buckets of at most so many texts compare all their pairs
STEP_OF_SIZE = 1.05
SLOTS, RANGES = 1 << 20, 16  # of the table that strips are ordered by, and its parts
# Poisson(1): chance of at most n darts in a unit of area
DARTS = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1, 20)))))


def strips(words: np.ndarray, size: int) -> np.ndarray:
    """A weighted set as unit strips: one 64-bit hash per shingle and occurrence.  What two such sets share is the sum of the
    smaller weights.  Fewer words than ``size`` make one shingle, none make none."""
    if not len(words):
        return words
    n = max(len(words) - size + 1, 1)
    found = np.sort(joined(*(words[k:n + k] for k in range(min(size, len(words))))))
    first = np.searchsorted(found, found)
    return mix(found + STEP * (np.arange(len(found)) - first).astype(np.uint64))


def dart_signature(units: np.ndarray, k: int) -> np.ndarray:
    """DartMinHash of unit strips: the earliest dart of each of ``k`` coordinates.

    Each strip is a plane of time on which darts lie as a Poisson process of its own, all drawn from hashes of strip and
    cell, each with a time and a coordinate.  The darts of the first theta units of time are thrown, theta such that about k ln k + 2k fall
    on the whole set; if a coordinate got none, twice the time.  Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.
    """
    theta = (k * np.log(k) + 2 * k) / len(units)
    while True:
        cells = np.arange(int(np.ceil(theta)), dtype=np.uint64)
        cell = mix(units[:, None] + (cells[None, :] + np.uint64(1)) * STEP)
        n = np.searchsorted(DARTS, (cell >> np.uint64(11)) * 2.0**-53, side="right").ravel()
        at = np.repeat(np.arange(cell.size), n)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(cell.ravel()[at] + (nth + 1).astype(np.uint64) * STEP)
        time = at % len(cells) + (dart >> np.uint64(32)) * 2.0**-32
        early = time < theta
        dart, time = dart[early], time[early]
        order = np.argsort(-time, kind="stable")
        coordinate = (dart & np.uint64(0xFFFFFFFF)) % np.uint64(k)
        out = np.zeros(k, np.uint64)
        seen = np.zeros(k, bool)
        out[coordinate[order]] = dart[order]  # the earliest is written last
        seen[coordinate] = True
        if seen.all():
            return out
        theta *= 2


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(BANDS, ROWS)
    return joined(np.arange(BANDS, dtype=np.uint64), *parts.T).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, row, content, size, bands) of every row: content names the sequence of words, size counts its strips."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words()
        with np.errstate(over="ignore"):
            for b in batches:
                content, size, bands = [], [], []
                for x in b.column(2):
                    own = words.of(x.as_py())
                    units = strips(own, SHINGLE)
                    content.append(xxhash.xxh3_128_digest(own.tobytes()))
                    size.append(len(units))
                    bands.append(band_keys(dart_signature(units, BANDS * ROWS)) if len(units) else [])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(content, pa.binary()), pa.array(size, pa.int32()), pa.array(bands, pa.list_(pa.int64()))],
                                                 ["doc_id", "row", "content", "size", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("row"), "text")
    return rows.mapInArrow(work, "doc_id long, row long, content binary, size int, bands array<long>")


def strip_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, units) of the wanted rows (doc_id, row, node), one row a node: the hashes of its strips, for exact counts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words()
        with np.errstate(over="ignore"):
            for b in batches:
                units = [strips(words.of(x.as_py()), SHINGLE).view(np.int64) for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(units, pa.list_(pa.int64()))], ["node", "units"])

    rows = docs.select(F.col("doc_id").cast("long").alias("d"), text_key("text").alias("r"), "text")
    on = F.col("d").eqNullSafe(wanted["doc_id"]) & (F.col("r") == wanted["row"])
    return rows.join(small(wanted), on).select("node", "text").mapInArrow(work, "node long, units array<long>").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least the threshold."""
    one, two = sets.select(F.col("node").alias("a"), F.col("units").alias("u")), sets.select(F.col("node").alias("b"), F.col("units").alias("v"))
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("u", "v"))
    return both.where(shared >= SIMILARITY * (F.size("u") + F.size("v") - shared)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of the edges (a, b) is connected with.

    Each round maps every node to its least neighbour and contracts the edges; rounds end when no edge
    is left.  A star is done in one round, a chain in a logarithmic number.
    """
    edges = settle(edges.where("a <> b").distinct())
    labels = settle(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("to")).where("to < a"))
        labels = settle(labels.join(least, F.col("label") == F.col("a"), "left").select("node", F.coalesce("to", "label").alias("label")))
        for end in ("a", "b"):
            edges = edges.join(least.select(F.col("a").alias("from"), "to"), F.col(end) == F.col("from"), "left").withColumn(end, F.coalesce("to", end)).select("a", "b")
        edges = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels


def _across(rows: DataFrame, key: list[str]) -> DataFrame:
    """Distinct pairs (a, b) of nodes that share a key, are not connected yet, and could be similar by their sizes."""
    one = rows.select(*key, F.col("node").alias("a"), F.col("label").alias("l"), F.col("size").alias("n"))
    two = rows.select(*key, F.col("node").alias("b"), F.col("label").alias("m"), F.col("size").alias("o"))
    near = (F.least("n", "o") >= SIMILARITY * F.greatest("n", "o"))
    return one.join(two, key).where((F.col("a") < F.col("b")) & (F.col("l") != F.col("m")) & near).select("a", "b").distinct()


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(STEP_OF_SIZE))).cast("int")


def spread_table(own: DataFrame) -> np.ndarray:
    """For each of SLOTS slots of the hash, about how many groups hold its strips, up to 64.

    Each group sets one of 64 bits in the slots of its strips.  Tasks fill arrays of their own, which are joined by OR, range by range, so a group of any
    size counts once; RANGES rows come to the driver and go to the workers, whatever the input.
    """
    each = SLOTS // RANGES

    def rows(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for _, x in parts], pa.binary())], ["part", "bits"])

    def bits(data: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(data), "<u8")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, "<u8")
        for b in batches:
            units = b.column(1)
            with np.errstate(over="ignore"):
                bit = np.uint64(1) << (mix(b.column(0).to_numpy().astype(np.uint64)) >> np.uint64(58))
            slots = (units.flatten().to_numpy() & (SLOTS - 1)).astype(np.int64)
            np.bitwise_or.at(table, slots, np.repeat(bit, units.value_lengths().to_numpy()))
        parts = [(r, table[r * each:(r + 1) * each]) for r in range(RANGES)]
        yield rows([x for x in parts if x[1].any()])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: dict[int, np.ndarray] = {}
        for b in batches:
            for r, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                both[r] = both.get(r, np.uint64(0)) | bits(data)
        yield rows(sorted(both.items()))

    schema = "part int, bits binary"
    table = np.zeros(SLOTS, np.uint8)
    for row in own.select("label", "units").mapInArrow(mark, schema).repartition("part").mapInArrow(join, schema).collect():
        table[row["part"] * each:(row["part"] + 1) * each] = np.bitwise_count(bits(row["bits"]))
    return table


def foremost(own: DataFrame) -> DataFrame:
    """(node, label, n, at, unit): the foremost strips of each node that more than one group holds, with their places.

    Strips are ordered by the table of ``spread_table``, then by hash.  Any order that is the same for all nodes loses nothing; by this one strips of one
    group come first, and a passage in many texts last.  No strip is joined with its count; of the foremost ones, those that
    one group alone has among them go.
    """
    table = own.sparkSession.sparkContext.broadcast(spread_table(own))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = []
            for node, label, units in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own_units = units.values.to_numpy()
                n = len(own_units)
                at = np.lexsort((own_units, table.value[own_units & (SLOTS - 1)]))[:int((1 - SIMILARITY) * n + 1e-9) + 1]
                out.append([np.full(len(at), node), np.full(len(at), label), np.full(len(at), n), np.arange(len(at)), own_units[at]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) if c else pa.array([], pa.int64()) for c in (zip(*out) if out else [()] * 5)], ["node", "label", "n", "at", "unit"])

    keys = own.select("node", "label", "units").mapInArrow(work, "node long, label long, n long, at long, unit long")
    same = Window.partitionBy("unit")
    spread = keys.withColumn("lo", F.min("label").over(same)).withColumn("hi", F.max("label").over(same))
    return spread.where("lo < hi").drop("lo", "hi")


def rare_pairs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes that are not connected yet and share a rare strip where two similar texts must share one.

    Take the first strip, in the order of ``foremost``, that two texts of n and m strips share: behind its place i in the one and j in the other lie
    at most n - i and m - j, and a similarity s needs s / (1 + s) * (n + m) of them.  So only the foremost strips are keys, the deeper a strip the
    fewer partners by size: a key is a strip and a class of sizes, that of the smaller text.  Strips of one group only can link nothing.
    """
    need = SIMILARITY / (1 + SIMILARITY)
    own = settle(rows.select("node", "label").distinct().join(sets, "node"))
    keys = settle(foremost(own))
    rest = F.col("n") - F.col("at")
    lower = keys.where(rest >= need * (F.col("n") + F.col("n") / STEP_OF_SIZE) - 1e-9).select(
        "unit", _size_class(F.col("n")).alias("class"), F.col("node").alias("x"), F.col("label").alias("l"), F.col("n"), rest.alias("r"))
    # partners are not larger, and no larger than the strips behind allow
    most = F.least(F.col("n").cast("double"), F.floor(rest / need - F.col("n") + 1e-9).cast("double"))
    least = F.ceil(SIMILARITY * F.col("n") - 1e-9)
    upper = keys.where(most >= least).select("unit", F.explode(F.sequence(_size_class(least), _size_class(most))).alias("class"),
                                             F.col("node").alias("y"), F.col("label").alias("k"), F.col("n").alias("m"), rest.alias("q"))
    enough = F.least("r", "q") >= need * (F.col("n") + F.col("m")) - 1e-9
    pairs = lower.join(upper, ["unit", "class"]).where((F.col("n") <= F.col("m")) & (F.col("x") != F.col("y")) & (F.col("l") != F.col("k")) & enough)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, row (see text_key), class_id, keeper for every row of ``docs`` (doc_id, text); class_id is the least doc_id of the class.

    Texts are words in lower case; two are linked if the weighted Jaccard similarity of their five-word shingles (weight:
    occurrences) is at least 0.8, and classes are the connected sets of links.  keeper marks the rows equal to the
    one that stays: the least doc_id (null last), then the least text key.

    Texts of equal words are one node.  Nodes that share a band form a bucket.  First each node is compared with one node of its
    bucket only, the one whose buckets are the largest (in a group of copies, mostly their original), and verified links are contracted: a group
    of any size is mostly done.  Buckets that still hold several groups compare across groups: small ones all pairs, others by
    ``rare_pairs``, which no similar pair can lack.
    So no bucket, however large, makes all its pairs, and no link within a bucket is lost.

    Null and empty texts have no words and are equal; a null doc_id is kept, and is class_id only if the class has no other; repeated
    rows share a class; other columns are ignored; an empty table gives no rows.
    """
    signed = settle(signatures(docs))
    # one row per distinct text; the numbers hold because the frame is written
    nodes = settle(signed.dropDuplicates(["content"]).withColumn("node", F.monotonically_increasing_id()))
    bands = nodes.select("node", "size", F.explode_outer("bands").alias("band")).where("band is not null")
    # frames joined by band are written, so that a frequent band is split in the joins
    buckets = settle(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = settle(bands.join(buckets, "band"))
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = settle(shared.join(weights, "node").groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("least"))).alias("h")).select("band", (-F.col("h.least")).alias("hub")))
    stars = shared.join(hubs, "band").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    stars = settle(stars.distinct())
    wanted = shared.select("node").distinct().join(nodes.select("node", "doc_id", "row"), "node")
    sets = settle(strip_sets(docs, wanted))
    links = settle(similar(stars, sets))
    first = components(links)
    open_ = shared.join(first, "node", "left").withColumn("label", F.coalesce("label", "node")).select("band", "n", "node", "size", "label")
    mixed = open_.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
    rest = settle(open_.join(mixed, "band", "left_semi"))
    pairs = _across(rest.where(F.col("n") <= FEW), ["band"])
    pairs = pairs.unionByName(rare_pairs(rest.where(F.col("n") > FEW), sets)).distinct()
    pairs = pairs.join(stars, ["a", "b"], "left_anti")
    labels = components(links.unionByName(similar(pairs, sets)))
    grouped = nodes.select("content", "node").join(labels, "node", "left").select("content", F.coalesce("label", "node").alias("label"))
    member = settle(signed.select("doc_id", "row", "content").join(grouped, "content").select("doc_id", "row", "label"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    best = member.groupBy("label").agg(F.min(order).alias("best"))
    keeper = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row") == F.col("best.row"))
    return member.join(best, "label").select("doc_id", "row", F.col("best.doc_id").alias("class_id"), keeper.alias("keeper"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class (see ``classes``), with all its columns; of rows equal in doc_id and text any one."""
    id_, row, n, key = unused(docs, "id", "row", "n", "key")
    kept = classes(docs).where("keeper").groupBy(F.col("doc_id").alias(id_), F.col("row").alias(row)).agg(F.count(F.lit(1)).alias(n))
    kept = settle(kept)
    out = docs.withColumn(key, text_key("text"))
    on = out["doc_id"].eqNullSafe(F.col(id_)) & (F.col(key) == F.col(row))
    # only rows that repeat need to meet
    once = out.join(kept.where(F.col(n) == 1), on, "left_semi")
    often = out.join(kept.where(F.col(n) > 1), on, "left_semi").dropDuplicates(["doc_id", key])
    return once.unionByName(often).drop(key)
