"""Benchmark decontamination: documents with a passage that repeats a benchmark item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costbook.llm.rows import shingles, small, text_key, unused, words
from costbook.session import settle

BITS = 64
SIMHASH = """aggregate(sequence(0, 63), 0L, (bits, b) -> bits | shiftleft(
  CASE WHEN 2 * aggregate({0}, 0, (ones, x) -> ones + CAST(shiftright(x, b) & 1L AS INT)) > size({0}) THEN 1L ELSE 0L END, b))"""


def simhash(shingle_column: str) -> Column:
    """Bit b is set if it is set in most shingles; a repeated shingle counts each time."""
    return F.expr(SIMHASH.format(shingle_column))


def blocks(print_column: str, radius: int) -> Column:
    """radius + 1 parts of the fingerprint: two that differ in at most ``radius`` bits agree in a part."""
    edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*(F.expr(f"shiftright({print_column}, {a}) & {(1 << (b - a)) - 1}L") for a, b in zip(edges, edges[1:])))


def strips(shingle_column: str) -> Column:
    """The shingles made distinct by their number of earlier occurrences: what two such sets share is the
    sum of the smaller weights."""
    own = F.col(shingle_column)

    def numbered(x: Column, i: Column) -> Column:
        return F.xxhash64(x, F.size(F.filter(F.slice(own, 1, i), lambda y: y == x)))

    return F.when(F.size(F.array_distinct(own)) == F.size(own), F.transform(own, lambda x: F.xxhash64(x, F.lit(0)))).otherwise(F.transform(own, numbered))


def items_of(benchmark: DataFrame, shingle: int, radius: int) -> DataFrame:
    """Distinct items with words: item_id, item (a key), size (in shingles), their shingles, strips and fingerprint."""
    rows = benchmark.select("item_id", text_key("text").alias("text_key"), words(F.col("text")).alias("words")).dropDuplicates(["item_id", "text_key"])
    rows = rows.select("item_id", F.xxhash64("item_id", "text_key").alias("item"), "words", shingles(F.col("words"), shingle).alias("shingles"))
    rows = rows.withColumn("size", F.size("shingles")).where("size > 0")
    return rows.select("*", simhash("shingles").alias("print"), strips("shingles").alias("strips"))


def least_shared(similarity: float) -> Column:
    """Strips that an item of ``size`` and a window of ``held`` shingles share at least if they are that similar."""
    return F.ceil((F.col("size") + F.col("held")) * similarity / (1 + similarity) - 1e-9).cast("int")


def seeds_of(items: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(seed, item, size, seeds): the rows by which documents are found, one for each distinct seed of an item.

    A window as similar as asked shares at least ``similarity`` of an item's shingles, hence one of any
    (1 - similarity) * size + 1 of them, wherever it stands in the window; the longest are taken, as they are the
    rarest.  seeds: how many shingles of the item are one of its seeds.
    """
    need = F.floor((1 - similarity) * F.col("size") + 1e-9).cast("int") + 1
    spelled = F.transform("shingles", lambda x, i: F.struct(F.length(F.array_join(F.slice("words", i + 1, shingle), "")).alias("letters"), x.alias("seed"), i.alias("at")))
    chosen = items.withColumn("spelled", spelled).withColumn("need", need)
    chosen = chosen.withColumn("best", F.transform(F.slice(F.sort_array("spelled", asc=False), 1, F.col("need")), lambda x: x["seed"]))
    chosen = chosen.withColumn("seeds", F.size(F.filter("shingles", lambda x: F.array_contains("best", x))))
    return chosen.select(F.explode(F.array_distinct("best")).alias("seed"), "item", "size", "seeds")


def starts_with(at: str, least: str, held: str, count: str) -> Column:
    """Runs (first, last) of all starts whose windows of ``held`` places, of ``count`` in all, hold ``least`` or more of the places ``at`` (ascending)."""
    places, k, n = F.col(at), F.col(least), F.col(held)
    room = F.transform(F.slice(places, 1, F.greatest(F.size(places) - k + 1, F.lit(0))), lambda x, i: F.struct(
        F.greatest(F.lit(0), F.get(places, i + k - 1) - n + 1).alias("first"), F.least(x, F.col(count) - n).alias("last")))
    return F.filter(room, lambda r: r["first"] <= r["last"])


def merged(runs: str) -> Column:
    """Runs, ascending in both ends, with those joined that touch."""
    own = F.col(runs)
    first = F.filter(own, lambda r, i: (i == 0) | (r["first"] > F.get(own, i - 1)["last"] + 1))
    last = F.filter(own, lambda r, i: (i == F.size(own) - 1) | (F.get(own, i + 1)["first"] > r["last"] + 1))
    return F.zip_with(first, last, lambda a, b: F.struct(a["first"].alias("first"), b["last"].alias("last")))


def windows_of(docs: DataFrame, items: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, row, size, start, window) of all windows that can be as similar to an item of their size as asked.

    Documents are found by seeds.  A window has at least as many places with a seed as an item's seeds are more than the
    shingles it can lack; around such windows all shingles of the item are looked up, and those windows stay that have
    as many places with one of them as they must share.  Neither count asks for an order.
    """
    seeds = small(seeds_of(items, similarity, shingle))
    texts = docs.select("doc_id", text_key("text").alias("row"), words(F.col("text")).alias("words"))
    texts = texts.select("doc_id", "row", shingles(F.col("words"), shingle).alias("shingles"))
    # outer: else Spark tests the array's size before, by hashing the shingles once more
    found = texts.select("doc_id", "row", F.size("shingles").alias("count"), F.posexplode_outer("shingles").alias("pos", "seed")).join(seeds, "seed")
    found = found.groupBy("doc_id", "row", "count", "item", "size", "seeds").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    found = found.withColumn("held", F.least("size", "count"))
    found = found.withColumn("least", F.greatest(F.lit(1), F.col("seeds") - F.col("size") + least_shared(similarity)))
    found = found.withColumn("runs", starts_with("at", "least", "held", "count")).withColumn("run", F.explode(merged("runs")))
    # few and short: one row for each document that can leak, so that its text is cut once more
    asked = settle(found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("item", "run")).alias("asked")))
    asked = small(asked.withColumnRenamed("doc_id", "id").withColumnRenamed("row", "key"))
    again = docs.select("doc_id", "text", text_key("text").alias("row"))
    again = again.join(asked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("key")))
    again = again.select("doc_id", "row", "asked", words(F.col("text")).alias("words"))
    again = again.select("doc_id", "row", "asked", shingles(F.col("words"), shingle).alias("shingles"))
    again = again.select("doc_id", "row", "shingles", F.explode("asked").alias("ask")).select("doc_id", "row", "shingles", "ask.item", "ask.run")
    again = again.join(small(items.select("item", "size", F.array_distinct("shingles").alias("kinds"))), "item")
    again = again.withColumn("held", F.least("size", F.size("shingles")))
    again = again.withColumn("part", F.slice("shingles", F.col("run.first") + 1, F.col("run.last") - F.col("run.first") + F.col("held"))).drop("shingles")
    again = again.withColumn("count", F.size("part")).withColumn("least", least_shared(similarity))
    shared = F.filter(F.transform("part", lambda x, i: F.when(F.array_contains("kinds", x), i)), lambda i: i.isNotNull())
    again = again.withColumn("at", shared).withColumn("runs", starts_with("at", "least", "held", "count")).withColumn("run_of", F.explode(merged("runs")))
    again = again.withColumn("from", F.explode(F.sequence("run_of.first", "run_of.last")))
    return again.select("doc_id", "row", "size", (F.col("run.first") + F.col("from")).alias("start"), F.slice("part", F.col("from") + 1, F.col("held")).alias("window"))


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 19) -> DataFrame:
    """Benchmark passages in documents: doc_id, row (see text_key), item_id, similarity, start (in words), one row
    for each document and item, of its most similar window (the earliest of these).

    Texts are words in lower case.  A window has as many words as the item, or is the whole document where that is shorter.  It
    counts if its weighted Jaccard similarity to the item over ``shingle``-word shingles (weight: occurrences) is at least
    ``similarity``, in whatever order the words of the passage come.  All windows that hold enough of an item's shingles (see
    ``windows_of``) are fingerprinted by SimHash, each distinct one once; a block index finds all item fingerprints of the same size within ``radius`` bits (19 of 64: at a
    similarity of 0.8 bits differ with probability 0.15, so one true window in a thousand is further off); the exact similarity decides.

    Rows without words, in either table, match nothing.  Null ids are kept as they are; repeated rows count once;
    other columns are ignored; empty tables give no rows.
    """
    items = settle(items_of(benchmark, shingle, radius))
    # the windows are few and short; they are written once and read for matching and for the result
    hits = settle(windows_of(docs, items, shingle, similarity).withColumn("content", F.xxhash64("window")))
    windows = hits.select("size", "content", "window").dropDuplicates(["size", "content"])
    windows = windows.select("*", simhash("window").alias("print"), strips("window").alias("strips"))
    probes = windows.select("size", "content", "strips", F.col("print").alias("w_print"), F.posexplode(blocks("print", radius)).alias("block", "part"))
    index = items.select("size", "item", "item_id", F.col("print").alias("i_print"), F.col("strips").alias("i_strips"), F.posexplode(blocks("print", radius)).alias("block", "part"))
    near = probes.join(small(index), ["size", "block", "part"]).where(F.bit_count(F.col("w_print").bitwiseXOR(F.col("i_print"))) <= radius)
    shared = F.size(F.array_intersect("strips", "i_strips"))
    near = near.withColumn("similarity", shared / (F.size("strips") + F.size("i_strips") - shared)).where(F.col("similarity") >= similarity)
    near = near.groupBy("size", "content", "item", "item_id").agg(F.max("similarity").alias("similarity"))
    best = F.min(F.struct((-F.col("similarity")).alias("order"), "start")).alias("best")
    out = hits.select("doc_id", "row", "size", "start", "content").join(near, ["size", "content"]).groupBy("doc_id", "row", "item", "item_id").agg(best)
    return out.select("doc_id", "row", "item_id", (-F.col("best.order")).alias("similarity"), F.col("best.start").cast("long").alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without those that hold a benchmark passage; columns and other rows as they are."""
    id_, row = unused(docs, "id", "row")
    bad = leaks(docs, benchmark, **options).select(F.col("doc_id").alias(id_), F.col("row").alias(row)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(id_)) & (text_key(docs["text"]) == F.col(row)), "left_anti")


SQL = """
WITH word AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
item AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
doc_s AS (SELECT doc_id, greatest(len(w) - 4, 1) AS n, unnest(range(greatest(len(w) - 4, 1))) AS p, w FROM word WHERE len(w) > 0),
item_s AS (SELECT item_id, greatest(len(w) - 4, 1) AS n, unnest(range(greatest(len(w) - 4, 1))) AS q, w FROM item WHERE len(w) > 0),
d AS (SELECT doc_id, n, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM doc_s),
i AS (SELECT item_id, n, q, array_to_string(w[q + 1:q + 5], ' ') AS s FROM item_s),
win AS (
  SELECT DISTINCT d.doc_id, i.item_id, i.n AS size, d.n, greatest(0, least(d.p - i.q, d.n - i.n)) AS start FROM d JOIN i ON d.s = i.s),
inside AS (
  SELECT win.doc_id, win.item_id, win.start, win.size, least(win.size, win.n) AS held, d.s, count(*) AS c
  FROM win JOIN d ON d.doc_id = win.doc_id AND d.p >= win.start AND d.p < win.start + win.size GROUP BY ALL),
ic AS (SELECT item_id, s, count(*) AS c FROM i GROUP BY ALL),
shared AS (
  SELECT doc_id, inside.item_id, start, size, held, sum(least(inside.c, ic.c)) AS m
  FROM inside JOIN ic ON ic.item_id = inside.item_id AND ic.s = inside.s GROUP BY ALL),
scored AS (SELECT doc_id, item_id, start, m / (held + size - m) AS similarity FROM shared)
SELECT doc_id, item_id, similarity, start FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS k FROM scored WHERE similarity >= 0.8) WHERE k = 1"""
