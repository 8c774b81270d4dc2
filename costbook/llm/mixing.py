"""Mixing sources to target weights: hash thresholds from histograms, refined at their boundary bucket only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costbook.llm.rows import small, unused
from costbook.operators.ordered import numbered
from costbook.session import settle

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
DEPTH, BITS = 60, 12  # bits of a document's hash; of these each histogram adds so many
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column | str) -> Column:
    """Number of words; of null none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hash_of(doc_id: Column | str, text: Column | str) -> Column:
    """The first 60 bits of the MD5 of id and text, so that other engines can tell them too."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, DEPTH // 4), 16, 10).cast("long")


def key_of(source: Column | str) -> Column:
    return F.xxhash64(source)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, at, size) of every row: the source's hash, the document's own, and its words."""
    return docs.select("doc_id", "source", key_of("source").alias("key"), hash_of("doc_id", "text").alias("at"), size_of("text").alias("size"))


def targets(rows: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(key, source_size, target) of every source of ``rows`` (see ``sized``).

    Sources by code point, null last, take the weights in turn.  Together they share ``share`` of all sizes; none gets more than
    ``most`` times its own size, and what is over goes to the others by weight.  Each round is one aggregate; the level that
    the others reach only rises, so rounds end when no further source is full.
    """
    sums = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    placed = numbered(sums, [F.col("source").asc_nulls_last()], "place")
    weight = F.get(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights)).cast("int"))
    sources = settle(placed.select(key_of("source").alias("key"), "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * float(most)).alias("cap")))
    total, all_weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    budget, full = share * total, 0
    rest, left = budget, all_weights
    while left:
        level = F.lit(rest) * F.col("weight") / F.lit(float(left))
        n, held, heavy = sources.where(F.col("cap") < level).agg(F.count(F.lit(1)), F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == full:
            break
        full, rest, left = n, budget - held, all_weights - heavy
    target = F.least("cap", F.lit(rest) * F.col("weight") / F.lit(float(left))) if left else F.col("cap")
    return sources.select("key", "source_size", target.alias("target"))


def _boundaries(inside: DataFrame, shift: int) -> DataFrame:
    """(key, tier, budget, prefix, below, held, rows): the bucket in which the running sum of sizes passes the budget.

    ``inside`` has (key, tier, budget, below, at, size); its buckets are the hashes without the last ``shift`` bits.  The
    window runs over the sums of at most 2**BITS buckets.
    """
    sums = inside.groupBy("key", "tier", F.shiftright("at", shift).alias("prefix")).agg(
        F.sum("size").alias("held"), F.count(F.lit(1)).alias("rows"), F.first("budget").alias("budget"), F.first("below").alias("start"))
    before = Window.partitionBy("key", "tier").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    below = sums.withColumn("below", F.col("start") + F.coalesce(F.sum("held").over(before), F.lit(0)))
    return below.where((F.col("below") <= F.col("budget")) & (F.col("below") + F.col("held") > F.col("budget"))).drop("start")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, tier, theta, ties): documents of hashes below theta, and ``ties`` of those at theta, come nearest to the tier's budget.

    ``budgets`` has (key, tier, budget), each above 0 and below the source's size.  Budgets of one source are nested: the smaller
    one's documents are among the larger one's.  A first histogram sums the sizes by source and the foremost bits of
    the hash; only rows of a bucket that a budget falls in go on to the next, by more bits, until it is one row or one hash.
    """
    shift = DEPTH - BITS
    # the first sums do not depend on the tiers, so they are made once a source
    some = rows.where("size > 0")
    first = some.groupBy("key", F.shiftright("at", shift).alias("prefix")).agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("key").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("below", F.coalesce(F.sum("held").over(before), F.lit(0))).join(budgets, "key")
    edge = settle(first.where((F.col("below") <= F.col("budget")) & (F.col("below") + F.col("held") > F.col("budget"))))
    inside, done = some, []
    while True:
        one = (F.col("rows") == 1) if shift else F.lit(True)
        each = F.col("held") / F.col("rows")
        take = F.floor((F.col("budget") - F.col("below")) / each + F.lit(0.5)).cast("long")
        # all of the bucket, none of it, or some rows of one hash
        theta = F.shiftleft(F.col("prefix") + F.when(take >= F.col("rows"), 1).otherwise(0), shift)
        done.append(edge.where(one).select("key", "tier", theta.alias("theta"), F.when(take < F.col("rows"), take).otherwise(0).alias("ties")))
        edge = edge.where(~one)
        if not shift or edge.isEmpty():
            return settle(reduce(DataFrame.unionByName, done))
        asked = small(edge.select(F.col("key").alias("k"), F.col("tier").alias("t"), F.col("budget").alias("b"), F.col("below").alias("l"), "prefix"))
        on = (F.col("key") == F.col("k")) & (F.shiftright("at", shift) == F.col("prefix"))
        if "tier" in inside.columns:
            on = on & (F.col("tier") == F.col("t"))
        inside = settle(inside.join(asked, on).select("key", "at", "size", F.col("t").alias("tier"), F.col("b").alias("budget"), F.col("l").alias("below")))
        shift -= BITS
        edge = settle(_boundaries(inside, shift))


def goals(rows: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(key, source_size, target, cuts) of every source; cuts has (theta, ties) for each copy that a document may have."""
    aims = settle(targets(rows, weights, share, most))
    part = F.greatest(F.lit(0.0), F.least(F.col("target") - F.col("tier") * F.col("source_size"), F.col("source_size").cast("double")))
    tiers = aims.withColumn("tier", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)))).withColumn("budget", part)
    open_ = tiers.where((F.col("budget") > 0) & (F.col("budget") < F.col("source_size")))
    found = thresholds(rows, small(open_.select("key", "tier", "budget")))
    whole = F.when(F.col("budget") > 0, F.lit(1 << DEPTH)).otherwise(0)
    cut = F.struct(F.coalesce("theta", whole).alias("theta"), F.coalesce("ties", F.lit(0)).cast("long").alias("ties"))
    return settle(tiers.join(found, ["key", "tier"], "left").groupBy("key").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.collect_list(cut).alias("cuts")))


def with_copies(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """``rows`` (with key, at, size) and source_size, target, copies: how often the mix takes each row."""
    own = rows.columns
    joined = rows.join(small(aims), "key")
    below = F.when(F.col("size") > 0, F.size(F.filter("cuts", lambda c: F.col("at") < c["theta"]))).otherwise(0).cast("long")
    tied = (F.col("size") > 0) & F.exists("cuts", lambda c: (F.col("at") == c["theta"]) & (c["ties"] > 0))
    out = [*own, "source_size", "target"]
    if aims.where(F.exists("cuts", lambda c: c["ties"] > 0)).isEmpty():
        return joined.select(*out, below.alias("copies"))
    # rows of one hash are alike, so any of them can be the ones that are taken
    row, nth = unused(joined, "row", "nth")
    same = settle(joined.where(tied)).withColumn(row, F.monotonically_increasing_id())
    same = numbered(same, [F.col(row)], nth, ["key", "at"])
    more = F.size(F.filter("cuts", lambda c: (F.col("at") == c["theta"]) & (F.col(nth) <= c["ties"])))
    return joined.where(~tied).select(*out, below.alias("copies")).unionByName(same.select(*out, (below + more).alias("copies")))


def mix_counts(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs`` (doc_id, text, source).

    A document's words count ``copies`` times, up to ``most``; taken is their number.  Each source's taken words differ from its
    target (see ``targets``) by at most half of one document's.  The choice depends on id and text alone, so reruns agree, and a source that
    grows keeps what it has where its share of the budget stays.

    Null and empty texts have the size 0 and are not taken; a null source is a source, the last; null ids are hashed as empty;
    repeated rows are taken or left one by one, any of them for the others; other columns are ignored; an empty table gives no rows.
    """
    rows = settle(sized(docs))
    return with_copies(rows, goals(rows, weights, share, most)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: the rows of ``docs``, all their columns, each as often as ``mix_counts`` says.  The thresholds are few, so
    texts are read once more and filtered where they lie: nothing of them is shuffled or sorted.  Columns of ``docs`` may have any names."""
    whole = unused(docs, "whole")[0]
    aims = goals(settle(sized(docs)), weights, share, most)
    rows = docs.select(F.struct(*docs.columns).alias(whole), key_of("source").alias("key"), hash_of("doc_id", "text").alias("at"), size_of("text").alias("size"))
    chosen = with_copies(rows, aims).where((F.col("copies") > 0) & (F.col("size") > 0))
    return chosen.select(whole, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(f"{whole}.*")


# The sources that are full come first by size for a unit of weight; documents are taken in order of their hashes.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS place FROM documents),
sums AS (SELECT source, sum(size)::HUGEINT AS source_size FROM sized GROUP BY ALL),
weighed AS (
  SELECT *, 2 * source_size AS cap, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::HUGEINT AS weight,
    sum(source_size) OVER () AS total FROM sums),
filled AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS cap_before, coalesce(sum(weight) OVER before, 0) AS weight_before, sum(weight) OVER () AS weights FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
full_ones AS (SELECT *, 2 * cap * (weights - weight_before) < weight * (3 * total - 2 * cap_before) AS is_full FROM filled),
aims AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE
    (1.5::DOUBLE * total::DOUBLE - coalesce(sum(cap) FILTER (is_full) OVER (), 0)::DOUBLE) * weight::DOUBLE / (sum(weight) FILTER (NOT is_full) OVER ())::DOUBLE END AS target
  FROM full_ones),
tiers AS (
  SELECT source, tier, greatest(0, least(target - tier * source_size, source_size)) AS budget FROM aims, (VALUES (0), (1)) AS k(tier)),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, nth) AS upto FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, place) AS nth FROM sized)),
taken AS (
  SELECT p.doc_id, p.nth, p.place, p.source, p.size, count(*) FILTER (p.upto <= t.budget OR (p.upto - p.size <= t.budget AND 2 * (t.budget - (p.upto - p.size)) >= p.size)) AS copies
  FROM placed p JOIN tiers t ON p.source IS NOT DISTINCT FROM t.source GROUP BY ALL)
SELECT k.doc_id, k.source, k.size::BIGINT AS size, a.source_size::BIGINT AS source_size, a.target, CASE WHEN k.size > 0 THEN copies ELSE 0 END::BIGINT AS copies, (copies * k.size)::BIGINT AS taken
FROM taken k JOIN aims a ON k.source IS NOT DISTINCT FROM a.source"""
