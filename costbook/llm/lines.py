"""Line dedup: lines that stand on many sites are boilerplate and stay in one document only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costbook.llm.rows import text_key, unused
from costbook.session import settle

MIN_SITES = 10
LONG_CHARS = 100
LONG_SITES = 3


def _line_key(line: Column, long_chars: int) -> Column:
    """63 bits of the line without blanks around it; the lowest bit is set if it has ``long_chars`` characters or more."""
    line = F.trim(line)
    return F.xxhash64(line).bitwiseAND(F.lit(-2)).bitwiseOR((F.length(line) >= long_chars).cast("long"))


def line_digest(docs: DataFrame, site: str = "source", long_chars: int = LONG_CHARS) -> DataFrame:
    """(doc_id, row, site, line) once for each distinct non-blank line of a document, all but doc_id as 64-bit hashes."""
    keys = F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: _line_key(x, long_chars)))
    keys = F.array_remove(keys, _line_key(F.lit(""), long_chars))
    # outer: else Spark tests the array's size before, by hashing all lines once more
    rows = docs.select("doc_id", text_key("text").alias("row"), F.xxhash64(F.coalesce(F.col(site), F.lit(""))).alias("site"), F.explode_outer(keys).alias("line"))
    return rows.where("line is not null")


def least_sites(is_long: Column, min_sites: int, long_sites: int) -> Column:
    """The rule of the operator: on how many sites a line must stand to be boilerplate, by its own length alone.  Texts of
    different hands share short lines, so those need ``min_sites``; a long line that repeats was copied, and needs ``long_sites``."""
    return F.when(is_long, F.lit(min(long_sites, min_sites))).otherwise(F.lit(min_sites))


def boilerplate(digest: DataFrame, min_sites: int, long_sites: int, precision: int) -> DataFrame:
    """(line, keeper) of the lines on ``min_sites`` sites or more, or ``long_sites`` if they are long; keeper is the row that comes first by doc_id.

    A HyperLogLog sketch of the sites of every line is merged map-side and across tasks, so a line with
    a third of all rows costs one sketch per task.  An estimate beyond three standard errors decides; lines nearer to
    the threshold have their sites counted exactly.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    spread = digest.groupBy("line").agg(F.hll_sketch_agg("site", precision).alias("sketch"), F.min(order).alias("keeper"))
    least = least_sites(F.col("line").bitwiseAND(F.lit(1)) == 1, min_sites, long_sites)
    margin = F.greatest(F.lit(1.0), least * 3 * 1.04 / math.sqrt(1 << precision))
    estimate = F.hll_sketch_estimate("sketch")
    # the few lines with a spread near or above the threshold; written once, read by both branches
    wide = settle(spread.where(estimate >= least - margin).select("line", "keeper", (estimate > least + margin).alias("sure")))
    near = wide.where("not sure").select("line")
    exact = digest.join(near, "line", "left_semi").select("line", "site").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    exact = exact.where(F.col("sites") >= least).select("line", F.lit(True).alias("counted"))
    # written too: a join with it then has an exchange on both sides, so that a frequent line can be split
    return settle(wide.join(exact, "line", "left").where("sure or counted").select("line", "keeper"))


def dedup_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", precision: int = 12, long_sites: int = LONG_SITES, long_chars: int = LONG_CHARS
) -> DataFrame:
    """Documents without the boilerplate lines that another document keeps.

    A line is compared without blanks around it.  If it stands on at least ``min_sites`` distinct sites (of
    ``long_chars`` characters or more: on the lesser of this and ``long_sites``, as clean texts share short lines only), the row with the smallest doc_id
    (rows without one come last, ties go by text hash) keeps its first occurrence, and all others
    go.  Blank lines stay.  Every row and column stays; ``text`` changes and ``removed_lines`` is added (in
    place of a column of that name).  A null text stays null, an empty one empty; a null site counts
    as the empty one; rows alike in doc_id and text are treated alike; an empty table stays empty.
    """
    digest = settle(line_digest(docs, site, long_chars))
    plain = boilerplate(digest, min_sites, long_sites, precision)
    own = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("row") == F.col("keeper.row"))
    drops = digest.join(plain, "line").withColumn("own", own).groupBy("doc_id", "row").agg(
        F.collect_list(F.when(~F.col("own"), F.col("line"))).alias("gone"), F.collect_list(F.when(F.col("own"), F.col("line"))).alias("once"))
    id_, row, gone, once, keys, kept = unused(docs, "id", "row", "gone", "once", "keys", "kept")
    drops = drops.select(F.col("doc_id").alias(id_), F.col("row").alias(row), F.col("gone").alias(gone), F.col("once").alias(once))
    both = docs.join(drops, docs["doc_id"].eqNullSafe(F.col(id_)) & (text_key(docs["text"]) == F.col(row)), "left")
    parts = F.split(docs["text"], "\n")
    # each line is hashed once a text
    both = both.withColumn(keys, F.when(F.col(row).isNotNull() & docs["text"].isNotNull(), F.transform(parts, lambda x: _line_key(x, long_chars))))

    def stays(line: Column, i: Column) -> Column:
        key = F.get(keys, i)
        return ~F.array_contains(gone, key) & (~F.array_contains(once, key) | (F.array_position(keys, key) == i + 1))

    both = both.withColumn(kept, F.when(F.col(keys).isNotNull(), F.filter(parts, stays)))
    removed = F.when(F.col(kept).isNotNull(), F.size(parts) - F.size(kept)).otherwise(0)
    text = F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n")).otherwise(docs["text"])
    columns = [text.alias(c) if c.lower() == "text" else docs[c] for c in docs.columns if c.lower() != "removed_lines"]
    return both.select(*columns, removed.alias("removed_lines"))


SQL = f"""
WITH line AS (
  SELECT doc_id, source, line, trim(line) AS key, pos FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
plain AS (
  SELECT key, min(doc_id) AS keeper FROM line WHERE key <> '' GROUP BY key HAVING count(DISTINCT coalesce(source, '')) >= CASE WHEN length(key) >= {LONG_CHARS} THEN {LONG_SITES} ELSE {MIN_SITES} END),
judged AS (
  SELECT l.doc_id, l.line, l.pos, plain.key IS NOT NULL AND NOT (l.doc_id = keeper AND row_number() OVER (PARTITION BY l.doc_id, l.key ORDER BY l.pos) = 1) AS gone
  FROM line l LEFT JOIN plain ON plain.key = l.key)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') END AS text,
       CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS removed_lines
FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id, d.text"""
