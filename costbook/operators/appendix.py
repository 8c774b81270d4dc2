"""A printed appendix table over several pages: levels of rocks with drilling values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costbook.functions.numbers import ROCK_BANDS, band
from costbook.operators.ordered import chunk_of, scan

VALUES = ("drill_alloy", "drill_quenched", "drill_manual", "strength", "coefficient")
# Markers of a level, and the y below which each page's data begin.
LEVEL_MARKS = ("V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI")
HEADER_ENDS = (155, 145, 145, 135, 120)


def data_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc, page_idx, line_no, x, y, text) below each page's header, page numbers aside."""
    t = F.trim("text")
    end = F.element_at(F.array(*[F.lit(v) for v in HEADER_ENDS]), F.least(F.col("page_idx") + 1, F.lit(len(HEADER_ENDS))).cast("int"))
    furniture = t.startswith("-") & t.endswith("-") & (F.length(t) < 8)
    return lines.filter((t != "") & ~furniture & (F.col("y") >= end)).withColumn("text", t).withColumn("kind", band(F.col("x"), ROCK_BANDS, "other"))


def _marker():
    return (F.col("x") < 50) & F.col("text").isin(*LEVEL_MARKS)


def place(lines: DataFrame) -> DataFrame:
    """Level (from 1) and rock (from 1, 0 before the first) each line belongs to.

    A numbered name opens a rock.  A name with number 1 opens a level too, but only if the running level has its mark and a
    rock before its last one; what comes before the first rock belongs to the first level.
    """
    opens = (F.col("kind") == "rock") & F.col("text").rlike(r"^\d+\.\s") & ~_marker()
    order = [F.col("page_idx"), F.col("y"), F.col("x"), F.col("line_no")]
    flag = lambda c: F.when(c, 1).otherwise(0)
    numbered = scan(lines, ["doc"], order, chunk_of(F.col("page_idx"), 64), total={
        "rock_no": flag(opens), "part_no": flag(opens & F.col("text").startswith("1."))})
    # a row per name with number 1; the walk over them is as long as the printed table has such names
    parts = numbered.groupBy("doc", "part_no").agg(F.count_if(_marker()).alias("marks"), F.count_if(opens).alias("rocks"))
    part = F.sort_array(F.collect_list(F.struct("part_no", "marks", "rocks")))
    none = F.array().cast("array<struct<part_no:bigint,level_no:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("marks"), F.lit(0).cast("long").alias("rocks"), F.lit(1).cast("long").alias("level"), none.alias("out"))

    def step(s, p):
        new = (p["part_no"] > 0) & (s["marks"] > 0) & (s["rocks"] > 1)
        level = s["level"] + F.when(new, 1).otherwise(0)
        return F.struct((F.when(new, 0).otherwise(s["marks"]) + p["marks"]).alias("marks"), (F.when(new, 0).otherwise(s["rocks"]) + p["rocks"]).alias("rocks"),
                        level.alias("level"), F.concat(s["out"], F.array(F.struct(p["part_no"].cast("long").alias("part_no"), level.alias("level_no")))).alias("out"))

    levels = parts.groupBy("doc").agg(part.alias("parts")).select("doc", F.explode(F.aggregate("parts", start, step, lambda s: s["out"])).alias("l"))
    return numbered.join(levels.select("doc", "l.part_no", "l.level_no"), ["doc", "part_no"]).drop("part_no")


def rocks(placed: DataFrame) -> DataFrame:
    """Names, over several lines where they run on, and the first density of every rock."""
    at = F.struct("page_idx", "y", "x", "line_no")
    own = placed.filter(F.col("rock_no") > 0)
    # lines of one printed cell
    return own.groupBy("doc", "level_no", "rock_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "rock", F.struct(at.alias("at"), "text")))), lambda p: p["text"]), "").alias("name"),
        F.min_by("text", F.when(F.col("kind") == "density", at)).alias("density"))


def level_values(placed: DataFrame) -> DataFrame:
    """First value and first bracketed alternative of every column per level, carried on from the level before; a level has
    a mark or a rock."""
    at = F.struct("page_idx", "y", "x", "line_no")
    bracketed = F.col("text").startswith("(") | F.col("text").startswith("（")
    pick = lambda k, alt: F.min_by("text", F.when((F.col("kind") == k) & (bracketed if alt else ~bracketed), at))
    levels = placed.groupBy("doc", "level_no").agg(
        F.max("rock_no").alias("_rocks"), F.max_by("text", F.when(_marker(), at)).alias("level"), *[pick(k, False).alias(k) for k in VALUES], *[pick(k, True).alias(f"alt_{k}") for k in VALUES])
    levels = levels.filter(F.col("level").isNotNull() | (F.col("_rocks") > 0)).drop("_rocks")
    return carry_values(levels, ["doc"], "level_no", VALUES)


def carry_values(levels: DataFrame, keys: list[str], order: str, columns: tuple[str, ...]) -> DataFrame:
    """Missing values take the last one above; a missing alternative takes the main value."""
    carried = scan(levels, keys, [F.col(order)], chunk_of(F.col(order)), carry={f"_{c}": F.col(c) for c in columns})
    rest = [c for c in levels.columns if c not in columns and c not in {f"alt_{k}" for k in columns}]
    return carried.select(*rest, *[F.col(f"_{c}").alias(c) for c in columns], *[F.coalesce(f"alt_{c}", f"_{c}").alias(f"alt_{c}") for c in columns])
