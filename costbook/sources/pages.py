"""Page sources: text lines, recognised blocks, Markdown pages and item files."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costbook.session import settle

LINE = "struct<x:double,y:double,x2:double,y2:double,text:string>"
PAGE = f"page long, pdf_page long, internal_page long, source string, page_width double, page_height double, lines array<{LINE}>"
BLOCK = "x1 double, y1 double, x2 double, y2 double, text string, confidence double, pass_label string"
ITEM = ("norms_code string, attr_level1 string, attr_level2 string, attr_level3 string, attr_level4 string, attr1_label string, "
        "attr2_label string, attr3_label string, attr4_label string, cost_item string, cost_item_unit string, amount double")


def number_in_path(path: Column, name: str = "page") -> Column:
    """Number that follows a name in a file's path: page_0012.json or page=12/part-0.json."""
    return F.regexp_extract(path, rf"{name}[_=]0*(\d+)", 1).try_cast("long")


class Read(NamedTuple):
    """What a source holds: its rows, and (file, record) of what could not be read as such.  Both come from one pass, written in between."""

    rows: DataFrame
    bad: DataFrame


def _permissive(spark: SparkSession, schema: str, path: str, multi_line: bool, number: Column, *more: Column) -> Read:
    """JSON records of a schema; a record that does not fit it, or whose file has no number where one is asked, is bad."""
    reader = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_corrupt")
    file = F.col("_metadata.file_path")
    columns = [c.split()[0] for c in re.split(r", (?=\w+ )", schema)]
    whole = settle(reader.json(path).select(file.alias("file"), number.alias("_number"), *more, *columns, "_corrupt"))
    good = F.col("_corrupt").isNull() & F.col("_number").isNotNull()
    return Read(whole.where(good).drop("file", "_corrupt"), whole.where(~good).select("file", F.coalesce("_corrupt", F.lit("no number in the file's name")).alias("record")))


def scan_page_lines(spark: SparkSession, path: str, multi_line: bool = True) -> Read:
    """The text lines of page files, one page a file or, without ``multi_line``, a line; pages that are no such record are bad."""
    found = _permissive(spark, PAGE, path, multi_line, F.lit(0))
    return Read(page_lines(found.rows), found.bad)


def scan_blocks(spark: SparkSession, path: str, multi_line: bool = True) -> Read:
    """The recognised blocks of page files, an array each; the page number stands in the file's path.

    Without ``multi_line`` a file holds many pages, a line each of the page's own file name and its blocks: {"name", "blocks"}.
    """
    if not multi_line:
        found = _permissive(spark, f"name string, blocks array<struct<{BLOCK.replace(', ', ',').replace(' ', ':')}>>", path, False, number_in_path(F.col("name"), "(?:ocr|page)"))
        return Read(found.rows.select(F.col("_number").alias("page"), F.inline("blocks")), found.bad)
    found = _permissive(spark, BLOCK, path, True, number_in_path(F.col("_metadata.file_path"), "(?:ocr|page)"))
    return Read(found.rows.withColumnRenamed("_number", "page"), found.bad)


def scan_items(spark: SparkSession, path: str) -> Read:
    """The items of table files, an array each; the table id stands in the file's path."""
    file = F.col("_metadata.file_path")
    number = F.coalesce(number_in_path(file, "table_id"), F.regexp_extract(file, r"/(\d+)\.json$", 1).try_cast("long"))
    found = _permissive(spark, ITEM, path, True, number)
    return Read(found.rows.withColumnRenamed("_number", "table_id"), found.bad)


def scan_markdown(spark: SparkSession, path: str, whole_files: bool = True) -> Read:
    """Markdown pages; a file without a page number in its path, or whose front matter is not closed, is bad.

    Without ``whole_files`` a file holds many pages, a line each of the page's own file name and its text: {"name", "text"}.
    """
    if not whole_files:
        found = _permissive(spark, "name string, text string", path, False, number_in_path(F.col("name")))
        closed = F.coalesce(_front_closed(F.col("text")), F.lit(False))
        return Read(markdown_pages(found.rows.where(closed).select(F.col("_number").alias("page"), "text")),
                    found.bad.unionByName(found.rows.where(~closed).select(F.col("name").alias("file"), F.col("text").alias("record"))))
    file = F.col("_metadata.file_path")
    whole = settle(spark.read.text(path, wholetext=True).select(file.alias("file"), number_in_path(file).alias("page"), F.col("value").alias("text")))
    good = F.col("page").isNotNull() & _front_closed(F.col("text"))
    return Read(markdown_pages(whole.where(good).drop("file")), whole.where(~good).select("file", F.col("text").alias("record")))


def read_page_lines(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return scan_page_lines(spark, path, multi_line).rows


def page_lines(pages: DataFrame) -> DataFrame:
    """One row per text line, numbered as stored."""
    return pages.select("page", "internal_page", "page_height", F.posexplode("lines").alias("line_no", "l")).select(
        "page", "internal_page", "page_height", "line_no", "l.*")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return scan_blocks(spark, path).rows


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return scan_markdown(spark, path).rows


FRONT = r"(?s)^---\s*\n(.*?)\n---\s*\n"


def _front_closed(text: Column) -> Column:
    return ~text.rlike(r"^---\s*\n") | text.rlike(FRONT)


def markdown_pages(pages: DataFrame) -> DataFrame:
    """Pages with their front matter (``key: value`` lines) as a map and the text below it."""
    front = F.regexp_extract("text", FRONT, 1)
    lines = F.filter(F.split(front, "\n"), lambda x: x.contains(":"))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))
    # of a repeated key the last line counts
    keyed = F.transform(lines, pair)
    last = F.filter(keyed, lambda p, i: ~F.exists(F.slice(keyed, i + 2, F.size(keyed) + 1), lambda q: q["k"] == p["k"]))
    return pages.select("*", F.map_from_entries(last).alias("front"), F.regexp_replace("text", FRONT, "").alias("body"))


def front_number(front: Column, key: str) -> Column:
    """Front-matter value as a whole number, null where it is text."""
    return F.when(front[key].rlike(r"^[+-]?\d+$"), front[key].try_cast("long"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return scan_items(spark, path).rows
