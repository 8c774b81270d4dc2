"""Text lines and recognised blocks of printed pages turned into rows, columns and records.

Lines carry (doc, page, line_no, x, x2, y, text).  Steps that depend on the order of y
values alone run over the distinct y values of a page, whose number its height bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costbook.functions.names import ATTRIBUTE_NAME, row_fields, split_fused
from costbook.operators.ordered import chunk_of, gap_groups, scan
from costbook.session import settle

PAGE_KEYS = ["doc", "page"]
STRIP = 1 << 20  # pairs of boxes that are compared at once

# Patterns of page furniture, titles, codes and attribute values.
NOISE = r"^-\s*\d+\s*-$|^-\s*\d+\s*\.\s*\d+\s*-$"
DOTS = ("·", ".", "..", "...")
CODE = r"^\d{5}$"
SHORT_CODE = r"^[1-9]\d{3}$"
CHAPTER = "第[一二三四五六七八九十]+章"
SECTION = "第[一二三四五六七八九十]+节"
ORDINAL_HEAD = "^[一二三四五六七八九十]+、"
IMPLICIT_VALUE = r"^[ⅠⅡⅢⅣⅤⅥⅨⅩIVXLCDM一二三四五六七八九十]+\s*(类土|类|级)$"
UNIT_TEXT = r"^\d+\s*(m[³3²2]|根|件|个|㎡|m|t|kg|km|%|元|工日)"
NOTE = r"^注[：:]"
LEFT_LABELS = ("顺序号", "项目", "单位", "代码", "序号", "顺", "序", "号")
ROW_UNITS = ("台班", "工日", "元", "m3", "m2", "m", "t", "kg", "10m3", "100m3", "100m2", "艘班", "组", "根", "榀", "%")
COVER_WORDS = "ICS|中华人民共和国行业标准|主编单位|批准部门"
NOTICE_WORDS = "公告|第57号|修订说明"


def not_noise(text: Column) -> Column:
    """Lines that are no page number and no lone dots."""
    t = F.trim(text)
    return (t != "") & ~t.rlike(NOISE) & ~t.isin(*DOTS)


# ---- rows from y ------------------------------------------------------------------------

def bucket(y: Column, size: int) -> Column:
    """Fixed row bucket, halves to even."""
    return (F.bround(y / size) * size).cast("long")


def rows_by_gap(lines: DataFrame, keys: list[str], tolerance: float, name: str = "row_no") -> DataFrame:
    """A new row where the step to the line above is at least the tolerance."""
    # a step equal to the tolerance already starts a row
    return gap_groups(lines, keys, F.col("y"), F.col("line_no"), tolerance - 1e-9, chunk_of(F.col("y"), 1024), name)


def rows_by_anchor(lines: DataFrame, keys: list[str], tolerance: float, rule: str = "first", name: str = "row_no") -> DataFrame:
    """Rows folded over the sorted y values of a page.

    ``first`` compares with the row's first line, ``mean`` with the running mean of the row,
    ``halving`` with an average that moves half way to every further line.
    """
    heights = lines.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n"))
    # distinct heights of one page, bounded by its height and print resolution
    sorted_ = heights.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("ys"))

    def step(acc: Column, v: Column) -> Column:
        near = (acc["no"] > 0) & (F.abs(v["y"] - acc["at"]) <= tolerance if rule == "first" else F.abs(v["y"] - acc["at"]) < tolerance)
        n = v["n"].cast("double")
        moved = {
            "first": acc["at"],
            "mean": (acc["at"] * acc["count"] + v["y"] * n) / (acc["count"] + n),
            "halving": v["y"] + (acc["at"] - v["y"]) / F.pow(F.lit(2.0), n),
        }[rule]
        no = F.when(near, acc["no"]).otherwise(acc["no"] + 1)
        return F.struct(no.alias("no"), F.when(near, moved).otherwise(v["y"]).alias("at"),
                        F.when(near, acc["count"] + n).otherwise(n).alias("count"),
                        F.concat(acc["rows"], F.array(F.struct(v["y"].alias("y"), no.alias("no")))).alias("rows"))

    start = F.struct(F.lit(0).alias("no"), F.lit(0.0).alias("at"), F.lit(0.0).alias("count"),
                     F.array().cast("array<struct<y:double,no:int>>").alias("rows"))
    placed = sorted_.select(*keys, F.explode(F.aggregate("ys", start, step, lambda a: a["rows"])).alias("r")).select(
        *keys, F.col("r.y").alias("y"), F.col("r.no").alias(name))
    return lines.join(placed, [*keys, "y"])


def value_groups(df: DataFrame, keys: list[str], value: str, tolerance: float, name: str) -> DataFrame:
    """One-dimensional clusters of a page coordinate: a new one where the step between values exceeds the tolerance.

    Runs over the distinct values of a page, bounded by its size and print resolution.
    """
    w = Window.partitionBy(*keys).orderBy(value)
    distinct = df.select(*keys, value).distinct()
    step = F.col(value) - F.lag(value).over(w)
    marked = distinct.withColumn("_start", F.when(step <= tolerance, 0).otherwise(1))
    placed = marked.withColumn(name, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_start")
    return df.join(placed, [*keys, value])


def _page_window(order: str, keys: list[str] = PAGE_KEYS) -> Window:
    # printed rows of one page, bounded by its height
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


# ---- columns ------------------------------------------------------------------------------

def cluster_centres(values: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """One-dimensional clusters with their mean."""
    # equal values fall together first, so the rows themselves meet no join
    counted = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    grouped = value_groups(counted, keys, value, tolerance, "group_no")
    return grouped.groupBy(*keys, "group_no").agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("centre"), F.sum("n").alias("n"))


def code_columns(lines: DataFrame, y_max: float = 250, tolerance: float = 15) -> DataFrame:
    """Code columns of every page: cells in the header band, clustered by x, their most common code, borders half way."""
    cells = lines.filter(F.col("text").rlike(CODE) & (F.col("y") < y_max))
    placed = value_groups(cells, PAGE_KEYS, "x", tolerance, "col")
    counted = placed.groupBy(*PAGE_KEYS, "col", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum((F.col("x") + F.col("x2")) / 2).alias("sc"))
    columns = counted.groupBy(*PAGE_KEYS, "col").agg(
        F.max_by("text", F.struct("n", -F.col("text").cast("long"))).alias("code"), (F.sum("sx") / F.sum("n")).alias("x"),
        (F.sum("sc") / F.sum("n")).alias("centre"))
    # columns of one page, bounded by its width
    w = Window.partitionBy(*PAGE_KEYS).orderBy("x")
    before, after = F.lag("x").over(w), F.lead("x").over(w)
    half = lambda other: F.abs(F.col("x") - other) / 2
    left = F.coalesce((before + F.col("x")) / 2, F.col("x") - half(after), F.col("x") - 60)
    right = F.coalesce((F.col("x") + after) / 2, F.col("x") + half(before), F.col("x") + 60)
    return columns.select(*PAGE_KEYS, "col", "code", "x", "centre", left.alias("left_x"), right.alias("right_x"))


def columns_of_page(columns: DataFrame) -> DataFrame:
    """The columns of a page as one small array."""
    return columns.groupBy(*PAGE_KEYS).agg(F.array_sort(F.collect_list(F.struct("col", "centre", "code"))).alias("columns"))


def nearest_column(cells: DataFrame, columns: DataFrame, at: Column, cutoff: float) -> DataFrame:
    """Column nearest to each cell, none beyond the cut-off; of equal distances the left one."""
    offers = F.transform("columns", lambda c: F.struct(F.abs(at - c["centre"]).alias("d"), c["col"].alias("col"), c["code"].alias("code")))
    near = cells.join(columns_of_page(columns), PAGE_KEYS).withColumn("_best", F.array_min(offers)).drop("columns")
    ok = F.col("_best.d") < cutoff
    return near.select(*cells.columns, F.when(ok, F.col("_best.col")).alias("col"), F.when(ok, F.col("_best.code")).alias("code"))


# ---- page types ----------------------------------------------------------------------------

def _any(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def _joined(*tests: Column) -> list[Column]:
    """The texts of the lines that pass each test, in order of the lines, joined by blanks; a page bounds them."""
    item = F.struct("line_no", "x", "text")
    return [F.array_join(F.transform(F.sort_array(F.collect_list(F.when(t, item))), lambda v: v["text"]), " ") for t in tests]


def classify_pages(lines: DataFrame) -> DataFrame:
    """Type of every page from its lines; titles may be set in several lines, so the header is read as one text."""
    t = F.coalesce("text", F.lit(""))
    header, opening = _joined(F.col("y") < 60, F.lit(True))
    flags = lines.groupBy(*PAGE_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t.rlike(CODE)).alias("codes"), F.count_if(F.length(t) > 30).alias("long"),
        F.count_if(t.rlike(r"\.{3,}")).alias("leaders"), _any(t.rlike(CHAPTER)).alias("chapter"), _any(t.rlike(COVER_WORDS)).alias("cover"),
        _any(t.rlike(NOTICE_WORDS)).alias("notice"), header.alias("header"), F.substring(opening, 1, 50).alias("opening"),
        _any((F.col("y") > F.col("page_height") - 60) & t.rlike(r"^-\s*\d+\s*-$")).alias("footer"))
    head = F.col("header")
    has_codes = F.col("codes") >= 3
    kind = (F.when(F.col("chapter") & (F.col("n") < 6), "chapter_title").when(F.col("n") < 3, "blank")
            .when(F.col("cover"), F.when(F.col("n") < 10, "blank").otherwise("cover")).when(F.col("notice"), "notice")
            .when(head.contains("目 次") | (F.col("leaders") >= 5), "toc")
            .when(head.contains("总说明") | F.col("opening").contains("总说明"), "general_instruction").when(head.rlike("附加说明|附录"), "appendix")
            .when(head.rlike("说( {1,2}| {4})明") & (F.col("n") < 25), "section_intro")
            .when(~has_codes & (F.col("n") >= 10) & (F.col("long") >= 5), "section_intro").when(head.rlike(SECTION) & ~has_codes, "section_intro")
            .when(has_codes, F.when(head.rlike("续 {0,2}表"), "continued_table").otherwise("norms_table"))
            .when(F.col("footer") & (F.col("n") > 20), "section_intro").otherwise("blank"))
    return flags.select(*PAGE_KEYS, kind.alias("page_type"))


def classify_block_pages(blocks: DataFrame) -> DataFrame:
    """Type of every page from its recognised blocks, with its codes and markers."""
    t = F.col("text")
    is_code = t.rlike(SHORT_CODE)
    flags = blocks.groupBy(*PAGE_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_code).alias("code_count"), F.min(F.when(is_code, t.try_cast("int"))).alias("first_code"),
        F.max(F.when(is_code, t.try_cast("int"))).alias("last_code"), _any(t.rlike("续[前该]?表")).alias("has_continued"),
        _any(t.rlike(r"第[一二三四五六七八九十\d]+[章节]")).alias("titled"), _any(t.contains("水上运距")).alias("has_transport"),
        F.min_by(F.regexp_extract("text", r"每\d+[根组m³t]", 0), F.when(t.rlike(r"每\d+[根组m³t]"), F.col("line_no"))).alias("unit"))
    has_codes = F.col("code_count") >= 3
    kind = (F.when(F.col("titled"), F.when(has_codes, "norms_table").otherwise("chapter_text"))
            .when(F.col("has_continued") | has_codes, "norms_table").when(F.col("n") < 30, "blank_or_short").otherwise("chapter_text"))
    return flags.select(*PAGE_KEYS, kind.alias("page_type"), "has_continued", "has_transport", F.coalesce("unit", F.lit("")).alias("unit"),
                        "code_count", "first_code", "last_code")


def page_metadata(lines: DataFrame, y_max: float = 130) -> DataFrame:
    """Sub-section, work content, unit and continued mark from the header band."""
    t, order = F.trim("text"), F.struct("y", "x", "line_no")
    first = lambda test, value=t: F.coalesce(F.min_by(value, F.when(test, order)), F.lit(""))
    work = t.contains("工程内容")
    is_unit = t.rlike(UNIT_TEXT) & (F.length(t) < 20)
    continued = _any(t.contains("续表") & (F.length(t) < 20)) & ~_any(t.contains("定额编号"))
    head = lines.filter((F.col("y") < y_max) | t.contains("定额编号"))
    return head.groupBy(*PAGE_KEYS).agg(
        first((F.col("y") < y_max) & (t.rlike(ORDINAL_HEAD) | t.rlike(r"^\d{1,2}[.、]\s*\S")) & ~work).alias("subsection"),
        F.coalesce(F.max_by(F.regexp_replace(t, "^.*?(工程内容|工作内容)[：:]?\\s*", ""), F.when((F.col("y") < y_max) & work, order)), F.lit("")).alias("work_content"),
        F.coalesce(F.min_by(t, F.when((F.col("y") < y_max) & is_unit, F.struct(F.length(t), "y", "x", "line_no"))), F.lit("")).alias("unit"),
        continued.alias("is_continued"))


# ---- context along the book ------------------------------------------------------------------

def context_carry(titles: DataFrame) -> DataFrame:
    """Chapter, section and sub-section of every page; a higher title empties the lower ones.

    ``titles`` (doc, page, level 1-3 or null, title).
    """
    lv, title, none = F.col("level"), F.col("title"), F.lit("")
    carry = {"chapter": F.when(lv == 1, title), "section": F.when(lv == 1, none).when(lv == 2, title),
             "subsection": F.when(lv <= 2, none).when(lv == 3, title)}
    out = scan(titles, ["doc"], [F.col("page")], chunk_of(F.col("page")), carry=carry)
    return out.select(*PAGE_KEYS, *[F.coalesce(c, none).alias(c) for c in carry])


def as_of_contents(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """Chapter, section and sub-section a page falls under by the table of contents.

    ``contents`` (doc, ord, level 1-3, title, start, with the start of the entries above it already
    applied); the last entry in document order that starts at or before the page counts.
    """
    entry = F.struct("ord", "title")
    starts = contents.select("doc", F.col("start").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("page"), "ord",
                             *[F.when(F.col("level") == i, entry).alias(f"e{i}") for i in (1, 2, 3)])
    nothing = F.lit(None).cast("struct<ord:bigint,title:string>")
    asked = pages.select("doc", F.col("page").alias("at"), F.lit(1).alias("side"), "page", F.lit(None).cast("long").alias("ord"),
                         *[nothing.alias(f"e{i}") for i in (1, 2, 3)])
    names = ("chapter", "section", "subsection")
    both = scan(starts.unionByName(asked), ["doc"], [F.col("at"), F.col("side"), F.coalesce("ord", "page")], chunk_of(F.col("at")),
                top={n: F.col(f"e{i}") for i, n in enumerate(names, 1)})
    return both.filter(F.col("side") == 1).select("doc", "page", *[F.coalesce(F.col(f"{n}.title"), F.lit("")).alias(n) for n in names])


FIXED_CHAPTERS = {"general_instruction": "总说明", "toc": "目录", "notice": "公告", "appendix": "附加说明"}


def page_context(typed: DataFrame, as_of: DataFrame, header: DataFrame) -> DataFrame:
    """Context of every page: fixed labels by type, else the contents, overridden by the page's own header.

    ``header`` (doc, page, h_section, h_subsection), null where the page shows none.
    """
    joined = typed.join(as_of, PAGE_KEYS, "left").join(header, PAGE_KEYS, "left")
    kind = F.col("page_type")
    located = kind.isin("norms_table", "continued_table", "section_intro")
    fixed = F.lit("")
    for k, label in FIXED_CHAPTERS.items():
        fixed = F.when(kind == k, F.lit(label)).otherwise(fixed)
    own = lambda h, c: F.when(located, F.coalesce(F.col(h), F.col(c), F.lit(""))).otherwise(F.lit(""))
    tables = kind.isin("norms_table", "continued_table")
    sub = F.when(tables, F.coalesce("h_subsection", "subsection", F.lit(""))).when(located, F.coalesce("subsection", F.lit(""))).otherwise(F.lit(""))
    return joined.select(*PAGE_KEYS, "page_type", F.when(located, F.coalesce("chapter", F.lit(""))).otherwise(fixed).alias("chapter"),
                         own("h_section", "section").alias("section"), sub.alias("subsection"))


def contents_tree(entries: DataFrame) -> DataFrame:
    """Levels and parents of table-of-contents lines (doc, ord, x, title, start).

    Level by indent; an entry hangs on the last entry above it of a lower level.  Starts are
    raised to those of the entries above, so a child never counts before its parent.
    """
    level = F.when(F.col("x") < 40, 1).when(F.col("x") < 65, 2).otherwise(3)
    leveled = entries.withColumn("level", level)
    is_top = F.col("level") == 1
    keep = leveled.filter(~is_top | F.col("title").rlike(CHAPTER) | F.col("title").contains("总说明") | F.col("title").contains("附加说明"))
    none = F.struct(F.lit(None).cast("long").alias("ord"), F.lit(None).cast("long").alias("start"))
    own = F.struct("ord", "start")
    out = scan(keep, ["doc"], [F.col("ord")], chunk_of(F.col("ord")), carry={
        "_chapter": F.when(is_top, own), "_section": F.when(is_top, none).when(F.col("level") == 2, own)})
    parent = F.when(F.col("level") == 2, F.col("_chapter.ord")).when(F.col("level") == 3, F.coalesce("_section.ord", "_chapter.ord"))
    above = F.greatest(F.when(F.col("level") > 1, F.col("_chapter.start")), F.when(F.col("level") > 2, F.col("_section.start")))
    return out.select("doc", "ord", "level", "title", F.greatest("start", above).alias("start"), parent.alias("parent_ord"))


def sections_of_pages(pages: DataFrame) -> DataFrame:
    """Runs of table pages that belong together; text pages stand alone.

    ``pages`` (doc, page, page_type, title, has_continued, unit, first_code, last_code, has_transport).
    """
    is_text = F.col("page_type").isin("blank_or_short", "chapter_text")
    opens = (F.coalesce("title", F.lit("")) != "") & ~F.col("has_continued")
    order, chunk = [F.col("page")], chunk_of(F.col("page"))
    seen = scan(pages.withColumn("_text", is_text), ["doc"], order, chunk, previous={"_was_text": F.col("_text")})
    start = F.when(F.col("_text") | opens | F.coalesce("_was_text", F.lit(True)), 1).otherwise(0)
    placed = scan(seen.withColumn("_start", start), ["doc"], order, chunk, total={"section_no": F.col("_start")})
    unit = F.min_by("unit", F.when(F.coalesce("unit", F.lit("")) != "", F.col("page")))
    first = F.min_by("first_code", F.when(F.col("first_code").isNotNull(), F.col("page")))
    return placed.groupBy("doc", "section_no").agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("pages"), F.bool_or("_text").alias("is_text"),
        F.coalesce(unit, F.lit("")).alias("unit"), first.alias("code_from"), F.max("last_code").alias("code_to"), F.bool_or("has_transport").alias("has_transport"))


# ---- table regions and rows --------------------------------------------------------------------

TABLE_TITLE = r"^(续?附表?\d|续?表[\d一二三四五六七八九十]|续表)"


def table_regions(rows: DataFrame) -> DataFrame:
    """Whether each row of a page belongs to a table, and the segment it falls in.

    ``rows`` (doc, page, row_no, cells, text, x).  A title opens a region that runs down to a note,
    a page number or a paragraph and up to the next paragraph above; without titles, four
    rows in a row of several cells make a table.
    """
    t, single = F.trim("text"), F.col("cells") == 1
    title = t.rlike(TABLE_TITLE)
    number = t.rlike(r"^[-–—·]\s*\d+\s*[-–—·]?\s*$") | (((F.col("x") < 60) | (F.col("x") > 500)) & t.rlike(r"^\d{1,3}$"))
    stop = single & ~title & (t.startswith("注") | number | ((F.length("text") >= 20) & ~F.col("text").contains("表")))
    paragraph = single & (F.length("text") > 30)
    down, up = _page_window("row_no"), Window.partitionBy(*PAGE_KEYS).orderBy(F.col("row_no").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = Window.partitionBy(*PAGE_KEYS).orderBy("row_no")
    last = lambda c, w: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0)) == 1
    marked = rows.withColumn("_marked", last(F.when(title, 1).when(stop, 0), down) | last(F.when(title, 1).when(paragraph, 0), up))
    multi = F.col("cells") >= 2
    begin = F.when(multi & ~F.coalesce(F.lag(multi).over(near), F.lit(False)), 1).otherwise(0)
    runs = marked.withColumn("_multi", multi).withColumn("_begin", begin).withColumn("_run", F.sum("_begin").over(down))
    whole = Window.partitionBy(*PAGE_KEYS, "_run", "_multi")
    first, end = F.min(F.when(~F.col("_marked"), F.col("row_no"))).over(whole), F.max("row_no").over(whole)
    fallback = F.coalesce(F.col("_multi") & (F.col("row_no") >= first) & (end - first >= 3), F.lit(False))
    tables = runs.withColumn("is_table", F.col("_marked") | fallback)
    change = F.when(F.coalesce(F.lag("is_table").over(near) == F.col("is_table"), F.lit(False)), 0).otherwise(1)
    return tables.withColumn("_change", change).select(*PAGE_KEYS, "row_no", "is_table", F.sum("_change").over(down).alias("segment"))


def merge_orphans(rows: DataFrame, keys: list[str], is_orphan: Column) -> DataFrame:
    """Group number of printed rows in which an orphan row joins the row above; the first row always opens a group."""
    first = F.lag(F.lit(1)).over(Window.partitionBy(*keys).orderBy("row_no")).isNull()
    marked = rows.withColumn("_start", F.when(is_orphan & ~first, 0).otherwise(1))
    return marked.withColumn("group_no", F.sum("_start").over(_page_window("row_no", keys))).drop("_start")


def drop_repeated_headers(lines: DataFrame, keys: list[str], order: str, is_header: Column) -> DataFrame:
    """Non-blank lines without a code header that directly repeats one."""
    shown = lines.filter(F.trim("text") != "").withColumn("_h", is_header)
    seen = scan(shown, keys, [F.col(order)], chunk_of(F.col(order)), previous={"_was": F.col("_h")})
    return seen.filter(~(F.col("_h") & F.coalesce("_was", F.lit(False)))).drop("_h", "_was")


def paragraph_text(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of text from placed blocks (row_no): a wide gap gives two blanks, a narrow one a blank, none joins."""
    order = [F.col("x"), F.col("line_no")]
    # one printed line at a time
    gap = F.col("x") - F.lag("x2").over(Window.partitionBy(*keys, "row_no").orderBy(*order))
    lead = F.when(gap.isNull() | (gap <= 0), "").when(gap > 20, "  ").otherwise(" ")
    pieces = blocks.withColumn("piece", F.concat(lead, "text"))
    joined = pieces.groupBy(*keys, "row_no").agg(F.array_sort(F.collect_list(F.struct("x", "line_no", "piece"))).alias("p"))
    text = F.trim(F.array_join(F.transform("p", lambda v: v["piece"]), ""))
    return joined.select(*keys, "row_no", text.alias("text")).filter((F.length("text") > 1) & ~F.col("text").rlike(r"^\d+$"))


def split_secondary(rows: DataFrame) -> DataFrame:
    """Main table, surcharge table or footnote: rows (doc, page, row_no, y, text) at or below the surcharge row go to the second."""
    t = F.col("text")
    surcharge = (t.contains("水上运距") & (t.contains("每增") | t.contains("km"))) | (t.contains("每增") & t.contains("1km") & (F.col("y") > 450))
    at = rows.groupBy(*PAGE_KEYS).agg(F.min(F.when(surcharge, F.col("y"))).alias("_at"))
    part = F.when(t.startswith("附注") | t.contains("附注："), "note").when(F.col("y") > F.col("_at") - 15, "secondary").otherwise("main")
    return rows.join(at, PAGE_KEYS).withColumn("part", part).drop("_at")


# ---- header attributes and records ---------------------------------------------------------------

def table_zones(lines: DataFrame, columns: DataFrame) -> DataFrame:
    """Per page: y of the code row, left border of the columns, y where the data begin."""
    first = columns.groupBy(*PAGE_KEYS).agg((F.min("x") - 20).alias("left_boundary"))
    marked = lines.join(first, PAGE_KEYS)
    code_row = marked.filter(F.col("text") == "定额编号").groupBy(*PAGE_KEYS).agg(F.min_by("y", "line_no").alias("code_y"))
    starts = marked.join(code_row, PAGE_KEYS).filter(
        (F.col("y") > F.col("code_y") + 20) & (F.col("x") < F.col("left_boundary")) & F.col("text").rlike(r"^\d{1,2}(\s|$)"))
    data = starts.groupBy(*PAGE_KEYS).agg(F.min("y").alias("data_y"))
    return first.join(code_row, PAGE_KEYS).join(data, PAGE_KEYS)


def header_attributes(lines: DataFrame, columns: DataFrame, zones: DataFrame) -> DataFrame:
    """Attribute values of every code column, by four rules of falling priority.

    Fused names apply to all columns; explicit names take the value row closest below; classes and
    grades name themselves; what is left takes the next value below a name in its own column.
    """
    t = F.col("text")
    inside = lines.join(zones, PAGE_KEYS).filter((F.col("y") > F.col("code_y")) & (F.col("y") < F.col("data_y")) & (F.col("x") >= F.col("left_boundary"))
                                                 & (t != "") & ~t.isin(*LEFT_LABELS) & ~t.rlike(CODE))
    named, implicit = t.rlike(ATTRIBUTE_NAME), t.rlike(IMPLICIT_VALUE)
    frags = inside.select(*PAGE_KEYS, "line_no", "x", "y", t, ((F.col("x") + F.col("x2")) / 2).alias("at"), bucket(F.col("y"), 8).alias("level"),
                          named.alias("named"), implicit.alias("implicit"))
    plain = ~F.col("named") & ~F.col("implicit") & (t.rlike(r"^[\d.]+$") | (F.length(t) <= 8))
    levels = frags.groupBy(*PAGE_KEYS, "level").agg(_any(F.col("implicit")).alias("i"), _any(F.col("named")).alias("n"), _any(plain).alias("v"))
    kinds = levels.select(*PAGE_KEYS, "level", F.when(F.col("i"), "implicit").when(F.col("n"), "names").when(F.col("v"), "values").otherwise("other").alias("kind"))
    placed = settle(nearest_column(frags.join(kinds, [*PAGE_KEYS, "level"]), columns, F.col("at"), 80))
    kinds = placed.select(*PAGE_KEYS, "level", "kind").distinct()
    split = split_fused(t)
    fused = placed.filter((F.col("kind") == "names") & split["name"].isNotNull()).select(*PAGE_KEYS, split["name"].alias("name"), split["value"].alias("value"), F.col("level").alias("ord"))
    fused_all = fused.groupBy(*PAGE_KEYS, "name").agg(F.max_by("value", "ord").alias("value")).join(columns.select(*PAGE_KEYS, "col", "code"), PAGE_KEYS)
    # value rows below each row of names, the closest one within 50
    name_levels = kinds.filter("kind = 'names'").select(*PAGE_KEYS, F.col("level").alias("name_level"))
    value_levels = kinds.filter("kind = 'values'").groupBy(*PAGE_KEYS).agg(F.array_sort(F.collect_list("level")).alias("below"))
    pairs = name_levels.join(value_levels, PAGE_KEYS).withColumn(
        "level", F.array_min(F.filter("below", lambda v: (v > F.col("name_level")) & (v - F.col("name_level") < 50)))).filter(F.col("level").isNotNull())
    names = placed.filter((F.col("kind") == "names") & F.col("named")).groupBy(*PAGE_KEYS, F.col("level").alias("name_level")).agg(
        F.array_sort(F.collect_list(F.struct("at", "text"))).alias("names"))
    values = placed.filter((F.col("kind") == "values") & F.col("col").isNotNull() & ~F.col("named") & ~F.col("implicit") & (F.length(t) <= 30) & ~t.isin(".", "-"))
    closest = F.array_min(F.transform("names", lambda n: F.struct(F.abs(F.col("at") - n["at"]).alias("d"), n["text"].alias("name"))))
    explicit = values.join(pairs.drop("below"), [*PAGE_KEYS, "level"]).join(names, [*PAGE_KEYS, "name_level"]).select(
        *PAGE_KEYS, "col", "code", closest["name"].alias("name"), t.alias("value"), F.col("name_level").alias("ord"), "line_no")
    own_name = F.when(t.contains("类"), "土壤类别").when(t.contains("级"), "级别").otherwise("分类")
    graded = placed.filter((F.col("kind") == "implicit") & F.col("implicit") & F.col("col").isNotNull()).select(
        *PAGE_KEYS, "col", "code", own_name.alias("name"), t.alias("value"), F.col("level").alias("ord"), "line_no")
    column_names = placed.filter(F.col("named") & F.col("col").isNotNull()).select(*PAGE_KEYS, "col", "code", t.alias("name"), F.col("y").alias("ny"))
    under = placed.filter(~F.col("named") & ~F.col("implicit") & F.col("col").isNotNull() & (F.length(t) < 30)).select(*PAGE_KEYS, "col", t.alias("value"), F.col("y").alias("vy"), "line_no")
    below = column_names.join(under, [*PAGE_KEYS, "col"]).filter((F.col("vy") >= F.col("ny")) & (F.col("vy") - F.col("ny") < 40))
    next_ = below.groupBy(*PAGE_KEYS, "col", "code", "name", "ny").agg(F.min_by("value", F.struct("vy", "line_no")).alias("value"))
    rule = lambda df, no: df.select(*PAGE_KEYS, "col", "code", "name", "value", F.lit(no).alias("rule"), F.col("ord").cast("double").alias("ord"), F.col("line_no").cast("long").alias("line_no"))
    every = (rule(fused_all.withColumn("ord", F.lit(0)).withColumn("line_no", F.lit(0)), 0).unionByName(rule(explicit, 1)).unionByName(rule(graded, 2))
             .unionByName(rule(next_.withColumn("ord", F.col("ny")).withColumn("line_no", F.lit(0)), 3)))
    return every.groupBy(*PAGE_KEYS, "col", "code", "name").agg(F.min_by("value", F.struct("rule", "ord", "line_no")).alias("value"))


def table_records(lines: DataFrame, columns: DataFrame, zones: DataFrame) -> DataFrame:
    """One record per data row and code column: code, item, unit, resource code and amount as text."""
    t = F.col("text")
    data = lines.join(zones, PAGE_KEYS).filter((F.col("y") >= F.col("data_y") - 3) & not_noise(t) & ~t.rlike(NOTE) & (t != "-"))
    placed = settle(data.withColumn("row_no", bucket(F.col("y"), 5)).withColumn("at", (F.col("x") + F.col("x2")) / 2))
    left = placed.filter(F.col("x") < F.col("left_boundary"))
    # parts of one printed row
    heads = left.groupBy(*PAGE_KEYS, "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "line_no", "text"))), lambda p: p["text"]), " ").alias("left_text"))
    cells = placed.filter(F.col("x") >= F.col("left_boundary"))
    rows = heads.select(*PAGE_KEYS, "row_no").unionByName(cells.select(*PAGE_KEYS, "row_no")).distinct().join(heads, [*PAGE_KEYS, "row_no"], "left").withColumn(
        "left_text", F.coalesce("left_text", F.lit(""))).filter(~F.col("left_text").startswith("注"))
    grouped = merge_orphans(rows, PAGE_KEYS, F.col("left_text").isin(*ROW_UNITS))
    merged = grouped.groupBy(*PAGE_KEYS, "group_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "left_text"))), lambda p: p["left_text"]), " ").alias("left_text"))
    fields = row_fields(F.col("left_text"))
    named = merged.withColumn("f", fields).filter(F.col("f.name") != "").select(*PAGE_KEYS, "group_no", F.col("f.name").alias("item"), F.col("f.unit").alias("unit"), F.col("f.code").alias("res_code"))
    # several numbers in one cell spread over the columns from the one it starts in
    several = F.split(t, r"\s+")
    is_several = t.rlike(r"^[\d.]+(\s+[\d.]+)+$")
    begin = nearest_column(cells.withColumn("_p", F.when(is_several, several).otherwise(F.array(t))), columns, F.when(is_several, F.col("x")).otherwise(F.col("at")), 80)
    spread = begin.filter(F.col("col").isNotNull()).select(*PAGE_KEYS, "row_no", "line_no", "x", "col", F.posexplode("_p").alias("i", "amount")).withColumn("col", F.col("col") + F.col("i"))
    valued = spread.join(grouped.select(*PAGE_KEYS, "row_no", "group_no"), [*PAGE_KEYS, "row_no"])
    # within a printed row the rightmost text of a column counts, of merged rows the upper one
    last = valued.groupBy(*PAGE_KEYS, "group_no", "row_no", "col").agg(F.max_by("amount", F.struct("x", "line_no")).alias("amount"))
    one = last.groupBy(*PAGE_KEYS, "group_no", "col").agg(F.min_by("amount", "row_no").alias("amount"))
    return one.join(named, [*PAGE_KEYS, "group_no"]).join(columns.select(*PAGE_KEYS, "col", "code"), [*PAGE_KEYS, "col"]).select(
        *PAGE_KEYS, "group_no", "code", "item", "unit", "res_code", "amount")


def records_with_attributes(records: DataFrame, attributes: DataFrame) -> DataFrame:
    """Records with the attributes of their code column as a map."""
    maps = attributes.groupBy(*PAGE_KEYS, "code").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "value")))).alias("attrs"))
    return records.join(maps, [*PAGE_KEYS, "code"], "left")


def attribute_order(attributes: DataFrame) -> DataFrame:
    """Attribute names of a page in the order columns first show them."""
    first = attributes.groupBy(*PAGE_KEYS, "name").agg(F.min("col").alias("first_col"))
    w = Window.partitionBy(*PAGE_KEYS).orderBy("first_col", "name")
    # names of one page's header
    return first.withColumn("pos", F.row_number().over(w))


# ---- recognised blocks ------------------------------------------------------------------------------

def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by page as batches of whole pages, each with the places where its pages begin and its end."""
    held: list[pa.RecordBatch] = []

    def begins(b: pa.RecordBatch) -> np.ndarray:
        codes = [b.column(k).dictionary_encode("encode").indices.to_numpy() for k in PAGE_KEYS]
        return np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1

    def joined(pieces: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        whole = pa.concat_batches(pieces)
        return whole, np.concatenate([[0], begins(whole), [whole.num_rows]])

    for b in batches:
        if not b.num_rows:
            continue
        if held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in PAGE_KEYS):
            yield joined(held)
            held = []
        cuts = begins(b)
        if len(cuts):
            yield joined([*held, b.slice(0, cuts[-1])])
            held = [b.slice(cuts[-1])]
        else:
            held.append(b)
    if held:
        yield joined(held)


def _overlapping(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, overlap: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each box of a page with the boxes before it that it overlaps by more than ``overlap`` (as ``bbox_iou``), in strips of bounded size."""
    n = len(x1)
    area = np.fmax(0.0, x2 - x1) * np.fmax(0.0, y2 - y1)
    strip = max(1, STRIP // n)
    for a in range(0, n, strip):
        s = slice(a, a + strip)
        inter = np.fmax(0.0, np.fmin(x2[s, None], x2) - np.fmax(x1[s, None], x1)) * np.fmax(0.0, np.fmin(y2[s, None], y2) - np.fmax(y1[s, None], y1))
        hits = inter / (area[s, None] + area - inter + 1e-6) > overlap
        for i in range(len(hits)):
            yield a + i, np.flatnonzero(hits[i, :a + i])


def _fold(corners: list[np.ndarray], lengths: list[int | None], overlap: float, first_box: bool) -> tuple[list[int], list[int]]:
    """The rows of a page's sorted blocks that stay, and for each the row whose box it has."""
    kept: list[int] = []
    boxes: list[int] = []
    place: dict[int, int] = {}  # of the row whose box a kept block has
    for i, hits in _overlapping(*corners, overlap):
        at = min((place[j] for j in hits.tolist() if j in place), default=None)
        if at is None:
            place[i] = len(kept)
            kept.append(i)
            boxes.append(i)
        elif lengths[i] is not None and lengths[kept[at]] is not None and lengths[i] > lengths[kept[at]]:
            kept[at] = i
            if not first_box:
                del place[boxes[at]]
                place[i], boxes[at] = at, i
    return kept, boxes


def fuse_blocks(blocks: DataFrame, overlap: float = 0.5, first_box: bool = False) -> DataFrame:
    """Blocks of several recognition passes, duplicates removed: most confident first, a longer text replaces.

    A replacing block brings its box along; with ``first_box`` the box of the first one stays, and text, confidence and the label
    of the pass (column ``pass_label``) are taken.  Equal blocks fall together before the fold, which takes one page at a time.
    """
    corners = ["x1", "y1", "x2", "y2"]
    box = [*corners, "text", "confidence", *(["pass_label"] if first_box else [])]
    distinct = blocks.select(*PAGE_KEYS, *[F.col(c).cast("double").alias(c) for c in corners], *box[4:]).distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bounds in _whole_pages(batches):
            places = [b.column(c).to_numpy(zero_copy_only=False) for c in corners]
            lengths = b.column("n").to_pylist()
            rows: list[int] = []
            taken: list[int] = []
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                kept, boxes = _fold([p[a:z] for p in places], lengths[a:z], overlap, first_box)
                rows += [a + i for i in kept]
                taken += [a + i for i in boxes]
            own, boxed = b.take(pa.array(rows, pa.int64())), b.select(corners).take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([boxed.column(c) if c in corners else own.column(c) for c in (*PAGE_KEYS, *box)], [*PAGE_KEYS, *box])

    # by page, most confident first, of these the longest text
    order = [F.col("confidence").desc_nulls_first(), F.col("n").desc_nulls_first(), *box]
    dealt = distinct.withColumn("n", F.length("text")).repartition(*PAGE_KEYS).sortWithinPartitions(*PAGE_KEYS, *order)
    return dealt.mapInArrow(work, distinct.schema)


def _in_grid(blocks: DataFrame, y_tolerance: float, x_tolerance: float) -> DataFrame:
    """The blocks with row and column of their page's grid: clustered centres, code columns exact."""
    # written, as five branches read it
    box = blocks.select(*PAGE_KEYS, "x1", "y1", "x2", "y2", "text", "confidence")
    mid = settle(box.withColumn("cx", (F.col("x1") + F.col("x2")) / 2).withColumn("cy", (F.col("y1") + F.col("y2")) / 2))
    rows = cluster_centres(mid, PAGE_KEYS, "cy", y_tolerance)
    columns = cluster_centres(mid, PAGE_KEYS, "cx", x_tolerance)
    codes = mid.filter(F.col("text").rlike(r"^\d{4}$")).select(*PAGE_KEYS, F.col("cx").alias("centre")).distinct()
    first = codes.groupBy(*PAGE_KEYS).agg(F.min("centre").alias("first_code"))
    kept = columns.join(first, PAGE_KEYS, "left").filter(F.col("first_code").isNull() | (F.col("centre") < F.col("first_code") - 30)).select(*PAGE_KEYS, "centre")
    # centres of one page, bounded by its size
    listed = lambda df, name: df.groupBy(*PAGE_KEYS).agg(F.array_sort(F.collect_list("centre")).alias(name))
    near = lambda centres, v: F.array_min(F.transform(centres, lambda c, i: F.struct(F.abs(c - v).alias("d"), i.alias("i"))))["i"]
    placed = mid.join(listed(rows, "ys"), PAGE_KEYS).join(listed(kept.unionByName(codes), "xs"), PAGE_KEYS)
    return placed.withColumn("row_no", near(F.col("ys"), F.col("cy"))).withColumn("col_no", near(F.col("xs"), F.col("cx")))


def assemble_grid(blocks: DataFrame, y_tolerance: float = 12, x_tolerance: float = 25) -> DataFrame:
    """Cells of a page with the text of their most confident block."""
    return _in_grid(blocks, y_tolerance, x_tolerance).groupBy(*PAGE_KEYS, "row_no", "col_no").agg(
        F.max_by("text", F.struct("confidence", (-F.col("y1")).alias("y"), (-F.col("x1")).alias("x"), "text")).alias("text"))


def grid_cells(blocks: DataFrame, y_tolerance: float = 12, x_tolerance: float = 25) -> DataFrame:
    """Cells of a page with all their texts, from top to bottom and left to right: trimmed, blank ones left out, of consecutive equal ones
    one, joined by blanks; with the highest confidence and the box around them."""
    item = F.struct("y1", "x1", F.trim("text").alias("text"))
    cells = _in_grid(blocks, y_tolerance, x_tolerance).where(F.trim("text") != "").groupBy(*PAGE_KEYS, "row_no", "col_no").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda v: v["text"]).alias("texts"), F.max("confidence").alias("confidence"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    own = F.col("texts")
    merged = F.filter(own, lambda x, i: (i == 0) | (x != F.get(own, i - 1)))
    return cells.select(*PAGE_KEYS, "row_no", "col_no", F.array_join(merged, " ").alias("text"), F.size(merged).alias("parts"), "confidence", "x1", "y1", "x2", "y2")


def merge_runs(cells: DataFrame) -> DataFrame:
    """Neighbouring grid cells of equal text as one: runs along a row first, then equal runs in the rows below.

    ``cells`` (doc, page, row_no, col_no, text) gives row_no, col_no, row_span, col_span, text of each merged cell.  A page bounds a window.
    """
    along = Window.partitionBy(*PAGE_KEYS, "row_no").orderBy("col_no")
    starts = F.when((F.lag("text").over(along) == F.col("text")) & (F.lag("col_no").over(along) == F.col("col_no") - 1), 0).otherwise(1)
    runs = cells.withColumn("_s", starts).withColumn("_run", F.sum("_s").over(along)).groupBy(*PAGE_KEYS, "row_no", "_run").agg(
        F.min("col_no").alias("col_no"), F.count(F.lit(1)).alias("col_span"), F.first("text").alias("text"))
    down = Window.partitionBy(*PAGE_KEYS, "col_no", "col_span", "text").orderBy("row_no")
    below = F.when(F.lag("row_no").over(down) == F.col("row_no") - 1, 0).otherwise(1)
    return runs.withColumn("_s", below).withColumn("_run", F.sum("_s").over(down)).groupBy(*PAGE_KEYS, "col_no", "col_span", "text", "_run").agg(
        F.min("row_no").alias("row_no"), F.count(F.lit(1)).alias("row_span")).select(*PAGE_KEYS, "row_no", "col_no", "row_span", "col_span", "text")


def split_grid(cells: DataFrame, least_rows: int = 3) -> DataFrame:
    """Grid rows cut into tables at ordinal headings; pieces of fewer rows than ``least_rows`` drop out."""
    rows = cells.groupBy(*PAGE_KEYS, "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda c: c["text"]), " ").alias("text"))
    heading = F.when(F.col("text").rlike("^[二三四五六七八九十]、") & (F.col("row_no") > 0), 1).otherwise(0)
    pieces = rows.withColumn("_h", heading).withColumn("piece", F.sum("_h").over(_page_window("row_no")))
    sizes = pieces.groupBy(*PAGE_KEYS, "piece").agg((F.max("row_no") - F.min("row_no") + 1).alias("rows")).filter(F.col("rows") >= least_rows)
    return pieces.join(sizes, [*PAGE_KEYS, "piece"]).select(*PAGE_KEYS, "piece", "row_no", "text")
