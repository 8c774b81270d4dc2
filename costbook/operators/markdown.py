"""Tables on Markdown pages as rows, and those rows as norm items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costbook.functions.costs import clean_cost_item, infer_unit
from costbook.functions.numbers import clean_amount
from costbook.functions.text import let

# Columns every table has, and words that mark the cost-item cell of a short row.
STANDARD = ("定额编号", "分部工程", "分项工程", "费用项目", "单位", "数量")
COST_TOKENS = ("人工|材料|机械|船机|基价|合计|型钢|钢板|钢筋|混凝土|板枋材|铁件|电焊条|氧气|乙炔气|红丹|调合漆|稀释剂|螺栓带帽|机加工件|其他材料|其他船机|设施摊销费|"
               "定型组合钢模|骨架|支撑|连接卡具|块石|圆木|硬杂木")
COST_PARTS = "水泥|砂浆|搅拌|起重|汽车|钻床|焊机"
AMOUNT_UNITS = ("瘦班", "艘班", "台班", "工日", "kg", "元", "m3")
RULE_ROW = r"^\|[\s\-:|]+$"


def cells_of(line: Column) -> Column:
    """Trimmed cells between the first and the last bar of a row."""
    parts = F.split(line, r"\|")
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda c: F.trim(c))


def align(cells: Column, headers: Column) -> Column:
    """Cells brought to the width of the header: extra ones cut (see ``overflow``), missing ones filled before the cost item."""
    return let(F.struct(cells.alias("c"), headers.alias("h")), lambda v: _aligned(v["c"], v["h"]))


def _aligned(cells: Column, headers: Column) -> Column:
    n, h = F.size(cells), F.size(headers)
    blank = lambda k: F.array_repeat(F.lit(""), F.greatest(k, F.lit(0)))
    attrs = F.greatest(n - 6, F.lit(0))
    middle = F.concat(F.slice(cells, F.lit(1), 3 + attrs), blank(h - 6 - attrs), F.slice(cells, 4 + attrs, F.greatest(n - 3 - attrs, F.lit(0))))
    mark = f"^({COST_TOKENS})$|{COST_PARTS}"
    found = F.array_position(F.transform(cells, lambda c, i: (i > 0) & c.rlike(mark)), True).cast("int") - 1

    def shifted(at: Column) -> Column:
        slots = h - (n - at)
        ids = F.slice(cells, F.lit(1), F.least(at, F.greatest(slots, F.lit(0))))
        tail = F.slice(cells, at + 1, F.greatest(n - at, F.lit(0)))
        return F.when(slots > 0, F.concat(ids, blank(slots - F.least(at, slots)), tail)).otherwise(F.concat(cells, blank(h - n)))

    # the search for the cost item is the dear part: bound to a variable, it runs once and for uneven rows alone
    moved = let(found, lambda f: let(F.when(f > 0, f).otherwise(F.greatest(F.lit(1), n - 3)), shifted))
    return (F.when(n == h, cells).when(n > h, F.slice(cells, F.lit(1), h)).when((n >= 6) & (h >= 6) & (h - 6 > attrs), middle).otherwise(moved))


def overflow(cells: Column, headers: Column) -> Column:
    """The cells that a row has beyond its header."""
    return F.slice(cells, F.size(headers) + 1, F.greatest(F.size(cells) - F.size(headers), F.lit(0)))


def _worked_out(rows: DataFrame, value: Column, name: str, kept: Callable[[Column], Column]) -> DataFrame:
    """The rows whose value passes, with it as a column; a plain filter would be moved before the column and work the value out again."""
    return rows.withColumn(name, F.explode_outer(F.filter(F.array(value), kept))).where(F.col(name).isNotNull())


def table_rows(pages: DataFrame) -> DataFrame:
    """Rows of all tables of Markdown pages (page, body), with heading, header, aligned cells and the cells beyond the header.

    A run of bar lines belongs to the first heading since the run before it; a run without
    heading counts only when a rule row follows its header and the header opens with the code column.
    Runs are found within the page's array of lines, so a page is read once and nothing is shuffled.
    """
    def bar(i: Column) -> Column:
        return F.coalesce(F.get("lines", i).startswith("|"), F.lit(False))

    split = pages.select("page", F.split(F.coalesce("body", F.lit("")), "\n").alias("lines"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    marked = split.select("page", "lines", F.filter(every, lambda i: bar(i) & ~bar(i - 1)).alias("starts"), F.filter(every, lambda i: bar(i) & ~bar(i + 1)).alias("ends"))

    def run(start: Column, k: Column) -> Column:
        before = F.coalesce(F.get("ends", k - 1), F.lit(-1))
        return F.struct(F.slice("lines", before + 2, start - before - 1).alias("gap"), F.slice("lines", start + 1, F.get("ends", k) - start + 1).alias("run"))

    # outer: else Spark tests the array's size before, by finding the runs once more
    runs = marked.select("page", F.posexplode_outer(F.transform("starts", run)).alias("k", "r")).where("k is not null")
    heading = F.get(F.filter("r.gap", lambda x: x.rlike(r"^#{2,4}\s+\S")), F.lit(0))
    meta = F.get(F.filter(F.transform("r.gap", lambda x: F.regexp_extract(x, r"^- \*\*(?:工程内容|单位)\*\*:\s*(.+)", 1)), lambda x: x != ""), F.lit(0))
    tables = runs.select("page", (F.col("k") + 1).cast("long").alias("table_no"), F.trim(F.regexp_replace(heading, r"^#{2,4}\s+", "")).alias("heading"), meta.alias("meta"),
                         cells_of(F.get("r.run", F.lit(0))).alias("headers"), F.coalesce(F.get("r.run", F.lit(1)).rlike(RULE_ROW), F.lit(False)).alias("ruled"), F.col("r.run").alias("run"))
    valid = tables.where(F.col("heading").isNotNull() | (F.col("ruled") & (F.get("headers", F.lit(0)) == STANDARD[0])))
    rows = valid.select("*", F.posexplode_outer("run").alias("pos", "line")).where((F.col("pos") > 0) & ~(F.col("ruled") & (F.col("pos") == 1)))
    rows = _worked_out(rows, cells_of(F.col("line")), "own", lambda c: F.size(c) > 0)
    return rows.select("page", "table_no", F.col("pos").alias("row_pos"), F.coalesce("heading", "meta", F.lit("")).alias("heading"),
                       "headers", align(F.col("own"), F.col("headers")).alias("cells"), overflow(F.col("own"), F.col("headers")).alias("overflow"))


def norm_items(rows: DataFrame) -> DataFrame:
    """Table rows as norm items with up to four attributes in columns of their own and all of them in a list; rows without a cost item drop out."""
    def picked(v: Column) -> Column:
        at = lambda name: F.array_position(v["h"], name).cast("int")
        cell = lambda name: F.when(at(name) > 0, F.try_element_at(v["c"], at(name)))
        pairs = F.filter(F.zip_with(v["h"], v["c"], lambda h, c: F.struct(h.alias("label"), c.alias("value"))),
                         lambda p: p["label"].isNotNull() & ~p["label"].isin(*STANDARD))
        return F.struct(cell("定额编号").alias("code"), cell("费用项目").alias("item"), F.coalesce(cell("单位"), F.lit("")).alias("unit"),
                        cell("数量").alias("raw"), pairs.alias("attrs"))

    fields = rows.select("page", "table_no", "row_pos", let(F.struct(F.col("headers").alias("h"), F.col("cells").alias("c")), picked).alias("f"))
    cleaned = _worked_out(fields, let(F.col("f.item"), lambda n: clean_cost_item(n)), "cost_item", lambda c: c != "")
    attr = lambda i, name: F.coalesce(F.try_element_at(F.col("f.attrs"), F.lit(i))[name], F.lit(""))
    raw, unit = F.col("f.raw"), F.col("f.unit")
    amount = clean_amount(raw)
    moved = F.when((unit == "") & F.trim(raw).isin(*AMOUNT_UNITS), F.replace(F.trim(raw), F.lit("瘦"), F.lit("艘"))).otherwise(unit)
    tail = r"\s+(kg|元|m3|工日|台班|艘班|套|个|把|根|t|m2|m)$"
    return cleaned.select(
        "page", "table_no", "row_pos", F.coalesce(F.trim("f.code"), F.lit("")).alias("norms_code"),
        *[attr(i, "value").alias(f"attr_level{i}") for i in range(1, 5)], *[attr(i, "label").alias(f"attr{i}_label") for i in range(1, 5)],
        F.regexp_replace(F.regexp_replace("cost_item", tail, ""), r"^[tT]\s*", "").alias("cost_item"),
        F.when(moved == "", let(F.col("cost_item"), lambda n: infer_unit(n))).otherwise(moved).alias("cost_item_unit"),
        amount["value"].alias("amount"), amount["quality"].alias("data_quality"), F.col("f.attrs").alias("attributes"))


def match_titles(wanted: DataFrame, titles: DataFrame) -> DataFrame:
    """Chapter of every wanted title: the equal one, else the first of which either is a prefix of the other.

    ``wanted`` (title), ``titles`` (name, ord, chap_ID).  Prefixes are spelled out, so both
    directions are equi-joins on text.
    """
    ask = wanted.select("title").distinct().filter(F.coalesce("title", F.lit("")) != "")
    known = titles.filter(F.coalesce("name", F.lit("")) != "").groupBy("name").agg(F.min(F.struct("ord", "chap_ID")).alias("hit"))
    exact = ask.join(known.withColumnRenamed("name", "title"), "title").select("title", "hit")
    heads = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n))
    longer = ask.withColumn("name", F.explode(heads(F.col("title")))).join(known, "name").groupBy("title").agg(F.min("hit").alias("hit"))
    starts = known.withColumn("title", F.explode(heads(F.col("name")))).groupBy("title").agg(F.min("hit").alias("hit"))
    shorter = ask.join(starts, "title").select("title", "hit")
    loose = longer.unionByName(shorter).groupBy("title").agg(F.min("hit").alias("hit")).join(exact, "title", "left_anti")
    return exact.unionByName(loose).select("title", F.col("hit.chap_ID").alias("chap_ID"))
