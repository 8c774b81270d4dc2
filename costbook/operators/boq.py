"""Bills of quantities: a sheet of cells A..Z per book turned into items, resources and quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costbook.functions.names import classify_boq_code, clean_text, strip_brackets
from costbook.functions.numbers import safe_float
from costbook.operators.ordered import chunk_of, scan

RESOURCE_COLUMNS = tuple("OPQRSTUVWXYZ")
HEADER_ROWS = 2
# Labels of the four attributes of a bill item.
ATTRIBUTE_LABELS = ("分类指标", "项目特征", "工作内容", "计算规则")


def coded_rows(grid: DataFrame) -> DataFrame:
    """Rows below the sheet header that carry a code in column A."""
    return grid.filter((F.col("row_no") > HEADER_ROWS) & (F.coalesce("A", F.lit("")) != ""))


def unpivot_columns(df: DataFrame, keys: list[str], columns: tuple[str, ...] = RESOURCE_COLUMNS) -> DataFrame:
    """Cells of several columns as rows (keys, col, cell)."""
    present = [c for c in columns if c in df.columns]
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("cell")) for c in present])).alias("x")).select(
        *keys, "x.col", "x.cell")


def resource_definitions(grid: DataFrame) -> DataFrame:
    """Resources named in a sub-section row (``name⏎unit``), priced by the first row below that holds a price.

    A price row has no code; only the first one after the sub-section row counts.
    """
    rows = grid.filter(F.col("row_no") > HEADER_ROWS)
    is_sub = F.coalesce(F.col("A"), F.lit("")).rlike(r"^[A-Z]\.[a-z]$")
    placed = scan(rows, ["book"], [F.col("row_no")], chunk_of(F.col("row_no")),
                  carry={"sub_code": F.when(is_sub, F.col("A")), "sub_row": F.when(is_sub, F.col("row_no"))})
    named = unpivot_columns(placed.filter(is_sub), ["book", "sub_code", "sub_row"]).filter(F.col("cell").contains("\n"))
    parts = F.split("cell", "\n")
    defs = named.select("book", "sub_code", "sub_row", "col", F.trim(parts[0]).alias("name"), F.trim(parts[1]).alias("unit"))
    uncoded = placed.filter((F.coalesce("A", F.lit("")) == "") & F.col("sub_row").isNotNull())
    cells = unpivot_columns(uncoded, ["book", "sub_row", "row_no"]).select(
        "book", "sub_row", "row_no", "col", safe_float(F.col("cell")).alias("unit_price")).filter(F.col("unit_price").isNotNull())
    offered = cells.join(defs.select("book", "sub_row", "col"), ["book", "sub_row", "col"], "left_semi")
    first = offered.groupBy("book", "sub_row").agg(F.min("row_no").alias("row_no"))
    prices = offered.join(first, ["book", "sub_row", "row_no"], "left_semi").drop("row_no")
    return defs.join(prices, ["book", "sub_row", "col"], "left").drop("sub_row")


def tree(grid: DataFrame) -> DataFrame:
    """Sections, sub-sections, groups and items by code; groups that only their items name are implicit."""
    rows = coded_rows(grid).withColumn("code", clean_text(F.col("A")))
    leveled = rows.withColumn("level", classify_boq_code(F.col("code"))).filter(F.col("level").isNotNull())
    title = strip_brackets(clean_text(F.col("B")))
    named = leveled.select("book", "code", "level", F.when(F.col("level") < 4, title["text"]).otherwise(clean_text(F.col("B"))).alias("title"),
                           F.when(F.col("level") < 4, title["kind"]).alias("kind"), F.lit(False).alias("implicit"))
    needed = leveled.filter(F.col("level") == 4).select("book", F.substring_index("code", ".", 3).alias("code")).distinct()
    missing = needed.join(leveled.filter(F.col("level") == 3).select("book", "code"), ["book", "code"], "left_anti")
    groups = missing.select("book", "code", F.lit(3).alias("level"), F.lit("").alias("title"), F.lit(None).cast("string").alias("kind"),
                            F.lit(True).alias("implicit"))
    parent = F.when(F.col("level") > 1, F.expr("substring_index(code, '.', level - 1)"))
    return named.unionByName(groups).withColumn("parent_code", parent)


def items(grid: DataFrame) -> DataFrame:
    """Bill items with their texts and numbers."""
    rows = coded_rows(grid).withColumn("code", clean_text(F.col("A"))).filter(classify_boq_code(F.col("code")) == 4)
    text = {"name": "B", "unit": "C", "description": "D", "type": "E", "work_content": "F", "calc_rule": "G"}
    number = {"amount": "I", "quantity": "J", "rate": "K", "labour": "L", "materials": "M", "mech": "N"}
    own = [c for c in RESOURCE_COLUMNS if c in grid.columns]
    return rows.select(
        "book", "code", F.substring_index("code", ".", 2).alias("sub_code"), F.substring_index("code", ".", 3).alias("group_code"),
        F.element_at(F.split("code", r"\."), 4).cast("int").alias("sort_order"),
        *[clean_text(F.col(c)).alias(n) for n, c in text.items()], *[safe_float(F.col(c)).alias(n) for n, c in number.items()], *own)


def quantities(boq_items: DataFrame) -> DataFrame:
    """Non-zero resource quantities of every item, one row each."""
    cells = unpivot_columns(boq_items, ["book", "code", "sub_code"])
    return cells.select("book", "code", "sub_code", "col", safe_float(F.col("cell")).alias("consumption")).filter(F.col("consumption") != 0)


def defined_quantities(qty: DataFrame, defs: DataFrame) -> DataFrame:
    """Quantities whose column the sub-section defines."""
    return qty.join(defs, ["book", "sub_code", "col"])


def compat_rows(boq_items: DataFrame, qty: DataFrame, defs: DataFrame) -> DataFrame:
    """Up to four cost rows and one row per resource for every item."""
    keys = [F.col("book"), F.col("code"), F.col("group_code"), F.col("sort_order"), F.col("type").alias("attr_level1"),
            F.col("description").alias("attr_level2"), F.col("work_content").alias("attr_level3"), F.col("calc_rule").alias("attr_level4")]
    cost = lambda name, c: F.when(F.coalesce(c, F.lit(0.0)) != 0, F.struct(F.lit(name).alias("cost_item"), F.lit("元").alias("unit"), F.col(c).alias("amount")))
    rate = F.when(F.col("rate").isNotNull(), F.struct(F.col("name").alias("cost_item"), F.col("unit").alias("unit"), F.col("rate").alias("amount")))
    rows = F.array_compact(F.array(cost("人工费", "labour"), cost("材料费", "materials"), cost("机械费", "mech"), rate))
    costs = boq_items.select(*keys, F.explode(rows).alias("x")).select("*", "x.*").drop("x")
    named = qty.join(defs.withColumnRenamed("name", "res_name").withColumnRenamed("unit", "res_unit"), ["book", "sub_code", "col"], "left")
    label = F.coalesce("res_name", F.format_string("消耗量(%s)", "col"))
    used = boq_items.select(*keys).join(named, ["book", "code"]).select(
        *[c for c in costs.columns if c not in ("cost_item", "unit", "amount")], label.alias("cost_item"),
        F.coalesce("res_unit", F.lit("")).alias("unit"), F.col("consumption").alias("amount"))
    return costs.unionByName(used).select("*", *[F.lit(x).alias(f"attr{i}_label") for i, x in enumerate(ATTRIBUTE_LABELS, 1)])


def group_summary(boq_items: DataFrame) -> DataFrame:
    """Per group: its units in order of first use, first work content, number of items."""
    keys = ["book", "group_code"]
    order = F.struct("sort_order", "code")
    units = boq_items.filter(F.col("unit") != "").groupBy(*keys, "unit").agg(F.min(order).alias("at"))
    shown = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "unit"))).alias("u"))
    text = F.array_join(F.transform("u", lambda x: x["unit"]), ", ")
    work = F.min_by("work_content", F.when(F.col("work_content") != "", order))
    sums = boq_items.groupBy(*keys).agg(F.coalesce(work, F.lit("")).alias("work_content"), F.count(F.lit(1)).alias("items"))
    return sums.join(shown.select(*keys, text.alias("units")), keys, "left").withColumn("units", F.coalesce("units", F.lit("")))


def definition_usage(defs: DataFrame, qty: DataFrame) -> DataFrame:
    """How many items use a resource definition and how much of it."""
    used = qty.groupBy("book", "sub_code", "col").agg(F.count(F.lit(1)).alias("used_by"), F.round(F.sum("consumption"), 4).alias("total"))
    return defs.join(used, ["book", "sub_code", "col"], "left").withColumn("used_by", F.coalesce("used_by", F.lit(0)).cast("long"))


def to_norm_book(boq_items: DataFrame, defs: DataFrame, qty: DataFrame, chapter_map: DataFrame, targets: DataFrame,
                 offset: int, source_lib: str) -> dict[str, DataFrame]:
    """A foreign bill as a norm book: items to norms, definitions to consumption, quantities to content.

    ``chapter_map`` (group_code, target) names the classification; a target must exist in
    ``targets`` (target, chap_ID).  Ids of items and definitions come with the frames.
    """
    kept = boq_items.join(chapter_map, "group_code").join(targets, "target")
    zero = F.lit(0.0)
    norm = kept.select(
        (F.col("item_id") + offset).alias("norm_ID"), "chap_ID", F.col("target").alias("chap_Code"), F.col("sort_order").alias("norm_SortID"),
        F.col("code").alias("norm_Code"), F.col("name").alias("norm_Name"), F.col("unit").alias("norm_Units"),
        F.col("labour").alias("norm_ManPrice"), F.col("materials").alias("norm_MaterialPrice"), F.col("mech").alias("norm_MachinePrice"),
        F.round(F.coalesce("labour", zero) + F.coalesce("materials", zero) + F.coalesce("mech", zero), 4).alias("amount"))
    consumption = defs.select((F.col("def_id") + offset).alias("cons_ID"), F.col("name").alias("cons_Name"),
                              F.col("unit").alias("cons_Units"), F.col("unit_price").alias("cons_Price"))
    content = defined_quantities(qty, defs.select("book", "sub_code", "col", "def_id")).join(
        kept.select("book", "code", "item_id"), ["book", "code"]).select(
        (F.col("item_id") + offset).alias("norm_ID"), (F.col("def_id") + offset).alias("cons_ID"), F.col("consumption").alias("cont_Amount"))
    lineage = kept.select((F.col("item_id") + offset).alias("norm_ID"), F.lit(source_lib).alias("source_lib"),
                          F.col("item_id").alias("source_norm_id"), F.col("code").alias("source_norm_code"), F.col("group_code").alias("source_chap_name"))
    return {"norm": norm, "consumption": consumption, "content": content, "norm_source": lineage}


OUT_OF_SCOPE = ("R", "S", "T", "U", "W", "X")


def scope_split(codes: DataFrame, chapter_map: DataFrame) -> DataFrame:
    """Chapters that have no target: outside the book's scope by their letter, or still to be mapped."""
    unmapped = codes.join(chapter_map.select("group_code"), "group_code", "left_anti")
    letter = F.substring_index("group_code", ".", 1)
    return unmapped.withColumn("status", F.when(letter.isin(*OUT_OF_SCOPE), "out_of_scope").otherwise("unmapped"))


def mix_sheet(grid: DataFrame, columns: tuple[str, ...] = tuple("JKLMNOPQRSTUVWXYZ")) -> tuple[DataFrame, DataFrame]:
    """Mix sheet: row 3 names the resources, row 4 prices them, each further named row is one mix.

    Returns the mixes as tables and their non-zero consumption rows.
    """
    head = unpivot_columns(grid.filter(F.col("row_no") == 3), ["book"], columns).filter(F.col("cell").contains("\n"))
    parts = F.split("cell", "\n")
    defs = head.select("book", "col", F.trim(parts[0]).alias("name"), F.trim(parts[1]).alias("unit")).filter(F.col("name") != "")
    body = grid.filter((F.col("row_no") > 4) & (F.coalesce("B", F.lit("")) != "") & ~F.col("B").startswith("【") & ~F.col("B").startswith("《"))
    tables = body.select("book", "row_no", F.trim("B").alias("mix"), F.trim(F.coalesce("C", F.lit(""))).alias("unit"), safe_float(F.col("E")).alias("rate"))
    used = unpivot_columns(body, ["book", "row_no"], columns).select("book", "row_no", "col", safe_float(F.col("cell")).alias("amount")).filter(F.col("amount") != 0)
    lines = used.join(defs, ["book", "col"]).join(tables.select("book", "row_no", "mix"), ["book", "row_no"])
    return tables, lines


def resolve_codes(bill: DataFrame, norms: DataFrame) -> DataFrame:
    """Norm of every bill code: exact chapter first, else the code anywhere in the volume.

    ``strict_ID`` tries the volume only where the chapter is known and merely lacks the code,
    as the original does; ``any_ID`` also where the chapter code itself is unknown.
    """
    exact = norms.groupBy("volume", "chapter_code", "norm_code").agg(F.min("norm_ID").alias("exact_ID"))
    loose = norms.groupBy("volume", "norm_code").agg(F.min("norm_ID").alias("loose_ID"))
    known = norms.select("volume", "chapter_code").distinct().withColumn("known", F.lit(True))
    joined = bill.join(exact, ["volume", "chapter_code", "norm_code"], "left").join(loose, ["volume", "norm_code"], "left").join(
        known, ["volume", "chapter_code"], "left")
    strict = F.coalesce("exact_ID", F.when(F.col("known"), F.col("loose_ID")))
    return joined.select(*bill.columns, strict.alias("strict_ID"), F.coalesce("exact_ID", "loose_ID").alias("any_ID"))


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """First row per key; rows with an empty key part stay apart from none."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
