"""Checks of extracted and imported tables: each yields (level, check, key, message) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costbook.operators.ordered import chunk_of, scan
from costbook.session import settle

# Words that are units and never a cost item.
UNIT_WORDS = ("工日", "台班", "元", "m3", "m²", "m³", "m", "t", "kg", "10m3", "100m3", "100m2", "艘班", "组", "根", "榀", "%", "件", "个", "块",
              "套", "只", "条", "片", "座", "处", "段", "延长米", "km", "㎡", "10m³", "10m", "100m²")


def issue(df: DataFrame, level: str, check: str, key: Column, message: Column) -> DataFrame:
    return df.select(F.lit(level).alias("level"), F.lit(check).alias("check"), key.cast("string").alias("key"), message.alias("message"))


def _all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def check_cost_items(items: DataFrame) -> DataFrame:
    """Cost items without a name, and unit words in their place (page, cost_item)."""
    name = F.coalesce("cost_item", F.lit(""))
    counts = items.withColumn("cost_item", name).filter((name == "") | name.isin(*UNIT_WORDS)).groupBy("page", "cost_item").agg(F.count(F.lit(1)).alias("n"))
    return _all(issue(counts.filter("cost_item = ''"), "ERROR", "cost_items", F.col("page"), text("unnamed: ", F.col("n"))),
                issue(counts.filter("cost_item <> ''"), "FATAL", "cost_items", F.col("page"), text("unit word ", F.col("cost_item"), ": ", F.col("n"))))


def check_dimensions(dims: DataFrame, codes: DataFrame) -> DataFrame:
    """Attribute rows whose values do not fit the codes, never vary, or are missing (page, name, vals) (page, code)."""
    n = codes.groupBy("page").agg(F.count(F.lit(1)).alias("codes"))
    joined = dims.join(n, "page", "left").withColumn("codes", F.coalesce("codes", F.lit(0)))
    filled = F.array_distinct(F.filter("vals", lambda v: F.coalesce(v, F.lit("")) != ""))
    page = F.col("page")
    return _all(
        issue(joined.filter(F.size("vals") != F.col("codes")), "FATAL", "attr_dimensions", page, text(F.col("name"), ": ", F.size("vals"), " values for ", F.col("codes"), " codes")),
        issue(joined.filter((F.size(filled) == 1) & (F.size("vals") > 1)), "WARN", "attr_dimensions", page, text(F.col("name"), ": constant ", filled[0])),
        issue(joined.filter(F.coalesce("name", F.lit("")) == ""), "ERROR", "attr_dimensions", page, text("unnamed dimension")),
        issue(n.join(dims.select("page"), "page", "left_anti").filter("codes > 1"), "WARN", "attr_dimensions", page, text(F.col("codes"), " codes without dimension")))


def check_work_content(pages: DataFrame) -> DataFrame:
    """Gaps in the numbering of a work content, and texts that seem cut off (page, work_content)."""
    numbers = F.transform(F.regexp_extract_all("work_content", F.lit(r"[（(](\d+)[）)]"), 1), lambda v: v.cast("int"))
    wanted = F.when(F.size(numbers) > 0, F.sequence(F.lit(1), F.greatest(F.array_max(numbers), F.lit(1))))
    missing = F.array_sort(F.array_except(wanted, numbers))
    gaps = pages.withColumn("missing", missing).filter(F.size("missing") > 0)
    cut = pages.filter(F.rtrim("work_content").rlike("[；;]$"))
    return _all(issue(gaps, "ERROR", "work_content", F.col("page"), text("missing ", F.array_join("missing", ","))),
                issue(cut, "WARN", "work_content", F.col("page"), text("ends with a semicolon")))


def code_differences(declared: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Codes declared but not used and used but not declared."""
    a, b = declared.select(*keys).distinct(), used.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("unused")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("undeclared")))


def check_codes(codes: DataFrame, items: DataFrame) -> DataFrame:
    """Pages without codes, codes of a wrong form, codes unused or undeclared (page, code)."""
    used = items.filter(F.coalesce("code", F.lit("")) != "").select("page", "code")
    diff = code_differences(codes, used.join(codes.select("page").distinct(), "page", "left_semi"), ["page", "code"])
    bare = items.select("page").distinct().join(codes.select("page"), "page", "left_anti")
    page = F.col("page")
    return _all(issue(bare, "FATAL", "norms_codes", page, text("items without codes")),
                issue(codes.filter(~F.col("code").rlike(r"^\d{5}$")), "WARN", "norms_codes", page, text("not five digits: ", F.col("code"))),
                issue(diff.filter("side = 'unused'"), "ERROR", "norms_codes", page, text("unused ", F.col("code"))),
                issue(diff.filter("side = 'undeclared'"), "WARN", "norms_codes", page, text("undeclared ", F.col("code"))))


def check_counts(codes: DataFrame, items: DataFrame) -> DataFrame:
    """Item count against cost items times codes, and cost items without any amount (page, cost_item, amount)."""
    per_item = items.groupBy("page", "cost_item").agg(F.count(F.lit(1)).alias("n"), F.count("amount").alias("filled"))
    per_page = per_item.groupBy("page").agg(F.sum("n").alias("actual"), F.count(F.lit(1)).alias("cost_items"))
    expected = per_page.join(codes.groupBy("page").agg(F.count(F.lit(1)).alias("codes")), "page").withColumn("expected", F.col("cost_items") * F.col("codes"))
    return _all(issue(expected.filter("actual <> expected"), "ERROR", "item_counts", F.col("page"), text(F.col("actual"), " of ", F.col("expected"))),
                issue(per_item.filter("filled = 0"), "WARN", "item_counts", F.col("page"), text("no amount: ", F.coalesce("cost_item", F.lit("")), " x ", F.col("n"))))


def check_subsection(pages: DataFrame) -> DataFrame:
    return issue(pages.filter(F.coalesce("subsection", F.lit("")) == ""), "WARN", "subsection", F.col("page"), text("empty subsection"))


def report(issues: DataFrame) -> DataFrame:
    return issues.groupBy("level").agg(F.count(F.lit(1)).alias("issues"))


def code_gaps(codes: DataFrame, keys: list[str]) -> DataFrame:
    """Whole codes missing between the lowest and the highest of a key.

    Only the gaps between neighbouring codes are spelled out, each by the row before it.
    """
    distinct = codes.select(*keys, F.col("code").cast("long").alias("code")).distinct()
    seen = scan(distinct, keys, [F.col("code")], chunk_of(F.col("code"), 1 << 16), previous={"_before": F.col("code")})
    return seen.filter(F.col("code") - F.col("_before") > 1).select(*keys, F.explode(F.sequence(F.col("_before") + 1, F.col("code") - 1)).alias("missing"))


def check_pages(front: DataFrame, rows: DataFrame, skipped: DataFrame) -> DataFrame:
    """Markdown pages: front matter (page, chapter, section, type), data rows (page, code, cost_item), code gaps, base prices.

    ``skipped`` (page): first pages of tables that run on, whose base price stands on the next page.
    """
    page = F.col("page")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    coded = rows.filter(F.col("code").rlike(r"^\d+$"))
    # written once, as the rows of a code repeat and three checks need the codes alone
    priced = settle(coded.groupBy("page", "code").agg(F.bool_or(F.coalesce(F.col("cost_item") == "基价", F.lit(False))).alias("priced")))
    without = priced.filter("not priced").join(skipped.select("page").distinct(), "page", "left_anti")
    return _all(issue(front.filter(empty("chapter")), "WARN", "front", page, text("missing chapter")), issue(front.filter(empty("section")), "WARN", "front", page, text("missing section")),
                issue(front.filter(F.coalesce("type", F.lit("")) != "norms_table"), "WARN", "front", page, text("type ", F.coalesce("type", F.lit("")))),
                issue(front.join(priced.select("page").distinct(), "page", "left_anti"), "ERROR", "rows", page, text("no data rows")),
                issue(code_gaps(priced, ["page"]), "WARN", "continuity", page, text("missing code ", F.col("missing"))),
                issue(without, "WARN", "base_price", page, text("no base price: ", F.col("code"))))


def acceptance(actuals: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """One row per named count (each frame: one row, column ``actual``) against what is expected; null expects more than zero."""
    rows = _all(*[df.select(F.lit(name).alias("check"), F.col("actual").cast("long").alias("actual"), F.lit(expected.get(name)).cast("long").alias("expected"))
                  for name, df in actuals.items()])
    return rows.withColumn("passed", F.when(F.col("expected").isNull(), F.col("actual") > 0).otherwise(F.col("actual") == F.col("expected")))
