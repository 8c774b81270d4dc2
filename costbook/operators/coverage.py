"""The usage ledger and what of it a price pack covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costbook.functions import labels as L
from costbook.functions.predicates import in_scope, list_predicate

LEDGER = ["vol", "cons_ID", "cons_Style", "kind_Code", "cons_Name", "cons_Standard", "cons_Units"]


def usage_ledger(consumption: DataFrame, content: DataFrame) -> DataFrame:
    """Content references per volume and linked consumption row; rows without any are kept with 0.

    ``content`` carries its volume.  References are counted before the join, so the fact
    table is reduced on the map side and the join meets one row per consumption row.  A book's stored
    price (``cons_Price``) is carried where the consumption has it.
    """
    stored = [c for c in consumption.columns if c == "cons_Price"]
    counted = content.groupBy("vol", "cons_ID").agg(F.count("norm_ID").alias("refs"))
    linked = consumption.filter(F.col("master_res_ID").isNotNull())
    return linked.join(counted, ["vol", "cons_ID"], "left").select(
        F.col("master_res_ID").alias("res_ID"), *LEDGER, *stored, F.coalesce("refs", F.lit(0)).cast("long").alias("refs"))


def unlinked_rows(consumption: DataFrame) -> DataFrame:
    """Consumption rows per volume that the ledger leaves out."""
    return consumption.groupBy("vol").agg(F.count_if(F.col("master_res_ID").isNull()).alias("unlinked"))


def with_price(usage: DataFrame, prices: DataFrame, pack: str) -> DataFrame:
    """Usage with the pack's price row; ``prices`` holds one row per resource and pack."""
    row = prices.filter(F.col("pack") == pack).withColumn("price_res_ID", F.col("res_ID")).drop("pack")
    return usage.join(row, "res_ID", "left")


def with_resource(usage: DataFrame, resources: DataFrame) -> DataFrame:
    return usage.join(resources, "res_ID")


def _has_price():
    return F.col("price_res_ID").isNotNull()


def _totals():
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(_has_price()).alias("priced"),
        F.coalesce(F.sum("refs"), F.lit(0)).alias("refs"),
    ]


def _refs_priced():
    return F.coalesce(F.sum(F.when(_has_price(), F.col("refs"))), F.lit(0)).alias("refs_priced")


def pack_registry(packs: DataFrame, prices: DataFrame) -> DataFrame:
    counts = prices.groupBy("pack").agg(F.count(F.lit(1)).alias("priced_count"))
    return packs.join(counts, "pack", "left").withColumn(
        "priced_count", F.coalesce("priced_count", F.lit(0)).cast("long"))


def class_totals(priced: DataFrame) -> DataFrame:
    return priced.groupBy("vol", F.col("cons_Style").alias("cls")).agg(*_totals())


def volume_totals(class_rows: DataFrame) -> DataFrame:
    """Volume subtotals from the class rows; the usage is not read again."""
    return class_rows.groupBy("vol").agg(*[F.sum(c).alias(c) for c in ("total", "priced", "refs")])


def coverage_matrix(priced: DataFrame) -> DataFrame:
    cls = F.col("cls")
    rows = priced.groupBy("vol", F.col("cons_Style").alias("cls")).agg(*_totals(), _refs_priced())
    return rows.select(
        "*", L.label(cls, L.CLASSES).alias("cls_name"), L.label(cls, L.CLASSES_EN).alias("cls_name_EN"),
        L.label(F.col("vol"), L.VOLUMES).alias("vol_name"))


def _per_resource(priced: DataFrame, *keys) -> DataFrame:
    # one row per resource first: distinct counts then are plain counts, without row expansion
    return priced.groupBy(*keys, "res_ID").agg(
        F.max(_has_price().cast("int")).alias("has"), F.sum("refs").alias("refs"),
        F.sum(F.when(_has_price(), F.col("refs")).otherwise(0)).alias("refs_priced"))


def _distinct_totals():
    return [F.count("res_ID").alias("total"), F.count_if(F.col("has") == 1).alias("priced"),
            F.coalesce(F.sum("refs"), F.lit(0)).alias("refs")]


def _by_module(df: DataFrame) -> DataFrame:
    member = F.array_compact(F.array(*[F.when(in_scope(m), F.lit(m)) for m in L.MODULES]))
    return df.select("*", F.explode(member).alias("module"))


def module_totals(priced: DataFrame) -> DataFrame:
    return _per_resource(_by_module(priced), "module").groupBy("module").agg(*_distinct_totals())


def module_volumes(usage: DataFrame) -> DataFrame:
    return _by_module(usage).groupBy("module", "vol").agg(F.count(F.lit(1)).alias("total"))


def overall_totals(priced: DataFrame) -> DataFrame:
    return _per_resource(priced).agg(*_distinct_totals()[:2])


def coverage_summary(priced: DataFrame) -> DataFrame:
    """Coverage by count and weighted by references."""
    one = _per_resource(priced).agg(
        *_distinct_totals(), F.coalesce(F.sum("refs_priced"), F.lit(0)).alias("refs_priced"))
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    return one.select("*", share("priced", "total").alias("coverage"), share("refs_priced", "refs").alias("weighted"))


def list_totals(listed: DataFrame) -> DataFrame:
    return _per_resource(listed).agg(*_distinct_totals())


def tier_histogram(prices: DataFrame, pack: str) -> DataFrame:
    rows = prices.filter(F.col("pack") == pack).groupBy("tier", "price_kind").agg(F.count(F.lit(1)).alias("n"))
    tier = F.col("tier")
    return rows.select("*", L.label(tier, L.TIERS).alias("tier_name"), L.label(tier, L.TIERS_EN).alias("tier_name_EN"))


def _volumes():
    return F.array_sort(F.collect_set("vol"))


def gap_ranking(usage: DataFrame, prices: DataFrame, resources: DataFrame, pack: str, n: int | None) -> DataFrame:
    """Resources in use without any price row, most referenced first."""
    gaps = usage.join(prices.filter(F.col("pack") == pack).select("res_ID"), "res_ID", "left_anti")
    rolled = gaps.groupBy("res_ID").agg(F.sum("refs").alias("refs"), _volumes().alias("vols"))
    ranked = with_resource(rolled, resources)
    return ranked if n is None else ranked.orderBy(F.col("refs").desc(), "res_ID").limit(n)


def price_listing(usage: DataFrame, resources: DataFrame, prices: DataFrame, pack: str, **filters) -> DataFrame:
    """Usage rows of the list before the roll-up, with resource and price columns."""
    joined = with_price(with_resource(usage, resources), prices, pack)
    return joined.filter(list_predicate(joined.columns, **filters))


def roll_up(listed: DataFrame) -> DataFrame:
    """One row per resource: references summed, volumes listed, lowest class and kind."""
    own = [c for c in listed.columns if c not in (*LEDGER, "res_ID", "refs")]
    # resource and price columns follow res_ID, so grouping by them changes no group
    return listed.groupBy("res_ID", *own).agg(
        F.sum("refs").alias("refs"), _volumes().alias("vols"),
        F.min("cons_Style").alias("cons_Style"), F.min("kind_Code").alias("kind_Code"))


def list_order() -> list:
    """Unpriced first, then most referenced, then code; the id makes the order total."""
    return [F.col("price").isNull().desc(), F.col("refs").desc(), F.col("res_Code").asc(), F.col("res_ID").asc()]


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered list, as long as the caller asks."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def price_report(rolled: DataFrame) -> DataFrame:
    """The exported price list: 25 columns, provenance only where priced."""
    has = F.col("price").isNotNull()
    shown = lambda c: F.when(has, F.col(c))
    cut = lambda c, d: F.when(has, F.round(F.col(c), d))
    return rolled.select(
        "res_Code", L.label(F.col("cons_Style"), L.CLASSES).alias("cls_name"), "res_Name", "res_Standard", "res_Unit",
        *[F.col(c) if c in rolled.columns else F.lit(None).cast("string").alias(c)
          for c in ("res_Name_EN", "res_Standard_EN", "res_Unit_EN")],
        cut("price", 4).alias("price"), cut("price_excl", 4).alias("price_excl"), shown("currency").alias("currency"),
        F.when(has, F.col("tier")).otherwise(L.TO_BE_QUOTED).alias("tier"),
        *[shown(c).alias(c) for c in ("price_kind", "price_date")],
        cut("src_price", 4).alias("src_price"), *[shown(c).alias(c) for c in ("src_currency", "src_unit")],
        cut("fx_rate", 6).alias("fx_rate"), cut("unit_factor", 6).alias("unit_factor"),
        *[shown(c).alias(c) for c in ("supplier", "source_doc", "source")],
        "refs", F.array_join("vols", "").alias("vols"))


def _cell(priced, total):
    return F.when(total > 0, F.format_string(
        "%d/%d  %s%%", priced, total, (priced * 100 / total).cast("decimal(5,1)"))).otherwise(F.lit("—"))


def coverage_band(ratio):
    return F.when(ratio >= 0.8, F.lit("ok")).when(ratio >= 0.4, F.lit("warn")).otherwise(F.lit("bad"))


def coverage_pivot(class_rows: DataFrame) -> DataFrame:
    """Volume rows, class columns as ``priced/total  pct``, a row total and its band."""
    per = []
    for cls in L.CLASSES:
        mine = F.col("cls") == cls
        per += [F.sum(F.when(mine, F.col("priced"))).alias(f"p{cls}"), F.sum(F.when(mine, F.col("total"))).alias(f"t{cls}")]
    wide = class_rows.groupBy("vol").agg(*per, F.sum("priced").alias("p"), F.sum("total").alias("t"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return wide.select(
        "vol", *[_cell(zero(f"p{c}"), zero(f"t{c}")).alias(f"cls{c}") for c in L.CLASSES],
        _cell(F.col("p"), F.col("t")).alias("all_classes"), coverage_band(F.col("p") / F.col("t")).alias("band"))


def tier_summary(histogram: DataFrame) -> DataFrame:
    """Reported tiers in their fixed order with the pricing kinds found."""
    rank = L.label(F.col("tier"), {t: i for i, t in enumerate(L.TIER_REPORT_ORDER)}, default=None)
    return histogram.filter(F.col("tier").isin(*L.TIER_REPORT_ORDER)).groupBy("tier").agg(
        F.array_join(F.array_sort(F.collect_set(F.coalesce("price_kind", F.lit("")))), ", ").alias("kinds"),
        F.sum("n").alias("n")).select(rank.alias("tier_rank"), "tier", L.label(F.col("tier"), L.TIERS).alias("tier_name"),
                                      "kinds", "n")
