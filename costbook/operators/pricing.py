"""Price packs: which price is current, and what a norm costs under it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costbook.functions.labels import DEFAULT_PACK, VAT_FACTOR, VAT_PACK
from costbook.session import shuffled

COST_FIELDS = {3: "man", 4: "mat", 5: "mach", 6: "equip", 7: "main_mat"}


def _latest(prices: DataFrame, keys: list[str]) -> DataFrame:
    # max_by combines before the shuffle, so a resource with very many dates stays cheap
    rest = [c for c in prices.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.coalesce("price_date", F.lit("0001-01-01").cast("date")))
    return prices.groupBy(*keys).agg(row.alias("row")).select(*keys, "row.*")


def latest_price(prices: DataFrame) -> DataFrame:
    """Latest price that is set, per resource and pack; used when browsing."""
    return _latest(prices.filter(F.col("price").isNotNull()), ["res_ID", "pack"])


def latest_price_row(prices: DataFrame) -> DataFrame:
    """Latest price row per resource and pack; an empty latest price hides older ones."""
    return _latest(prices, ["res_ID", "pack"])


def default_pack(packs: DataFrame, prices: DataFrame, constant: str = DEFAULT_PACK) -> DataFrame:
    """One row: lowest active pack, else any pack that has prices, else the constant."""
    active = packs.agg(F.min(F.when(F.col("status") == "active", F.col("pack"))).alias("active"))
    priced = prices.agg(F.min("pack").alias("priced"))
    both = active.select("active", F.lit(None).cast("string").alias("priced")).unionByName(
        priced.select(F.lit(None).cast("string").alias("active"), "priced"))
    return both.agg(F.coalesce(F.max("active"), F.max("priced"), F.lit(constant)).alias("pack"))


def first_anchor(anchors: DataFrame) -> DataFrame:
    """First anchor usable for pricing per resource, by anchor id."""
    told = F.lit(False)
    for name in ("supplier", "address", "project"):
        told = told | (F.coalesce(F.col(name), F.lit("")) != "")
    usable = anchors.filter((F.col("use_for_price") == 1) & told)
    rest = [c for c in anchors.columns if c != "res_ID"]
    return usable.groupBy("res_ID").agg(F.min_by(F.struct(*rest), "anchor_ID").alias("row")).select("res_ID", "row.*")


ANCHOR_TEXTS = ("supplier", "contact", "phone", "address", "quote_date", "project")


def overlay_anchor(prices: DataFrame, anchors: DataFrame, pack: str) -> DataFrame:
    """Direct quotes override the tax-free price, tell who offered it and are named in the source.

    Only the VAT pack has them; in any other pack, and without one, their columns are blank.
    """
    a = first_anchor(anchors).select(
        "res_ID", F.lit(True).alias("anchored"), *[F.col(c).alias(f"a_{c}") for c in ANCHOR_TEXTS], F.col("price_excl").alias("a_excl"))
    a = a.filter(F.lit(pack == VAT_PACK))
    project = F.coalesce(F.col("a_project"), F.lit(""))
    source = F.coalesce(F.col("source"), F.lit(""))
    return prices.join(a, "res_ID", "left").select(
        *[c for c in prices.columns if c not in (*ANCHOR_TEXTS, "source", "price_excl")],
        *[F.coalesce(f"a_{c}", F.lit("")).alias(c) for c in ANCHOR_TEXTS],
        F.when(F.col("anchored"), F.col("a_excl")).otherwise(F.col("price_excl")).alias("price_excl"),
        F.when(project != "", F.concat(source, F.lit(";project="), project)).otherwise(source).alias("source"))


def price_split(price: Column, excl: Column, pack: str | Column) -> tuple[Column, Column]:
    """(tax-free price, tax), both empty when unpriced; only the VAT pack derives tax from its rate."""
    pack = F.lit(pack) if isinstance(pack, str) else pack
    net = F.when(price.isNotNull(), F.round(
        F.coalesce(excl, F.when(pack == VAT_PACK, price / F.lit(VAT_FACTOR)).otherwise(price)), 4))
    return net, F.round(price - net, 4)


def expand_norms(content: DataFrame, consumption: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Every content line of every norm with its consumption row."""
    return content.join(shuffled(consumption), on or ["cons_ID"])


def cost_columns(cls: Column, amount: Column, price: Column) -> list[Column]:
    """Aggregates: one sum per cost field and the count of lines without a price."""
    worth = F.coalesce(amount, F.lit(0.0)) * price
    sums = [F.round(F.coalesce(F.sum(F.when(cls == k, worth)), F.lit(0.0)), 4).alias(f) for k, f in COST_FIELDS.items()]
    return [*sums, F.count_if(price.isNull()).alias("unpriced")]


def norm_costs(lines: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Costs per norm: lines carry cons_Style, master_res_ID and cont_Amount; prices one row per res_ID."""
    price = prices.select(F.col("res_ID").alias("master_res_ID"), "price")
    # a null link never equals a resource, so it stays unpriced
    priced = lines.join(price, "master_res_ID", "left")
    return priced.groupBy(*keys).agg(*cost_columns(F.col("cons_Style"), F.col("cont_Amount"), F.col("price")))


def base_amount(costs: DataFrame, norms: DataFrame) -> DataFrame:
    """Norm amount without main material and equipment; norms without content keep their other price."""
    zero = F.lit(0.0)
    part = lambda c: F.coalesce(F.col(c), zero)
    return norms.join(costs, "norm_ID", "left").select(
        "norm_ID", "norm_Code",
        F.round(part("man") + part("mat") + part("mach") + part("norm_OtherPrice"), 4).alias("amount"),
        F.coalesce("unpriced", F.lit(0)).cast("long").alias("unpriced"))
