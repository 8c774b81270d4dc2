"""Where a price comes from: quotes, aliases, anchors, observations, norms that use it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costbook.operators.ordered import numbered
from costbook.operators.pricing import latest_price_row
from costbook.session import shuffled


def top_per_key(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The n first rows per key; the limit is applied before the shuffle as well as after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def quote_provenance(matches: DataFrame, quotes: DataFrame, n: int | None = None) -> DataFrame:
    """Quotes of every resource ranked by confidence, then date; all of them, or the n first."""
    both = matches.join(quotes.drop("res_ID"), "quote_ID")
    order = [F.col("confidence").desc(), F.col("quote_date").desc(), F.col("quote_ID")]
    if n is not None:
        return top_per_key(both, ["res_ID"], order, n)
    return numbered(both, order, "rank", ["res_ID"])


def live_aliases(aliases: DataFrame, usage: DataFrame) -> DataFrame:
    """Aliases whose consumption row is still in use, with its references."""
    live = usage.select("res_ID", F.col("vol").alias("src_vol"), F.col("cons_ID").alias("src_cons_ID"), "refs")
    return shuffled(aliases).join(live, ["res_ID", "src_vol", "src_cons_ID"])


def volume_content(content: DataFrame, norms: DataFrame) -> DataFrame:
    """Content with the volume of its norm."""
    return content.join(norms.select("norm_ID", "vol"), "norm_ID")


def norms_using(consumption: DataFrame, content: DataFrame, norms: DataFrame, n: int | None = None) -> DataFrame:
    """Per resource and volume the norms that use it, ranked by amount; all of them, or the n first."""
    linked = consumption.filter(F.col("master_res_ID").isNotNull()).select(
        F.col("master_res_ID").alias("res_ID"), "vol", "cons_ID", "cons_Units")
    lines = volume_content(content, norms).join(shuffled(linked), ["vol", "cons_ID"])
    order = [F.col("cont_Amount").desc_nulls_last(), F.col("norm_ID")]
    if n is None:
        best = numbered(lines, order, "rank", ["res_ID", "vol"])
    else:
        # cut before the norm texts are fetched
        best = top_per_key(lines, ["res_ID", "vol"], order, n)
    return best.join(norms.select("norm_ID", "norm_Code", "norm_Name"), "norm_ID")


def observations(obs: DataFrame, pack: str) -> DataFrame:
    return obs.filter(F.col("pack") == pack)


def observation_order() -> list:
    return [F.col("weight").desc(), F.col("value_cny").asc(), F.col("obs_ref").asc(), F.col("source").asc()]


def benchmark(prices: DataFrame, obs: DataFrame, pack: str) -> dict[str, DataFrame]:
    """Latest stored benchmark price per resource, and the observations behind it."""
    stored = prices.filter((F.col("pack") == pack) & (F.col("price_kind") == "benchmark"))
    return {"price": latest_price_row(stored), "observations": observations(obs, pack)}


def price_detail(resources: DataFrame, prices: DataFrame, pack: str, matches: DataFrame, quotes: DataFrame,
                 aliases: DataFrame, usage: DataFrame, consumption: DataFrame, content: DataFrame,
                 norms: DataFrame, anchors: DataFrame) -> dict[str, DataFrame]:
    """Every resource's detail as flat frames keyed by res_ID; nothing is nested, so no group grows unbounded."""
    return {
        "resource": resources,
        "price": latest_price_row(prices.filter(F.col("pack") == pack)),
        "quotes": quote_provenance(matches, quotes),
        "aliases": live_aliases(aliases, usage),
        "norms": norms_using(consumption, content, norms),
        "anchors": anchors,
    }
