"""Unit rates of selected norms: picks, resources, consumption, rates and column blocks."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costbook.functions import labels as L
from costbook.functions.names import classify_resource
from costbook.functions.text import join_spec
from costbook.operators.blocks import pack
from costbook.operators.ordered import numbered
from costbook.operators.pricing import latest_price_row, overlay_anchor, price_split
from costbook.session import settle, shuffled, stored

BLOCK_COLUMNS = 55
UNPRICED = "本包未定价"  # fixed value: the note on a resource that the pack has no price for


def clean_picks(picks: DataFrame, documents: list[str]) -> DataFrame:
    """Selection (doc, code, norm_id as text, pos) without unknown documents, empty codes and repeats; the first of each stays."""
    code = F.trim(F.coalesce("code", F.lit("")))
    valid = picks.filter(F.col("doc").isin(*documents) & (code != "")).select(
        "doc", code.alias("code"), F.col("norm_id").try_cast("long").alias("norm_id"), "pos")
    return valid.groupBy("doc", "code", "norm_id").agg(F.min("pos").alias("pos"))


def resolve_picks(picks: DataFrame, norms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Norm of every pick: by id where given, else the lowest id of its code; and the picks without one."""
    by_id = norms.select("doc", F.col("norm_ID").alias("norm_id"), F.col("norm_ID").alias("found_id"))
    by_code = norms.groupBy("doc", F.col("norm_Code").alias("code")).agg(F.min("norm_ID").alias("first_id"))
    joined = picks.join(by_id, ["doc", "norm_id"], "left").join(by_code, ["doc", "code"], "left")
    resolved = joined.withColumn("norm_ID_found", F.when(F.col("norm_id").isNotNull(), F.col("found_id")).otherwise(F.col("first_id")))
    keep = ["doc", "code", "norm_id", "pos"]
    found = resolved.filter(F.col("norm_ID_found").isNotNull()).select(*keep, "norm_ID_found")
    return found, resolved.filter(F.col("norm_ID_found").isNull()).select(*keep)


def _named(rows: DataFrame, kind: str) -> tuple[DataFrame, list[Column]]:
    """Consumption rows that have a name, and their name, unit, class and label."""
    named = rows.withColumn("name", join_spec(F.col("cons_Name"), F.col("cons_Standard"))).filter(F.col("name") != "")
    unit = F.trim(F.coalesce("cons_Units", F.lit("")))
    return named, [F.col("name"), unit.alias("unit"), classify_resource(F.col("cons_Style"), F.col(kind), F.col("name")).alias("cls"),
                   F.when(unit != "", F.concat_ws("\n", "name", unit)).otherwise(F.col("name")).alias("label")]


def resource_lines(content: DataFrame, consumption: DataFrame, on: list[str], kind: str = "kind_Code") -> DataFrame:
    """Content lines as labelled, classed resources; lines without a name drop out."""
    lines, (name, unit, cls, label) = _named(content.join(shuffled(consumption), on), kind)
    return lines.select("norm_ID", "cons_ID", "master_res_ID", name, unit, F.coalesce("cont_Amount", F.lit(0.0)).alias("amount"), cls, label)


def class_rank(cls: Column) -> Column:
    """Labour before materials before machines."""
    return L.label(cls, L.RATE_CLASS_ORDER, 9)


def price_lines(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """Lines with the latest price row of their resource; an empty price is kept as unpriced."""
    return lines.join(prices.withColumnRenamed("res_ID", "master_res_ID"), "master_res_ID", "left")


def first_lines(lines: DataFrame) -> DataFrame:
    """Distinct resources by label, the first line of each."""
    own = [c for c in lines.columns if c != "label"]
    return lines.groupBy("label").agg(F.min_by(F.struct(*own), F.struct("norm_ID", "cons_ID")).alias("r")).select("label", "r.*")


def registry(lines: DataFrame) -> DataFrame:
    """The first line of every label, numbered by class then name."""
    first = first_lines(lines)
    order = [class_rank(F.col("cls")), F.col("name"), F.col("label")]
    return numbered(first, order, "no")


def consumption_matrix(lines: DataFrame) -> DataFrame:
    """Norm by resource in long form; of repeated labels the last line's amount and the first line's class count."""
    return lines.groupBy("norm_ID", "label").agg(F.max_by("amount", F.struct("cons_ID", "amount")).alias("amount"),
                                               F.min_by("cls", F.struct("cons_ID", "cls")).alias("cls"))


def matrix_block(matrix: DataFrame, labels: list[str]) -> DataFrame:
    """One block of the matrix as columns, for labels that are known."""
    return matrix.groupBy("norm_ID").pivot("label", labels).agg(F.max("amount"))


def unit_rates(matrix: DataFrame, reference: DataFrame) -> DataFrame:
    """Rate of every norm: amount times the reference price of the label, by class; a blank price counts 0."""
    return _by_class(matrix.join(reference.select("label", F.col("price").alias("reference_price")), "label", "left"))


def _by_class(cells: DataFrame) -> DataFrame:
    """Sums of amount times reference price of every norm, by class and in all."""
    worth = F.col("amount") * F.coalesce("reference_price", F.lit(0.0))
    parts = [F.round(F.coalesce(F.sum(F.when(F.col("cls") == c, worth)), F.lit(0.0)), 4).alias(c) for c in L.RATE_CLASSES]
    return cells.groupBy("norm_ID").agg(*parts, F.round(F.sum(worth), 4).alias("rate"))


def rates(lines: DataFrame) -> DataFrame:
    """Unit rates of priced lines; a label's reference price is that of its first line.

    The lines are grouped once: reference prices come from the same groups, so the facts are read once.
    """
    cells = lines.groupBy("norm_ID", "label").agg(
        F.max_by("amount", F.struct("cons_ID", "amount")).alias("amount"), F.min_by("cls", F.struct("cons_ID", "cls")).alias("cls"),
        F.min_by("price", "cons_ID").alias("price"))
    return unit_rates(cells.drop("price"), cells.groupBy("label").agg(F.min_by("price", "norm_ID").alias("price")))


def rates_of(wanted: DataFrame, content: DataFrame, consumption: DataFrame, prices: DataFrame, kind: str = "kind_Code") -> DataFrame:
    """As ``rates`` of all priced lines, for the ``wanted`` norms (norm_ID, distinct) alone; reference prices come from all lines.

    Labels and prices are those of a consumption row, so they are found before the lines are joined: no line carries a text of its resource.
    ``content`` (vol, norm_ID, cons_ID, cont_Amount), ``prices`` (res_ID, price).
    """
    on = ["vol", "cons_ID"]
    rows, (_, _, cls, label) = _named(consumption, kind)
    known = stored(price_lines(rows.select(*on, "master_res_ID", cls, label), prices).drop("master_res_ID"), "resources")
    # the first line of a label is the first one of one of its rows
    first = known.join(content.groupBy(*on).agg(F.min("norm_ID").alias("norm_ID")), on)
    reference = first.groupBy("label").agg(F.min_by("price", F.struct("norm_ID", "cons_ID")).alias("reference_price"))
    labels = stored(reference.withColumn("label_ID", F.monotonically_increasing_id()), "labels")
    cells = known.drop("price").join(shuffled(labels), "label").drop("label")
    lines = content.join(wanted, "norm_ID", "left_semi").join(shuffled(cells), on).repartition("norm_ID")
    # one exchange by norm serves both groupings
    matrix = lines.select("norm_ID", "cons_ID", "cls", "label_ID", "reference_price", F.coalesce("cont_Amount", F.lit(0.0)).alias("amount")).groupBy(
        "norm_ID", "label_ID", "reference_price").agg(F.max_by("amount", F.struct("cons_ID", "amount")).alias("amount"), F.min_by("cls", F.struct("cons_ID", "cls")).alias("cls"))
    return _by_class(matrix)


BLOCK_KEYS = ["chapter", "section", "subsection"]


def pack_blocks(items: DataFrame, capacity: int = BLOCK_COLUMNS) -> DataFrame:
    """Column blocks per sub-section: items in order, a new block when the labels would outgrow it (see ``blocks.pack``).

    ``items`` (chapter, section, subsection, pos, norm_ID, labels).
    """
    return pack(items, BLOCK_KEYS, [F.col("pos"), F.col("norm_ID")], "norm_ID", capacity)


def block_names(blocks: DataFrame) -> DataFrame:
    """Shown name of every block: later blocks of a sub-section carry their number."""
    base = F.when(F.col("subsection") != "", F.col("subsection")).otherwise(F.col("section"))
    return blocks.withColumn("block_name", F.when(F.col("block") > 1, F.format_string("%s (%d)", base, "block")).otherwise(base))


class Export(NamedTuple):
    """What an export of selected norms holds; see ``export_norms``."""

    prices: DataFrame
    rates: DataFrame
    blocks: DataFrame
    missing: DataFrame
    summary: DataFrame


def price_sheet(lines: DataFrame, pack: str) -> DataFrame:
    """The resources of priced lines, numbered: tax-free price and tax, the direct quote's date and offerer where there is one, and a note."""
    net, tax = price_split(F.col("price"), F.col("price_excl"), pack)
    blank = lambda c: F.coalesce(c, F.lit(""))
    shown = (blank(F.col("supplier")) != "") & ~blank(F.col("supplier")).contains("?")
    note = F.when(blank(F.col("source")) != "", F.col("source")).otherwise(F.when(F.col("price").isNull(), UNPRICED).otherwise(""))
    date = F.when(blank(F.col("quote_date")) != "", F.col("quote_date")).otherwise(blank(F.col("price_date").cast("string")))
    return registry(lines).select("no", "cls", "name", "unit", net.alias("net"), tax.alias("tax"), "price", date.alias("date"), F.when(shown, F.col("supplier")).otherwise(blank(F.col("project"))).alias("offered_by"),
                                  *[blank(F.col(c)).alias(c) for c in ("contact", "phone", "address")], note.alias("note"))


def export_norms(picks: DataFrame, documents: list[str], norms: DataFrame, content: DataFrame, consumption: DataFrame, price_rows: DataFrame, anchors: DataFrame, pack: str,
                 items: Callable[[DataFrame], DataFrame], capacity: int = BLOCK_COLUMNS) -> Export:
    """The export of a selection under a price pack, as five frames.

    ``picks`` (doc, code, norm_id, pos), ``norms`` (doc, norm_ID, norm_Code), ``content`` (vol, norm_ID, cons_ID, cont_Amount), ``consumption``, ``price_rows`` of the pack
    (res_ID, price_date, price, price_excl, source), ``anchors``.  ``items`` gives the packable items of norms (norm_ID).  Prices are the latest rows; direct
    quotes overlay the tax-free price of the VAT pack.  A label's reference price is its first line among the selected norms.  ``missing`` holds
    the picks without a norm; ``summary`` counts norms, missing picks, and lines of known resources that have no price.
    """
    found, missing = resolve_picks(clean_picks(picks, documents), norms)
    wanted = settle(found.select(F.col("norm_ID_found").alias("norm_ID")).distinct())
    known = overlay_anchor(latest_price_row(price_rows).drop("pack"), anchors, pack)
    lines = settle(price_lines(resource_lines(content.join(wanted, "norm_ID", "left_semi"), consumption, ["vol", "cons_ID"]), known))
    own = rates(lines.select("norm_ID", "cons_ID", "master_res_ID", "name", "unit", "amount", "cls", "label", "price"))
    unpriced = lines.agg(F.count_if(F.col("master_res_ID").isNotNull() & F.col("price").isNull()).alias("unpriced"))
    counts = [wanted.agg(F.count(F.lit(1)).alias("norms")), missing.agg(F.count(F.lit(1)).alias("missing")), unpriced]
    # one row each
    summary = counts[0].join(F.broadcast(counts[1]), F.lit(True)).join(F.broadcast(counts[2]), F.lit(True))
    return Export(price_sheet(lines, pack), own, block_names(pack_blocks(items(wanted), capacity)), missing, summary)


def chapter_order() -> list[Column]:
    """Volumes A, B, C, then the first number in the chapter's name; chapters without one come last."""
    number = F.regexp_extract("chapter", r"(\d+)", 1).try_cast("int")
    volume = L.label(F.col("volume"), {"A": 0, "B": 1, "C": 2}, 99)
    return [volume, F.coalesce(number, F.lit(99)), F.col("chapter")]


def machine_shift_matrix(items: DataFrame, cost: list[str], usage: list[str], fallback_units: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Machine shifts by code: a row without amount names the machine, the others fill its columns.

    Returns the matrix and the unit of every column: the first one told, else the fallback, else blank.
    """
    order = F.struct("sort_order", "id")
    is_name = F.col("amount").isNull()
    pick = lambda c: F.coalesce(F.max_by(F.coalesce(c, F.lit("")), F.when(is_name, order)), F.lit(""))
    cells = [F.max_by("amount", F.when(~is_name & (F.col("cost_item") == c), order)).alias(c) for c in (*cost, *usage)]
    matrix = items.groupBy("norms_code").agg(pick("cost_item").alias("name"), pick("cost_item_unit").alias("unit_raw"), *cells)
    shown = matrix.withColumn("unit", F.when(F.col("unit_raw") != "", F.col("unit_raw")).otherwise("台班")).drop("unit_raw")
    found = items.filter(F.coalesce("cost_item_unit", F.lit("")) != "").groupBy("cost_item").agg(
        F.min_by("cost_item_unit", F.struct("table_id", "sort_order", "id")).alias("unit"))
    columns = items.sparkSession.createDataFrame([(c, fallback_units.get(c, "")) for c in (*cost, *usage)], "cost_item string, missing string")
    # the column list is as long as the call's arguments
    units = F.broadcast(columns).join(found, "cost_item", "left").select("cost_item", F.coalesce("unit", "missing").alias("unit"))
    return shown, units
