"""Numbers as they come off a page: decimal commas, brackets, ranges, merged cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that stand for "no amount".
BLANK_CELLS = ("---", "—", "-", "－")


def number_form(text: Column) -> Column:
    """Digits with one comma before 1-3 digits read as a decimal comma, other commas group thousands."""
    tight = F.replace(text, F.lit(" "), F.lit(""))
    return F.when(tight.rlike(r"^\d+,\d{1,3}$"), F.replace(tight, F.lit(","), F.lit("."))).otherwise(
        F.replace(tight, F.lit(","), F.lit("")))


def is_number_text(text: Column) -> Column:
    return F.coalesce(number_form(text).rlike(r"^-?\d+(\.\d+)?$"), F.lit(False))


def safe_float(text: Column) -> Column:
    return F.when(is_number_text(text), number_form(text).try_cast("double"))


PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def plain_double(text: Column) -> Column:
    """Number where the whole text is one, else null."""
    return F.when(text.rlike(PLAIN), text.try_cast("double"))


def clean_amount(text: Column) -> Column:
    """struct(value, quality, shown): brackets dropped, ranges kept as text, scan noise removed on a second try."""
    v = F.trim(text)
    blank = v.isNull() | (v == "") | v.isin(*BLANK_CELLS[:3])
    is_range = v.rlike(r"^\d+-\d+$")
    direct = (F.when(v.rlike(r"^\(\d+\.?\d*\)$"), F.regexp_extract(v, r"^\((\d+\.?\d*)\)$", 1).try_cast("double"))
              .when(v.rlike(r"^\d+,\d+$"), F.replace(v, F.lit(","), F.lit(".")).try_cast("double"))
              .otherwise(plain_double(v)))
    value = F.when(~blank & ~is_range, F.coalesce(direct, plain_double(F.regexp_replace(v, r"[^\d.\-,]", ""))))
    quality = F.when(blank, "raw").when(is_range, "range").when(value.isNotNull(), "raw").otherwise("unparseable")
    return F.struct(value.alias("value"), quality.alias("quality"), F.when(is_range, v).alias("shown"))


def clean_amount_strict(text: Column) -> Column:
    """Number with thousands commas, null for blank cells and anything else."""
    v = F.trim(text)
    return F.when(~v.isin(*BLANK_CELLS), plain_double(F.replace(v, F.lit(","), F.lit(""))))


def leading_zero(text: Column) -> Column:
    """'.5' or '. 5' to '0.5'."""
    return F.regexp_replace(F.replace(F.trim(text), F.lit(" "), F.lit("")), r"^\.(\d)", "0.$1")


def split_merged(text: Column) -> Column:
    """Base prices that ran together: prices with two places, else long digit runs, else the text itself."""
    priced = F.regexp_extract_all(text, F.lit(r"(\d{3,6}\.\d{2})"), 1)
    runs = F.regexp_extract_all(text, F.lit(r"(\d{4,})"), 1)
    pointed = F.transform(runs, lambda r: F.when(F.length(r) >= 5, F.regexp_replace(r, r"(\d\d)$", ".$1")).otherwise(r))
    return F.when(F.size(priced) > 1, priced).when(F.size(runs) > 2, pointed).otherwise(F.array(text))


def bbox_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap of two boxes with corners x1, y1, x2, y2."""
    zero = F.lit(0.0)
    width = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: F.greatest(zero, r["x2"] - r["x1"]) * F.greatest(zero, r["y2"] - r["y1"])
    inter = width * height
    return inter / (area(a) + area(b) - inter + F.lit(1e-6))


# Left edges of the columns of two printed appendix tables.
ROCK_BANDS = ((55, "rock"), (185, "density"), (250, "drill_alloy"), (315, "drill_quenched"), (400, "drill_manual"),
              (465, "strength"), (515, "coefficient"), (560, "other"))
SOIL_BANDS = ((None, 0), (65, 1), (225, 2), (295, 3), (440, 4))


def band(x: Column, bands: tuple, below: object = None) -> Column:
    """Name of the band that holds x: the last one whose edge is not right of it."""
    out = F.lit(below)
    for edge, name in bands:
        out = F.lit(name) if edge is None else F.when(x >= edge, F.lit(name)).otherwise(out)
    return out
