"""Text pieces of item names, titles and notes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordinals that open sub-titles, and the marks they are written with.
ORDINALS = "一二三四五六七八九十"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def join_spec(name: Column, spec: Column) -> Column:
    """Shown name: base name and specification, either may be absent."""
    return F.concat_ws(" ", blank_to_null(name), blank_to_null(spec))


def strip_ordinals(title: Column) -> Column:
    """Sub-title without the Chinese ordinals and list marks it opens with."""
    return F.regexp_replace(title, f"^[{ORDINALS}、]+", "")


def unit_bridge(from_unit: Column, to_unit: Column) -> Column:
    """How much of ``from_unit`` one ``to_unit`` is, for tonnes and kilograms; 1 for all else."""
    return (F.when((from_unit == "t") & (to_unit == "kg"), 0.001)
            .when((from_unit == "kg") & (to_unit == "t"), 1000.0).otherwise(1.0))


def mix_spec(label: Column, value: Column) -> Column:
    """Readable piece of a mix attribute; a bare number gets the unit its label implies."""
    v, lb = F.trim(value), F.coalesce(label, F.lit(""))
    return (F.when(F.coalesce(value, F.lit("")) == "", F.lit(""))
            .when(v.rlike(r"\p{L}"), v)
            .when(lb.contains("粒径"), F.concat(v, F.lit("mm")))
            .when(lb.contains("水胶比"), F.concat(F.lit("水胶比"), v))
            .when(lb.contains("龄期"), F.concat(v, F.lit("d")))
            .when(lb.contains("抗拉"), F.concat(F.lit("抗拉"), v, F.lit("MPa")))
            .when(lb.contains("抗压"), F.concat(F.lit("抗压"), v, F.lit("MPa")))
            .otherwise(v))


def mix_name(title: Column, attributes: list[tuple[Column, Column]]) -> Column:
    """Title, strength grade, then the other attributes in order."""
    is_grade = lambda lb: F.coalesce(lb, F.lit("")).contains("强度等级")
    grades = F.array_compact(F.array(*[F.when(is_grade(lb), blank_to_null(v)) for lb, v in attributes]))
    rest = [F.when(~is_grade(lb), F.nullif(mix_spec(lb, v), F.lit(""))) for lb, v in attributes]
    # of several grades the last one counts
    return F.concat_ws(" ", F.trim(title), F.try_element_at(grades, F.lit(-1)), *rest)


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


HEADER = "attr_columns array<string>, notes array<string>, cost_composition array<string>, consumption array<string>"


def header_fields(header_json: Column) -> Column:
    """Fields of a table header; malformed text reads as empty."""
    return F.from_json(F.coalesce(header_json, F.lit("{}")), HEADER)


def note_text(header_json: Column) -> Column:
    """Notes of a table, escaped and joined for display."""
    notes = F.coalesce(header_fields(header_json)["notes"], F.array().cast("array<string>"))
    return F.array_join(F.transform(notes, escape_html), "<br>")


def nrm_prefix(code: Column) -> Column:
    """Two-level chapter code inside a measurement code, null where there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(code, F.lit("")), r"^[A-Z]\.(\d{2}\.\d{2})", 1), F.lit(""))
