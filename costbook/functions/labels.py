"""Codes and labels of the cost-norm model, and lookups over them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, equal to the source model's code systems.
VOLUMES = {
    "A": "A册 建筑装饰", "B": "B册 通用安装", "C": "C册 市政园林", "D": "D册 水运工程", "E": "E册 房屋修缮",
}
VOLUMES_EN = {
    "A": "Vol.A Building & Decoration", "B": "Vol.B General Installation",
    "C": "Vol.C Municipal & Landscape", "D": "Vol.D Waterway Engineering", "E": "Vol.E Building Repair",
}
CLASSES = {3: "人工", 4: "材料", 5: "机械", 6: "设备", 7: "主材"}
CLASSES_EN = {3: "Labour", 4: "Material", 5: "Machinery", 6: "Equipment", 7: "Main Material"}
TIERS = {
    "T1": "泰国直采", "T2": "邻国报价", "T3": "中国报价", "T4": "非洲报价",
    "S": "近似重名", "D": "派生", "B": "基准价",
}
TIERS_EN = {
    "T1": "Thailand direct", "T2": "Neighbouring country", "T3": "China quote", "T4": "Africa quote",
    "S": "Similar name", "D": "Derived", "B": "Benchmark",
}
TIER_REPORT_ORDER = ("T1", "T2", "T3", "T4", "S", "D")
RATE_CLASSES = {"labour": "人工", "materials": "材料", "mech": "机械"}
RATE_CLASS_ORDER = {"labour": 0, "materials": 1, "mech": 2}
CURRENCIES = {"THB": "泰铢", "CNY": "人民币", "USD": "美元"}
MODULES = ("mix", "machine", "me_main")
DEFAULT_PACK = "th_2026"
VAT_PACK = "th_2026"
VAT_FACTOR = 1.07
TO_BE_QUOTED = "待询价"


def label(key: Column, labels: dict, default: str = "") -> Column:
    """The label of a key; keys outside the fixed table get the default."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(labels.items())])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def sql_case(key: str, labels: dict, default: str = "") -> str:
    """The same lookup as a CASE text for the checking SQL."""
    arms = " ".join(
        f"WHEN {k if isinstance(k, int) else repr(k)} THEN {v if isinstance(v, int) else repr(v)}"
        for k, v in labels.items()
    )
    return f"CASE {key} {arms} ELSE {default if isinstance(default, int) else repr(default)} END"
