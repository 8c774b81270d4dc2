"""Names of norms, chapters and resources: cleaning, prefixes, categories, classes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from costbook.functions.text import ORDINALS, let

# Patterns of bracketed tails, trailing units and leading codes.
BRACKET_TAIL = r"[（(][^)）]*[)）]$"
UNIT_TAIL = r"(?i)\s*(m[²³23]?|kg|t|mm|cm|m|km|个|套|座|根|块|片|条|台|组|项|元|%|‰)\s*$"
CODE_HEAD = r"^[A-Za-z](\.\d+)+\s+"

# Keyword groups of chapter names, in the order they are tested.
CATEGORIES = {
    "prefab": "预制|装配式|装配|PC构件",
    "cast_in_situ": "现浇|浇筑|现场搅拌",
    "masonry": "砖砌|砌块|石砌|砖墙|石墙|砌体|砖柱",
    "steel": "钢网架|钢屋架|钢桁架|钢柱|钢梁|钢构件|钢板|压型钢板|金属结构",
    "wood": "木屋架|木构件|木梁|木柱|木楼|木基层",
    "waterproof": "防水|防潮|止水|嵌缝",
    "insulation": "保温|隔热|防腐|绝热",
    "pipe": "管道|管件|阀门|法兰|给水|排水管|钢管|铸铁管|塑料管|混凝土管",
    "well": "检查井|阀门井|水表井|雨水井|污水井|闸井|跌水井|排气井|排泥井",
    "road": "路面|路基|基层|面层|沥青|水泥混凝土路面|路缘石|人行道|侧石|平石",
    "bridge": "桥墩|桥台|梁板|盖梁|系梁|承台|墩柱|桥面|支座|伸缩缝|栏杆",
    "greening": "种植|绿化|草坪|树木|花卉|灌木|乔木|栽植|养护",
    "garden": "园路|园桥|景石|塑石|假山|水景|喷泉|驳岸",
    "landscape": "景观|小品|亭|廊|花架|雕塑|座椅",
}
# Categories that never match each other.
EXCLUSIONS = (("prefab", "cast_in_situ"), ("masonry", "cast_in_situ"), ("steel", "masonry"), ("wood", "steel"),
              ("road", "bridge"), ("pipe", "road"), ("greening", "road"), ("greening", "bridge"))
# Words that mark a resource as a machine.
MACHINE_WORDS = "机|车|船|泵|钻|搅拌|起重|装载|推土|压路|打桩|挖掘|自卸|拖轮|驳|发电|空压|电焊"


def clean_name(name: Column) -> Column:
    """Name without a bracketed tail, then without a trailing unit."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), BRACKET_TAIL, ""), UNIT_TAIL, ""))


def strip_code_prefix(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, CODE_HEAD, ""))


def strip_cn_ordinal(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, rf"^[{ORDINALS}]+[、．.\s)]*", ""))


def clean_title(title: Column) -> Column:
    return F.regexp_replace(title, rf"^[{ORDINALS}]+[、，]\s*", "")


def normalize_text(text: Column) -> Column:
    """Two common misreadings corrected, blanks collapsed, Latin I, II, III as Roman numerals, longest first."""
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("冻士"), F.lit("冻土")), F.lit("毎"), F.lit("每"))
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    for latin, roman in (("III", "Ⅲ"), ("II", "Ⅱ"), ("I", "Ⅰ")):
        out = F.replace(out, F.lit(latin), F.lit(roman))
    return out


def strip_chapter_prefix(text: Column) -> Column:
    return F.trim(F.regexp_replace(normalize_text(text), rf"^[{ORDINALS}百千零]+、", ""))


def semantic_categories(name: Column) -> Column:
    """Categories whose keywords the cleaned name holds."""
    return let(clean_name(name), lambda n: F.array_compact(F.array(*[F.when(n.rlike(words), F.lit(c)) for c, words in CATEGORIES.items()])))


def compatible(a: Column, b: Column) -> Column:
    """Whether two category lists may match; every exclusion holds both ways."""
    has = F.array_contains
    clash = lambda p, q: reduce(or_, [(has(p, x) & has(q, y)) | (has(p, y) & has(q, x)) for x, y in EXCLUSIONS])
    return ~let(F.struct(a.alias("a"), b.alias("b")), lambda v: clash(v["a"], v["b"]))


def classify_resource(style: Column, kind: Column, name: Column) -> Column:
    """Rate class of a resource: its class where set, else the kind's first digit, else its name."""
    k = F.coalesce(kind.cast("string"), F.lit("0"))
    return (F.when(style == 3, "labour").when(style.isin(4, 7), "materials").when(style.isin(5, 6), "mech")
            .when(k.startswith("1") | name.contains("工日"), "labour").when(k.startswith("3"), "mech")
            .when(name.rlike(MACHINE_WORDS), "mech").otherwise("materials"))


def normalize_chapter(name: Column) -> Column:
    """第2章 to 第二章, for chapters 1 to 10."""
    out = name
    for i, sign in enumerate(ORDINALS, 1):
        out = F.replace(out, F.lit(f"第{i}章"), F.lit(f"第{sign}章"))
    return out


def is_page_artifact(text: Column) -> Column:
    """Page numbers that were read as table cells."""
    t = F.trim(text)
    return (t.rlike(r"^\d{3}\s*[\s\-–—]*\s*\d{3}\s*[二三四五六七八九]?\s*[\-–—]*\s*$")
            | t.rlike(r"^\d{3}[\s\-–—]+$") | t.rlike(r"^\d{3}\s*二?\s*$"))


def clean_text(text: Column) -> Column:
    """Text without zero-width signs."""
    return F.trim(F.translate(F.coalesce(text, F.lit("")), "​‌‍", ""))


BRACKETS = (("【", "】", "section"), ("《", "》", "subsection"), ("{", "}", "group"))


def strip_brackets(text: Column) -> Column:
    """struct(text, kind): the pair of brackets around a title tells its level."""
    t = F.trim(F.coalesce(text, F.lit("")))
    inner, kind = t, F.lit(None).cast("string")
    for left, right, name in BRACKETS:
        fits = t.startswith(left) & t.endswith(right) & (F.length(t) > 1)
        inner = F.when(fits, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(inner)
        kind = F.when(fits, F.lit(name)).otherwise(kind)
    return F.struct(inner.alias("text"), kind.alias("kind"))


# Words that make a text an attribute name, and the shape of a name fused with its value.
ATTRIBUTE_NAME = "类别|级别|长度|厚度|深度|直径|高度|宽度|斗容|吨位|桩长|孔深|面积|体积|运距|截面|形式|规格|型号|等级|标号|强度|坡度|类型"
FUSED = r"^([一-鿿]{1,4})(\d+(?:\.\d+)?)(.*)$"


def split_fused(text: Column) -> Column:
    """struct(name, value) of an attribute cell that ran together with its value, e.g. 桩长20m."""
    name = F.regexp_extract(text, FUSED, 1)
    ok = text.rlike(FUSED) & name.rlike(ATTRIBUTE_NAME)
    value = F.concat(F.regexp_extract(text, FUSED, 2), F.regexp_extract(text, FUSED, 3))
    return F.struct(F.when(ok, name).alias("name"), F.when(ok, value).alias("value"))


# Unit words that stand in a column of their own.
UNIT_WORDS = ("工日", "台班", "元", "m3", "m²", "m³", "m", "t", "kg", "10m3", "100m3", "100m2", "艘班", "组", "根", "榀",
              "%", "件", "个", "块", "套", "只", "条", "片", "座", "处", "段", "延长米")


def row_fields(text: Column) -> Column:
    """struct(seq, name, unit, code) of the left part of a table row."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != "")
    first = lambda test: F.coalesce(F.try_element_at(F.filter(parts, test), F.lit(1)), F.lit(""))
    seq, code = first(lambda p: p.rlike(r"^\d{1,2}$")), first(lambda p: p.rlike(r"^\d{10,13}$"))
    units = F.filter(parts, lambda p: p.isin(*UNIT_WORDS))
    named = F.filter(parts, lambda p: ~p.rlike(r"^[\d.()\-]+$") & ~p.isin(*UNIT_WORDS))
    return F.struct(seq.alias("seq"), F.array_join(named, " ").alias("name"),
                    F.coalesce(F.try_element_at(units, F.lit(-1)), F.lit("")).alias("unit"), code.alias("code"))


def classify_boq_code(code: Column) -> Column:
    """Level 1-4 of a bill code, null for other texts."""
    return (F.when(code.rlike("^[A-Z]$"), 1).when(code.rlike(r"^[A-Z]\.[a-z]$"), 2)
            .when(code.rlike(r"^[A-Z]\.[a-z]\.\d+$"), 3).when(code.rlike(r"^[A-Z]\.[a-z]\.\d+\.\d+$"), 4))


def parse_boq_code(code: Column) -> Column:
    """struct(volume, chapter_code, norm_code) of VOL.c1.c2.c3.code; all null below four parts."""
    parts = F.split(code, r"\.")
    ok = F.size(parts) >= 4
    return F.struct(F.when(ok, F.element_at(parts, 1)).alias("volume"),
                    F.when(ok, F.array_join(F.slice(parts, 2, 3), ".")).alias("chapter_code"),
                    F.when(ok, F.array_join(F.slice(parts, 5, 99), ".")).alias("norm_code"))


def clean_country(country: Column) -> Column:
    """'' for a missing or damaged country."""
    return F.when(F.coalesce(country, F.lit("??")) == "??", F.lit("")).otherwise(country)


def parse_project(features: Column) -> Column:
    """struct(project, rest) of ``project=... | location=... | free text``."""
    text = F.coalesce(features, F.lit(""))
    parts = F.transform(F.split(text, r"\|"), lambda p: F.trim(p))
    tagged = lambda tag: F.trim(F.regexp_replace(F.coalesce(F.try_element_at(
        F.filter(parts, lambda p: p.startswith(f"{tag}=")), F.lit(-1)), F.lit("")), f"^{tag}=", ""))
    place = tagged("location")
    project = F.concat(tagged("project"), F.when(place != "", F.concat(F.lit(" · "), place)).otherwise(""))
    rest = F.array_join(F.filter(parts, lambda p: (p != "") & ~p.contains("=")), " ")
    has = text.contains("project=")
    return F.struct(F.when(has, project).otherwise("").alias("project"), F.when(has, rest).otherwise(text).alias("rest"))


def fx_text(currency: Column, fx_json: Column) -> Column:
    """``1 CUR → x.xxxx K`` for every rate that is set; malformed rates read as none."""
    rates = F.map_entries(F.coalesce(F.from_json(fx_json, "map<string,double>"), F.create_map().cast("map<string,double>")))
    live = F.filter(rates, lambda e: F.coalesce(e["value"], F.lit(0.0)) != 0)
    shown = lambda e: F.concat(F.lit("1 "), currency, F.lit(" → "), F.format_string("%.4f", 1 / e["value"]), F.lit(" "), e["key"])
    return F.array_join(F.transform(live, shown), ", ")


def chapter_content(feature: Column, rule: Column, work: Column, code: Column) -> Column:
    """Composed content of a chapter leaf; empty parts drop out."""
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    return F.concat_ws("\n", part("【项目特征】", feature), part("【计量规则】", rule), part("【工作内容】", work), part("【GB编码】", code))


def source_prefix(code: Column, source_lib: Column) -> Column:
    """Norm code marked with the edition it came from; codes already marked stay."""
    out = code
    for year, mark in (("2012", "BJ12."), ("2021", "BJ21.")):
        out = F.when(source_lib.contains(year) & ~code.startswith(mark), F.concat(F.lit(mark), code)).otherwise(out)
    return out
