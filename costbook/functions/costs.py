"""Names and units of cost items read off pages: misreadings corrected, noise dropped, units inferred."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from costbook.functions.text import let

# Misread words of scanned pages and what they stand for.
SCAN_FIXES = (("围抢", "围堰"), ("围捻", "围堰"), ("瘦班", "艘班"), ("混凝士", "混凝土"), ("箕他材料", "其他材料"), ("腹带", "履带"),
              ("内然", "内燃"), ("内燃李压机", "内燃空压机"), ("设施摊消费", "设施摊销费"), ("Ⅰt", "1t"), ("Ⅰ", "1"))
COST_FIXES = (("定型板面", "定型组合钢模"), ("钢模厂连接卡具", "连接卡具"), ("钢模连接卡具", "连接卡具"), ("组合骨架、支撑", "骨架、支撑"),
              ("基基价", "基价"), ("2基", "基价"), ("组合板面", "定型组合钢模"), ("板面 定型", "定型组合钢模"), ("定型 板面", "定型组合钢模"),
              ("混凝主", "混凝土"), ("钢加钢", "钢筋"), ("板面", "定型组合钢模"))
NOT_ITEMS = ("-", "—", "定额。", "续前页", "工日", "kg", "m3", "台班", "艘班")
NOT_ITEM_HEADS = ("附注", "顺序号", "每组", "项目", "（", "(", "$")
DANGLING = ("-", "—", ".", "/")
WHOLE_FIXES = {"钢": "钢筋", "板材": "板枋材"}

# Units by name.  Each rule is (how, words, unit): "is" compares the whole name,
# "has" looks inside it, "ends" at its end; the first rule that fits counts.
UNIT_RULES = (
    ("is", "人工", "工日"), ("has_not_搅拌", "混凝土", "m3"), ("has", "板枋材|圆木|硬杂木", "m3"),
    ("has", "水泥砂浆|环氧砂浆|环氧水泥砂浆|沥青砂浆|沥青混凝土", "m3"), ("has", "砂", "kg"), ("has", "碎石|石屑|石子", "m3"),
    ("has", "定型组合钢模|定型板面|钢板|型钢|钢管|钢筋|铁件|螺栓|电焊条|碳精棒|系船柱壳体|预埋件|钢轨|钢丝绳|铁钉|铁线", "kg"),
    ("has", "骨架|支撑|连接卡具|模板|胎模", "kg"), ("has", "橡胶|胶囊|稀释剂", "kg"),
    ("has", "沥青|红丹|汽油|煤油|油漆|涂料", "kg"), ("has", "其他材料", "元"), ("has", "预制构件", "m3"), ("has", "固定预制场使用费", "元"),
    ("has", "搅拌站", "台班"), ("has", "搅拌船", "艘班"),
    ("has", "起重机|装载机|皮带机|自卸汽车|机动翻斗车|卷扬机|电焊机|空压机|振捣器|切断机|弯曲机|对焊机|抽水机|水泵|电钻", "台班"),
    ("has", "汽车|平板车|拖车", "台班"), ("has", "拖轮|方驳|铁驳|驳船|工作船|定位船|抛锚船|潜水船|机动艇", "艘班"), ("has", "其他船机", "元"),
    ("has", "船用锤|打桩船|扒杆起重船|旋转扒杆", "艘班"), ("has", "潜水组", "组日"), ("has", "电动运砼车|带斗车", "台班"), ("has", "基价", "元"),
    ("has", "乙炔气|氧气", "m3"), ("is", "脱模剂|铁链|麻丝|焊剂", "kg"), ("has", "调合漆", "kg"), ("is", "麻布|塑料止水带", "m2"),
    ("is", "卡环M42|卡环M52|钻头|扣件|底座", "个"), ("has", "系船柱", "个"), ("is", "块石|片石|粘土|特大枋|毛竹|垫木", "m3"), ("is", "编织袋", "个"),
    ("is", "成品钢护", "t"), ("is", "设施摊销费", "元"), ("has", "施工取费|设备摊销|使用费|摊销费", "元"),
    ("ends", "气", "m3"), ("ends", "石|土|木|材|枋", "m3"), ("ends", "链", "kg"),
)
SHORT_UNIT_RULES = (
    ("is", "人工", "工日"), ("has", "混凝土|砂浆", "m3"), ("has", "板枋材|圆木|硬杂木|块石|片石|碎石|石屑", "m3"),
    ("has", "钢筋|型钢|钢板|钢管|铁件|螺栓|钢丝绳|铁钉|铁线|电焊条|连接卡具|骨架|支撑", "kg"), ("has", "基价", "元"),
    ("has", "其他材料|其他船机", "元"), ("has", "船|驳|艇", "艘班"),
    ("has", "起重机|装载机|汽车|翻斗车|搅拌|钻机|电焊机|空压机|卷扬机|振捣器|切断机|弯曲机|水泵|抽水机", "台班"), ("has", "拖轮", "艘班"), ("ends", "气", "m3"),
)


def _fits(name: Column, how: str, words: str) -> Column:
    if how == "is":
        return name.isin(*words.split("|"))
    if how == "ends":
        return name.rlike(f"({words})$")
    test = name.rlike(words)
    return test & ~name.contains(how.rsplit("_", 1)[1]) if how.startswith("has_not_") else test


def infer_unit(name: Column, rules: tuple = UNIT_RULES) -> Column:
    """Unit a cost item is measured in, by the first rule its name fits; '' where none does."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return F.coalesce(*[F.when(_fits(n, how, words), F.lit(unit)) for how, words, unit in rules], F.lit(""))


def fix_text(text: Column) -> Column:
    """Misread words corrected and decimals that were torn apart closed."""
    out = text
    for wrong, right in SCAN_FIXES:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return F.trim(F.regexp_replace(out, r"(\d)\.\s+(\d)", "$1.$2"))


def clean_cost_item(name: Column) -> Column:
    """Cost item without scan noise; '' for texts that are no cost item."""
    noise = reduce(or_, [name.startswith(h) for h in NOT_ITEM_HEADS], name.isin(*NOT_ITEMS))
    out = F.regexp_replace(name, r"(?i)\s*kg\.?\s*", "")
    for wrong, right in COST_FIXES:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    out = F.regexp_replace(F.regexp_replace(out, r"^\d+\s*", ""), r"^(台班|艘班|工日)\s+", "")
    for wrong, right in WHOLE_FIXES.items():
        out = F.regexp_replace(out, f"^{wrong}$", right)

    def judged(cleaned: Column) -> Column:
        letters = F.length(F.regexp_replace(cleaned, r"[\d\s./—\-(),;:+]+", ""))
        merged = cleaned.rlike(r"\d{3,}") & (letters < 3)
        return F.when(noise | cleaned.isin(*DANGLING) | merged, F.lit("")).otherwise(F.trim(cleaned))

    return let(out, judged)
