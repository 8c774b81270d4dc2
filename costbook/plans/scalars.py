"""Scalar functions over every row of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from costbook.functions import costs as K
from costbook.functions import names as A
from costbook.functions import numbers as U
from costbook.functions import similarity as S
from costbook.functions import text as X
from costbook.operators import coverage as C
from costbook.operators import pricing as R
from costbook.plans.prices import PACK
from costbook.plans.registry import register
from costbook.sources.bindings import define_view
from costbook.sources.tables import col_or

ITEMS = ("人工,混凝土,混凝土搅拌站,板枋材,水泥砂浆,碎石,中粗砂,3 钢筋,铁件kg.,骨架、支撑,橡胶护舷,沥青,其他材料,预制构件,搅拌船,内然起重机,15t自卸汽车,"
         "拖轮 800kW,方驳,其他船机,潜水组,基基价,氧气,麻布,钻头,块石,编织袋,设施摊消费,钢,板面,定型 板面,附注一,续前页,12345/6,(见注),镀锌链,乙炔气,黏土,台班 水泵,混凝主 2,-")
TITLES = ("一、预制混凝土梁（C30）,二、现浇混凝土柱 m3,砖砌体 10m2,A.01.02 钢构件安装,三、木屋架,防水层铺设(二层),保温 kg,给水管道 个,检查井 座,沥青路面,"
          "桥墩浇筑 t,绿化种植 株,园路铺装,景观小品 套,装配式墙板,钢网架 榀,塑料管 100m,  冻士  开挖 ,III类土 毎层,十一、其他,第2章 桩基,第10章 护岸,路基")
CELLS = "(10.25);120-450;0,15;—;;1,234.5;12.5kg;abc;3854.184486.63;.75;12 345;1,2345;1234567 12345 99999;-7.5;424 424 —;432 二;1,234,567;约3.2"
CODES = "A,B.c,C.d.12,A.a.03.004,X.9,A.01.02.003.1-7,B.02.01.004.5-6.2,C.1.2,zz,E.b.7"
MARKED = "【土方工程】;《人工挖土》;{基坑};【开口;plain text;《》;{}"
ROWS = "1 人工 工日 1000000001;12 板枋材 m3 20100000012;混凝土 C30 m3;3 钢筋 直径 kg;100;续 表 - .;7 起重机 15t 台班 9900000123456"
FUSED = "桩长20m;孔深1.5;类别;吨位100kN;土壤12;厚度30cm内;x12"
FEATURES = "project=Alpha | location=Town | sheet=3 | grade B;steel bar;location=Here | x;project= Beta ;project=A | project=B | plain one | plain two"


def pick(text: str, key: str, mark: str = ",") -> str:
    return f"split_part('{text}', '{mark}', CAST({key} % {len(text.split(mark))} + 1 AS INT))"


define_view("cell", f"""
SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
       {pick(ITEMS, 'l_partkey')} AS item, {pick(TITLES, 'l_orderkey')} AS title, {pick(CELLS, '(l_partkey + l_suppkey)', ';')} AS amount,
       {pick(CODES, 'l_suppkey')} AS code, {pick(MARKED, 'l_orderkey', ';')} AS marked, {pick(ROWS, 'l_partkey', ';')} AS row_text,
       {pick(FUSED, 'l_suppkey', ';')} AS fused, {pick(FEATURES, 'l_partkey', ';')} AS features, {pick(TITLES, '(l_partkey + l_linenumber)')} AS other,
       CAST(l_partkey % 600 AS DOUBLE) AS x, l_quantity, CAST(l_linenumber AS DOUBLE) AS y
FROM lineitem""")
KEYS = ("ok", "ln", "pk", "sk")
K_SQL = "ok, ln, pk, sk"


def cells(t, *columns):
    return t.cell.select(*KEYS, *columns)


CLEAN = """trim(regexp_replace(regexp_replace({0}, '[（(][^)）]*[)）]$', ''), '(?i)\\s*(m[²³23]?|kg|t|mm|cm|m|km|个|套|座|根|块|片|条|台|组|项|元|%|‰)\\s*$', ''))"""


@register("x06_clean_name", f"""SELECT {K_SQL}, {CLEAN.format('title')} AS name, {CLEAN.format('p_name')} AS part FROM cell JOIN part ON p_partkey = pk""")
def _(t):
    return t.cell.join(t.part.select(F.col("p_partkey").alias("pk"), "p_name"), "pk").select(
        *KEYS, A.clean_name(F.col("title")).alias("name"), A.clean_name(F.col("p_name")).alias("part"))


NORMALIZED = "replace(replace(replace(trim(regexp_replace(replace(replace(title, '冻士', '冻土'), '毎', '每'), '\\s+', ' ', 'g')), 'III', 'Ⅲ'), 'II', 'Ⅱ'), 'I', 'Ⅰ')"


@register("x07_strip_prefixes", f"""
SELECT {K_SQL}, trim(regexp_replace(title, '^[A-Za-z](\\.\\d+)+\\s+', '')) AS no_code, trim(regexp_replace(title, '^[一二三四五六七八九十]+[、．.\\s)]*', '')) AS no_ordinal,
  trim(regexp_replace({NORMALIZED}, '^[一二三四五六七八九十百千零]+、', '')) AS no_chapter, regexp_replace(title, '^[一二三四五六七八九十]+[、，]\\s*', '') AS clean
FROM cell""")
def _(t):
    c = F.col("title")
    return cells(t, A.strip_code_prefix(c).alias("no_code"), A.strip_cn_ordinal(c).alias("no_ordinal"),
                 A.strip_chapter_prefix(c).alias("no_chapter"), A.clean_title(c).alias("clean"))


CHARS = "list_sort(list_distinct(regexp_extract_all(regexp_replace({0}, '[\\s()（）\\[\\]【】,，、/\\\\·\\-—_+]', '', 'g'), '.')))"


@register("x08_norm_chars", f"""SELECT {K_SQL}, array_to_string({CHARS.format('title')}, '') AS chars FROM cell
UNION ALL SELECT doc_id, 0, 0, 0, array_to_string({CHARS.format('text')}, '') FROM documents""")
def _(t):
    chars = lambda c: F.array_join(F.array_sort(S.norm_chars(F.col(c))), "").alias("chars")
    return cells(t, chars("title")).union(t.documents.select("doc_id", F.lit(0), F.lit(0), F.lit(0), chars("text")))


@register("x09_prefilter", f"""
WITH c AS (SELECT {K_SQL}, {CHARS.format('title')} AS a, {CHARS.format('other')} AS b FROM cell),
d AS (SELECT {K_SQL}, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS k FROM c)
SELECT {K_SQL}, CASE WHEN k < 2 THEN 0 ELSE greatest(k / (na + nb - k), k / least(na, nb) * CAST(0.7 AS DOUBLE)) END AS score FROM d""")
def _(t):
    return cells(t, S.prefilter(S.norm_chars(F.col("title")), S.norm_chars(F.col("other"))).alias("score"))


@register("x10_rerank")
def _(t):
    return cells(t, S.rerank(F.col("title"), F.col("other"), F.col("ln") % 2 == 0).alias("score"))


@register("x11_match_score")
def _(t):
    a, b = A.clean_name(F.col("title")), A.clean_name(F.col("other"))
    return cells(t, S.match_score(a, b, A.strip_cn_ordinal(a), A.strip_cn_ordinal(b)).alias("score"))


@register("x12_semantic_categories", f"""
SELECT {K_SQL}, concat_ws(',', """ + ", ".join(f"CASE WHEN regexp_matches({CLEAN.format('title')}, '{w}') THEN '{c}' END"
                                            for c, w in A.CATEGORIES.items()) + ") AS categories FROM cell")
def _(t):
    return cells(t, F.array_join(A.semantic_categories(F.col("title")), ",").alias("categories"))


CATS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({CLEAN.format('{0}')}, '{w}') THEN '{c}' END" for c, w in A.CATEGORIES.items()) + "], lambda v: v IS NOT NULL)"


@register("x13_compatible", f"""WITH c AS (SELECT {K_SQL}, {CATS.replace('{0}', 'title')} AS a, {CATS.replace('{0}', 'other')} AS b FROM cell)
SELECT {K_SQL}, NOT (""" + " OR ".join(f"list_contains({p}, '{x}') AND list_contains({q}, '{y}')" for x, y in A.EXCLUSIONS
                                       for p, q in (("a", "b"), ("b", "a"))) + ") AS ok_pair FROM c")
def _(t):
    return cells(t, A.compatible(A.semantic_categories(F.col("title")), A.semantic_categories(F.col("other"))).alias("ok_pair"))


@register("x14_classify_resource", f"""
SELECT {K_SQL}, CASE WHEN ln = 3 THEN 'labour' WHEN ln IN (4, 7) THEN 'materials' WHEN ln IN (5, 6) THEN 'mech'
  WHEN CAST(sk AS STRING) LIKE '1%' OR item LIKE '%工日%' THEN 'labour' WHEN CAST(sk AS STRING) LIKE '3%' THEN 'mech'
  WHEN regexp_matches(item, '{A.MACHINE_WORDS}') THEN 'mech' ELSE 'materials' END AS cls FROM cell""")
def _(t):
    return cells(t, A.classify_resource(F.col("ln"), F.col("sk"), F.col("item")).alias("cls"))


@register("x15_price_split", """
WITH x AS (SELECT res_ID, pack, CAST(price_date AS STRING) AS price_date, price, CASE WHEN price IS NOT NULL THEN round(coalesce(price_excl,
  CASE WHEN tier = 'T1' THEN price / CAST(1.07 AS DOUBLE) ELSE price END), 4) END AS net FROM price_row)
SELECT res_ID, pack, price_date, net, round(price - net, 4) AS tax FROM x""")
def _(t):
    pack = F.when(F.col("tier") == "T1", R.VAT_PACK).otherwise(F.col("pack"))
    net, tax = R.price_split(F.col("price"), F.col("price_excl"), pack)
    return t.price_row.select("res_ID", "pack", F.col("price_date").cast("string").alias("price_date"), net.alias("net"), tax.alias("tax"))


@register("x16_coverage_band", f"""SELECT {K_SQL}, CASE WHEN l_quantity / 50 >= CAST(0.8 AS DOUBLE) THEN 'ok' WHEN l_quantity / 50 >= CAST(0.4 AS DOUBLE) THEN 'warn' ELSE 'bad' END AS band FROM cell""")
def _(t):
    return cells(t, C.coverage_band(F.col("l_quantity") / 50).alias("band"))


@register("x17_clean_country", "SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN '' WHEN s_nationkey % 3 = 1 THEN '' ELSE n_name END AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    nation = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    raw = F.when(F.col("s_nationkey") % 3 == 0, F.lit("??")).when(F.col("s_nationkey") % 3 == 2, F.col("n_name"))
    return t.supplier.join(nation, "s_nationkey").select("s_suppkey", A.clean_country(raw).alias("country"))


_project = {"0": ("Alpha · Town", "grade B"), "1": ("", "steel bar"), "2": ("", "location=Here | x"), "3": ("Beta", ""), "4": ("B", "plain one plain two")}


@register("x18_parse_project", f"""SELECT {K_SQL}, CASE pk % 5 """ + " ".join(f"WHEN {i} THEN '{p}'" for i, (p, _) in _project.items()) + " END AS project, CASE pk % 5 "
          + " ".join(f"WHEN {i} THEN '{r}'" for i, (_, r) in _project.items()) + " END AS rest FROM cell")
def _(t):
    p = A.parse_project(F.col("features"))
    return cells(t, p["project"].alias("project"), p["rest"].alias("rest"))


@register("x19_fx_text", """SELECT event_id, CASE WHEN CAST(props->>'k' AS BIGINT) = 0 THEN '' ELSE
  concat('1 THB → ', printf('%.4f', round(CAST(1 AS DOUBLE) / CAST(props->>'k' AS DOUBLE), 4)), ' k') END AS fx FROM events""")
def _(t):
    return t.events.select("event_id", A.fx_text(F.lit("THB"), F.col("props")).alias("fx"))


def _nested(column: str, fixes) -> str:
    for wrong, right in fixes:
        column = f"replace({column}, '{wrong}', '{right}')"
    return column


COST = f"""
WITH a AS (SELECT {K_SQL}, item, regexp_replace(item, '(?i)\\s*kg\\.?\\s*', '', 'g') AS s FROM cell),
b AS (SELECT *, regexp_replace(regexp_replace({_nested('s', K.COST_FIXES)}, '^\\d+\\s*', ''), '^(台班|艘班|工日)\\s+', '') AS r FROM a),
c AS (SELECT *, CASE r WHEN '钢' THEN '钢筋' WHEN '板材' THEN '板枋材' ELSE r END AS z FROM b)
SELECT {K_SQL}, CASE WHEN item IN ({', '.join(repr(w) for w in K.NOT_ITEMS)}) OR {' OR '.join(f"starts_with(item, '{h}')" for h in K.NOT_ITEM_HEADS)}
  OR z IN ('-', '—', '.', '/') OR regexp_matches(z, '\\d{{3,}}') AND length(regexp_replace(z, '[\\d\\s./—\\-(),;:+]+', '', 'g')) < 3 THEN '' ELSE trim(z) END AS cost_item FROM c"""


@register("x20_clean_cost_item", COST)
def _(t):
    return cells(t, K.clean_cost_item(F.col("item")).alias("cost_item"))


NUM = "'^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$'"
AMOUNT = f"""WITH v AS (SELECT {K_SQL}, trim(amount) AS v FROM cell), w AS (SELECT *, v = '' OR v IN ('---', '—', '-') AS blank, regexp_matches(v, '^\\d+-\\d+$') AS rng,
  CASE WHEN regexp_matches(v, '^\\(\\d+\\.?\\d*\\)$') THEN replace(replace(v, '(', ''), ')', '') WHEN regexp_matches(v, '^\\d+,\\d+$') THEN replace(v, ',', '.')
  WHEN regexp_matches(v, {NUM}) THEN v ELSE regexp_replace(v, '[^\\d.\\-,]', '', 'g') END AS d FROM v)"""


@register("x21_clean_amount", AMOUNT + f"""
SELECT {K_SQL}, CASE WHEN NOT blank AND NOT rng AND regexp_matches(d, {NUM}) THEN TRY_CAST(d AS DOUBLE) END AS value,
  CASE WHEN blank THEN 'raw' WHEN rng THEN 'range' WHEN regexp_matches(d, {NUM}) THEN 'raw' ELSE 'unparseable' END AS quality, CASE WHEN rng THEN v END AS shown FROM w""")
def _(t):
    a = U.clean_amount(F.col("amount"))
    return cells(t, a["value"].alias("value"), a["quality"].alias("quality"), a["shown"].alias("shown"))


@register("x22_clean_amount_strict", f"""SELECT {K_SQL}, CASE WHEN trim(amount) NOT IN ('---', '—', '-', '－') AND regexp_matches(replace(trim(amount), ',', ''), {NUM})
  THEN TRY_CAST(replace(trim(amount), ',', '') AS DOUBLE) END AS value FROM cell""")
def _(t):
    return cells(t, U.clean_amount_strict(F.col("amount")).alias("value"))


def _unit_sql(rules) -> str:
    arms = []
    for how, words, unit in rules:
        each = words.split("|")
        test = {"is": f"n IN ({', '.join(repr(w) for w in each)})", "ends": " OR ".join(f"n LIKE '%{w}'" for w in each)}.get(
            how, " OR ".join(f"n LIKE '%{w}%'" for w in each))
        if how.startswith("has_not_"):
            test = f"({test}) AND n NOT LIKE '%{how.rsplit('_', 1)[1]}%'"
        arms.append(f"WHEN {test} THEN '{unit}'")
    return f"CASE {' '.join(arms)} ELSE '' END"


@register("x23_infer_unit", f"SELECT {K_SQL}, {_unit_sql(K.UNIT_RULES)} AS unit, {_unit_sql(K.SHORT_UNIT_RULES)} AS short FROM (SELECT *, trim(item) AS n FROM cell)")
def _(t):
    return cells(t, K.infer_unit(F.col("item")).alias("unit"), K.infer_unit(F.col("item"), K.SHORT_UNIT_RULES).alias("short"))


FORM = "CASE WHEN regexp_matches(replace(amount, ' ', ''), '^\\d+,\\d{1,3}$') THEN replace(replace(amount, ' ', ''), ',', '.') ELSE replace(replace(amount, ' ', ''), ',', '') END"


@register("x24_number_text", f"""SELECT {K_SQL}, regexp_matches(f, '^-?\\d+(\\.\\d+)?$') AS is_number, CASE WHEN regexp_matches(f, '^-?\\d+(\\.\\d+)?$') THEN CAST(f AS DOUBLE) END AS value
FROM (SELECT *, {FORM} AS f FROM cell)""")
def _(t):
    return cells(t, U.is_number_text(F.col("amount")).alias("is_number"), U.safe_float(F.col("amount")).alias("value"))


@register("x25_normalize_text", f"""SELECT {K_SQL}, {NORMALIZED} AS normal, trim(regexp_replace({_nested('item', K.SCAN_FIXES)}, '(\\d)\\.\\s+(\\d)', '\\1.\\2', 'g')) AS fixed,
  regexp_replace(replace(trim(amount), ' ', ''), '^\\.(\\d)', '0.\\1') AS zeroed FROM cell""")
def _(t):
    return cells(t, A.normalize_text(F.col("title")).alias("normal"), K.fix_text(F.col("item")).alias("fixed"), U.leading_zero(F.col("amount")).alias("zeroed"))


@register("x26_split_merged_numbers", f"""WITH p AS (SELECT *, regexp_extract_all(amount, '\\d{{3,6}}\\.\\d{{2}}') AS a, regexp_extract_all(amount, '\\d{{4,}}') AS b FROM cell)
SELECT {K_SQL}, array_to_string(CASE WHEN len(a) > 1 THEN a WHEN len(b) > 2 THEN list_transform(b, lambda r: CASE WHEN length(r) >= 5 THEN regexp_replace(r, '(\\d\\d)$', '.\\1') ELSE r END)
  ELSE [amount] END, '|') AS parts FROM p""")
def _(t):
    return cells(t, F.array_join(U.split_merged(F.col("amount")), "|").alias("parts"))


@register("x27_page_artifact", f"""SELECT {K_SQL}, regexp_matches(trim(amount), '^\\d{{3}}\\s*[\\s\\-–—]*\\s*\\d{{3}}\\s*[二三四五六七八九]?\\s*[\\-–—]*\\s*$')
  OR regexp_matches(trim(amount), '^\\d{{3}}[\\s\\-–—]+$') OR regexp_matches(trim(amount), '^\\d{{3}}\\s*二?\\s*$') AS artifact FROM cell""")
def _(t):
    return cells(t, A.is_page_artifact(F.col("amount")).alias("artifact"))


@register("x28_normalize_chapter", f"SELECT {K_SQL}, replace(replace(title, '第2章', '第二章'), '第10章', '第十章') AS title FROM cell")
def _(t):
    return cells(t, A.normalize_chapter(F.col("title")).alias("title"))


@register("x29_classify_boq_code", f"""SELECT {K_SQL}, CASE WHEN regexp_full_match(code, '[A-Z]') THEN 1 WHEN regexp_full_match(code, '[A-Z]\\.[a-z]') THEN 2
  WHEN regexp_full_match(code, '[A-Z]\\.[a-z]\\.\\d+') THEN 3 WHEN regexp_full_match(code, '[A-Z]\\.[a-z]\\.\\d+\\.\\d+') THEN 4 END AS level FROM cell""")
def _(t):
    return cells(t, A.classify_boq_code(F.col("code")).alias("level"))


@register("x30_strip_brackets", f"""SELECT {K_SQL}, CASE WHEN kind IS NULL THEN marked ELSE substr(marked, 2, length(marked) - 2) END AS text, kind FROM (
  SELECT *, CASE WHEN marked LIKE '【%】' THEN 'section' WHEN marked LIKE '《%》' THEN 'subsection' WHEN marked LIKE '{{%}}' THEN 'group' END AS kind FROM cell)""")
def _(t):
    b = A.strip_brackets(A.clean_text(F.col("marked")))
    return cells(t, b["text"].alias("text"), b["kind"].alias("kind"))


@register("x31_parse_boq_code", f"""WITH p AS (SELECT {K_SQL}, string_split(code, '.') AS p FROM cell)
SELECT {K_SQL}, CASE WHEN len(p) >= 4 THEN p[1] END AS volume, CASE WHEN len(p) >= 4 THEN array_to_string(p[2:4], '.') END AS chapter_code,
  CASE WHEN len(p) >= 4 THEN array_to_string(p[5:], '.') END AS norm_code FROM p""")
def _(t):
    p = A.parse_boq_code(F.col("code"))
    return cells(t, p["volume"].alias("volume"), p["chapter_code"].alias("chapter_code"), p["norm_code"].alias("norm_code"))


define_view("norm_source", """
SELECT o_orderkey AS norm_ID, CASE o_orderkey % 3 WHEN 0 THEN 'book 2012' WHEN 1 THEN 'book 2021' ELSE 'other' END AS source_lib,
       CASE WHEN o_orderkey % 7 = 0 THEN 'BJ12.x' ELSE concat('n', CAST(o_orderkey AS STRING)) END AS code FROM orders""")


@register("x32_source_prefix", """SELECT norm_ID, CASE WHEN source_lib LIKE '%2012%' AND code NOT LIKE 'BJ12.%' THEN concat('BJ12.', code)
  WHEN source_lib LIKE '%2021%' AND code NOT LIKE 'BJ21.%' THEN concat('BJ21.', code) ELSE code END AS code FROM norm_source""")
def _(t):
    return t.norm_source.select("norm_ID", A.source_prefix(F.col("code"), F.col("source_lib")).alias("code"))


@register("x34_chapter_content", """SELECT code, concat_ws(chr(10), CASE WHEN item_feature <> '' THEN concat('【项目特征】', item_feature) END,
  CASE WHEN calc_rule <> '' THEN concat('【计量规则】', calc_rule) END, CASE WHEN work_content <> '' THEN concat('【工作内容】', work_content) END, concat('【GB编码】', code)) AS content FROM enterprise_item""")
def _(t):
    return t.enterprise_item.select("code", A.chapter_content(F.col("item_feature"), F.col("calc_rule"), F.col("work_content"), F.col("code")).alias("content"))


BOX_SQL = ("x", "y", "x + l_quantity", "y + 20"), ("x + 5", "y + ln", "x + 30", "y + 25")


@register("x35_bbox_iou", f"""WITH b AS (SELECT {K_SQL}, x AS a1, y AS b1, x + l_quantity AS a2, y + 20 AS b2, x + 5 AS c1, y + ln AS d1, x + 30 AS c2, y + 25 AS d2 FROM cell),
i AS (SELECT *, greatest(0.0::DOUBLE, least(a2, c2) - greatest(a1, c1)) * greatest(0.0::DOUBLE, least(b2, d2) - greatest(b1, d1)) AS inter FROM b)
SELECT {K_SQL}, inter / (greatest(0.0::DOUBLE, a2 - a1) * greatest(0.0::DOUBLE, b2 - b1) + greatest(0.0::DOUBLE, c2 - c1) * greatest(0.0::DOUBLE, d2 - d1) - inter + CAST(0.000001 AS DOUBLE)) AS iou FROM i""")
def _(t):
    x, y = F.col("x"), F.col("y")
    a = {"x1": x, "y1": y, "x2": x + F.col("l_quantity"), "y2": y + 20}
    b = {"x1": x + 5, "y1": y + F.col("ln"), "x2": x + 30, "y2": y + 25}
    return cells(t, U.bbox_iou(a, b).alias("iou"))


@register("x36_band_columns", f"""SELECT {K_SQL}, CASE WHEN x >= 560 OR x < 55 THEN 'other' WHEN x < 185 THEN 'rock' WHEN x < 250 THEN 'density' WHEN x < 315 THEN 'drill_alloy'
  WHEN x < 400 THEN 'drill_quenched' WHEN x < 465 THEN 'drill_manual' WHEN x < 515 THEN 'strength' ELSE 'coefficient' END AS rock,
  CASE WHEN x < 65 THEN 0 WHEN x < 225 THEN 1 WHEN x < 295 THEN 2 WHEN x < 440 THEN 3 ELSE 4 END AS soil FROM cell""")
def _(t):
    return cells(t, U.band(F.col("x"), U.ROCK_BANDS, "other").alias("rock"), U.band(F.col("x"), U.SOIL_BANDS).alias("soil"))


@register("x38_split_fused", f"""SELECT {K_SQL}, CASE WHEN ok_ THEN regexp_extract(fused, '^([一-鿿]{{1,4}})(\\d+(?:\\.\\d+)?)(.*)$', 1) END AS name,
  CASE WHEN ok_ THEN regexp_extract(fused, '^([一-鿿]{{1,4}})(\\d+(?:\\.\\d+)?)(.*)$', 2) || regexp_extract(fused, '^([一-鿿]{{1,4}})(\\d+(?:\\.\\d+)?)(.*)$', 3) END AS value FROM (
  SELECT *, regexp_matches(regexp_extract(fused, '^([一-鿿]{{1,4}})(\\d+(?:\\.\\d+)?)(.*)$', 1), '{A.ATTRIBUTE_NAME}') AS ok_ FROM cell)""")
def _(t):
    f = A.split_fused(F.col("fused"))
    return cells(t, f["name"].alias("name"), f["value"].alias("value"))


@register("x40_row_fields", f"""WITH p AS (SELECT {K_SQL}, string_split_regex(trim(row_text), '\\s+') AS p FROM cell)
SELECT {K_SQL}, coalesce(list_filter(p, lambda v: regexp_full_match(v, '\\d{{1,2}}'))[1], '') AS seq,
  array_to_string(list_filter(p, lambda v: NOT regexp_full_match(v, '[\\d.()\\-]+') AND NOT list_contains([{', '.join(repr(u) for u in A.UNIT_WORDS)}], v)), ' ') AS name,
  coalesce(list_filter(p, lambda v: list_contains([{', '.join(repr(u) for u in A.UNIT_WORDS)}], v))[-1], '') AS unit,
  coalesce(list_filter(p, lambda v: regexp_full_match(v, '\\d{{10,13}}'))[1], '') AS code FROM p""")
def _(t):
    r = A.row_fields(F.col("row_text"))
    return cells(t, *[r[c].alias(c) for c in ("seq", "name", "unit", "code")])


@register("f12_drop_empty_items", COST.replace("SELECT ok, ln, pk, sk, CASE", "SELECT * FROM (SELECT ok, ln, pk, sk, CASE") + ") WHERE cost_item <> '' AND pk % 4 <> 0")
def _(t):
    cleaned = cells(t, K.clean_cost_item(F.col("item")).alias("cost_item"), F.when(F.col("pk") % 4 != 0, "c").otherwise("").alias("code"))
    return cleaned.filter((F.col("code") != "") & (F.col("cost_item") != "")).drop("code")


@register("u05_ordered_dedupe", """SELECT ok, title, min(ln) AS first_ln FROM cell WHERE title <> '' GROUP BY 1, 2""")
def _(t):
    return t.cell.filter(F.col("title") != "").groupBy("ok", "title").agg(F.min("ln").alias("first_ln"))


@register("src03_optional_column", "SELECT p_partkey, p_name, 'none' AS p_color FROM part")
def _(t):
    return t.part.select("p_partkey", col_or(t.part, "p_name", "").alias("p_name"), col_or(t.part, "p_color", "none").alias("p_color"))
