"""Bills of quantities and the consolidation of source books."""

from __future__ import annotations

from pyspark.sql import functions as F

from costbook.functions import names as A
from costbook.operators import boq as B
from costbook.operators import consolidate as D
from costbook.operators import hierarchy as H
from costbook.plans.registry import register
from costbook.plans.tree import WBS
from costbook.session import stored
from costbook.sources.bindings import define_derived, define_view
from costbook.sources.tables import stack_sources

L1 = "substr('ABCDEFGHRX', CAST(1 + FLOOR(k / 200) AS INT), 1)"
SUB = f"concat({L1}, '.', substr('abcdefghij', CAST(1 + FLOOR(k / 20) % 10 AS INT), 1))"
NUM = "CAST(o_custkey % 90 AS STRING)"
define_view("boq_grid", f"""
SELECT book, k + 3 AS row_no,
  CASE WHEN m = 0 AND k % 200 = 0 THEN {L1} WHEN m = 1 THEN {SUB} WHEN m = 4 THEN concat({SUB}, '.01')
       WHEN m BETWEEN 5 AND 11 THEN concat({SUB}, '.01.', lpad(CAST(m AS STRING), 3, '0'))
       WHEN m > 12 THEN concat({SUB}, '.02.', lpad(CAST(m AS STRING), 3, '0')) WHEN m = 12 THEN 'zz' END AS A,
  CASE WHEN m = 0 THEN '【Section】' WHEN m = 1 THEN '《Sub section》' WHEN m = 4 THEN '{{Group}}' ELSE concat('item ', CAST(o_custkey AS STRING)) END AS B,
  CASE o_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'kg' WHEN 2 THEN 't' WHEN 3 THEN 'm' WHEN 4 THEN 'm2' ELSE 'm3' END AS C,
  o_orderstatus AS D, o_orderpriority AS E, CASE WHEN m % 3 = 0 THEN concat('work ', o_orderpriority) ELSE '' END AS F, 'rule' AS G,
  {NUM} AS I, '2' AS J, CASE WHEN m % 5 = 0 THEN '' ELSE concat({NUM}, '.5') END AS K, CASE WHEN m % 2 = 0 THEN '0' ELSE {NUM} END AS L,
  CASE WHEN m % 4 = 0 THEN '' ELSE '12,5' END AS M, 'n/a' AS N,
  CASE WHEN m = 1 THEN concat('worker', {{nl}}, '工日') WHEN m = 2 AND g % 3 <> 0 OR m = 3 THEN concat({NUM}, '.25') WHEN m > 4 THEN {NUM} END AS O,
  CASE WHEN m = 1 AND g % 2 = 0 THEN concat('sand', {{nl}}, 't') WHEN m = 2 AND g % 3 <> 0 THEN '12.5' WHEN m > 4 AND m % 2 = 0 THEN '0' WHEN m > 4 THEN '1.5' END AS P,
  CASE WHEN m = 1 THEN 'remark' WHEN m > 4 AND m % 3 = 0 THEN '3' END AS Q
FROM (SELECT concat('K', CAST(CAST(FLOOR(o_orderkey / 2000) AS BIGINT) AS STRING)) AS book, o_orderkey % 2000 AS k, o_orderkey % 20 AS m,
             CAST(FLOOR((o_orderkey % 2000) / 20) AS BIGINT) AS g, o_custkey, o_orderstatus, o_orderpriority FROM orders) r""".replace("{nl}", "chr(10)").replace("{{", "{").replace("}}", "}"))
define_view("chapter_target", """
SELECT concat(substr('ABCDEFGH', CAST(1 + p_partkey % 8 AS INT), 1), '.', substr('abcdefghij', CAST(1 + FLOOR(p_partkey / 8) % 10 AS INT), 1), '.01') AS group_code,
       concat('T', CAST(min(p_size) AS STRING)) AS target FROM part GROUP BY 1""")
define_view("target_chapter", "SELECT concat('T', CAST(s AS STRING)) AS target, CAST(5000 + s AS BIGINT) AS chap_ID FROM (SELECT DISTINCT p_size AS s FROM part WHERE p_size % 4 <> 1) q")

SF = """CASE WHEN regexp_matches(replace({0}, ' ', ''), '^\\d+,\\d{{1,3}}$') THEN CAST(replace(replace({0}, ' ', ''), ',', '.') AS DOUBLE)
 WHEN regexp_matches(replace(replace({0}, ' ', ''), ',', ''), '^-?\\d+(\\.\\d+)?$') THEN CAST(replace(replace({0}, ' ', ''), ',', '') AS DOUBLE) END"""
define_derived("boq_def", f"""
WITH s AS (SELECT book, A AS sub_code, row_no AS sub_row, lead(row_no, 1, 1000000) OVER (PARTITION BY book ORDER BY row_no) AS next_row, O, P, Q
           FROM boq_grid WHERE regexp_full_match(A, '[A-Z]\\.[a-z]') AND row_no > 2),
d AS (SELECT book, sub_code, sub_row, next_row, c AS col, v FROM s UNPIVOT (v FOR c IN (O, P, Q)) WHERE v LIKE '%' || chr(10) || '%'),
n AS (SELECT book, row_no, c AS col, {SF.format('v')} AS price FROM (SELECT book, row_no, O, P, Q FROM boq_grid WHERE coalesce(A, '') = '' AND row_no > 2) UNPIVOT (v FOR c IN (O, P, Q))),
f AS (SELECT d.book, d.sub_row, min(n.row_no) AS row_no FROM d JOIN n ON n.book = d.book AND n.col = d.col AND n.row_no > d.sub_row AND n.row_no < d.next_row
      WHERE n.price IS NOT NULL GROUP BY 1, 2)
SELECT d.book, d.sub_code, d.col, split_part(d.v, chr(10), 1) AS name, split_part(d.v, chr(10), 2) AS unit, n.price AS unit_price
FROM d LEFT JOIN f ON f.book = d.book AND f.sub_row = d.sub_row LEFT JOIN n ON n.book = d.book AND n.row_no = f.row_no AND n.col = d.col""")
define_derived("boq_item", f"""
SELECT book, A AS code, regexp_extract(A, '^[A-Z]\\.[a-z]') AS sub_code, regexp_extract(A, '^[A-Z]\\.[a-z]\\.\\d+') AS group_code, CAST(split_part(A, '.', 4) AS INT) AS sort_order,
       B AS name, C AS unit, D AS description, E AS type, F AS work_content, G AS calc_rule, {SF.format('I')} AS amount, {SF.format('J')} AS quantity,
       {SF.format('K')} AS rate, {SF.format('L')} AS labour, {SF.format('M')} AS materials, {SF.format('N')} AS mech, O, P, Q
FROM boq_grid WHERE row_no > 2 AND regexp_full_match(A, '[A-Z]\\.[a-z]\\.\\d+\\.\\d+')""")
define_derived("boq_qty", f"SELECT book, code, sub_code, col, v AS consumption FROM (SELECT book, code, sub_code, c AS col, {SF.format('x')} AS v FROM (SELECT book, code, sub_code, O, P, Q FROM boq_item) UNPIVOT (x FOR c IN (O, P, Q))) WHERE v <> 0")


@register("src07_boq_coded_rows", "SELECT book, row_no, A AS code, B AS name FROM boq_grid WHERE row_no > 2 AND coalesce(A, '') <> ''")
def _(t):
    return B.coded_rows(t.boq_grid).select("book", "row_no", F.col("A").alias("code"), F.col("B").alias("name"))


@register("w06_boq_resource_prices", "SELECT * FROM boq_def")
def _(t):
    return B.resource_definitions(t.boq_grid)


@register("h11_boq_tree", """
WITH c AS (SELECT book, A AS code, B, CASE WHEN regexp_full_match(A, '[A-Z]') THEN 1 WHEN regexp_full_match(A, '[A-Z]\\.[a-z]') THEN 2
  WHEN regexp_full_match(A, '[A-Z]\\.[a-z]\\.\\d+') THEN 3 WHEN regexp_full_match(A, '[A-Z]\\.[a-z]\\.\\d+\\.\\d+') THEN 4 END AS level FROM boq_grid WHERE row_no > 2),
n AS (SELECT book, code, level, CASE WHEN level < 4 THEN substr(B, 2, length(B) - 2) ELSE B END AS title,
  CASE level WHEN 1 THEN 'section' WHEN 2 THEN 'subsection' WHEN 3 THEN 'group' END AS kind, false AS implicit FROM c WHERE level IS NOT NULL
  UNION ALL SELECT DISTINCT book, regexp_extract(code, '^[A-Z]\\.[a-z]\\.\\d+'), 3, '', NULL, true FROM c i WHERE level = 4 AND NOT EXISTS (
    SELECT 1 FROM c g WHERE g.level = 3 AND g.book = i.book AND g.code = regexp_extract(i.code, '^[A-Z]\\.[a-z]\\.\\d+')))
SELECT *, CASE level WHEN 2 THEN substr(code, 1, 1) WHEN 3 THEN substr(code, 1, 3) WHEN 4 THEN regexp_extract(code, '^[A-Z]\\.[a-z]\\.\\d+') END AS parent_code FROM n""")
def _(t):
    return B.tree(t.boq_grid)


@register("d12_boq_import", """
SELECT 'item' AS part, book, code, name AS text, rate AS value FROM boq_item
UNION ALL SELECT 'definition', book, sub_code, concat(col, ' ', name), unit_price FROM boq_def
UNION ALL SELECT 'quantity', q.book, q.code, concat(q.col, ' ', d.name), q.consumption FROM boq_qty q JOIN boq_def d ON d.book = q.book AND d.sub_code = q.sub_code AND d.col = q.col""")
def _(t):
    items, defs = B.items(t.boq_grid), B.resource_definitions(t.boq_grid)
    qty = B.defined_quantities(B.quantities(items), defs)
    text = "concat(col, ' ', name)"
    return (items.selectExpr("'item' AS part", "book", "code", "name AS text", "rate AS value")
            .union(defs.selectExpr("'definition'", "book", "sub_code", text, "unit_price"))
            .union(qty.selectExpr("'quantity'", "book", "code", text, "consumption")))


@register("d13_boq_compat_rows", """
SELECT *, '分类指标' AS attr1_label, '项目特征' AS attr2_label, '工作内容' AS attr3_label, '计算规则' AS attr4_label FROM (
SELECT book, code, group_code, sort_order, type AS attr_level1, description AS attr_level2, work_content AS attr_level3, calc_rule AS attr_level4,
  x.cost_item, x.unit, x.amount FROM (
  SELECT i.*, unnest([{'cost_item': '人工费', 'unit': '元', 'amount': labour}, {'cost_item': '材料费', 'unit': '元', 'amount': materials},
    {'cost_item': '机械费', 'unit': '元', 'amount': mech}]) AS x FROM boq_item i) WHERE x.amount <> 0
UNION ALL SELECT book, code, group_code, sort_order, type, description, work_content, calc_rule, name, unit, rate FROM boq_item WHERE rate IS NOT NULL
UNION ALL SELECT i.book, i.code, i.group_code, i.sort_order, i.type, i.description, i.work_content, i.calc_rule,
  coalesce(d.name, concat('消耗量(', q.col, ')')), coalesce(d.unit, ''), q.consumption
  FROM boq_item i JOIN boq_qty q ON q.book = i.book AND q.code = i.code LEFT JOIN boq_def d ON d.book = q.book AND d.sub_code = q.sub_code AND d.col = q.col)""")
def _(t):
    # three parts of the plan read the items, whose texts and numbers are worked out once
    items = stored(B.items(t.boq_grid), "boq-items")
    return B.compat_rows(items, B.quantities(items), B.resource_definitions(t.boq_grid))


@register("a21_boq_group_summary", """
WITH u AS (SELECT book, group_code, unit, min({'a': sort_order, 'b': code}) AS pos FROM boq_item WHERE unit <> '' GROUP BY 1, 2, 3),
v AS (SELECT book, group_code, string_agg(unit, ', ' ORDER BY pos) AS units FROM u GROUP BY 1, 2)
SELECT i.book, i.group_code, coalesce(max(v.units), '') AS units,
  coalesce(min_by(i.work_content, i.sort_order) FILTER (i.work_content <> ''), '') AS work_content, count(*) AS items
FROM boq_item i LEFT JOIN v ON v.book = i.book AND v.group_code = i.group_code GROUP BY 1, 2""")
def _(t):
    return B.group_summary(B.items(t.boq_grid))


@register("a22_definition_usage", """
SELECT d.*, count(q.code) AS used_by, round(sum(q.consumption), 4) AS total FROM boq_def d LEFT JOIN boq_qty q ON q.book = d.book AND q.sub_code = d.sub_code AND q.col = d.col GROUP BY ALL""")
def _(t):
    return B.definition_usage(B.resource_definitions(t.boq_grid), B.quantities(B.items(t.boq_grid)))


@register("f13_scope_split", """
SELECT DISTINCT i.group_code, CASE WHEN substr(i.group_code, 1, 1) IN ('R', 'S', 'T', 'U', 'W', 'X') THEN 'out_of_scope' ELSE 'unmapped' END AS status
FROM boq_item i WHERE i.group_code NOT IN (SELECT group_code FROM chapter_target)""")
def _(t):
    return B.scope_split(B.items(t.boq_grid).select("group_code").distinct(), t.chapter_target)


@register("j12_boq_chapter_map", """
SELECT i.book, i.code, m.target, c.chap_ID FROM boq_item i JOIN chapter_target m ON m.group_code = i.group_code JOIN target_chapter c ON c.target = m.target""")
def _(t):
    return B.items(t.boq_grid).join(t.chapter_target, "group_code").join(t.target_chapter, "target").select("book", "code", "target", "chap_ID")


OFFSET = 20_000_000
IDS = "CAST(substr(book, 2) AS BIGINT) * 1000000 + "


@register("d16_foreign_boq_to_book", f"""
WITH it AS (SELECT *, {IDS} ascii(substr(code, 1, 1)) * 10000 + ascii(substr(code, 3, 1)) * 100 + sort_order AS item_id FROM boq_item),
de AS (SELECT *, {IDS} ascii(substr(sub_code, 1, 1)) * 10000 + ascii(substr(sub_code, 3, 1)) * 100 + ascii(col) AS def_id FROM boq_def),
k AS (SELECT it.*, m.target, c.chap_ID FROM it JOIN chapter_target m ON m.group_code = it.group_code JOIN target_chapter c ON c.target = m.target)
SELECT 'norm' AS part, item_id + {OFFSET} AS id, chap_ID AS owner, code AS text, round(coalesce(labour, 0) + coalesce(materials, 0) + coalesce(mech, 0), 4) AS value FROM k
UNION ALL SELECT 'consumption', def_id + {OFFSET}, NULL, name, unit_price FROM de
UNION ALL SELECT 'content', k.item_id + {OFFSET}, de.def_id + {OFFSET}, NULL, q.consumption FROM k JOIN boq_qty q ON q.book = k.book AND q.code = k.code
  JOIN de ON de.book = q.book AND de.sub_code = q.sub_code AND de.col = q.col
UNION ALL SELECT 'lineage', item_id + {OFFSET}, item_id, group_code, NULL FROM k""")
def _(t):
    number = lambda c, last: (F.substring("book", 2, 9).cast("long") * 1000000 + F.ascii(F.substring(c, 1, 1)) * 10000
                              + F.ascii(F.substring(c, 3, 1)) * 100 + last)
    items = B.items(t.boq_grid)
    numbered_items = items.withColumn("item_id", number("code", F.col("sort_order")))
    defs = B.resource_definitions(t.boq_grid).withColumn("def_id", number("sub_code", F.ascii("col")))
    book = B.to_norm_book(numbered_items, defs, B.quantities(items), t.chapter_target, t.target_chapter, OFFSET, "foreign bill")
    return (book["norm"].selectExpr("'norm' AS part", "norm_ID AS id", "chap_ID AS owner", "norm_Code AS text", "amount AS value")
            .union(book["consumption"].selectExpr("'consumption'", "cons_ID", "cast(null as bigint)", "cons_Name", "cons_Price"))
            .union(book["content"].selectExpr("'content'", "norm_ID", "cons_ID", "cast(null as string)", "cont_Amount"))
            .union(book["norm_source"].selectExpr("'lineage'", "norm_ID", "source_norm_id", "source_chap_name", "cast(null as double)")))


define_view("mix_grid", """
SELECT concat('M', CAST(CAST(FLOOR(o_orderkey / 500) AS BIGINT) AS STRING)) AS book, o_orderkey % 500 + 1 AS row_no,
  CASE WHEN o_orderkey % 500 = 1 THEN '【mixes】' WHEN o_orderkey % 500 = 2 THEN '《concrete》' WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('C', CAST(o_custkey AS STRING)) END AS B,
  'm3' AS C, CAST(o_custkey % 400 AS STRING) AS E,
  CASE WHEN o_orderkey % 500 = 2 THEN concat('cement', chr(10), 'kg') WHEN o_orderkey % 3 = 0 THEN '0' ELSE CAST(o_custkey % 60 AS STRING) END AS J,
  CASE WHEN o_orderkey % 500 = 2 THEN concat('water', chr(10), 't') ELSE '0,18' END AS K, 'x' AS L
FROM orders""")


@register("d15_mix_sheet", f"""
WITH b AS (SELECT * FROM mix_grid WHERE row_no > 4 AND B <> '' AND B NOT LIKE '【%' AND B NOT LIKE '《%')
SELECT 'table' AS part, book, row_no, B AS name, C AS unit, {SF.format('E')} AS amount FROM b
UNION ALL SELECT 'line', book, row_no, 'cement', 'kg', {SF.format('J')} FROM b WHERE {SF.format('J')} <> 0
UNION ALL SELECT 'line', book, row_no, 'water', 't', {SF.format('K')} FROM b""")
def _(t):
    tables, lines = B.mix_sheet(t.mix_grid)
    return tables.selectExpr("'table' AS part", "book", "row_no", "mix AS name", "unit", "rate AS amount").union(
        lines.selectExpr("'line'", "book", "row_no", "name", "unit", "amount"))


define_view("bill_line", """
SELECT l_returnflag AS disc, l_linestatus AS cat, CAST(l_suppkey % 5 AS STRING) AS subcat, l_orderkey * 8 + l_linenumber AS pos,
       CASE WHEN l_orderkey % 17 = 0 THEN 'bad.code' ELSE concat(vol, '.', CASE WHEN l_orderkey % 5 = 0 THEN concat(substr(chap_code, 1, 6), '00000000')
         WHEN l_orderkey % 7 = 0 THEN chap_code2 ELSE chap_code END, '.', norm_Code) END AS boq_code
FROM lineitem JOIN norm ON norm_ID = l_orderkey JOIN (SELECT chap_ID AS c_ID, chap_code, min(chap_code) OVER (PARTITION BY chap_PID) AS chap_code2 FROM chapter) c ON c_ID = chap_ID""")
BILL = """WITH bd AS (SELECT disc, cat, subcat, boq_code, min(pos) AS pos FROM bill_line GROUP BY 1, 2, 3, 4),
bp AS (SELECT *, split_part(boq_code, '.', 1) AS volume, concat(split_part(boq_code, '.', 2), '.', split_part(boq_code, '.', 3), '.', split_part(boq_code, '.', 4)) AS chapter_code,
  split_part(boq_code, '.', 5) AS norm_code FROM bd WHERE boq_code <> 'bad.code'),
nn AS (SELECT n.norm_ID, n.vol AS volume, c.chap_code AS chapter_code, n.norm_Code AS norm_code FROM norm n JOIN chapter c ON c.chap_ID = n.chap_ID),
bx AS (SELECT bp.*, (SELECT min(norm_ID) FROM nn WHERE nn.volume = bp.volume AND nn.chapter_code = bp.chapter_code AND nn.norm_code = bp.norm_code) AS e,
  (SELECT min(norm_ID) FROM nn WHERE nn.volume = bp.volume AND nn.norm_code = bp.norm_code) AS l,
  EXISTS (SELECT 1 FROM nn WHERE nn.volume = bp.volume AND nn.chapter_code = bp.chapter_code) AS known FROM bp),
resolved AS (SELECT disc, cat, subcat, boq_code, volume, norm_code, coalesce(e, CASE WHEN known THEN l END) AS strict_ID, coalesce(e, l) AS any_ID FROM bx)
"""


def bill(t):
    first = B.first_per_key(t.bill_line, ["disc", "cat", "subcat", "boq_code"], F.col("pos"))
    parsed = A.parse_boq_code(F.col("boq_code"))
    return first.select("disc", "cat", "subcat", "boq_code", "pos", parsed.alias("p")).select("*", "p.*").drop("p").filter(F.col("volume").isNotNull())


def coded_norms(t):
    return t.norm.join(t.chapter.select("chap_ID", "chap_code"), "chap_ID").select(
        "norm_ID", F.col("vol").alias("volume"), F.col("chap_code").alias("chapter_code"), F.col("norm_Code").alias("norm_code"))


@register("j19_boq_code_resolution", BILL + "SELECT * FROM resolved")
def _(t):
    return B.resolve_codes(bill(t), coded_norms(t)).select("disc", "cat", "subcat", "boq_code", "volume", "norm_code", "strict_ID", "any_ID")


# ---- consolidation -------------------------------------------------------------------

define_view("division", "SELECT lpad(CAST(r_regionkey + 1 AS STRING), 2, '0') AS division, r_name AS name FROM region")
define_view("sub_division", """
SELECT lpad(CAST(n_regionkey + 1 AS STRING), 2, '0') AS division, lpad(CAST(n_nationkey + 1 AS STRING), 2, '0') AS sub, n_name AS name FROM nation""")
define_view("list_item", """
SELECT concat('V.', lpad(CAST(n_regionkey + 1 AS STRING), 2, '0'), '.', lpad(CAST(n_nationkey + 1 AS STRING), 2, '0'), '.', lpad(CAST(s_suppkey AS STRING), 6, '0')) AS code,
       lpad(CAST(n_regionkey + 1 AS STRING), 2, '0') AS division, lpad(CAST(n_nationkey + 1 AS STRING), 2, '0') AS sub, s_name AS name,
       CASE WHEN s_suppkey % 2 = 0 THEN 'feature' ELSE '' END AS item_feature, '' AS calc_rule, n_name AS work_content,
       CASE WHEN s_suppkey % 3 = 0 THEN 'GB' END AS gb_ref, s_suppkey AS item_no
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
define_view("chapter_default", """
SELECT chap_ID, concat('V.', substr(chap_code, 1, 2), '.', lpad(CAST(chap_ID % 25 + 1 AS STRING), 2, '0'), '.', lpad(CAST(chap_ID % 97 AS STRING), 6, '0')) AS raw_code,
       code AS default_code FROM chapter JOIN (SELECT code, item_no FROM list_item) i ON item_no = chap_ID % 120 WHERE chap_PID >= 100""")
define_view("name_rule", """
SELECT d.chap_ID, CAST(r AS INT) AS rule_no, CASE r WHEN 1 THEN '^1.* F$' WHEN 2 THEN 'HIGH|LOW' ELSE 'O$' END AS pattern,
       CASE r WHEN 1 THEN 'V.none' ELSE code END AS code
FROM (SELECT chap_ID, {explode}(split('1,2,3', ',')) AS rs FROM chapter_default WHERE chap_ID % 3 = 0) d
JOIN (SELECT '1' AS k, 1 AS r UNION ALL SELECT '2', 2 UNION ALL SELECT '3', 3) n ON n.k = d.rs
JOIN (SELECT code, item_no FROM list_item) i ON item_no = (d.chap_ID + r) % 50""")

MAPPED = """WITH tg AS (SELECT code, CAST(division AS BIGINT) * 1000000 + CAST(sub AS BIGINT) * 1000 + item_no AS chap_ID FROM list_item),
hit AS (SELECT n.norm_ID, min_by(r.code, r.rule_no) AS code FROM norm n JOIN name_rule r ON r.chap_ID = n.chap_ID WHERE regexp_matches(n.norm_Name, r.pattern) GROUP BY 1),
mapped AS (SELECT n.norm_ID, n.norm_Code, n.norm_Name, n.chap_ID, coalesce(x.code, d.default_code) AS target, coalesce(x.chap_ID, g.chap_ID) AS target_ID, x.code IS NOT NULL AS refined
FROM norm n JOIN chapter_default d ON d.chap_ID = n.chap_ID JOIN tg g ON g.code = d.default_code LEFT JOIN hit h ON h.norm_ID = n.norm_ID LEFT JOIN tg x ON x.code = h.code)
"""


def book_tree(t):
    extensions = t.list_item.withColumn("code", F.regexp_replace("code", r"\d{6}$", F.lpad((F.col("item_no") * 7).cast("string"), 6, "0")))
    return D.coded_tree(t.division, t.sub_division, t.list_item, extensions.filter(F.col("item_no") % 5 == 0))


EXT = """(SELECT division, sub, name, item_feature, calc_rule, work_content, item_no * 7 AS seq,
  CAST(division AS BIGINT) * 1000000 + CAST(sub AS BIGINT) * 1000 + item_no * 7 AS chap_ID FROM list_item WHERE item_no % 5 = 0)"""
TREE = f"""SELECT CAST(division AS BIGINT) * 1000000 AS chap_ID, 0 AS chap_PID, name AS chap_Name, '' AS chap_Content, division AS chap_code FROM division
UNION ALL SELECT CAST(division AS BIGINT) * 1000000 + CAST(sub AS BIGINT) * 1000, CAST(division AS BIGINT) * 1000000, concat(division, '.', sub, ' ', name), '', concat(division, '.', sub) FROM sub_division
UNION ALL SELECT CAST(division AS BIGINT) * 1000000 + CAST(sub AS BIGINT) * 1000 + item_no, CAST(division AS BIGINT) * 1000000 + CAST(sub AS BIGINT) * 1000, concat(code, ' ', name),
  concat_ws(chr(10), CASE WHEN item_feature <> '' THEN concat('【项目特征】', item_feature) END, concat('【工作内容】', work_content), '【GB编码】' || gb_ref), concat(division, '.', sub, '.', lpad(CAST(item_no AS STRING), 6, '0')) FROM list_item
UNION ALL SELECT chap_ID, CAST(division AS BIGINT) * 1000000 + CAST(sub AS BIGINT) * 1000, concat('V.', division, '.', sub, '.', lpad(CAST(seq AS STRING), 6, '0'), ' ', name),
  concat_ws(chr(10), CASE WHEN item_feature <> '' THEN concat('【项目特征】', item_feature) END, concat('【工作内容】', work_content), '{D.EXTENSION_NOTE}'), concat(division, '.', sub, '.', lpad(CAST(seq AS STRING), 6, '0'))
  FROM {EXT} WHERE chap_ID NOT IN (SELECT CAST(division AS BIGINT) * 1000000 + CAST(sub AS BIGINT) * 1000 + item_no FROM list_item)"""


@register("h09_coded_tree", TREE)
def _(t):
    return book_tree(t)["chapter"]


@register("j13_two_level_mapping", MAPPED + "SELECT * FROM mapped")
def _(t):
    return D.map_norms(t.norm, t.chapter_default.select("chap_ID", "default_code"), t.name_rule, book_tree(t)["targets"])


@register("j14_item_mapping", """
SELECT n.norm_ID, i.code, CAST(i.division AS BIGINT) * 1000000 + CAST(i.sub AS BIGINT) * 1000 + i.item_no AS target_ID FROM norm n JOIN list_item i ON i.item_no = n.norm_ID % 1000""")
def _(t):
    wanted = t.norm.select("norm_ID", (F.col("norm_ID") % 1000).alias("item_no")).join(t.list_item.select("item_no", "code"), "item_no").select("norm_ID", "code")
    official = t.list_item.select("code", (F.col("division").cast("long") * 1000000 + F.col("sub").cast("long") * 1000 + F.col("item_no")).alias("chap_ID"))
    return D.map_items(t.norm, wanted, official).select("norm_ID", "code", "target_ID")


@register("j15_unmapped_chapters", "SELECT chap_ID, count(*) AS norms FROM norm WHERE chap_ID NOT IN (SELECT chap_ID FROM chapter_default) GROUP BY 1")
def _(t):
    return D.unmapped_chapters(t.norm, t.chapter_default)


KEPT = "SELECT norm_ID FROM norm WHERE chap_ID % 5 = 0"


@register("j17_referenced_copy", f"""
SELECT 'content' AS part, CAST(NULL AS STRING) AS vol, cons_ID, count(*) AS rows FROM content WHERE norm_ID IN ({KEPT}) GROUP BY cons_ID
UNION ALL SELECT 'consumption', vol, cons_ID, 1 FROM consumption WHERE cons_ID IN (SELECT cons_ID FROM content WHERE norm_ID IN ({KEPT}))""")
def _(t):
    facts, resources = D.referenced(t.content, t.consumption, t.norm.filter(F.col("chap_ID") % 5 == 0))
    return facts.groupBy("cons_ID").agg(F.count(F.lit(1)).alias("rows")).selectExpr("'content' AS part", "cast(null as string) AS vol", "cons_ID", "rows").union(
        resources.selectExpr("'consumption'", "vol", "cons_ID", "cast(1 as bigint)"))


@register("a31_keyword_split_counts", MAPPED + "SELECT chap_ID, target, count(*) AS norms FROM mapped WHERE chap_ID IN (SELECT chap_ID FROM name_rule) GROUP BY 1, 2")
def _(t):
    return D.split_counts(D.map_norms(t.norm, t.chapter_default.select("chap_ID", "default_code"), t.name_rule, book_tree(t)["targets"]), t.name_rule)


@register("d17_full_book_build", MAPPED + f""", tree AS ({TREE})
SELECT 'chapter' AS part, chap_ID AS id, chap_Name AS text FROM tree UNION ALL SELECT 'norm', norm_ID, target FROM mapped
UNION ALL SELECT 'content', norm_ID, CAST(cons_ID AS STRING) FROM content WHERE norm_ID IN (SELECT norm_ID FROM mapped)
UNION ALL SELECT 'consumption', cons_ID, vol FROM consumption WHERE cons_ID IN (SELECT cons_ID FROM content WHERE norm_ID IN (SELECT norm_ID FROM mapped))
UNION ALL SELECT 'lineage', m.norm_ID, concat(c3.chap_Name, ' > ', c2.chap_Name, ' > ', c1.chap_Name) FROM mapped m JOIN chapter c1 ON c1.chap_ID = m.chap_ID
  JOIN chapter c2 ON c2.chap_ID = c1.chap_PID JOIN chapter c3 ON c3.chap_ID = c2.chap_PID
UNION ALL SELECT 'unmapped', chap_ID, CAST(count(*) AS STRING) FROM norm WHERE chap_ID NOT IN (SELECT chap_ID FROM chapter_default) GROUP BY chap_ID""")
def _(t):
    book = D.build_book(t.norm, t.content, t.consumption, t.chapter, t.chapter_default.select("chap_ID", "default_code"), t.name_rule, book_tree(t), "book 2012")
    part = lambda name, id_, text, label=None: book[name].selectExpr(f"'{label or name}' AS part", f"{id_} AS id", f"{text} AS text")
    return (part("chapter", "chap_ID", "chap_Name").union(part("norm", "norm_ID", "target")).union(part("content", "norm_ID", "cast(cons_ID as string)"))
            .union(part("consumption", "cons_ID", "vol")).union(part("norm_source", "norm_ID", "source_chap_path", "lineage"))
            .union(part("unmapped", "chap_ID", "cast(norms as string)")))


@register("src02_stack_sources", """
SELECT 'parts' AS source_id, p_partkey AS id, p_name AS name, p_brand AS brand FROM part UNION ALL SELECT 'suppliers', s_suppkey, s_name, NULL FROM supplier""")
def _(t):
    parts = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return stack_sources({"parts": parts, "suppliers": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))}, ["id", "name", "brand"])


@register("src08_wbs_sheet", "SELECT row_no, wbs_code, name_cn, nullif(trim(work_content), '') AS work_content FROM wbs_sheet WHERE regexp_full_match(wbs_code, '[0-9]{12}')")
def _(t):
    sheet = t.wbs_sheet.filter(F.col("wbs_code").rlike("^[0-9]{12}$"))
    return sheet.select("row_no", "wbs_code", "name_cn", F.nullif(F.trim("work_content"), F.lit("")).alias("work_content"))


define_view("wbs_mapping", "SELECT wbs_code, CAST(row_no * 3 AS BIGINT) AS norm_ID, CASE WHEN row_no % 2 = 0 THEN 'strong' ELSE 'weak' END AS strength FROM wbs_sheet WHERE row_no % 3 = 0")


@register("j25_discipline_view", WBS + """, c AS (SELECT wbs_code, level, CASE substr(wbs_code, 1, 2) WHEN '01' THEN '土建' WHEN '02' THEN '安装' WHEN '03' THEN '土建' END AS discipline FROM x)
SELECT c.wbs_code, c.level, m.norm_ID, m.strength FROM c LEFT JOIN wbs_mapping m ON m.wbs_code = c.wbs_code WHERE c.discipline = '土建'""")
def _(t):
    prefix = F.substring("wbs_code", 1, 2)
    classes = H.wbs_nodes(t.wbs_sheet).withColumn("discipline", F.when(prefix.isin("01", "03"), "土建").when(prefix == "02", "安装"))
    return D.discipline_view(classes, t.wbs_mapping, "土建").select("wbs_code", "level", "norm_ID", "strength")


def source_chapters(t):
    both = stack_sources({"1": t.chapter, "2": t.chapter}, ["chap_ID", "chap_code"])
    mark = F.substring("chap_code", 1, 2)
    return both.withColumn("discipline", F.when((F.col("source_id") == "1") & mark.isin("01", "02"), "土建").when(mark == "03", "安装"))


def source_norms(t):
    return t.norm.select(F.when(F.col("norm_ID") % 2 == 0, "1").otherwise("2").alias("source_id"), "norm_ID", "chap_ID")


BACKFILLED = """SELECT CASE WHEN n.norm_ID % 2 = 0 THEN '1' ELSE '2' END AS source_id, n.norm_ID, CASE WHEN n.norm_ID % 2 = 0 AND substr(c.chap_code, 1, 2) IN ('01', '02') THEN '土建'
  WHEN substr(c.chap_code, 1, 2) = '03' THEN '安装' END AS discipline FROM norm n LEFT JOIN chapter c ON c.chap_ID = n.chap_ID"""


@register("j29_discipline_backfill", BACKFILLED)
def _(t):
    return D.backfill_discipline(source_norms(t), source_chapters(t)).select("source_id", "norm_ID", "discipline")


@register("a29_distributions", WBS + f"""
SELECT 'discipline' AS part, discipline AS name, count(*) AS rows FROM ({BACKFILLED}) GROUP BY 2
UNION ALL SELECT 'aa', substr(wbs_code, 1, 2), count(*) FROM x GROUP BY 2 UNION ALL SELECT 'level', CAST(level AS STRING), count(*) FROM x GROUP BY 2
UNION ALL SELECT 'source', source_lib, count(*) FROM norm_source GROUP BY 2 UNION ALL SELECT 'volume', vol, count(*) FROM usage GROUP BY 2""")
def _(t):
    from costbook.plans.prices import usage
    nodes = H.wbs_nodes(t.wbs_sheet)
    named = lambda df, part, c: D.distribution(df, c.alias("name")).select(F.lit(part).alias("part"), "name", "rows")
    norms = D.backfill_discipline(source_norms(t), source_chapters(t))
    return (named(norms, "discipline", F.col("discipline")).union(named(nodes, "aa", F.substring("wbs_code", 1, 2)))
            .union(named(nodes, "level", F.col("level").cast("string"))).union(named(t.norm_source, "source", F.col("source_lib")))
            .union(named(usage(t), "volume", F.col("vol"))))
