"""Norm details, chapter indexes and mixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from costbook.functions import labels as L
from costbook.functions import text as X
from costbook.operators import hierarchy as H
from costbook.operators import norms as N
from costbook.operators import pricing as R
from costbook.operators.ordered import numbered
from costbook.operators.provenance import volume_content
from costbook.plans.prices import PACK, _latest
from costbook.plans.registry import register
from costbook.plans.tree import DIRECT, SUBTREE
from costbook.sources.bindings import Tables, define_view

define_view("norms_table", """
SELECT o_orderkey AS id, o_orderstatus AS doc, CAST(1000 + o_custkey AS BIGINT) AS chapter_id,
       CAST(FLOOR(o_orderkey / 3) AS BIGINT) AS page, CAST(o_orderkey % 3 AS INT) AS seq_on_page,
       o_orderpriority AS section_title,
       CASE WHEN o_orderkey % 5 = 0 THEN concat('三、', substr(o_orderpriority, 3)) ELSE '' END AS subsection_title,
       CASE WHEN o_orderkey % 13 = 0 THEN '{broken' ELSE concat('{"attr_columns": ["a"], "notes": ["see <',
         CAST(o_custkey AS STRING), '>", "x & y"], "cost_composition": ["k1", "k2"], "consumption": ["u1"]}') END AS header_json
FROM orders""")
define_view("page_index", """
SELECT doc, page, CASE WHEN page % 2 = 1 THEN 'continued_table' ELSE 'norms_table' END AS page_type,
       max(id) AS table_id, min(chapter_id) AS chapter_id FROM norms_table GROUP BY doc, page""")
define_view("norms_item", """
SELECT l_orderkey AS table_id, concat('M', CAST(l_suppkey AS STRING)) AS norms_code, l_linenumber AS sort_order,
       l_partkey * 1000 + CAST(l_quantity AS BIGINT) AS id, p_name AS cost_item,
       CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN p_size % 5 = 0 THEN '工日' WHEN p_size % 5 = 2 THEN '台班'
            WHEN p_size % 2 = 0 THEN 'kg' ELSE 't' END AS cost_item_unit,
       CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity END AS amount,
       '强度等级' AS attr1_label, concat('C', CAST(p_size AS STRING)) AS attr_level1,
       '碎石粒径' AS attr2_label, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(p_size AS STRING) END AS attr_level2,
       '抗压强度' AS attr3_label, CAST(l_linenumber AS STRING) AS attr_level3,
       NULL AS attr4_label, CASE WHEN l_linenumber % 2 = 0 THEN p_type END AS attr_level4
FROM lineitem JOIN part ON l_partkey = p_partkey""")
define_view("nrm_item", """
SELECT CASE WHEN s_suppkey % 11 = 0 THEN 'none' ELSE concat(substr('ABC', CAST(1 + s_suppkey % 3 AS INT), 1), '.',
         lpad(CAST(n_regionkey + 1 AS STRING), 2, '0'), '.', lpad(CAST(n_nationkey AS STRING), 2, '0'), '.',
         lpad(CAST(s_suppkey AS STRING), 6, '0')) END AS code,
       s_name AS name, n_name AS nrm_section_title, s_suppkey AS item_no
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
define_view("quota_item", """
SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS section_id,
       CASE WHEN c_nationkey % 5 = 0 THEN 'all' ELSE o_orderpriority END AS subitem_title,
       concat('Q-', CAST(o_orderkey AS STRING)) AS code, o_orderstatus AS item_name, CAST(o_orderkey % 50 AS INT) AS page
FROM orders JOIN customer ON o_custkey = c_custkey""")
define_view("section", """
SELECT CAST(n_nationkey AS BIGINT) AS section_id, n_name AS section_title, CAST(n_regionkey AS BIGINT) AS chapter_id,
       n_nationkey AS section_no FROM nation""")
define_view("book_chapter", "SELECT CAST(r_regionkey AS BIGINT) AS chapter_id, r_name AS chapter_name FROM region")
define_view("mix_alias", """
SELECT res_ID, src_vol, src_Name, src_Unit, unit_factor FROM resource_alias WHERE src_vol = 'B'""")


def lines(t: Tables):
    prices = R.latest_price(t.resource_price).filter(F.col("pack") == PACK)
    return N.priced_lines(volume_content(t.content, t.norm), t.consumption, prices, ["vol", "cons_ID"])


LINES = f"""
WITH priced_line AS (SELECT n.norm_ID, n.chap_ID, n.norm_Code, c.cons_Name, c.cons_Standard, c.cons_Units, c.cons_Style, ct.cont_Amount, p.price
FROM content ct JOIN norm n ON n.norm_ID = ct.norm_ID JOIN consumption c ON c.vol = n.vol AND c.cons_ID = ct.cons_ID
LEFT JOIN (SELECT * FROM latest_price WHERE pack = '{PACK}') p ON p.res_ID = c.master_res_ID)
, cost AS (SELECT norm_ID, """ + ", ".join(
    f"round(coalesce(sum(CASE WHEN cons_Style = {k} THEN coalesce(cont_Amount, 0) * price END), 0), 4) AS {f}"
    for k, f in R.COST_FIELDS.items()) + """, CAST(sum(CASE WHEN price IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unpriced
  FROM priced_line GROUP BY norm_ID)
"""


@register("j03_norm_expansion", """
SELECT ct.norm_ID, n.vol, c.cons_ID, c.cons_Name, c.cons_Style, ct.cont_Amount FROM content ct JOIN norm n ON n.norm_ID = ct.norm_ID
JOIN consumption c ON c.vol = n.vol AND c.cons_ID = ct.cons_ID""")
def _(t):
    return R.expand_norms(volume_content(t.content, t.norm), t.consumption, ["vol", "cons_ID"]).select(
        "norm_ID", "vol", "cons_ID", "cons_Name", "cons_Style", "cont_Amount")


@register("a12_norm_cost", LINES + "SELECT * FROM cost")
def _(t):
    return N.line_costs(lines(t))


@register("a13_norm_base_amount", LINES + """
SELECT n.norm_ID, n.norm_Code, round(coalesce(man, 0) + coalesce(mat, 0) + coalesce(mach, 0) + norm_OtherPrice, 4) AS amount,
       coalesce(unpriced, 0) AS unpriced FROM norm n LEFT JOIN cost ON cost.norm_ID = n.norm_ID""")
def _(t):
    return R.base_amount(N.line_costs(lines(t)), t.norm)


TITLED = """SELECT t.*, coalesce(c.chap_Name, '') AS chapter_title, coalesce(p.page_type, '') AS page_type FROM norms_table t
LEFT JOIN chapter c ON c.chap_ID = t.chapter_id LEFT JOIN page_index p ON p.doc = t.doc AND p.page = t.page"""


@register("j04_table_chapter", """
SELECT 'table' AS part, t.id, c.chap_Name AS chapter_title FROM norms_table t LEFT JOIN chapter c ON c.chap_ID = t.chapter_id
UNION ALL SELECT 'page', p.page, c.chap_Name FROM page_index p LEFT JOIN chapter c ON c.chap_ID = p.chapter_id""")
def _(t):
    return N.titled(t.norms_table, t.chapter).selectExpr("'table' AS part", "id", "chapter_title").union(
        N.titled(t.page_index, t.chapter).selectExpr("'page'", "page", "chapter_title"))


@register("j05_table_page_type", f"SELECT id, doc, page, page_type FROM ({TITLED})")
def _(t):
    return N.paged(t.norms_table, t.page_index).select("id", "doc", "page", "page_type")


FILLED = f"""WITH x AS ({TITLED}),
y AS (SELECT *, page_type = 'continued_table' AND subsection_title = '' AND row_number() OVER (PARTITION BY doc ORDER BY page, seq_on_page) > 1 AS waits FROM x),
z AS (SELECT *, sum(CASE WHEN waits THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page, seq_on_page) AS g FROM y),
filled AS (SELECT id, doc, page, first_value(section_title) OVER w AS section_title, first_value(subsection_title) OVER w AS subsection_title,
  first_value(chapter_title) OVER w AS chapter_title FROM z WINDOW w AS (PARTITION BY doc, g ORDER BY page, seq_on_page))
SELECT *, regexp_replace(subsection_title, '^[一二三四五六七八九十、]+', '') AS subsection_clean FROM filled"""


def filled(t):
    return N.fill_continued(N.paged(N.titled(t.norms_table, t.chapter), t.page_index)).select(
        "id", "doc", "page", "section_title", "subsection_title", "chapter_title", "subsection_clean")


@register("w05_continued_table_fill", FILLED)
def _(t):
    return filled(t)


@register("x04_strip_ordinals", "SELECT id, regexp_replace(subsection_title, '^[一二三四五六七八九十、]+', '') AS title FROM norms_table")
def _(t):
    return t.norms_table.select("id", X.strip_ordinals(F.col("subsection_title")).alias("title"))


@register("a18_code_to_table", "SELECT norms_code, max(table_id) AS table_id FROM norms_item GROUP BY 1")
def _(t):
    return N.code_to_table(t.norms_item)


@register("a18_code_to_chapters", """
SELECT code, row_number() OVER (PARTITION BY code ORDER BY kind, norm_ID, code, chap_ID) AS pos, chap_ID FROM (
  SELECT norm_Code AS code, 0 AS kind, norm_ID, chap_ID FROM norm UNION ALL SELECT code, 1, 0, chap_ID FROM enterprise_item)""")
def _(t):
    return N.code_to_chapters(t.norm, t.enterprise_item)


@register("a19_search_text", """
SELECT chap_ID, CAST(FLOOR(norm_ID / 16384) AS BIGINT) AS slice, string_agg(norm_Name, ' ' ORDER BY norm_ID) AS text FROM norm GROUP BY 1, 2""")
def _(t):
    return N.search_text(t.norm)


@register("f07_lite_index", "SELECT id, doc, page FROM norms_table")
def _(t):
    index = t.norms_table.select("id", "doc", "page", F.lit("x").alias("norm_list"), F.lit("y").alias("code_index"), F.lit("z").alias("search_text"))
    return N.lite(index)


@register("f09_blank_nulls", """
SELECT id, table_id, norms_code, cost_item, coalesce(cost_item_unit, '') AS cost_item_unit, coalesce(attr_level2, '') AS attr_level2,
       coalesce(attr_level4, '') AS attr_level4, amount FROM norms_item""")
def _(t):
    return N.blank_nulls(t.norms_item.select("id", "table_id", "norms_code", "cost_item", "cost_item_unit", "attr_level2", "attr_level4", "amount"))


@register("j11_chapter_fallback", """
WITH n AS (SELECT chap_ID, count(*) AS norms FROM spread_norm GROUP BY 1)
SELECT c.chap_ID, coalesce(n.chap_ID, p.chap_ID) AS shown_ID, coalesce(n.norms, p.norms) AS norms FROM chapter c
LEFT JOIN n ON n.chap_ID = c.chap_ID LEFT JOIN n p ON p.chap_ID = c.chap_PID WHERE coalesce(n.chap_ID, p.chap_ID) IS NOT NULL""")
def _(t):
    counts = t.spread_norm.groupBy(F.col("chap_ID").alias("shown_ID")).agg(F.count(F.lit(1)).alias("norms"))
    return N.effective_chapter(t.chapter, t.spread_norm).join(counts, "shown_ID").select("chap_ID", "shown_ID", "norms")


@register("u01_chapter_listing", """
SELECT chap_ID, norm_Code AS code, norm_Name AS name, round(norm_OtherPrice, 4) AS amount FROM norm
UNION ALL SELECT chap_ID, code, name, 0.0::DOUBLE FROM enterprise_item""")
def _(t):
    return N.listing(t.norm, t.enterprise_item)


DETAIL = LINES + """, detail AS (
SELECT n.chap_ID, 0 AS part, n.norm_ID AS ord, n.norm_Code AS code, 0 AS kind, 0 AS sub, n.norm_Name AS cost_item, '' AS unit,
  round(coalesce(man, 0) + coalesce(mat, 0) + coalesce(mach, 0) + norm_OtherPrice, 4) AS amount, NULL::DOUBLE AS unit_price, '' AS label, false AS unpriced
FROM norm n LEFT JOIN cost ON cost.norm_ID = n.norm_ID
UNION ALL SELECT chap_ID, 0, norm_ID, norm_Code, 1, 0, concat(cons_Name, ' ', cons_Standard), cons_Units, round(cont_Amount, 6),
  CASE WHEN price <> 0 THEN round(price, 4) END, """ + L.sql_case("cons_Style", L.CLASSES) + """, price IS NULL FROM priced_line
""" + "".join(f"""UNION ALL SELECT n.chap_ID, 0, n.norm_ID, n.norm_Code, 2, {i}, '{name}', '元', {c}, NULL, '', false
FROM norm n JOIN cost ON cost.norm_ID = n.norm_ID WHERE {c} <> 0
""" for i, (name, c) in enumerate((("人工费", "man"), ("材料费", "mat"), ("机械费", "mach")))) + "".join(
    f"""UNION ALL SELECT chap_ID, 1, 0, code, 3, {i}, {c}, {"unit" if i == 0 else "''"}, 0, NULL, '{lb}', false FROM enterprise_item WHERE {i} = 0 OR {c} <> ''
""" for i, (c, lb) in enumerate((("name", ""), ("item_feature", "项目特征"), ("work_content", "工作内容"), ("calc_rule", "计算规则")))) + ")"
ORDER = "part, ord, code, kind, sub, cost_item, unit, amount, unit_price NULLS FIRST, label, unpriced"


def detail(t):
    own = lines(t).drop("vol")
    return N.detail_rows(t.norm.withColumn("norm_SortID", F.col("norm_ID")), own, N.line_costs(own), t.enterprise_item)


def detail_sizes(t):
    return N.detail_sizes(t.norm, t.content, t.enterprise_item)


@register("u02_detail_rows", DETAIL + " SELECT * FROM detail")
def _(t):
    return detail(t)


@register("w07_running_sort_order", DETAIL + f"""
SELECT chap_ID, code, kind, cost_item, amount, row_number() OVER (PARTITION BY chap_ID ORDER BY {ORDER}) AS sort_order FROM detail""")
def _(t):
    return N.sort_rows(detail(t), detail_sizes(t)).select("chap_ID", "code", "kind", "cost_item", "amount", "sort_order")


@register("e09_items", DETAIL + f"""
SELECT *, row_number() OVER (PARTITION BY chap_ID ORDER BY {ORDER}) AS sort_order FROM detail
WHERE chap_ID IN (SELECT chap_ID FROM chapter WHERE chap_code LIKE '02.%')""")
def _(t):
    wanted = t.chapter.filter(F.col("chap_code").startswith("02.")).select("chap_ID")
    return N.sort_rows(detail(t).join(wanted, "chap_ID", "left_semi"), detail_sizes(t).join(wanted, "chap_ID", "left_semi"))


@register("x01_join_spec", "SELECT vol, cons_ID, concat(trim(cons_Name), ' ', trim(cons_Standard)) AS shown FROM consumption")
def _(t):
    return t.consumption.select("vol", "cons_ID", X.join_spec(F.col("cons_Name"), F.col("cons_Standard")).alias("shown"))


@register("x37_shown_price", "SELECT res_ID, pack, CAST(price_date AS STRING) AS price_date, CASE WHEN price <> 0 THEN round(price, 4) END AS price, tier FROM resource_price")
def _(t):
    return _latest(t.resource_price.withColumn("price", N.shown_price(F.col("price"))))


MAPPED = """(SELECT DISTINCT regexp_extract(code, '^[A-Z]\\.(\\d{2}\\.\\d{2})', 1) AS prefix FROM nrm_item WHERE regexp_matches(code, '^[A-Z]\\.\\d{2}\\.\\d{2}'))"""


@register("j10_nrm_prefix_join", f"SELECT m.prefix, c.chap_ID FROM {MAPPED} m JOIN chapter c ON c.chap_code LIKE concat(m.prefix, '.%')")
def _(t):
    return N.nrm_mapped(t.nrm_item, t.chapter)


@register("x05_nrm_prefix", "SELECT item_no, nullif(regexp_extract(code, '^[A-Z]\\.(\\d{2}\\.\\d{2})', 1), '') AS prefix FROM nrm_item")
def _(t):
    return t.nrm_item.select("item_no", X.nrm_prefix(F.col("code")).alias("prefix"))


@register("a17_nrm_sections", f"""
WITH k AS (SELECT m.prefix, count(*) AS norm_count FROM {MAPPED} m JOIN chapter c ON c.chap_code LIKE concat(m.prefix, '.%')
  JOIN norm n ON n.chap_ID = c.chap_ID GROUP BY 1)
SELECT min(i.code) OVER (PARTITION BY nrm_section_title) AS first_code, nrm_section_title, i.code, i.name, coalesce(norm_count, 0) AS norm_count
FROM nrm_item i LEFT JOIN k ON k.prefix = nullif(regexp_extract(i.code, '^[A-Z]\\.(\\d{{2}}\\.\\d{{2}})', 1), '')""")
def _(t):
    return N.nrm_sections(t.nrm_item, t.chapter, t.norm)


@register("e11_nrm_items", DETAIL + f"""
SELECT m.prefix, d.* FROM {MAPPED} m JOIN chapter c ON c.chap_code LIKE concat(m.prefix, '.%') JOIN detail d ON d.chap_ID = c.chap_ID""")
def _(t):
    return detail(t).join(N.nrm_mapped(t.nrm_item, t.chapter), "chap_ID")


BOOKS = ("A", "B", "C")


def books(t):
    chapters, norms, nrm = [], [], []
    for i, doc in enumerate(BOOKS):
        chapters.append(t.chapter.withColumn("doc", F.lit(doc)))
        norms.append(t.spread_norm.filter(F.col("norm_ID") % 3 == i).select(F.lit(doc).alias("doc"), "chap_ID"))
        nrm.append(t.nrm_item.filter(F.col("code").startswith(doc)).withColumn("doc", F.lit(doc)))
    union = lambda frames: frames[0].unionByName(frames[1]).unionByName(frames[2])
    return union(nrm), union(chapters), union(norms)


CROSS = """
WITH held AS (SELECT substr('ABC', CAST(1 + norm_ID % 3 AS INT), 1) AS doc, chap_ID, count(*) AS norms FROM spread_norm GROUP BY 1, 2),
ref AS (SELECT DISTINCT substr(code, 1, 1) AS doc, regexp_extract(code, '^[A-Z]\\.(\\d{2}\\.\\d{2})', 1) AS prefix FROM nrm_item WHERE code <> 'none'),
leaf AS (SELECT r.doc, r.prefix, c.chap_ID FROM ref r JOIN chapter c ON c.chap_code LIKE concat(r.prefix, '.%')
  JOIN held h ON h.doc = r.doc AND h.chap_ID = c.chap_ID),
shown AS (SELECT DISTINCT l.doc, l.prefix, cl.ancestor AS chap_ID FROM leaf l JOIN closure cl ON cl.node = l.chap_ID)
, tree AS (SELECT s.prefix, s.doc, s.chap_ID, c.chap_Name, c.chap_code, coalesce(h.norms, 0) AS row_count FROM shown s JOIN chapter c ON c.chap_ID = s.chap_ID
LEFT JOIN held h ON h.doc = s.doc AND h.chap_ID = s.chap_ID WHERE c.chap_PID <> 0 AND length(c.chap_code) - length(replace(c.chap_code, '.', '')) >= 2)
"""


@register("j27_cross_book_tree", CROSS + "SELECT * FROM tree")
def _(t):
    return N.cross_book_tree(*books(t))


@register("e12_cross_book_index", CROSS + """
SELECT prefix, doc, count(*) AS leaves, CAST(sum(row_count) AS BIGINT) AS norms, min(chap_code) AS first_code FROM tree GROUP BY 1, 2""")
def _(t):
    return N.cross_book_tree(*books(t)).groupBy("prefix", "doc").agg(
        F.count(F.lit(1)).alias("leaves"), F.sum("row_count").alias("norms"), F.min("chap_code").alias("first_code"))


@register("j26_section_chapter", "SELECT s.section_id, s.section_title, s.section_no, s.chapter_id, c.chapter_name FROM section s JOIN book_chapter c ON c.chapter_id = s.chapter_id")
def _(t):
    return N.sections_with_chapters(t.section, t.book_chapter).select("section_id", "section_title", "section_no", "chapter_id", "chapter_name")


SECTION_TABLES = """WITH s AS (SELECT section_id, subitem_title, count(*) AS row_count, min_by(page, id) AS page, min(id) AS first_id FROM quota_item GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY first_id) - 1 AS position, count(*) OVER (PARTITION BY section_id) AS subitems,
  CAST(sum(row_count) OVER (PARTITION BY section_id) AS BIGINT) AS section_rows FROM s)
"""


@register("a20_section_rows", SECTION_TABLES + "SELECT section_id, subitem_title, row_count, page, section_rows, subitems FROM p")
def _(t):
    return N.section_tables(t.quota_item).select("section_id", "subitem_title", "row_count", "page", "section_rows", "subitems")


@register("w08_synthetic_table_id", SECTION_TABLES + """
SELECT section_id, subitem_title, position, CASE WHEN subitems > 1 THEN section_id * 1000 + position ELSE section_id END AS table_id FROM p""")
def _(t):
    return N.section_tables(t.quota_item).select("section_id", "subitem_title", "position", "table_id")


@register("e08_chapter_index", f"""
WITH d AS ({DIRECT}), s AS ({SUBTREE})
SELECT c.chap_ID, c.chap_PID, c.chap_Name, length(c.chap_code) - length(replace(c.chap_code, '.', '')) + 1 AS level, s.badge,
       row_number() OVER (ORDER BY c.chap_code, c.chap_ID) - 1 AS sort_order FROM chapter c JOIN s ON s.chap_ID = c.chap_ID""")
def _(t):
    counts = H.subtree_counts(t.chapter, H.direct_counts(t.spread_norm, t.enterprise_item)).select("chap_ID", "badge")
    order = [F.col("chap_code"), F.col("chap_ID")]
    ranked = numbered(t.chapter.join(counts, "chap_ID"), order, "no")
    return ranked.select("chap_ID", "chap_PID", "chap_Name", H.code_level(F.col("chap_code")).cast("long").alias("level"), "badge",
                         (F.col("no") - 1).alias("sort_order"))


@register("e08_page_book_index", FILLED.replace("SELECT *, regexp_replace", "SELECT id, doc, page, section_title, chapter_title, regexp_replace"))
def _(t):
    return filled(t).select("id", "doc", "page", "section_title", "chapter_title", "subsection_clean")


@register("e08_section_book_index", SECTION_TABLES + """
SELECT b.chapter_name, s.section_title, p.subitem_title, p.row_count, p.page,
       CASE WHEN subitems > 1 THEN p.section_id * 1000 + position ELSE p.section_id END AS table_id
FROM p JOIN section s ON s.section_id = p.section_id JOIN book_chapter b ON b.chapter_id = s.chapter_id""")
def _(t):
    tables = N.section_tables(t.quota_item)
    return tables.join(N.sections_with_chapters(t.section, t.book_chapter), "section_id").select(
        "chapter_name", "section_title", "subitem_title", "row_count", "page", "table_id")


@register("e15_norm_search_list", """
SELECT norm_Code AS code, norm_Name AS name, chap_ID FROM norm UNION ALL SELECT code, name, chap_ID FROM enterprise_item""")
def _(t):
    return N.listing(t.norm, t.enterprise_item).select("code", "name", "chap_ID")


NOTES = """CASE WHEN t.header_json LIKE '{broken%' THEN '' ELSE concat('see &lt;', CAST(t.chapter_id - 1000 AS STRING), '&gt;<br>x &amp; y') END"""


@register("j30_page_notes", f"SELECT p.doc, p.page, {NOTES} AS notes FROM page_index p JOIN norms_table t ON t.id = p.table_id")
def _(t):
    header = t.norms_table.select(F.col("id").alias("table_id"), "header_json")
    return t.page_index.join(header, "table_id").select("doc", "page", X.note_text(F.col("header_json")).alias("notes"))


@register("x33_header_fields", """
SELECT id, CASE WHEN header_json LIKE '{broken%' THEN NULL ELSE 'a' END AS attr_columns, CASE WHEN header_json LIKE '{broken%' THEN NULL ELSE 'k1,k2' END AS cost_composition,
  CASE WHEN header_json LIKE '{broken%' THEN NULL ELSE 'u1' END AS consumption FROM norms_table""")
def _(t):
    h = X.header_fields(F.col("header_json"))
    joined = lambda c: F.array_join(h[c], ",").alias(c)
    return t.norms_table.select("id", joined("attr_columns"), joined("cost_composition"), joined("consumption"))


@register("e16_page_text_header_notes", f"""
SELECT p.doc, p.page, p.page_type, p.table_id, t.section_title, {NOTES} AS notes FROM page_index p LEFT JOIN norms_table t ON t.id = p.table_id""")
def _(t):
    header = t.norms_table.select(F.col("id").alias("table_id"), "header_json", "section_title")
    return t.page_index.join(header, "table_id", "left").select(
        "doc", "page", "page_type", "table_id", "section_title", X.note_text(F.col("header_json")).alias("notes"))


MIX = f"""
WITH mp AS (SELECT src_Name, max_by(struct_pack(price := p.price, f := a.unit_factor, u := a.src_Unit), a.res_ID) AS s FROM mix_alias a
  JOIN resource r ON r.res_ID = a.res_ID LEFT JOIN (SELECT * FROM latest_row WHERE pack = '{PACK}') p ON p.res_ID = a.res_ID GROUP BY 1),
mix AS (SELECT i.*, s.price * s.f * CASE WHEN s.u = 't' AND coalesce(cost_item_unit, '') = 'kg' THEN CAST(0.001 AS DOUBLE)
  WHEN s.u = 'kg' AND coalesce(cost_item_unit, '') = 't' THEN CAST(1000 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS unit_price
  FROM norms_item i LEFT JOIN mp ON mp.src_Name = i.cost_item)
"""


def mix(t):
    prices = R.latest_price_row(t.resource_price).filter(F.col("pack") == PACK)
    return N.mix_lines(t.norms_item, N.mix_prices(t.mix_alias, t.resource, prices, "B"))


@register("j20_mix_price_join", MIX + "SELECT table_id, norms_code, id, sort_order, cost_item, unit_price FROM mix")
def _(t):
    return mix(t).select("table_id", "norms_code", "id", "sort_order", "cost_item", "unit_price")


WORTH = "CAST(coalesce(amount, 0) AS DECIMAL(12,4)) * CAST(unit_price AS DECIMAL(20,8))"
RATES = f"""SELECT table_id, norms_code, CAST(round(coalesce(sum({WORTH}), 0), 2) AS DOUBLE) AS rate,
 CAST(round(coalesce(sum(CASE WHEN cost_item_unit = '工日' THEN {WORTH} END), 0), 2) AS DOUBLE) AS labour,
 CAST(round(coalesce(sum(CASE WHEN cost_item_unit IS NULL OR cost_item_unit NOT IN ('工日', '台班') THEN {WORTH} END), 0), 2) AS DOUBLE) AS materials,
 CAST(round(coalesce(sum(CASE WHEN cost_item_unit = '台班' THEN {WORTH} END), 0), 2) AS DOUBLE) AS mech FROM mix GROUP BY 1, 2"""


@register("a14_mix_rate", MIX + RATES)
def _(t):
    return N.mix_rates(mix(t))


@register("o04_mix_item_order", """
SELECT table_id, norms_code, id, row_number() OVER (PARTITION BY table_id, norms_code ORDER BY
  CASE WHEN cost_item = '基价' THEN 3 WHEN cost_item_unit = '工日' THEN 0 WHEN cost_item_unit = '台班' THEN 2 ELSE 1 END, sort_order, id) AS no FROM norms_item""")
def _(t):
    order = N.mix_order()
    return numbered(t.norms_item, order, "no", ["table_id", "norms_code"]).select("table_id", "norms_code", "id", "no")


SPEC2 = "CASE WHEN a.attr_level2 IS NOT NULL THEN concat(' ', a.attr_level2, 'mm') ELSE '' END"


@register("x39_mix_name", f"""
WITH a AS (SELECT * FROM norms_item QUALIFY row_number() OVER (PARTITION BY table_id, norms_code ORDER BY sort_order, id) = 1)
SELECT a.table_id, a.norms_code, concat(t.subsection_title, ' ', a.attr_level1, {SPEC2}, ' 抗压', a.attr_level3, 'MPa',
  CASE WHEN a.attr_level4 IS NOT NULL THEN concat(' ', a.attr_level4) ELSE '' END) AS cost_item
FROM a JOIN norms_table t ON t.id = a.table_id""")
def _(t):
    return N.mix_names(t.norms_table, t.norms_item)


@register("x02_mix_spec", """
SELECT id, sort_order, table_id, coalesce(attr_level2 || 'mm', '') AS size, concat('抗压', attr_level3, 'MPa') AS strength, attr_level1 AS grade FROM norms_item""")
def _(t):
    s = lambda i: X.mix_spec(F.col(f"attr{i}_label"), F.col(f"attr_level{i}"))
    return t.norms_item.select("id", "sort_order", "table_id", s(2).alias("size"), s(3).alias("strength"), s(1).alias("grade"))


@register("x03_unit_bridge", """
SELECT c.vol, c.cons_ID, CASE WHEN cons_Units = 't' AND cons_ID % 2 = 0 THEN CAST(0.001 AS DOUBLE) WHEN cons_Units = 'kg' AND cons_ID % 2 = 1 THEN CAST(1000 AS DOUBLE)
  ELSE CAST(1 AS DOUBLE) END AS bridge FROM consumption c""")
def _(t):
    to = F.when(F.col("cons_ID") % 2 == 0, "kg").otherwise("t")
    return t.consumption.select("vol", "cons_ID", X.unit_bridge(F.col("cons_Units"), to).alias("bridge"))


@register("e10_mix_items", MIX + f", rates AS ({RATES})" + """
SELECT table_id, norms_code, 0 AS kind, '' AS cost_item, rate AS amount FROM rates
UNION ALL SELECT table_id, norms_code, 1, '人工费', labour FROM rates UNION ALL SELECT table_id, norms_code, 1, '材料费', materials FROM rates
UNION ALL SELECT table_id, norms_code, 1, '机械费', mech FROM rates
UNION ALL SELECT table_id, norms_code, 2, cost_item, amount FROM mix""")
def _(t):
    rows = mix(t)
    sums = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("cost_item"), F.col(c).alias("amount"))
                     for k, n, c in ((0, "", "rate"), (1, "人工费", "labour"), (1, "材料费", "materials"), (1, "机械费", "mech"))])
    heads = N.mix_rates(rows).select("table_id", "norms_code", F.explode(sums).alias("x")).select("table_id", "norms_code", "x.*")
    return heads.unionByName(rows.select("table_id", "norms_code", F.lit(2).alias("kind"), "cost_item", "amount"))
