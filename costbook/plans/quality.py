"""Data-quality checks, acceptance tables and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from costbook.functions import names as A
from costbook.operators import boq as B
from costbook.operators import export as E
from costbook.operators import hierarchy as H
from costbook.operators import norms as N
from costbook.operators import quality as Q
from costbook.operators.ordered import numbered
from costbook.plans.books import source_chapters, source_norms
from costbook.plans.registry import register
from costbook.plans.tree import REPARENTED, WBS
from costbook.session import scratch_path
from costbook.sources import pages as S
from costbook.sources.bindings import define_view

P8 = "CAST(FLOOR(l_orderkey / 8) AS BIGINT)"
define_view("qc_item", f"""
SELECT {P8} AS page, CASE l_partkey % 29 WHEN 0 THEN '' WHEN 1 THEN '工日' WHEN 2 THEN 'm³' WHEN 3 THEN NULL ELSE p_name END AS cost_item,
  CASE WHEN l_suppkey % 37 = 0 THEN '' ELSE CAST(10000 + {P8} % 9000 * 10 + l_linenumber AS STRING) END AS code, CASE WHEN l_discount < 0.03 THEN NULL ELSE l_quantity END AS amount
FROM lineitem JOIN part ON p_partkey = l_partkey""")
define_view("qc_code", f"""
SELECT DISTINCT {P8} AS page, CASE WHEN l_linenumber = 7 THEN 'bad' ELSE CAST(10000 + {P8} % 9000 * 10 + l_linenumber AS STRING) END AS code FROM lineitem WHERE {P8} % 11 <> 0 AND l_linenumber % 5 <> 1""")
define_view("qc_dim", """
SELECT CAST(FLOOR(o_orderkey / 16) AS BIGINT) AS page, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END AS name,
  split(CASE WHEN o_custkey % 3 = 0 THEN 'a,a,a,a' WHEN o_custkey % 3 = 1 THEN 'a,b,,c,d' ELSE concat(o_orderstatus, ',x,y') END, ',') AS vals FROM orders WHERE o_orderkey % 3 = 0""")
define_view("qc_page", """
SELECT o_orderkey AS page, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE o_orderpriority END AS subsection,
  CASE o_custkey % 5 WHEN 0 THEN '(1)挖；(3)运；' WHEN 1 THEN '（1）a（2）b' WHEN 2 THEN '' WHEN 3 THEN '(2)x (5)y' ELSE 'text; ' END AS work_content FROM orders""")

ISSUE = "SELECT '{level}' AS level, '{check}' AS check, CAST(page AS STRING) AS key, {message} AS message"
WORDS = ", ".join(f"'{w}'" for w in Q.UNIT_WORDS)
Q01 = f"""SELECT CASE WHEN c = '' THEN 'ERROR' ELSE 'FATAL' END AS level, 'cost_items' AS "check", CAST(page AS STRING) AS key,
  CASE WHEN c = '' THEN concat('unnamed: ', n) ELSE concat('unit word ', c, ': ', n) END AS message
FROM (SELECT page, coalesce(cost_item, '') AS c, count(*) AS n FROM qc_item GROUP BY 1, 2) WHERE c = '' OR c IN ({WORDS})"""


@register("q01_cost_items", Q01)
def _(t):
    return Q.check_cost_items(t.qc_item)


@register("q02_attribute_dimensions", """
WITH n AS (SELECT page, count(*) AS codes FROM qc_code GROUP BY 1), d AS (SELECT q.*, coalesce(n.codes, 0) AS codes, list_distinct(list_filter(vals, lambda v: v <> '')) AS f FROM qc_dim q LEFT JOIN n ON n.page = q.page)
SELECT 'FATAL' AS level, 'attr_dimensions' AS "check", CAST(page AS STRING) AS key, concat(name, ': ', len(vals), ' values for ', codes, ' codes') AS message FROM d WHERE len(vals) <> codes
UNION ALL SELECT 'WARN', 'attr_dimensions', CAST(page AS STRING), concat(name, ': constant ', f[1]) FROM d WHERE len(f) = 1 AND len(vals) > 1
UNION ALL SELECT 'ERROR', 'attr_dimensions', CAST(page AS STRING), 'unnamed dimension' FROM d WHERE name = ''
UNION ALL SELECT 'WARN', 'attr_dimensions', CAST(page AS STRING), concat(codes, ' codes without dimension') FROM n WHERE codes > 1 AND page NOT IN (SELECT page FROM qc_dim)""")
def _(t):
    return Q.check_dimensions(t.qc_dim, t.qc_code)


Q03 = """SELECT 'ERROR' AS level, 'work_content' AS "check", CAST(page AS STRING) AS key, CASE work_content WHEN '(1)挖；(3)运；' THEN 'missing 2' ELSE 'missing 1,3,4' END AS message
FROM qc_page WHERE work_content IN ('(1)挖；(3)运；', '(2)x (5)y') UNION ALL SELECT 'WARN', 'work_content', CAST(page AS STRING), 'ends with a semicolon' FROM qc_page WHERE regexp_matches(rtrim(work_content), '[；;]$')"""


@register("q03_work_content", Q03)
def _(t):
    return Q.check_work_content(t.qc_page)


@register("q04_norm_codes", """
WITH u AS (SELECT DISTINCT page, code FROM qc_item WHERE code <> '' AND page IN (SELECT page FROM qc_code))
SELECT 'FATAL' AS level, 'norms_codes' AS "check", CAST(page AS STRING) AS key, 'items without codes' AS message FROM (SELECT DISTINCT page FROM qc_item) WHERE page NOT IN (SELECT page FROM qc_code)
UNION ALL SELECT 'WARN', 'norms_codes', CAST(page AS STRING), concat('not five digits: ', code) FROM qc_code WHERE NOT regexp_full_match(code, '\\d{5}')
UNION ALL SELECT 'ERROR', 'norms_codes', CAST(page AS STRING), concat('unused ', code) FROM qc_code q WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.page = q.page AND u.code = q.code)
UNION ALL SELECT 'WARN', 'norms_codes', CAST(page AS STRING), concat('undeclared ', code) FROM u WHERE NOT EXISTS (SELECT 1 FROM qc_code q WHERE u.page = q.page AND u.code = q.code)""")
def _(t):
    return Q.check_codes(t.qc_code, t.qc_item)


@register("u04_code_differences", """
SELECT page, code, 'unused' AS side FROM (SELECT page, code FROM qc_code EXCEPT SELECT page, code FROM qc_item)
UNION ALL SELECT page, code, 'undeclared' FROM (SELECT page, code FROM qc_item EXCEPT SELECT page, code FROM qc_code)""")
def _(t):
    return Q.code_differences(t.qc_code, t.qc_item, ["page", "code"])


@register("q05_item_counts", """
WITH i AS (SELECT page, cost_item, count(*) AS n, count(amount) AS f FROM qc_item GROUP BY 1, 2), p AS (SELECT page, CAST(sum(n) AS BIGINT) AS a, count(*) AS k FROM i GROUP BY 1),
e AS (SELECT p.page, a, k * c.n AS x FROM p JOIN (SELECT page, count(*) AS n FROM qc_code GROUP BY 1) c ON c.page = p.page)
SELECT 'ERROR' AS level, 'item_counts' AS "check", CAST(page AS STRING) AS key, concat(a, ' of ', x) AS message FROM e WHERE a <> x
UNION ALL SELECT 'WARN', 'item_counts', CAST(page AS STRING), concat('no amount: ', coalesce(cost_item, ''), ' x ', n) FROM i WHERE f = 0""")
def _(t):
    return Q.check_counts(t.qc_code, t.qc_item)


@register("q06_empty_subsection", """SELECT 'WARN' AS level, 'subsection' AS "check", CAST(page AS STRING) AS key, 'empty subsection' AS message FROM qc_page WHERE subsection = ''""")
def _(t):
    return Q.check_subsection(t.qc_page)


@register("q00_report", f"""SELECT level, count(*) AS issues FROM ({Q01} UNION ALL {Q03}) GROUP BY 1""")
def _(t):
    return Q.report(Q.check_cost_items(t.qc_item).unionByName(Q.check_work_content(t.qc_page)))


define_view("md_code", """
SELECT l_suppkey AS page, CAST(l_suppkey * 10000 + l_partkey % 701 AS STRING) AS code, CASE WHEN l_linenumber = 1 THEN '基价' ELSE '人工' END AS cost_item FROM lineitem""")
define_view("md_front", """
SELECT s_suppkey AS page, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS chapter, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 's' END AS section, CASE WHEN s_suppkey % 5 = 0 THEN 'toc' ELSE 'norms_table' END AS type,
       s_suppkey * 7 % 100 AS continued_from FROM supplier UNION ALL SELECT s_suppkey + 1000000000, 'c', 's', 'norms_table', 0 FROM supplier""")
CODE_GAPS = """SELECT page, unnest(generate_series(b + 1, code - 1)) AS missing FROM (SELECT page, code, lag(code) OVER (PARTITION BY page ORDER BY code) AS b FROM (SELECT DISTINCT page, CAST(code AS BIGINT) AS code FROM md_code)) WHERE code - b > 1"""


@register("w19_code_continuity", CODE_GAPS)
def _(t):
    return Q.code_gaps(t.md_code, ["page"])


@register("o08_codes_as_numbers", "SELECT page, code, row_number() OVER (PARTITION BY page ORDER BY CAST(code AS BIGINT)) AS no FROM (SELECT DISTINCT page, code FROM md_code)")
def _(t):
    number = F.col("code").cast("long")
    return numbered(t.md_code.select("page", "code").distinct(), [number], "no", ["page"])


@register("q07_markdown_pages", f"""
WITH pr AS (SELECT page, code, bool_or(cost_item = '基价') AS b FROM md_code GROUP BY 1, 2)
SELECT 'WARN' AS level, 'front' AS "check", CAST(page AS STRING) AS key, 'missing chapter' AS message FROM md_front WHERE chapter = ''
UNION ALL SELECT 'WARN', 'front', CAST(page AS STRING), 'missing section' FROM md_front WHERE section IS NULL UNION ALL SELECT 'WARN', 'front', CAST(page AS STRING), concat('type ', type) FROM md_front WHERE type <> 'norms_table'
UNION ALL SELECT 'ERROR', 'rows', CAST(page AS STRING), 'no data rows' FROM md_front WHERE page NOT IN (SELECT page FROM md_code)
UNION ALL SELECT 'WARN', 'continuity', CAST(page AS STRING), concat('missing code ', missing) FROM ({CODE_GAPS})
UNION ALL SELECT 'WARN', 'base_price', CAST(page AS STRING), concat('no base price: ', code) FROM pr WHERE NOT b AND page NOT IN (SELECT continued_from FROM md_front)""")
def _(t):
    return Q.check_pages(t.md_front, t.md_code, t.md_front.select(F.col("continued_from").alias("page")))


def one(df, value=None):
    return df.agg((F.count(F.lit(1)) if value is None else value).alias("actual"))


@register("q08_skeleton_acceptance", """
WITH c AS (SELECT chap_ID, chap_code FROM chapter), r AS (
SELECT 'chapters' AS "check", count(*) * 2 AS actual, 60 AS expected FROM c UNION ALL SELECT 'norms', count(*), 15000 FROM norm
UNION ALL SELECT 'null discipline', 2 * count(*) - count(*) FILTER (substr(chap_code, 1, 2) IN ('01', '02')) - 2 * count(*) FILTER (substr(chap_code, 1, 2) = '03'), 0 FROM c
UNION ALL SELECT 'orphans', count(*), 0 FROM chapter WHERE chap_PID <> 0 AND chap_PID NOT IN (SELECT chap_ID FROM chapter)
UNION ALL SELECT 'sample name', count(*), 1 FROM chapter WHERE chap_ID = 1 AND chap_Name = 'AFRICA' UNION ALL SELECT 'view', count(*), NULL FROM norm WHERE vol = 'A')
SELECT "check", CAST(actual AS BIGINT) AS actual, CAST(expected AS BIGINT) AS expected, CASE WHEN expected IS NULL THEN actual > 0 ELSE actual = expected END AS passed FROM r""")
def _(t):
    chapters = source_chapters(t)
    actuals = {
        "chapters": one(chapters), "norms": one(source_norms(t)), "null discipline": one(chapters, F.count_if(F.col("discipline").isNull())),
        "orphans": one(H.orphans(t.chapter.filter("chap_PID <> 0").unionByName(t.chapter.filter("chap_PID = 0").withColumn("chap_PID", F.lit(None).cast("long"))), "chap_ID", "chap_PID")),
        "sample name": one(t.chapter, F.count_if((F.col("chap_ID") == 1) & (F.col("chap_Name") == "AFRICA"))), "view": one(t.norm.filter("vol = 'A'"))}
    return Q.acceptance(actuals, {"chapters": 60, "norms": 15000, "null discipline": 0, "orphans": 0, "sample name": 1})


@register("q09_import_acceptance", """
WITH l AS (SELECT CASE WHEN regexp_full_match(A, '[A-Z]') THEN 1 WHEN regexp_full_match(A, '[A-Z]\\.[a-z]') THEN 2 WHEN regexp_full_match(A, '[A-Z]\\.[a-z]\\.\\d+') THEN 3 END AS lv FROM boq_grid WHERE row_no > 2),
r AS (SELECT 'sections' AS "check", count(*) FILTER (lv = 1) AS actual, 10 AS expected FROM l UNION ALL SELECT 'subsections', count(*) FILTER (lv = 2), 100 FROM l
UNION ALL SELECT 'implicit groups', count(DISTINCT book || group_code), NULL FROM boq_item WHERE group_code LIKE '%.02' UNION ALL SELECT 'items', count(*), NULL FROM boq_item
UNION ALL SELECT 'with rate', count(rate), NULL FROM boq_item UNION ALL SELECT 'definitions', count(*), NULL FROM boq_def)
SELECT "check", actual, CAST(expected AS BIGINT) AS expected, CASE WHEN expected IS NULL THEN actual > 0 ELSE actual = expected END AS passed FROM r""")
def _(t):
    tree, items = B.tree(t.boq_grid), B.items(t.boq_grid)
    actuals = {"sections": one(tree, F.count_if(F.col("level") == 1)), "subsections": one(tree, F.count_if(F.col("level") == 2)),
               "implicit groups": one(tree, F.count_if("implicit")), "items": one(items), "with rate": one(items, F.count("rate")),
               "definitions": one(B.resource_definitions(t.boq_grid))}
    return Q.acceptance(actuals, {"sections": 10, "subsections": 100})


@register("q11_merge_audit", f"""
WITH m AS ({REPARENTED}), n AS (SELECT CASE WHEN source_lib LIKE '%2012%' AND code NOT LIKE 'BJ12.%' THEN concat('BJ12.', code) WHEN source_lib LIKE '%2021%' AND code NOT LIKE 'BJ21.%' THEN concat('BJ21.', code) ELSE code END AS code FROM norm_source)
SELECT 'roots' AS "check", count(*) AS actual FROM m WHERE chap_PID = 0 UNION ALL SELECT 'chapters', count(*) FROM m UNION ALL SELECT 'dangling', count(*) FROM m WHERE chap_PID <> 0 AND chap_PID NOT IN (SELECT chap_ID FROM m)
UNION ALL SELECT 'BJ12', count(*) FROM n WHERE code LIKE 'BJ12.%' UNION ALL SELECT 'BJ21', count(*) FROM n WHERE code LIKE 'BJ21.%' UNION ALL SELECT 'norms', count(*) FROM n""")
def _(t):
    merged = H.reparent(t.chapter, t.chapter_move, t.retired_root)
    dangling = merged.filter("chap_PID <> 0").join(merged.select(F.col("chap_ID").alias("chap_PID")), "chap_PID", "left_anti")
    codes = t.norm_source.select(A.source_prefix(F.col("code"), F.col("source_lib")).alias("code"))
    marked = lambda p: one(codes, F.count_if(F.col("code").startswith(p)))
    rows = Q.acceptance({"roots": one(merged.filter("chap_PID = 0")), "chapters": one(merged), "dangling": one(dangling),
                         "BJ12": marked("BJ12."), "BJ21": marked("BJ21."), "norms": one(codes)}, {})
    return rows.select("check", "actual")


# ---- sources and sinks ------------------------------------------------------------------------------

@register("src01_read_library", "SELECT norm_ID, chap_ID, norm_Code, norm_Name FROM norm WHERE vol = 'B'")
def _(t):
    from costbook.sources.tables import read_library
    root = scratch_path(t.spark, "library")
    t.norm.withColumn("doc", F.col("vol")).write.partitionBy("doc").parquet(f"{root}/Norm")
    families = {v: ("Norm", "chapter") for v in "ABCDE"}
    return read_library(t.spark, root, "nrm_B", families)["Norm"].select("norm_ID", "chap_ID", "norm_Code", "norm_Name")


@register("snk01_item_export")
def _(t):
    items = E.item_rows(t.norms_item)
    return items.select("table_id", "sort_order", E.all_columns_json(items.drop("table_id", "sort_order", "id")).alias("value"))


@register("snk02_index_export", f"""
SELECT 'chapters' AS part, CAST(chap_ID AS VARCHAR) AS key, chap_Name AS text FROM chapter UNION ALL SELECT 'tables', CAST(id AS VARCHAR), section_title FROM norms_table
UNION ALL SELECT 'pages', concat(doc, '/', page), page_type FROM page_index UNION ALL SELECT 'code_index', norms_code, CAST(max(table_id) AS VARCHAR) FROM norms_item WHERE norms_code IS NOT NULL AND norms_code <> '' GROUP BY 2""")
def _(t):
    root = scratch_path(t.spark, "index")
    E.write_index(t.chapter, t.norms_table.drop("header_json"), t.page_index, N.code_to_table(t.norms_item), root)
    read = lambda name, schema: E.read_published(t.spark, root, name, schema)
    text = lambda c: F.col(c).cast("string")
    parts = [read("chapters", "chap_ID long, chap_Name string").select(F.lit("chapters").alias("part"), text("chap_ID").alias("key"), F.col("chap_Name").alias("text")),
             read("tables", "id long, section_title string").select(F.lit("tables"), text("id"), "section_title"),
             read("pages", "doc string, page long, page_type string").select(F.lit("pages"), F.concat_ws("/", "doc", "page"), "page_type"),
             read("code_index", "norms_code string, table_id string").select(F.lit("code_index"), "norms_code", "table_id")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@register("snk03_text_export", """
SELECT doc_id AS page, lang AS type, text AS content FROM documents WHERE coalesce(text, '') <> ''""")
def _(t):
    root = scratch_path(t.spark, "texts")
    E.write_text_pages(t.documents.select(F.col("doc_id").alias("page"), F.col("lang").alias("type"), F.col("text").alias("content")), root)
    return E.read_published(t.spark, root, "pages", "page long, type string, content string")


@register("snk04_class_tree_export")
def _(t):
    nodes = H.wbs_nodes(t.wbs_sheet).withColumn("discipline", F.substring("wbs_code", 1, 2))
    root = scratch_path(t.spark, "tree")
    E.write_class_tree(E.class_tree(nodes, ("level", "name_cn", "name_en")), root)
    return E.read_published(t.spark, root, "tree", "discipline string, wbs_code string, tree string")


@register("snk05_pool_export", """
SELECT 'bj_chapters' AS part, concat(s, '/', chap_ID) AS key, chap_Name AS text FROM chapter, (SELECT unnest(['1', '2']) AS s)
UNION ALL SELECT 'bj_norms', concat(CASE WHEN norm_ID % 2 = 0 THEN '1' ELSE '2' END, '/', norm_ID), norm_Name FROM norm
UNION ALL SELECT 'jts_chapters', concat('3/', chap_ID), chap_Name FROM chapter UNION ALL SELECT 'jts_norms_tables', concat('3/', id), section_title FROM norms_table
UNION ALL SELECT 'jts_items', concat('3/', id), cost_item FROM norms_item""")
def _(t):
    three = lambda df: df.withColumn("source_id", F.lit("3"))
    chapters = source_chapters(t).join(t.chapter.select("chap_ID", "chap_PID", "chap_Name"), "chap_ID")
    norms = t.norm.withColumn("source_id", F.when(F.col("norm_ID") % 2 == 0, "1").otherwise("2"))
    page_chapters = three(t.chapter.select(F.col("chap_ID").alias("id"), F.col("chap_PID").alias("parent_id"), H.code_level(F.col("chap_code")).alias("level"), F.col("chap_Name").alias("title")))
    frames = E.pool(chapters, norms, page_chapters, three(t.norms_table), three(t.norms_item))
    keys = {"bj_chapters": ("chap_ID", "chap_Name"), "bj_norms": ("norm_ID", "norm_Name"), "jts_chapters": ("id", "title"), "jts_norms_tables": ("id", "section_title"), "jts_items": ("id", "cost_item")}
    root = scratch_path(t.spark, "pool")
    E.write_pool(frames, root)
    out = None
    for name, (key, text) in keys.items():
        stored = E.read_published(t.spark, root, name, f"source_id string, {key} long, {text} string")
        part = stored.select(F.lit(name).alias("part"), F.concat_ws("/", "source_id", F.col(key).cast("string")).alias("key"), F.col(text).alias("text"))
        out = part if out is None else out.union(part)
    return out
