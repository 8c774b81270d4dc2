"""Chapter trees and their roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from costbook.operators import hierarchy as H
from costbook.operators.ordered import numbered
from costbook.plans.registry import register
from costbook.sources.bindings import define_view

define_view("enterprise_item", """
SELECT concat('Q', lpad(CAST(p_partkey AS STRING), 6, '0')) AS code, p_name AS name, 'm3' AS unit,
       CAST(1000 + c_custkey AS BIGINT) AS chap_ID,
       CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS item_feature,
       CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE '' END AS work_content,
       CASE WHEN p_partkey % 7 = 0 THEN 'by size' ELSE '' END AS calc_rule
FROM part JOIN customer ON c_custkey = p_partkey WHERE p_partkey % 3 = 0""")
# a tenth of the norms hang one level higher, so that some leaves are empty
define_view("spread_norm", """
SELECT norm_ID, CASE WHEN norm_ID % 10 = 0 OR chap_ID % 4 = 0 THEN chap_PID ELSE n.chap_ID END AS chap_ID,
       norm_Code, norm_Name, vol, norm_OtherPrice
FROM norm n JOIN (SELECT chap_ID AS own_ID, chap_PID FROM chapter) c ON c.own_ID = n.chap_ID""")
define_view("domain_map", """
SELECT chap_ID, chap_Name AS domain FROM chapter WHERE chap_PID = 0 OR (chap_PID < 100 AND chap_ID % 3 = 0)""")
define_view("retired_root", "SELECT chap_ID FROM chapter WHERE chap_PID = 0 AND chap_ID % 2 = 0")
define_view("chapter_move", """
SELECT chap_ID, CAST(1 AS BIGINT) AS new_PID FROM chapter WHERE chap_PID > 0 AND chap_PID < 100 AND chap_PID % 2 = 0""")
define_view("wbs_sheet", """
SELECT p_partkey AS row_no,
       CASE WHEN p_partkey % 23 = 0 THEN concat('X', CAST(p_partkey AS STRING)) ELSE
       concat(lpad(CAST(p_size % 9 + 1 AS STRING), 2, '0'),
              CASE WHEN p_partkey % 11 = 0 THEN '00' ELSE lpad(CAST(p_partkey % 5 + 1 AS STRING), 2, '0') END,
              CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 0 THEN '00' ELSE lpad(CAST(p_partkey % 6 + 1 AS STRING), 2, '0') END,
              CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 0 OR p_partkey % 3 = 0 THEN '000' ELSE lpad(CAST(p_partkey % 40 + 1 AS STRING), 3, '0') END,
              CASE WHEN p_partkey % 2 = 0 OR p_partkey % 11 = 0 OR p_partkey % 7 = 0 OR p_partkey % 3 = 0 THEN '000'
                   ELSE lpad(CAST(p_partkey % 100 + 1 AS STRING), 3, '0') END) END AS wbs_code,
       p_name AS name_cn, p_type AS name_en, p_brand AS work_content
FROM part""")

NEAR = "SELECT cl.node AS chap_ID, min_by(m.domain, cl.distance) AS domain FROM closure cl JOIN domain_map m ON m.chap_ID = cl.ancestor GROUP BY 1"
ROOTS = "(SELECT chap_ID AS root FROM chapter WHERE chap_PID = 1)"


def roots(t):
    return t.chapter.filter(F.col("chap_PID") == 1).select(F.col("chap_ID").alias("root"))


@register("h01_ancestor_chain", """
SELECT c.chap_ID, string_agg(a.chap_Name, ' > ' ORDER BY cl.distance DESC) AS path,
       string_agg(a.chap_code, '/' ORDER BY cl.distance DESC) AS codes, max_by(a.chap_Name, cl.distance) AS book
FROM chapter c JOIN closure cl ON cl.node = c.chap_ID JOIN chapter a ON a.chap_ID = cl.ancestor GROUP BY 1""")
def _(t):
    return H.chapter_paths(t.chapter).select("chap_ID", "path", F.array_join("codes", "/").alias("codes"), "book")


@register("h02_split_levels", """
SELECT c.chap_ID, max_by(a.chap_Name, cl.distance) AS chapter,
       coalesce(max(CASE WHEN depth = 2 AND distance = 1 OR depth = 1 AND distance = 0 THEN a.chap_Name END), '') AS section,
       coalesce(max(CASE WHEN depth = 2 AND distance = 0 THEN a.chap_Name END), '') AS subsection
FROM chapter c JOIN (SELECT *, max(distance) OVER (PARTITION BY node) AS depth FROM closure) cl ON cl.node = c.chap_ID
JOIN chapter a ON a.chap_ID = cl.ancestor GROUP BY 1""")
def _(t):
    return H.chapter_paths(t.chapter).select("chap_ID", *H.split_levels(F.col("names")))


@register("h03_descendants", f"SELECT r.root, cl.node AS chap_ID FROM closure cl JOIN {ROOTS} r ON r.root = cl.ancestor")
def _(t):
    return H.descendants(t.chapter, roots(t))


@register("h04_nearest_mapped_ancestor", NEAR)
def _(t):
    return H.nearest_mapped(t.chapter, t.domain_map)


LEAVES = f"""SELECT r.root, cl.node AS chap_ID FROM closure cl JOIN {ROOTS} r ON r.root = cl.ancestor
WHERE NOT EXISTS (SELECT 1 FROM chapter k WHERE k.chap_PID = cl.node)"""


@register("h05_leaves", LEAVES + " AND EXISTS (SELECT 1 FROM spread_norm n WHERE n.chap_ID = cl.node AND n.norm_ID % 3 = 0)")
def _(t):
    return H.leaves(t.chapter, roots(t), t.spread_norm.filter(F.col("norm_ID") % 3 == 0))


REPARENTED = """SELECT c.chap_ID, coalesce(m.new_PID, c.chap_PID) AS chap_PID, c.chap_Name, c.chap_code
FROM chapter c LEFT JOIN chapter_move m ON m.chap_ID = c.chap_ID WHERE c.chap_ID NOT IN (SELECT chap_ID FROM retired_root)"""


@register("h06_reparent", REPARENTED)
def _(t):
    return H.reparent(t.chapter, t.chapter_move, t.retired_root)


@register("h07_prune_empty", """
SELECT chap_ID, chap_PID FROM chapter c WHERE chap_PID = 0 OR EXISTS (
  SELECT 1 FROM closure cl JOIN spread_norm n ON n.chap_ID = cl.node WHERE cl.ancestor = c.chap_ID AND n.norm_ID % 4 = 1)""")
def _(t):
    return H.prune_empty(t.chapter, t.spread_norm.filter(F.col("norm_ID") % 4 == 1)).select("chap_ID", "chap_PID")


OFFSET = 2_600_000_000


@register("h08_copy_subtree", f"""
WITH inside AS (SELECT DISTINCT cl.node FROM closure cl JOIN {ROOTS} r ON r.root = cl.ancestor),
kept AS (SELECT * FROM norm WHERE chap_ID IN (SELECT node FROM inside))
SELECT 'chapter' AS part, chap_ID + {OFFSET} AS id, CASE WHEN chap_PID = 0 THEN 0 ELSE chap_PID + {OFFSET} END AS owner, chap_Name AS text
FROM chapter WHERE chap_ID IN (SELECT node FROM inside)
UNION ALL SELECT 'norm', norm_ID + {OFFSET}, chap_ID + {OFFSET}, norm_Code FROM kept
UNION ALL SELECT 'content', cons_ID + {OFFSET}, norm_ID + {OFFSET}, CAST(CAST(cont_Amount AS BIGINT) AS STRING) FROM content
  WHERE norm_ID IN (SELECT norm_ID FROM kept)
UNION ALL SELECT 'consumption', cons_ID + {OFFSET}, NULL, vol FROM consumption
  WHERE cons_ID IN (SELECT cons_ID FROM content WHERE norm_ID IN (SELECT norm_ID FROM kept))
UNION ALL SELECT 'lineage', k.norm_ID + {OFFSET}, k.norm_ID, concat(c3.chap_Name, ' > ', c2.chap_Name, ' > ', c1.chap_Name)
FROM kept k JOIN chapter c1 ON c1.chap_ID = k.chap_ID JOIN chapter c2 ON c2.chap_ID = c1.chap_PID
JOIN chapter c3 ON c3.chap_ID = c2.chap_PID""")
def _(t):
    made = H.copy_subtree(t.chapter, t.norm, t.content, t.consumption, roots(t), OFFSET, "book 2021")
    part = lambda name, *cols: made[name].selectExpr(f"'{name}' AS part", *cols)
    return (part("chapter", "chap_ID AS id", "chap_PID AS owner", "chap_Name AS text")
            .union(part("norm", "norm_ID", "chap_ID", "norm_Code"))
            .union(part("content", "cons_ID", "norm_ID", "cast(cast(cont_Amount as bigint) as string)"))
            .union(part("consumption", "cons_ID", "cast(null as bigint)", "vol"))
            .union(made["norm_source"].selectExpr("'lineage'", "norm_ID", "source_norm_id", "source_chap_path")))


@register("h12_code_level", """
SELECT chap_ID, length(chap_code) - length(replace(chap_code, '.', '')) + 1 AS level FROM chapter""")
def _(t):
    return t.chapter.select("chap_ID", H.code_level(F.col("chap_code")).cast("long").alias("level"))


@register("h13_override_subtree", """
WITH seed AS (SELECT chap_ID FROM chapter WHERE regexp_matches(chap_code, '^01\\.[0-9]{2}$') AND (chap_Name LIKE '%_1%' OR chap_Name LIKE '%_2%'))
SELECT c.chap_ID, CASE WHEN c.chap_ID IN (SELECT cl.node FROM closure cl JOIN seed s ON s.chap_ID = cl.ancestor) THEN '装修'
  WHEN c.chap_code LIKE '01%' THEN '房建' WHEN c.chap_code LIKE '02%' THEN '机电' WHEN c.chap_code LIKE '04%' THEN '市政' END AS discipline
FROM chapter c""")
def _(t):
    seed = F.col("chap_code").rlike(r"^01\.[0-9]{2}$") & (F.col("chap_Name").like("%_1%") | F.col("chap_Name").like("%_2%"))
    return H.override_subtree(t.chapter, {"01": "房建", "02": "机电", "04": "市政"}, seed, "装修").select("chap_ID", "discipline")


WBS = """WITH v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wbs_code ORDER BY row_no DESC) AS rn FROM wbs_sheet
  WHERE regexp_full_match(wbs_code, '[0-9]{12}')) WHERE rn = 1),
w AS (SELECT *, CASE WHEN substr(wbs_code, 10, 3) <> '000' THEN 5 WHEN substr(wbs_code, 7, 3) <> '000' THEN 4
  WHEN substr(wbs_code, 5, 2) <> '00' THEN 3 WHEN substr(wbs_code, 3, 2) <> '00' THEN 2 ELSE 1 END AS level FROM v),
x AS (SELECT *, CASE level WHEN 5 THEN concat(substr(wbs_code, 1, 9), '000') WHEN 4 THEN concat(substr(wbs_code, 1, 6), '000000')
  WHEN 3 THEN concat(substr(wbs_code, 1, 4), '00000000') WHEN 2 THEN concat(substr(wbs_code, 1, 2), '0000000000') END AS parent_code FROM w)
"""


@register("h14_wbs_level_parent", WBS + "SELECT wbs_code, row_no, level, parent_code, name_cn FROM x")
def _(t):
    return H.wbs_nodes(t.wbs_sheet).select("wbs_code", "row_no", "level", "parent_code", "name_cn")


@register("j16_orphans", WBS + """
SELECT wbs_code, parent_code FROM x WHERE parent_code IS NOT NULL AND parent_code NOT IN (SELECT wbs_code FROM x)""")
def _(t):
    return H.orphans(H.wbs_nodes(t.wbs_sheet), "wbs_code", "parent_code").select("wbs_code", "parent_code")


@register("f10_wbs_validity", """
SELECT regexp_full_match(wbs_code, '[0-9]{12}') AS valid, count(*) AS rows FROM wbs_sheet GROUP BY 1""")
def _(t):
    return t.wbs_sheet.groupBy(F.col("wbs_code").rlike("^[0-9]{12}$").alias("valid")).agg(F.count(F.lit(1)).alias("rows"))


@register("h15_norms_under_retired", """
SELECT r.chap_ID AS root, count(*) AS norms FROM retired_root r JOIN closure cl ON cl.ancestor = r.chap_ID
JOIN norm n ON n.chap_ID = cl.node GROUP BY 1""")
def _(t):
    return H.under_retired(t.chapter, t.norm, t.retired_root)


DIRECT = "SELECT chap_ID, count(*) AS direct FROM (SELECT chap_ID FROM spread_norm UNION ALL SELECT chap_ID FROM enterprise_item) GROUP BY 1"


@register("a15_direct_count", DIRECT)
def _(t):
    return H.direct_counts(t.spread_norm, t.enterprise_item)


SUBTREE = f"""SELECT c.chap_ID, c.chap_PID, coalesce(max(d.direct), 0) AS direct, CAST(coalesce(sum(b.direct), 0) AS BIGINT) AS subtree,
  CAST(CASE WHEN coalesce(sum(b.direct), 0) = 0 AND c.chap_PID <> 0 THEN coalesce(max(p.direct), 0) ELSE coalesce(sum(b.direct), 0) END AS BIGINT) AS badge
FROM chapter c LEFT JOIN d ON d.chap_ID = c.chap_ID LEFT JOIN d p ON p.chap_ID = c.chap_PID
JOIN closure cl ON cl.ancestor = c.chap_ID LEFT JOIN d b ON b.chap_ID = cl.node GROUP BY 1, 2"""


@register("a16_subtree_count", f"WITH d AS ({DIRECT}) {SUBTREE}")
def _(t):
    return H.subtree_counts(t.chapter, H.direct_counts(t.spread_norm, t.enterprise_item))


@register("a32_root_counts", """
SELECT c.chap_ID, c.chap_Name, count(n.norm_ID) AS norms FROM chapter c JOIN closure cl ON cl.ancestor = c.chap_ID
LEFT JOIN spread_norm n ON n.chap_ID = cl.node WHERE c.chap_PID = 0 GROUP BY 1, 2""")
def _(t):
    counts = H.subtree_counts(t.chapter, H.direct_counts(t.spread_norm))
    return counts.filter(F.col("chap_PID") == 0).join(t.chapter.select("chap_ID", "chap_Name"), "chap_ID").select(
        "chap_ID", "chap_Name", F.col("subtree").alias("norms"))


@register("a33_domain_has_norms", f"""
SELECT domain, bool_or(EXISTS (SELECT 1 FROM spread_norm n WHERE n.chap_ID = x.chap_ID AND n.norm_ID % 7 = 0)) AS has_norms
FROM ({NEAR}) x GROUP BY 1""")
def _(t):
    held = t.spread_norm.filter(F.col("norm_ID") % 7 == 0).select("chap_ID").distinct().withColumn("held", F.lit(True))
    return H.nearest_mapped(t.chapter, t.domain_map).join(held, "chap_ID", "left").groupBy("domain").agg(
        F.bool_or(F.coalesce("held", F.lit(False))).alias("has_norms"))


@register("o05_natural_chapter_order", """
SELECT chap_ID, chap_code, row_number() OVER (PARTITION BY chap_PID ORDER BY
  list_transform(string_split(chap_code, '.'), lambda x: CAST(x AS INT)), chap_ID) AS no FROM chapter""")
def _(t):
    order = H.natural_order(F.col("chap_code"))
    return numbered(t.chapter, [order, F.col("chap_ID")], "no", ["chap_PID"]).select("chap_ID", "chap_code", "no")
