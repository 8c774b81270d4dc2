"""Price packs, price list, coverage and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from costbook.functions import labels as L
from costbook.functions import predicates as P
from costbook.operators import coverage as C
from costbook.operators import export as E
from costbook.operators import pricing as R
from costbook.operators import provenance as V
from costbook.operators.ordered import numbered
from costbook.plans.registry import register
from costbook.session import scratch_path
from costbook.sources.bindings import Tables, define_view

PACK = "ASIA"

define_view("price_row", """
SELECT res_ID, pack, price_date, price, tier,
       CASE res_ID % 3 WHEN 0 THEN 'quote' WHEN 1 THEN 'benchmark' ELSE NULL END AS price_kind,
       CASE WHEN res_ID % 4 = 0 THEN price - 1 END AS price_excl,
       CASE pack WHEN 'AFRICA' THEN 'THB' WHEN 'AMERICA' THEN 'CNY' ELSE 'USD' END AS currency,
       price + 2 AS src_price, 'CNY' AS src_currency, CASE WHEN res_ID % 2 = 0 THEN 't' ELSE 'kg' END AS src_unit,
       CAST(0.25 AS DOUBLE) AS fx_rate, CAST(1 AS DOUBLE) AS unit_factor,
       concat('S', CAST(res_ID % 10 AS STRING)) AS supplier, 'list.csv' AS source_doc,
       concat('row ', CAST(res_ID AS STRING)) AS source
FROM resource_price""")
define_view("quote_match", """
SELECT res_ID, quote_ID, CASE WHEN quote_ID % 2 = 0 THEN 'exact' ELSE 'name' END AS match_type,
       CAST(quote_ID % 20 AS DOUBLE) / 20 AS confidence FROM price_quote""")
define_view("resource_alias", """
SELECT master_res_ID AS res_ID, vol AS src_vol,
       CASE WHEN cons_ID % 5 = 0 THEN cons_ID + 1000000000 ELSE cons_ID END AS src_cons_ID,
       cons_Name AS src_Name, CASE WHEN cons_ID % 4 = 0 THEN 'kg' WHEN cons_ID % 4 = 1 THEN 't' ELSE cons_Units END AS src_Unit,
       CAST(cons_ID % 50 AS DOUBLE) AS src_Price,
       CASE WHEN cons_ID % 7 = 0 THEN NULL ELSE CAST(1 + cons_ID % 3 AS DOUBLE) END AS unit_factor
FROM consumption WHERE master_res_ID IS NOT NULL""")
define_view("price_anchor", """
SELECT quote_ID AS anchor_ID, res_ID, CAST(quote_ID % 2 AS INT) AS use_for_price,
       CASE WHEN quote_ID % 3 = 0 THEN '' ELSE supplier END AS supplier, concat('C', CAST(quote_ID % 4 AS STRING)) AS contact,
       CASE WHEN quote_ID % 6 = 0 THEN '' ELSE CAST(quote_ID % 1000 AS STRING) END AS phone, '' AS address,
       CASE WHEN quote_ID % 5 = 0 THEN concat('P', CAST(quote_ID % 7 AS STRING)) ELSE '' END AS project,
       CAST(quote_date AS STRING) AS quote_date, price_incl - 1 AS price_excl
FROM price_quote""")
define_view("benchmark_obs", """
SELECT l_partkey AS res_ID, CASE WHEN l_suppkey % 2 = 0 THEN 'ASIA' ELSE 'EUROPE' END AS pack,
       concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS obs_ref,
       l_extendedprice AS value_cny, l_tax AS weight, l_returnflag AS source
FROM lineitem""")


def usage(t: Tables):
    return C.usage_ledger(t.consumption, V.volume_content(t.content, t.norm))


def priced(t: Tables):
    return C.with_price(usage(t), R.latest_price_row(t.price_row), PACK)


PRICED = f"""
WITH latest_priced AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY res_ID, pack ORDER BY price_date DESC) AS rn FROM price_row) WHERE rn = 1),
p AS (SELECT * FROM latest_priced WHERE pack = '{PACK}'),
u AS (SELECT u.*, p.res_ID AS price_res_ID FROM usage u LEFT JOIN p ON p.res_ID = u.res_ID)
"""
LISTED = PRICED + """, listed AS (
  SELECT u.*, r.res_Code, r.res_Name, r.res_Standard, r.res_Unit, r.res_Family, p.price, p.tier, p.price_kind, p.price_date,
         p.price_excl, p.currency, p.src_price, p.src_currency, p.src_unit, p.fx_rate, p.unit_factor, p.supplier,
         p.source_doc, p.source
  FROM u JOIN resource r ON r.res_ID = u.res_ID LEFT JOIN p ON p.res_ID = u.res_ID)
, rolled AS (
  SELECT res_ID, CAST(sum(refs) AS BIGINT) AS refs, string_agg(DISTINCT vol, ',' ORDER BY vol) AS vols,
         min(cons_Style) AS cons_Style, min(kind_Code) AS kind_Code, any_value(res_Code) AS res_Code,
         any_value(res_Name) AS res_Name, any_value(res_Standard) AS res_Standard, any_value(res_Unit) AS res_Unit,
         any_value(price) AS price, any_value(price_excl) AS price_excl, any_value(currency) AS currency,
         any_value(tier) AS tier, any_value(price_kind) AS price_kind, any_value(price_date) AS price_date,
         any_value(src_price) AS src_price, any_value(src_currency) AS src_currency, any_value(src_unit) AS src_unit,
         any_value(fx_rate) AS fx_rate, any_value(unit_factor) AS unit_factor, any_value(supplier) AS supplier,
         any_value(source_doc) AS source_doc, any_value(source) AS source
  FROM listed {where} GROUP BY res_ID)
"""
TOTALS = """CAST(count(*) AS BIGINT) AS total, CAST(count(price_res_ID) AS BIGINT) AS priced,
  CAST(coalesce(sum(refs), 0) AS BIGINT) AS refs"""
DISTINCT = """count(DISTINCT res_ID) AS total, count(DISTINCT CASE WHEN price_res_ID IS NOT NULL THEN res_ID END) AS priced"""
REFS_PRICED = "CAST(coalesce(sum(CASE WHEN price_res_ID IS NOT NULL THEN refs END), 0) AS BIGINT) AS refs_priced"
ONE_PACK = f"(SELECT * FROM latest_row WHERE pack = '{PACK}')"


def listing(t: Tables, **filters):
    return C.price_listing(usage(t), t.resource, R.latest_price_row(t.price_row), PACK, **filters)


@register("a11_usage_ledger", "SELECT * FROM usage")
def _(t):
    return usage(t)


@register("a11_usage_ledger_with_stored_price", "SELECT *, CAST(cons_ID % 400 AS DOUBLE) / CAST(4 AS DOUBLE) AS cons_Price FROM usage")
def _(t):
    stored = t.consumption.withColumn("cons_Price", (F.col("cons_ID") % 400).cast("double") / 4)
    return C.usage_ledger(stored, V.volume_content(t.content, t.norm))


@register("j01_usage_price", f"""
SELECT u.res_ID, u.vol, u.cons_ID, u.refs, p.price, p.tier, CAST(p.price_date AS STRING) AS price_date
FROM usage u LEFT JOIN {ONE_PACK} p ON p.res_ID = u.res_ID""")
def _(t):
    joined = C.with_price(usage(t), R.latest_price_row(t.resource_price), PACK)
    return joined.select("res_ID", "vol", "cons_ID", "refs", "price", "tier", F.col("price_date").cast("string").alias("price_date"))


@register("j02_usage_resource", """
SELECT u.res_ID, u.vol, u.cons_ID, u.refs, r.res_Code, r.res_Name, r.res_Unit
FROM usage u JOIN resource r ON r.res_ID = u.res_ID""")
def _(t):
    return C.with_resource(usage(t), t.resource).select("res_ID", "vol", "cons_ID", "refs", "res_Code", "res_Name", "res_Unit")


LATEST_COLUMNS = "res_ID, pack, CAST(price_date AS STRING) AS price_date, price, tier"


def _latest(df):
    return df.select("res_ID", "pack", F.col("price_date").cast("string").alias("price_date"), "price", "tier")


@register("w01_latest_price", f"SELECT {LATEST_COLUMNS} FROM latest_price")
def _(t):
    return _latest(R.latest_price(t.resource_price))


@register("w02_latest_price_row", f"SELECT {LATEST_COLUMNS} FROM latest_row")
def _(t):
    return _latest(R.latest_price_row(t.resource_price))


ANCHOR = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY res_ID ORDER BY anchor_ID) AS rn FROM price_anchor
  WHERE use_for_price = 1 AND (supplier <> '' OR address <> '' OR project <> '')) WHERE rn = 1)"""


@register("w03_first_anchor", f"SELECT res_ID, anchor_ID, supplier, project, price_excl FROM {ANCHOR}")
def _(t):
    return R.first_anchor(t.price_anchor).select("res_ID", "anchor_ID", "supplier", "project", "price_excl")


@register("w04_default_pack", """
SELECT coalesce((SELECT min(pack) FROM price_pack WHERE status = 'active'), (SELECT min(pack) FROM resource_price),
                'th_2026') AS pack""")
def _(t):
    return R.default_pack(t.price_pack, t.resource_price)


@register("a01_pack_registry", """
SELECT pack, status, currency, (SELECT count(*) FROM resource_price p WHERE p.pack = k.pack) AS priced_count
FROM price_pack k""")
def _(t):
    return C.pack_registry(t.price_pack, t.resource_price).select("pack", "status", "currency", "priced_count")


@register("e01_packs", """
SELECT pack, status, currency, (SELECT count(*) FROM resource_price p WHERE p.pack = k.pack) AS priced_count,
       pack = (SELECT min(pack) FROM price_pack WHERE status = 'active') AS is_default
FROM price_pack k""")
def _(t):
    chosen = R.default_pack(t.price_pack, t.resource_price).withColumn("chosen", F.lit(True))
    packs = C.pack_registry(t.price_pack, t.resource_price).join(chosen, "pack", "left")
    return packs.select("pack", "status", "currency", "priced_count", F.coalesce("chosen", F.lit(False)).alias("is_default"))


@register("a02_class_totals", PRICED + f"SELECT vol, cons_Style AS cls, {TOTALS} FROM u GROUP BY 1, 2")
def _(t):
    return C.class_totals(priced(t))


@register("a02_volume_totals", PRICED + f"SELECT vol, {TOTALS} FROM u GROUP BY 1")
def _(t):
    return C.volume_totals(C.class_totals(priced(t)))


MODULE_ARMS = """(SELECT *, 'mix' AS module FROM u WHERE kind_Code LIKE '06%' UNION ALL
SELECT *, 'machine' FROM u WHERE cons_Style = 5 UNION ALL SELECT *, 'me_main' FROM u WHERE cons_Style IN (6, 7))"""


@register("a03_module_totals", PRICED + f"""
SELECT module, {DISTINCT}, CAST(sum(refs) AS BIGINT) AS refs FROM {MODULE_ARMS} GROUP BY 1""")
def _(t):
    return C.module_totals(priced(t))


@register("a03_module_volumes", PRICED + f"SELECT module, vol, count(*) AS total FROM {MODULE_ARMS} GROUP BY 1, 2")
def _(t):
    return C.module_volumes(usage(t))


@register("a04_overall_totals", PRICED + f"SELECT {DISTINCT} FROM u")
def _(t):
    return C.overall_totals(priced(t))


@register("e02_price_index", PRICED + f"""
SELECT 'class' AS part, vol AS name, cons_Style AS cls, {TOTALS} FROM u GROUP BY 2, 3
UNION ALL SELECT 'volume', vol, NULL, {TOTALS} FROM u GROUP BY 2
UNION ALL SELECT 'module', module, NULL, {DISTINCT}, CAST(sum(refs) AS BIGINT) FROM {MODULE_ARMS} GROUP BY 2
UNION ALL SELECT 'all', NULL, NULL, {DISTINCT}, NULL FROM u""")
def _(t):
    base = priced(t)
    classes = C.class_totals(base)
    part = lambda df, what, name, cls="cast(null as int)", refs="refs": df.selectExpr(
        f"'{what}' AS part", f"{name} AS name", f"{cls} AS cls", "total", "priced", f"{refs} AS refs")
    return (part(classes, "class", "vol", "cls")
            .unionByName(part(C.volume_totals(classes), "volume", "vol"))
            .unionByName(part(C.module_totals(base), "module", "module"))
            .unionByName(part(C.overall_totals(base), "all", "cast(null as string)", refs="cast(null as bigint)")))


@register("a05_list_totals", LISTED.replace("{where}", "") + f"""
SELECT {DISTINCT}, CAST(coalesce(sum(refs), 0) AS BIGINT) AS refs FROM listed WHERE kind_Code LIKE '06%'""")
def _(t):
    return C.list_totals(listing(t, scope="mix"))


ROLLED_COLUMNS = ["res_ID", "res_Code", "res_Name", "refs", "vols", "cons_Style", "kind_Code", "price", "tier"]


def _rolled(df):
    return df.withColumn("vols", F.array_join("vols", ",")).select(*ROLLED_COLUMNS)


@register("a06_resource_roll_up", LISTED.replace("{where}", "") + f"SELECT {', '.join(ROLLED_COLUMNS)} FROM rolled")
def _(t):
    return _rolled(C.roll_up(listing(t)))


MATRIX = f"""SELECT vol, cons_Style AS cls, {TOTALS}, {REFS_PRICED}, {L.sql_case('cons_Style', L.CLASSES)} AS cls_name,
  {L.sql_case('cons_Style', L.CLASSES_EN)} AS cls_name_EN, {L.sql_case('vol', L.VOLUMES)} AS vol_name FROM u GROUP BY vol, cons_Style"""


@register("a07_coverage_matrix", PRICED + MATRIX)
def _(t):
    return C.coverage_matrix(priced(t))


TIER_ROWS = f"""SELECT tier, price_kind, count(*) AS n, {L.sql_case('tier', L.TIERS)} AS tier_name,
  {L.sql_case('tier', L.TIERS_EN)} AS tier_name_EN FROM price_row WHERE pack = '{PACK}' GROUP BY tier, price_kind"""


@register("a08_tier_histogram", TIER_ROWS)
def _(t):
    return C.tier_histogram(t.price_row, PACK)


GAPS = """SELECT u.res_ID, CAST(sum(u.refs) AS BIGINT) AS refs, string_agg(DISTINCT u.vol, ',' ORDER BY u.vol) AS vols,
  any_value(r.res_Code) AS res_Code, any_value(r.res_Name) AS res_Name
  FROM u JOIN resource r ON r.res_ID = u.res_ID WHERE u.price_res_ID IS NULL GROUP BY u.res_ID"""


def gaps(t: Tables, n: int | None):
    ranked = C.gap_ranking(usage(t), t.resource_price, t.resource, PACK, n)
    return ranked.select("res_ID", "refs", F.array_join("vols", ",").alias("vols"), "res_Code", "res_Name")


@register("a09_gap_ranking", PRICED + GAPS + " ORDER BY refs DESC, res_ID LIMIT 60")
def _(t):
    return gaps(t, 60)


SUMMARY = f"""SELECT *, round(priced / total, 6) AS coverage, round(refs_priced / refs, 6) AS weighted FROM (
  SELECT {DISTINCT}, CAST(sum(refs) AS BIGINT) AS refs, {REFS_PRICED} FROM u)"""


@register("a10_coverage_summary", PRICED + SUMMARY)
def _(t):
    return C.coverage_summary(priced(t))


@register("e06_coverage", PRICED + f""", m AS ({MATRIX}), s AS ({SUMMARY}), g AS ({GAPS} ORDER BY refs DESC, res_ID LIMIT 60),
h AS ({TIER_ROWS})
SELECT 'matrix' AS part, concat(vol, '/', cls) AS name, total, priced, refs, refs_priced FROM m
UNION ALL SELECT 'summary', NULL, total, priced, refs, refs_priced FROM s
UNION ALL SELECT 'gap', res_Code, NULL, NULL, refs, NULL FROM g
UNION ALL SELECT 'tier', concat(tier, '/', coalesce(price_kind, '')), n, NULL, NULL, NULL FROM h""")
def _(t):
    base = priced(t)
    none = "cast(null as bigint)"
    matrix = C.coverage_matrix(base).selectExpr("'matrix' AS part", "concat(vol, '/', cls) AS name", "total", "priced", "refs", "refs_priced")
    summary = C.coverage_summary(base).selectExpr("'summary'", "cast(null as string)", "total", "priced", "refs", "refs_priced")
    gap = gaps(t, 60).selectExpr("'gap'", "res_Code", none, none, "refs", none)
    tier = C.tier_histogram(t.price_row, PACK).selectExpr(
        "'tier'", "concat(tier, '/', coalesce(price_kind, ''))", "n", none, none, none)
    return matrix.union(summary).union(gap).union(tier)


@register("a23_coverage_pivot", PRICED + ", c AS (SELECT vol, cons_Style AS cls, " + TOTALS + """ FROM u GROUP BY 1, 2),
w AS (SELECT vol, """ + ", ".join(
    f"coalesce(sum(CASE WHEN cls = {k} THEN priced END), 0) AS p{k}, coalesce(sum(CASE WHEN cls = {k} THEN total END), 0) AS t{k}"
    for k in L.CLASSES) + """, sum(priced) AS p, sum(total) AS t FROM c GROUP BY vol)
SELECT vol, """ + ", ".join(
    f"CASE WHEN t{k} > 0 THEN concat(p{k}, '/', t{k}, '  ', CAST(round(p{k} * 100 / t{k}, 1) AS DECIMAL(5,1)), '%') ELSE '—' END AS cls{k}"
    for k in L.CLASSES) + """, concat(p, '/', t, '  ', CAST(round(p * 100 / t, 1) AS DECIMAL(5,1)), '%') AS all_classes,
  CASE WHEN p / t >= 0.8 THEN 'ok' WHEN p / t >= 0.4 THEN 'warn' ELSE 'bad' END AS band FROM w""")
def _(t):
    return C.coverage_pivot(C.class_totals(priced(t)))


@register("a24_tier_summary", f"""
SELECT {L.sql_case('tier', {x: i for i, x in enumerate(L.TIER_REPORT_ORDER)}, 9)} AS tier_rank, tier, {L.sql_case('tier', L.TIERS)} AS tier_name,
       string_agg(DISTINCT coalesce(price_kind, ''), ', ' ORDER BY coalesce(price_kind, '')) AS kinds, count(*) AS n
FROM price_row WHERE pack = '{PACK}' AND tier IN ('T1', 'T2', 'T3', 'T4', 'S', 'D') GROUP BY tier""")
def _(t):
    return C.tier_summary(C.tier_histogram(t.price_row, PACK))


@register("a34_unpriced_unlinked", f"""
SELECT 'unlinked' AS part, vol AS name, CAST(sum(CASE WHEN master_res_ID IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n
FROM consumption GROUP BY vol
UNION ALL SELECT 'unpriced', pack, CAST(sum(CASE WHEN price IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM latest_row GROUP BY pack""")
def _(t):
    unlinked = C.unlinked_rows(t.consumption).selectExpr("'unlinked' AS part", "vol AS name", "unlinked AS n")
    unpriced = R.latest_price_row(t.resource_price).groupBy("pack").agg(F.count_if(F.col("price").isNull()).alias("n"))
    return unlinked.unionByName(unpriced.selectExpr("'unpriced' AS part", "pack AS name", "n"))


@register("f01_scope_filter", "SELECT vol, cons_ID FROM usage WHERE kind_Code LIKE '06%'")
def _(t):
    return usage(t).filter(P.in_scope("mix")).select("vol", "cons_ID")


@register("f02_list_predicate", LISTED.replace("{where}", "") + """
SELECT vol, cons_ID, res_ID FROM listed
WHERE vol = 'B' AND cons_Style = 4 AND price_res_ID IS NOT NULL AND tier IN ('T3') AND (
  res_Name LIKE '%ring%' OR res_Standard LIKE '%ring%' OR res_Code LIKE '%ring%' OR cons_Name LIKE '%ring%')""")
def _(t):
    return listing(t, vol="B", cls=4, priced="yes", tier="T3,", q=" Ring ").select("vol", "cons_ID", "res_ID")


@register("f03_keyword_search", LISTED.replace("{where}", "") + """
SELECT vol, cons_ID FROM listed WHERE lower(res_Name) LIKE '%r_d%w%' OR lower(res_Standard) LIKE '%r_d%w%'
   OR lower(res_Code) LIKE '%r_d%w%' OR lower(cons_Name) LIKE '%r_d%w%'""")
def _(t):
    return listing(t, q="R_D%w").select("vol", "cons_ID")


@register("f04_tier_filter", "SELECT res_ID, pack, CAST(price_date AS STRING) AS price_date FROM resource_price WHERE tier IN ('T1', 'T3')")
def _(t):
    return t.resource_price.filter(P.in_tiers(" T1, ,T3 ")).select("res_ID", "pack", F.col("price_date").cast("string").alias("price_date"))


@register("f05_priced_filter", PRICED + "SELECT vol, cons_ID FROM u WHERE price_res_ID IS NULL")
def _(t):
    return priced(t).filter(P.is_priced("no")).select("vol", "cons_ID")


@register("f08_labels", f"""
SELECT vol, cons_ID, {L.sql_case('vol', L.VOLUMES)} AS vol_name, {L.sql_case('cons_Style', L.CLASSES)} AS cls_name FROM consumption""")
def _(t):
    return t.consumption.select("vol", "cons_ID", L.label(F.col("vol"), L.VOLUMES).alias("vol_name"),
                                L.label(F.col("cons_Style"), L.CLASSES).alias("cls_name"))


@register("o01_price_list_order", LISTED.replace("{where}", "") + f"""
SELECT row_number() OVER (ORDER BY (price IS NULL) DESC, refs DESC, res_Code, res_ID) AS no, {', '.join(ROLLED_COLUMNS)} FROM rolled""")
def _(t):
    return numbered(_rolled(C.roll_up(listing(t))), C.list_order(), "no")


@register("o02_paging", LISTED.replace("{where}", "WHERE vol = 'C'") + f"""
SELECT {', '.join(ROLLED_COLUMNS)} FROM rolled ORDER BY (price IS NULL) DESC, refs DESC, res_Code, res_ID LIMIT 200 OFFSET 100""")
def _(t):
    return _rolled(C.page(C.roll_up(listing(t, vol="C")), C.list_order(), 200, 100))


@register("o02_paging_by_key", LISTED.replace("{where}", "") + f"""
SELECT 'page 3' AS part, {', '.join(ROLLED_COLUMNS)} FROM (SELECT *, row_number() OVER (ORDER BY (price IS NULL) DESC, refs DESC, res_Code, res_ID) AS k FROM rolled) WHERE k BETWEEN 101 AND 150
UNION ALL SELECT 'after 150', {', '.join(ROLLED_COLUMNS)} FROM (SELECT *, row_number() OVER (ORDER BY (price IS NULL) DESC, refs DESC, res_Code, res_ID) AS k FROM rolled) WHERE k BETWEEN 151 AND 180""")
def _(t):
    root = scratch_path(t.spark, "list")
    E.publish_list(_rolled(C.roll_up(listing(t))), C.list_order(), root)
    third = E.read_page(t.spark, root, 3, 50)
    unpriced = F.col("price").isNull().cast("int")
    last = third.withColumn("open", unpriced).orderBy(F.desc("no")).first()  # one row: where the reader is
    keys = [("open", True), ("refs", True), ("res_Code", False), ("res_ID", False)]
    stored = t.spark.read.parquet(root).withColumn("open", unpriced)
    after = E.rows_after(stored, keys, last.asDict(), 30)
    return third.select(F.lit("page 3").alias("part"), *ROLLED_COLUMNS).union(after.select(F.lit("after 150"), *ROLLED_COLUMNS))


@register("e03_price_list", LISTED.replace("{where}", "WHERE cons_Style IN (6, 7) AND price_res_ID IS NOT NULL") + f"""
SELECT {', '.join(ROLLED_COLUMNS)}, (SELECT count(*) FROM rolled) AS total, (SELECT CAST(sum(refs) AS BIGINT) FROM rolled) AS total_refs
FROM rolled""")
def _(t):
    listed = listing(t, scope="me_main", priced="yes")
    totals = C.list_totals(listed).select("total", F.col("refs").alias("total_refs"))
    rows = _rolled(C.roll_up(listed))
    # one totals row, repeated on every row of the list
    return rows.join(F.broadcast(totals), F.lit(True))


REPORT = """
SELECT res_Code, """ + L.sql_case("cons_Style", L.CLASSES) + """ AS cls_name, res_Name, res_Standard, res_Unit,
  CAST(NULL AS STRING) AS res_Name_EN, CAST(NULL AS STRING) AS res_Standard_EN, CAST(NULL AS STRING) AS res_Unit_EN,
  round(price, 4) AS price, CASE WHEN price IS NOT NULL THEN round(price_excl, 4) END AS price_excl,
  CASE WHEN price IS NOT NULL THEN currency END AS currency, CASE WHEN price IS NOT NULL THEN tier ELSE '待询价' END AS tier,
  CASE WHEN price IS NOT NULL THEN price_kind END AS price_kind,
  CASE WHEN price IS NOT NULL THEN CAST(price_date AS STRING) END AS price_date,
  CASE WHEN price IS NOT NULL THEN round(src_price, 4) END AS src_price,
  CASE WHEN price IS NOT NULL THEN src_currency END AS src_currency, CASE WHEN price IS NOT NULL THEN src_unit END AS src_unit,
  CASE WHEN price IS NOT NULL THEN fx_rate END AS fx_rate, CASE WHEN price IS NOT NULL THEN unit_factor END AS unit_factor,
  CASE WHEN price IS NOT NULL THEN supplier END AS supplier, CASE WHEN price IS NOT NULL THEN source_doc END AS source_doc,
  CASE WHEN price IS NOT NULL THEN source END AS source, refs, replace(vols, ',', '') AS vols FROM rolled"""


def report(t):
    return C.price_report(C.roll_up(listing(t))).withColumn("price_date", F.col("price_date").cast("string"))


@register("snk06_price_report", LISTED.replace("{where}", "") + REPORT)
def _(t):
    return report(t)


@register("e14_export_price_list", LISTED.replace("{where}", "") + f"""
SELECT row_number() OVER (ORDER BY price IS NOT NULL, refs DESC, res_Code) AS no, * FROM ({REPORT.strip()})""")
def _(t):
    unpriced_first = F.when(F.col("price").isNull(), 0).otherwise(1)
    return numbered(report(t), [unpriced_first, F.col("refs").desc(), F.col("res_Code")], "no")


@register("snk07_export_statistics", LISTED.replace("{where}", "") + """
SELECT count(*) AS rows, count(price) AS priced, count(*) - count(price) AS unpriced FROM rolled""")
def _(t):
    return C.roll_up(listing(t)).agg(F.count(F.lit(1)).alias("rows"), F.count("price").alias("priced"),
                                     F.count_if(F.col("price").isNull()).alias("unpriced"))


@register("j06_quote_provenance", """
SELECT res_ID, quote_ID, confidence, match_type, supplier, CAST(quote_date AS STRING) AS quote_date, CAST(rank AS INT) AS rank FROM (
  SELECT m.res_ID, m.quote_ID, m.confidence, m.match_type, q.supplier, q.quote_date,
         row_number() OVER (PARTITION BY m.res_ID ORDER BY m.confidence DESC, q.quote_date DESC, q.quote_ID) AS rank
  FROM quote_match m JOIN price_quote q ON q.quote_ID = m.quote_ID)""")
def _(t):
    best = V.quote_provenance(t.quote_match, t.price_quote)
    return best.select("res_ID", "quote_ID", "confidence", "match_type", "supplier",
                       F.col("quote_date").cast("string").alias("quote_date"), "rank")


@register("j07_live_aliases", """
SELECT a.res_ID, a.src_vol, a.src_cons_ID, a.src_Name, a.src_Price, u.refs
FROM resource_alias a JOIN usage u ON u.res_ID = a.res_ID AND u.vol = a.src_vol AND u.cons_ID = a.src_cons_ID""")
def _(t):
    return V.live_aliases(t.resource_alias, usage(t)).select("res_ID", "src_vol", "src_cons_ID", "src_Name", "src_Price", "refs")


@register("j08_anchor_overlay", f"""
SELECT p.res_ID, p.pack, p.price, coalesce(a.supplier, '') AS supplier, coalesce(a.contact, '') AS contact, coalesce(a.phone, '') AS phone,
       coalesce(a.address, '') AS address, coalesce(a.quote_date, '') AS quote_date, coalesce(a.project, '') AS project, CASE WHEN a.res_ID IS NOT NULL THEN a.price_excl ELSE p.price_excl END AS price_excl,
       CASE WHEN coalesce(a.project, '') <> '' THEN concat(coalesce(p.source, ''), ';project=', a.project) ELSE coalesce(p.source, '') END AS source
FROM (SELECT *, CASE pack WHEN 'ASIA' THEN '{L.VAT_PACK}' ELSE 'EUROPE' END AS shown
      FROM (SELECT *, row_number() OVER (PARTITION BY res_ID, pack ORDER BY price_date DESC) AS rn FROM price_row) WHERE rn = 1 AND pack IN ('ASIA', 'EUROPE')) p
LEFT JOIN {ANCHOR} a ON a.res_ID = p.res_ID AND p.shown = '{L.VAT_PACK}'""")
def _(t):
    parts = []
    # one region stands for the VAT pack, which has anchors, another for a pack that has none
    for region, pack in (("ASIA", L.VAT_PACK), ("EUROPE", "EUROPE")):
        prices = R.latest_price_row(t.price_row.filter(F.col("pack") == region))
        parts.append(R.overlay_anchor(prices, t.price_anchor, pack).select(
            "res_ID", "pack", "price", *R.ANCHOR_TEXTS, "price_excl", "source"))
    return parts[0].unionByName(parts[1])


NORMS_USING = """SELECT res_ID, vol, norm_ID, norm_Code, norm_Name, cont_Amount, cons_Units, CAST(rank AS INT) AS rank FROM (
  SELECT c.master_res_ID AS res_ID, n.vol, n.norm_ID, n.norm_Code, n.norm_Name, ct.cont_Amount, c.cons_Units,
         row_number() OVER (PARTITION BY c.master_res_ID, n.vol ORDER BY ct.cont_Amount DESC, n.norm_ID) AS rank
  FROM content ct JOIN norm n ON n.norm_ID = ct.norm_ID JOIN consumption c ON c.vol = n.vol AND c.cons_ID = ct.cons_ID
  WHERE c.master_res_ID IS NOT NULL)"""


@register("j09_norms_using_resource", NORMS_USING)
def _(t):
    return V.norms_using(t.consumption, t.content, t.norm).select(
        "res_ID", "vol", "norm_ID", "norm_Code", "norm_Name", "cont_Amount", "cons_Units", "rank")


@register("w14_top_per_key", """
SELECT res_ID, pack, CAST(price_date AS STRING) AS price_date, price, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY res_ID ORDER BY price DESC NULLS LAST, price_date, pack) AS rank FROM resource_price)
WHERE rank <= 3""")
def _(t):
    top = V.top_per_key(t.resource_price, ["res_ID"], [F.col("price").desc_nulls_last(), F.col("price_date"), F.col("pack")], 3)
    return top.select("res_ID", "pack", F.col("price_date").cast("string").alias("price_date"), "price", "rank")


@register("o03_observation_order", f"""
SELECT row_number() OVER (ORDER BY weight DESC, value_cny, obs_ref, source, res_ID) AS no, res_ID, obs_ref, value_cny, weight, source
FROM benchmark_obs WHERE pack = '{PACK}'""")
def _(t):
    rows = V.observations(t.benchmark_obs, PACK).select("res_ID", "obs_ref", "value_cny", "weight", "source")
    return numbered(rows, [*V.observation_order(), F.col("res_ID")], "no")


@register("e05_benchmark", f"""
WITH stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY res_ID ORDER BY price_date DESC) AS rn
  FROM price_row WHERE pack = '{PACK}' AND price_kind = 'benchmark') WHERE rn = 1)
SELECT o.res_ID, s.price, CAST(s.price_date AS STRING) AS price_date, o.obs_ref, o.value_cny, o.weight, o.source
FROM benchmark_obs o LEFT JOIN stored s ON s.res_ID = o.res_ID WHERE o.pack = '{PACK}'""")
def _(t):
    parts = V.benchmark(t.price_row, t.benchmark_obs, PACK)
    price = parts["price"].select("res_ID", "price", F.col("price_date").cast("string").alias("price_date"))
    return parts["observations"].join(price, "res_ID", "left").select(
        "res_ID", "price", "price_date", "obs_ref", "value_cny", "weight", "source")


@register("e04_price_detail", f"""
WITH q AS (SELECT res_ID, count(*) AS quotes FROM quote_match GROUP BY 1),
a AS (SELECT a.res_ID, count(*) AS aliases FROM resource_alias a JOIN usage u
      ON u.res_ID = a.res_ID AND u.vol = a.src_vol AND u.cons_ID = a.src_cons_ID GROUP BY 1),
n AS (SELECT res_ID, count(*) AS norms, round(sum(cont_Amount), 4) AS amount FROM ({NORMS_USING}) GROUP BY 1),
k AS (SELECT res_ID, count(*) AS anchors FROM price_anchor GROUP BY 1)
SELECT r.res_ID, r.res_Code, p.price, p.tier, coalesce(quotes, 0) AS quotes, coalesce(aliases, 0) AS aliases,
       coalesce(norms, 0) AS norms, amount, coalesce(anchors, 0) AS anchors
FROM resource r LEFT JOIN {ONE_PACK} p ON p.res_ID = r.res_ID LEFT JOIN q ON q.res_ID = r.res_ID
LEFT JOIN a ON a.res_ID = r.res_ID LEFT JOIN n ON n.res_ID = r.res_ID LEFT JOIN k ON k.res_ID = r.res_ID""")
def _(t):
    d = V.price_detail(t.resource, t.resource_price, PACK, t.quote_match, t.price_quote, t.resource_alias, usage(t),
                       t.consumption, t.content, t.norm, t.price_anchor)
    out = d["resource"].join(d["price"].drop("pack"), "res_ID", "left")
    for name in ("quotes", "aliases", "norms", "anchors"):
        sums = [F.count(F.lit(1)).alias(name)]
        if name == "norms":
            sums.append(F.round(F.sum("cont_Amount"), 4).alias("amount"))
        out = out.join(d[name].groupBy("res_ID").agg(*sums), "res_ID", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("quotes", "aliases", "norms")]
    return out.select("res_ID", "res_Code", "price", "tier", *counts, "amount",
                      F.coalesce("anchors", F.lit(0)).cast("long").alias("anchors"))
