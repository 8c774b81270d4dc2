"""Unit-rate export and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from costbook.functions import labels as L
from costbook.functions import names as A
from costbook.operators import boq as B
from costbook.operators import coverage as C
from costbook.operators import hierarchy as H
from costbook.operators import matching as M
from costbook.operators import pricing as R
from costbook.operators import rates as U
from costbook.operators.ordered import numbered
from costbook.operators.provenance import volume_content
from costbook.plans.books import BILL, bill, coded_norms
from costbook.plans.prices import ANCHOR, PACK, PRICED, usage
from costbook.plans.registry import register
from costbook.plans.scalars import TITLES, pick
from costbook.session import stored
from costbook.sources.bindings import define_view

DOCUMENTS = ["A", "B", "C", "D", "E"]
define_view("selection", """
SELECT CASE WHEN l_suppkey % 19 = 0 THEN 'zz' ELSE vol END AS doc, CASE WHEN l_partkey % 23 = 0 THEN ' ' ELSE concat(norm_Code, ' ') END AS code,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 7 = 0 THEN 'x1' WHEN l_orderkey % 11 = 0 THEN CAST(l_orderkey + 900000000 AS STRING)
            ELSE CAST(l_orderkey AS STRING) END AS norm_id, l_partkey * 100 + l_linenumber AS pos
FROM lineitem JOIN norm ON norm_ID = l_orderkey""")
PICKS = """WITH pk AS (SELECT doc, trim(code) AS code, TRY_CAST(norm_id AS BIGINT) AS norm_id, min(pos) AS pos FROM selection
  WHERE doc IN ('A', 'B', 'C', 'D', 'E') AND trim(code) <> '' GROUP BY 1, 2, 3),
rs AS (SELECT pk.*, CASE WHEN pk.norm_id IS NOT NULL THEN (SELECT n.norm_ID FROM norm n WHERE n.norm_ID = pk.norm_id AND n.vol = pk.doc)
  ELSE (SELECT min(n.norm_ID) FROM norm n WHERE n.vol = pk.doc AND n.norm_Code = pk.code) END AS norm_ID_found FROM pk)
"""


def picks(t):
    return U.clean_picks(t.selection, DOCUMENTS)


def resolved(t):
    return U.resolve_picks(picks(t), t.norm.withColumnRenamed("vol", "doc"))


@register("f06_clean_selection", PICKS + "SELECT * FROM pk")
def _(t):
    return picks(t)


@register("j18_pick_resolution", PICKS + "SELECT doc, code, norm_id, norm_ID_found AS found, norm_ID_found IS NULL AS missing FROM rs")
def _(t):
    found, missing = resolved(t)
    return found.select("doc", "code", "norm_id", F.col("norm_ID_found").alias("found"), F.lit(False).alias("missing")).union(
        missing.select("doc", "code", "norm_id", F.lit(None).cast("long"), F.lit(True)))


RES = """rl AS (SELECT ct.norm_ID, c.cons_ID, c.master_res_ID, concat(c.cons_Name, ' ', c.cons_Standard) AS name, c.cons_Units AS unit, ct.cont_Amount AS amount,
  CASE c.cons_Style WHEN 3 THEN 'labour' WHEN 4 THEN 'materials' WHEN 7 THEN 'materials' ELSE 'mech' END AS cls, concat(c.cons_Name, ' ', c.cons_Standard, chr(10), c.cons_Units) AS label
  FROM content ct JOIN norm n ON n.norm_ID = ct.norm_ID JOIN consumption c ON c.vol = n.vol AND c.cons_ID = ct.cons_ID),
px AS (SELECT res_ID, price FROM latest_row WHERE pack = 'ASIA'),
rp AS (SELECT rl.*, px.price FROM rl LEFT JOIN px ON px.res_ID = rl.master_res_ID),
rg AS (SELECT label, name, unit, cls, price FROM rp QUALIFY row_number() OVER (PARTITION BY label ORDER BY norm_ID, cons_ID, amount, price) = 1),
mx AS (SELECT norm_ID, label, max_by(amount, cons_ID * 1000 + amount) AS amount, min_by(cls, {'a': cons_ID, 'b': cls}) AS cls FROM rp GROUP BY 1, 2),
ur AS (SELECT mx.norm_ID, """ + ", ".join(f"round(coalesce(sum(CASE WHEN mx.cls = '{c}' THEN amount * coalesce(price, 0) END), 0), 4) AS {c}" for c in L.RATE_CLASSES) + """,
  round(sum(amount * coalesce(price, 0)), 4) AS rate FROM mx LEFT JOIN rg ON rg.label = mx.label GROUP BY 1)
"""


def pack_prices(t):
    return R.latest_price_row(t.resource_price).filter(F.col("pack") == PACK).select("res_ID", "price")


def priced_lines(t, norms=None):
    content = volume_content(t.content, t.norm)
    if norms is not None:
        content = content.join(norms, "norm_ID", "left_semi")
    lines = U.resource_lines(content, t.consumption, ["vol", "cons_ID"])
    return U.price_lines(lines, pack_prices(t))


@register("a28_resource_registry", "WITH " + RES + """
SELECT row_number() OVER (ORDER BY CASE cls WHEN 'labour' THEN 0 WHEN 'materials' THEN 1 ELSE 2 END, name, label) AS no, label, name, unit, cls, price FROM rg""")
def _(t):
    return U.registry(priced_lines(t)).select("no", "label", "name", "unit", "cls", "price")


@register("o06_class_order", "WITH " + RES + """
SELECT label, row_number() OVER (PARTITION BY unit ORDER BY CASE cls WHEN 'labour' THEN 0 WHEN 'materials' THEN 1 ELSE 2 END, name, label) AS no FROM rg""")
def _(t):
    order = [U.class_rank(F.col("cls")), F.col("name"), F.col("label")]
    return numbered(U.first_lines(priced_lines(t)), order, "no", ["unit"]).select("label", "no")


@register("a26_consumption_matrix", "WITH " + RES + "SELECT * FROM mx")
def _(t):
    return U.consumption_matrix(priced_lines(t))


@register("a27_unit_rate", "WITH " + RES + "SELECT * FROM ur")
def _(t):
    return U.rates(priced_lines(t))


def _items(t, found=None):
    """Items of the export: selected norms (all, if none are given) below their chapter levels with their labels in order."""
    paths = H.chapter_paths(t.chapter).select("chap_ID", *H.split_levels(F.col("names")))
    norms = t.norm.join(paths, "chap_ID").select("norm_ID", "norm_Code", *U.BLOCK_KEYS)
    content = volume_content(t.content, t.norm)
    if found is not None:
        norms, content = norms.join(found, "norm_ID", "left_semi"), content.join(found, "norm_ID", "left_semi")
    lines = U.resource_lines(content, t.consumption, ["vol", "cons_ID"])
    labels = lines.groupBy("norm_ID").agg(F.transform(F.array_sort(F.collect_set(F.struct("cons_ID", "label"))), lambda x: x["label"]).alias("labels"))
    return norms.join(labels, "norm_ID").withColumn("pos", F.col("norm_ID"))


@register("w17_block_packing")
def _(t):
    return U.pack_blocks(_items(t))


@register("w20_block_numbers")
def _(t):
    named = U.block_names(U.pack_blocks(_items(t)))
    order = [F.col(c) for c in (*U.BLOCK_KEYS, "block", "norm_ID")]
    return numbered(named, order, "seq")


def exported(t):
    """The export of the selection; a region stands for the VAT pack, which has direct quotes."""
    norms = t.norm.withColumnRenamed("vol", "doc")
    return U.export_norms(t.selection, DOCUMENTS, norms, volume_content(t.content, t.norm), t.consumption, t.price_row.filter(F.col("pack") == PACK), t.price_anchor, L.VAT_PACK,
                          lambda wanted: _items(t, wanted))


@register("e13_export_norms")
def _(t):
    out = exported(t)
    return out.blocks.join(out.rates, "norm_ID", "left")


EXPORTED = PICKS.rstrip() + ", " + RES.split("px AS (")[0].rstrip().rstrip(",").replace("c.cons_ID = ct.cons_ID)", "c.cons_ID = ct.cons_ID WHERE ct.norm_ID IN (SELECT norm_ID_found FROM rs))") + f""",
px AS (SELECT p.res_ID, p.price, p.price_date, CASE WHEN a.res_ID IS NOT NULL THEN a.price_excl ELSE p.price_excl END AS price_excl, coalesce(a.supplier, '') AS supplier, coalesce(a.contact, '') AS contact,
  coalesce(a.phone, '') AS phone, coalesce(a.address, '') AS address, coalesce(a.quote_date, '') AS quote_date, coalesce(a.project, '') AS project,
  concat(coalesce(p.source, ''), CASE WHEN coalesce(a.project, '') <> '' THEN concat(';project=', a.project) ELSE '' END) AS source
  FROM (SELECT *, row_number() OVER (PARTITION BY res_ID, pack ORDER BY price_date DESC) AS rn FROM price_row WHERE pack = '{PACK}') p LEFT JOIN {ANCHOR} a ON a.res_ID = p.res_ID WHERE p.rn = 1),
rp AS (SELECT rl.*, px.* EXCLUDE (res_ID) FROM rl LEFT JOIN px ON px.res_ID = rl.master_res_ID),
rg AS (SELECT *, CASE WHEN price IS NOT NULL THEN round(coalesce(price_excl, price / CAST(1.07 AS DOUBLE)), 4) END AS net FROM rp QUALIFY row_number() OVER (PARTITION BY label ORDER BY norm_ID, cons_ID, amount) = 1)
"""


@register("e13_price_sheet", EXPORTED + f"""
SELECT row_number() OVER (ORDER BY CASE cls WHEN 'labour' THEN 0 WHEN 'materials' THEN 1 ELSE 2 END, name, label) AS no, cls, name, unit, net, round(price - net, 4) AS tax, price,
  CASE WHEN coalesce(quote_date, '') <> '' THEN quote_date ELSE coalesce(CAST(price_date AS VARCHAR), '') END AS date,
  CASE WHEN coalesce(supplier, '') NOT IN ('') AND supplier NOT LIKE '%?%' THEN supplier ELSE coalesce(project, '') END AS offered_by, coalesce(contact, '') AS contact, coalesce(phone, '') AS phone,
  coalesce(address, '') AS address, CASE WHEN coalesce(source, '') <> '' THEN source WHEN price IS NULL THEN '{U.UNPRICED}' ELSE '' END AS note FROM rg""")
def _(t):
    return exported(t).prices


@register("e13_export_summary", EXPORTED + """
SELECT (SELECT count(DISTINCT norm_ID_found) FROM rs) AS norms, (SELECT count(*) FROM rs WHERE norm_ID_found IS NULL) AS missing, (SELECT count(*) FROM rp WHERE master_res_ID IS NOT NULL AND price IS NULL) AS unpriced""")
def _(t):
    return exported(t).summary


# the export knows the selected norms only: a label's reference price is its first line among them
@register("e13_export_unit_rates", PICKS.rstrip() + ", " + RES.replace("c.cons_ID = ct.cons_ID),\npx", "c.cons_ID = ct.cons_ID WHERE ct.norm_ID IN (SELECT norm_ID_found FROM rs)),\npx") + """
SELECT ur.* FROM ur""")
def _(t):
    found, _missing = resolved(t)
    return U.rates(priced_lines(t, found.select(F.col("norm_ID_found").alias("norm_ID"))))


@register("d14_consumption_book", BILL.rstrip() + ", " + RES.replace("rl AS (", "rl AS (", 1) + """
SELECT b.disc, b.cat, b.subcat, b.boq_code, b.strict_ID AS norm_ID, c3.chap_Name AS chapter, c2.chap_Name AS section, c1.chap_Name AS subsection, ur.labour, ur.materials, ur.mech, ur.rate
FROM resolved b JOIN norm n ON n.norm_ID = b.strict_ID JOIN chapter c1 ON c1.chap_ID = n.chap_ID JOIN chapter c2 ON c2.chap_ID = c1.chap_PID JOIN chapter c3 ON c3.chap_ID = c2.chap_PID
LEFT JOIN ur ON ur.norm_ID = b.strict_ID""")
def _(t):
    # packed, as both the book and its norms are read from it
    found = stored(B.resolve_codes(bill(t), coded_norms(t)).filter(F.col("strict_ID").isNotNull()).select(
        "disc", "cat", "subcat", "boq_code", F.col("strict_ID").alias("norm_ID")), "found")
    paths = H.chapter_paths(t.chapter).select("chap_ID", *H.split_levels(F.col("names"), fourth=True)).drop("level4")
    rates = U.rates_of(found.select("norm_ID").distinct(), volume_content(t.content, t.norm), t.consumption, pack_prices(t))
    return found.join(t.norm.select("norm_ID", "chap_ID"), "norm_ID").join(paths, "chap_ID").join(rates, "norm_ID", "left").drop("chap_ID")


@register("o07_chapter_order", """
WITH v AS (SELECT DISTINCT n.vol AS volume, c.chap_Name AS chapter FROM norm n JOIN chapter k ON k.chap_ID = n.chap_ID JOIN chapter c ON c.chap_ID = k.chap_PID)
SELECT volume, chapter, row_number() OVER (ORDER BY CASE volume WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 99 END, coalesce(TRY_CAST(regexp_extract(chapter, '(\\d+)', 1) AS INT), 99), chapter, volume) AS no FROM v""")
def _(t):
    leaf = t.chapter.select("chap_ID", F.col("chap_PID").alias("up"))
    upper = t.chapter.select(F.col("chap_ID").alias("up"), F.col("chap_Name").alias("chapter"))
    rows = t.norm.select("chap_ID", F.col("vol").alias("volume")).distinct().join(leaf, "chap_ID").join(upper, "up").select("volume", "chapter").distinct()
    order = [*U.chapter_order(), F.col("volume")]
    return numbered(rows, order, "no")


FIELDS = "CASE l_linenumber WHEN 1 THEN 'k1' WHEN 2 THEN 'k2' WHEN 3 THEN 'u1' WHEN 4 THEN 'other' ELSE 'k1' END"
define_view("shift_item", f"""
SELECT l_orderkey AS table_id, concat('S', CAST(l_orderkey AS STRING)) AS norms_code, l_linenumber AS sort_order, l_partkey * 1000000 + l_suppkey AS id,
       CASE WHEN l_linenumber = 6 THEN concat('machine ', CAST(l_partkey AS STRING)) ELSE {FIELDS} END AS cost_item,
       CASE WHEN l_linenumber = 6 AND l_partkey % 2 = 0 THEN '' WHEN l_linenumber = 6 THEN '台' WHEN l_linenumber = 3 THEN '' ELSE '元' END AS cost_item_unit,
       CASE WHEN l_linenumber = 6 THEN NULL ELSE l_extendedprice END AS amount FROM lineitem""")
CELL = "max_by(amount, {'a': sort_order, 'b': id}) FILTER (cost_item = 'C' AND amount IS NOT NULL)"


@register("a25_machine_shift_matrix", """
SELECT norms_code, coalesce(max_by(cost_item, {'a': sort_order, 'b': id}) FILTER (amount IS NULL), '') AS name, """ + ", ".join(f"{CELL.replace('C', c, 1)} AS {c}".replace("FILTER (C", "FILTER (c") for c in ("k1", "k2", "u1")) + """,
  CASE WHEN coalesce(max_by(cost_item_unit, {'a': sort_order, 'b': id}) FILTER (amount IS NULL), '') = '' THEN '台班' ELSE max_by(cost_item_unit, {'a': sort_order, 'b': id}) FILTER (amount IS NULL) END AS unit
FROM shift_item GROUP BY 1""")
def _(t):
    return U.machine_shift_matrix(t.shift_item, ["k1", "k2"], ["u1"], {"u1": "工日"})[0]


@register("a25_machine_shift_units", """
SELECT c.cost_item, coalesce(u.unit, c.missing) AS unit FROM (VALUES ('k1', ''), ('k2', ''), ('u1', '工日'), ('none', '元')) c(cost_item, missing)
LEFT JOIN (SELECT cost_item, min_by(cost_item_unit, {'a': table_id, 'b': sort_order, 'c': id}) AS unit FROM shift_item WHERE coalesce(cost_item_unit, '') <> '' GROUP BY 1) u
  ON u.cost_item = c.cost_item""")
def _(t):
    return U.machine_shift_matrix(t.shift_item, ["k1", "k2", "none"], ["u1"], {"u1": "工日", "none": "元"})[1]


# ---- fuzzy matching -------------------------------------------------------------------

def gap_resources(t):
    gaps = C.gap_ranking(usage(t).filter(F.col("cons_Style").isin(6, 7)), t.resource_price, t.resource, PACK, None)
    return gaps.select("res_ID", F.concat_ws(" ", "res_Name", "res_Standard").alias("name"), F.col("res_Unit").alias("unit"), "refs")


def quotes(t):
    return t.price_quote.select("quote_ID", "name", F.when(F.col("quote_ID") % 2 == 0, "t").otherwise("台班").alias("unit"))


@register("j21_gap_match")
def _(t):
    return M.match_gaps(gap_resources(t), quotes(t))


@register("e07_gap_match_report", None)
def _(t):
    return M.gap_match(usage(t).filter(F.col("cons_Style").isin(6, 7)), t.resource_price, t.resource, quotes(t), PACK)


@register("e07_gap_match_counts", f"""
WITH g AS (SELECT res_ID FROM usage u JOIN resource r USING (res_ID) WHERE vol = 'C' AND cons_Style = 7 AND res_ID NOT IN (SELECT res_ID FROM resource_price WHERE pack = '{PACK}') GROUP BY 1)
SELECT count(*) AS total, greatest(count(*) - 20, 0) AS truncated, least(count(*), 20) AS shown FROM g""")
def _(t):
    # one volume and class, the twenty most referenced gaps, quotes of one specialty
    marked = quotes(t).withColumn("specialty", F.when(F.col("quote_ID") % 3 == 0, "pipes").otherwise("cables"))
    out = M.gap_match(usage(t), t.resource_price, t.resource, marked, PACK, vol="C", cls=7, specialty="pipe%", limit=20, cand=3, min_score=0.4)
    return out.groupBy("total", "truncated").agg(F.countDistinct("res_ID").alias("shown"))


def _glyphs(key, n: int, alphabet: int):
    """A name of n signs, drawn by hash from an alphabet in which some are far more frequent."""
    def glyph(k: int):
        share = (F.pmod(F.xxhash64(key, F.lit(k)), F.lit(10000)) / 10000)
        return F.decode(F.unhex(F.lpad(F.hex(F.lit(0x4E00) + F.floor(share * share * alphabet).cast("long")), 4, "0")), "UTF-16BE")

    return F.concat(*[glyph(k) for k in range(n)])


@register("j21_gap_match_of_many_names")
def _(t):
    # a name of its own for every line, and gaps that share four of six signs with one of them
    lines = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("quote_ID"), "l_partkey")
    named = lines.select("quote_ID", _glyphs(F.col("quote_ID"), 6, 3000).alias("name"), F.when(F.col("quote_ID") % 2 == 0, "m").otherwise("t").alias("unit"), "l_partkey")
    like = named.groupBy("l_partkey").agg(F.min_by("name", "quote_ID").alias("near"))
    gaps = like.select(F.col("l_partkey").alias("res_ID"), F.concat(F.substring("near", 1, 4), _glyphs(F.col("l_partkey"), 2, 3000)).alias("name"), F.lit("m").alias("unit"))
    return M.match_gaps(gaps, named.drop("l_partkey"))


define_view("existing_leaf", f"""
SELECT chap_ID AS leaf_ID, CAST(chap_PID AS BIGINT) AS domain, concat({pick(TITLES, 'chap_ID')}, ' ', substr(chap_code, 7)) AS leaf_name FROM chapter WHERE chap_PID >= 100 AND chap_ID % 2 = 0""")
define_view("new_norm", f"""
SELECT o_orderkey AS norm_ID, CAST(100 + c_nationkey AS BIGINT) AS domain, concat({pick(TITLES, 'o_orderkey')}, ' ', o_orderstatus) AS norm_Name,
       CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE {pick(TITLES, '(o_orderkey + 7)')} END AS parent_name FROM orders JOIN customer ON o_custkey = c_custkey""")
define_view("held_norm", f"SELECT 1000 + o_custkey AS chap_ID, {pick(TITLES, '(o_orderkey * 3)')} AS norm_Name FROM orders")
define_view("new_chapter", f"""
SELECT chap_ID, CAST(chap_PID AS BIGINT) AS domain, {pick(TITLES, '(chap_ID * 5)')} AS name, CASE WHEN chap_ID % 4 = 0 THEN NULL ELSE {pick(TITLES, '(chap_ID + 3)')} END AS parent_name
FROM chapter WHERE chap_PID >= 100 AND chap_ID % 2 = 1""")


@register("j22_best_leaf")
def _(t):
    return M.match_leaves(t.new_norm.select("norm_ID", "domain", "norm_Name"), t.existing_leaf, t.held_norm)


@register("j23_best_leaf_with_parent")
def _(t):
    return M.match_leaves_with_parent(t.new_norm, t.existing_leaf, t.held_norm)


@register("j24_semantic_chapter_match")
def _(t):
    return M.match_chapters(t.new_chapter, t.existing_leaf)


@register("a30_match_quality")
def _(t):
    return M.quality_histogram(M.match_chapters(t.new_chapter, t.existing_leaf))


@register("q10_misassignment_audit")
def _(t):
    return M.misassigned(M.match_chapters(t.new_chapter, t.existing_leaf), t.existing_leaf)
