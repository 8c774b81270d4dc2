"""Chapter indexes and norm details of the three table families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costbook.functions import labels as L
from costbook.functions.text import join_spec, mix_name, nrm_prefix, strip_ordinals, unit_bridge
from costbook.operators.hierarchy import closure, natural_order
from costbook.operators.ordered import chunk_of, numbered, numbered_by_key, scan
from costbook.operators.pricing import cost_columns
from costbook.session import shuffled


def titled(tables: DataFrame, chapters: DataFrame) -> DataFrame:
    """Tables or pages with the title of their chapter, '' where it is unknown."""
    names = chapters.select(F.col("chap_ID").alias("chapter_id"), F.col("chap_Name").alias("chapter_title"))
    return tables.join(names, "chapter_id", "left").withColumn("chapter_title", F.coalesce("chapter_title", F.lit("")))


def paged(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """Tables with the type of the page they start on."""
    types = pages.select("doc", "page", "page_type")
    return tables.join(types, ["doc", "page"], "left").withColumn("page_type", F.coalesce("page_type", F.lit("")))


INHERITED = ("section_title", "subsection_title", "chapter_title")


def fill_continued(tables: DataFrame) -> DataFrame:
    """A continued table without sub-title takes its titles from the table before it."""
    order = [F.col("page"), F.col("seq_on_page")]
    waits = (F.col("page_type") == "continued_table") & (F.coalesce("subsection_title", F.lit("")) == "")
    titles = F.struct(*INHERITED)
    filled = scan(tables, ["doc"], order, chunk_of(F.col("page")), carry={"_own": F.when(~waits, titles)})
    # the very first table has none before it and keeps its own titles
    first = tables.groupBy("doc").agg(F.min_by(titles, F.struct("page", "seq_on_page")).alias("_first"))
    rest = [c for c in tables.columns if c not in INHERITED]
    source = F.when(waits, F.coalesce("_own", "_first")).otherwise(titles)
    return filled.join(first, "doc").select(*rest, source.alias("_t")).select(
        *rest, *[F.col(f"_t.{c}").alias(c) for c in INHERITED],
        strip_ordinals(F.col("_t.subsection_title")).alias("subsection_clean"))


def code_to_table(items: DataFrame) -> DataFrame:
    """Code to the last table that holds it."""
    return items.filter(F.coalesce("norms_code", F.lit("")) != "").groupBy("norms_code").agg(F.max("table_id").alias("table_id"))


def code_to_chapters(norms: DataFrame, items: DataFrame) -> DataFrame:
    """Code to its chapters in order, norms before list items: one row per place."""
    all_ = norms.select(F.col("norm_Code").alias("code"), F.lit(0).alias("kind"), F.col("norm_ID").cast("string").alias("ord"),
                        F.col("norm_ID").alias("_n"), "chap_ID").unionByName(
        items.select("code", F.lit(1).alias("kind"), F.col("code").alias("ord"), F.lit(0).cast("long").alias("_n"), "chap_ID"))
    kept = all_.filter(F.coalesce("code", F.lit("")) != "")
    order = [F.col("kind"), F.col("_n"), F.col("ord"), F.col("chap_ID")]
    return numbered(kept, order, "pos", ["code"]).select("code", "pos", "chap_ID")


def search_text(norms: DataFrame, slice_size: int = 1 << 14) -> DataFrame:
    """Names of a chapter as searchable text, in slices of bounded size."""
    slice_no = chunk_of(F.col("norm_ID"), slice_size)
    named = norms.filter(F.coalesce("norm_Name", F.lit("")) != "")
    listed = named.groupBy("chap_ID", slice_no.alias("slice")).agg(
        F.array_sort(F.collect_list(F.struct("norm_ID", "norm_Name"))).alias("names"))
    return listed.select("chap_ID", "slice", F.array_join(F.transform("names", lambda x: x["norm_Name"]), " ").alias("text"))


def lite(index: DataFrame, heavy: tuple[str, ...] = ("norm_list", "code_index", "search_text")) -> DataFrame:
    """The index without the parts only a search needs."""
    return index.drop(*heavy)


def blank_nulls(df: DataFrame) -> DataFrame:
    """Missing texts as '', numbers untouched."""
    return df.fillna("", subset=[n for n, kind in df.dtypes if kind == "string"])


def effective_chapter(chapters: DataFrame, norms: DataFrame) -> DataFrame:
    """Chapter whose norms are shown: its own, or its parent's where it has none."""
    held = norms.select("chap_ID").distinct()
    own = chapters.join(held, "chap_ID", "left_semi").select("chap_ID", F.col("chap_ID").alias("shown_ID"))
    up = chapters.join(held, "chap_ID", "left_anti").filter(F.col("chap_PID") != 0).select(
        "chap_ID", F.col("chap_PID").alias("shown_ID"))
    return own.unionByName(up.join(held.withColumnRenamed("chap_ID", "shown_ID"), "shown_ID", "left_semi").select("chap_ID", "shown_ID"))


def listing(norms: DataFrame, items: DataFrame) -> DataFrame:
    """Norms and list items of every chapter in one row shape."""
    return norms.select("chap_ID", F.col("norm_Code").alias("code"), F.col("norm_Name").alias("name"),
                        F.round("norm_OtherPrice", 4).alias("amount")).unionByName(
        items.select("chap_ID", "code", "name", F.lit(0.0).alias("amount")))


def shown_price(price: Column) -> Column:
    """Price of an item line: a zero price is shown empty yet counts as priced."""
    return F.when(price != 0, F.round(price, 4))


NAME, RESOURCE, COST, LISTED = 0, 1, 2, 3


def detail_rows(norms: DataFrame, lines: DataFrame, costs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of a chapter: each norm's name, its resources and its cost sums, then the list items.

    ``lines`` carry the price of their resource (null when unpriced), ``costs`` the sums per norm.
    """
    empty = lambda kind: F.lit(None).cast(kind)
    base = [F.col("chap_ID"), F.lit(0).alias("part"), F.col("norm_SortID").alias("ord"), F.col("norm_Code").alias("code")]
    with_cost = norms.join(costs, "norm_ID", "left")
    sums = F.coalesce("man", F.lit(0.0)) + F.coalesce("mat", F.lit(0.0)) + F.coalesce("mach", F.lit(0.0))
    resource = norms.join(lines, "norm_ID").select(
        *base, F.lit(RESOURCE).alias("kind"), F.lit(0).alias("sub"), join_spec(F.col("cons_Name"), F.col("cons_Standard")).alias("cost_item"),
        F.coalesce("cons_Units", F.lit("")).alias("unit"), F.round(F.coalesce("cont_Amount", F.lit(0.0)), 6).alias("amount"),
        shown_price(F.col("price")).alias("unit_price"), L.label(F.col("cons_Style"), L.CLASSES).alias("label"),
        F.col("price").isNull().alias("unpriced"))
    # a norm's name and its three sums come from one pass
    own = [(NAME, 0, F.col("norm_Name"), "", F.round(sums + F.coalesce("norm_OtherPrice", F.lit(0.0)), 4), F.lit(True))]
    own += [(COST, i, F.lit(t), "元", F.round(c, 4), F.coalesce(F.col(c) != 0, F.lit(False))) for i, (t, c) in enumerate((("人工费", "man"), ("材料费", "mat"), ("机械费", "mach")))]
    parts = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(sub).alias("sub"), item.alias("cost_item"), F.lit(unit).alias("unit"), amount.alias("amount"), shown.alias("shown"))
                      for kind, sub, item, unit, amount, shown in own])
    of_norm = with_cost.select(*base, F.explode(F.filter(parts, lambda x: x["shown"])).alias("x")).select(
        "chap_ID", "part", "ord", "code", "x.kind", "x.sub", "x.cost_item", "x.unit", "x.amount", empty("double").alias("unit_price"), F.lit("").alias("label"), F.lit(False).alias("unpriced"))
    texts = F.array(*[F.struct(F.lit(i).alias("sub"), F.col(c).alias("cost_item"), F.lit(lb).alias("label"))
                      for i, (c, lb) in enumerate((("name", ""), ("item_feature", "项目特征"), ("work_content", "工作内容"), ("calc_rule", "计算规则")))])
    listed = items.select("*", F.explode(texts).alias("x")).filter((F.col("x.sub") == 0) | (F.coalesce("x.cost_item", F.lit("")) != "")).select(
        "chap_ID", F.lit(1).alias("part"), F.lit(0).cast("long").alias("ord"), "code", F.lit(LISTED).alias("kind"), "x.sub", "x.cost_item",
        F.when(F.col("x.sub") == 0, F.col("unit")).otherwise("").alias("unit"), F.lit(0.0).alias("amount"),
        empty("double").alias("unit_price"), "x.label", F.lit(False).alias("unpriced"))
    return of_norm.unionByName(resource).unionByName(listed)


def detail_order() -> list[Column]:
    return [F.col(c) for c in ("part", "ord", "code", "kind", "sub", "cost_item", "unit", "amount", "unit_price", "label", "unpriced")]


def detail_sizes(norms: DataFrame, content: DataFrame, items: DataFrame) -> DataFrame:
    """(chap_ID, n): at least the detail rows of each chapter, counted without prices and resources."""
    held = norms.join(content.groupBy("norm_ID").agg(F.count(F.lit(1)).alias("_lines")), "norm_ID", "left")
    # a name and three sums, or four texts
    rows = held.select("chap_ID", (F.coalesce("_lines", F.lit(0)) + 4).alias("n")).unionByName(items.select("chap_ID", F.lit(4).cast("long").alias("n")))
    return rows.groupBy("chap_ID").agg(F.sum("n").alias("n"))


def sort_rows(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Running number of the rows of each chapter; ``sizes`` (chap_ID, n) tells about how many it has."""
    return numbered_by_key(rows, detail_order(), "sort_order", ["chap_ID"], sizes)


def nrm_mapped(nrm: DataFrame, chapters: DataFrame) -> DataFrame:
    """Two-level prefixes in use with the chapters below them: an equi-join on the prefix."""
    wanted = nrm.select(nrm_prefix(F.col("code")).alias("prefix")).filter(F.col("prefix").isNotNull()).distinct()
    below = chapters.filter(F.size(F.split("chap_code", r"\.")) > 2).select(
        F.substring_index("chap_code", ".", 2).alias("prefix"), "chap_ID")
    return wanted.join(below, "prefix")


def nrm_sections(nrm: DataFrame, chapters: DataFrame, norms: DataFrame) -> DataFrame:
    """Items with the norms they map to, sections in the order their first item appears.

    Norms are counted per prefix first, so items sharing a prefix never multiply chapters.
    """
    counts = nrm_mapped(nrm, chapters).join(norms.groupBy("chap_ID").agg(F.count(F.lit(1)).alias("n")), "chap_ID").groupBy(
        "prefix").agg(F.sum("n").alias("norm_count"))
    items = nrm.withColumn("prefix", nrm_prefix(F.col("code"))).join(counts, "prefix", "left").withColumn(
        "norm_count", F.coalesce("norm_count", F.lit(0)).cast("long"))
    first = items.groupBy("nrm_section_title").agg(F.min("code").alias("first_code"))
    return items.join(first, "nrm_section_title").select("first_code", "nrm_section_title", "code", "name", "norm_count")


def cross_book_tree(nrm: DataFrame, chapters: DataFrame, norms: DataFrame) -> DataFrame:
    """Mapped chapters of several books (column ``doc``) below each prefix, with the chapters above them.

    Leaves without norms are dropped; roots are left out and chapters of less than three
    code parts are not shown.
    """
    # ids of different books may clash, so the books' trees are closed under (doc, id) keys
    keyed = chapters.withColumn("key", F.concat_ws(":", "doc", "chap_ID")).withColumn(
        "up", F.when(F.col("chap_PID") == 0, F.lit("0")).otherwise(F.concat_ws(":", "doc", "chap_PID")))
    counts = norms.groupBy("doc", "chap_ID").agg(F.count(F.lit(1)).alias("norms"))
    refs = nrm.select("doc", nrm_prefix(F.col("code")).alias("prefix")).filter(F.col("prefix").isNotNull()).distinct()
    below = keyed.filter(F.size(F.split("chap_code", r"\.")) > 2).withColumn("prefix", F.substring_index("chap_code", ".", 2))
    leaves = below.join(refs, ["doc", "prefix"], "left_semi").join(counts, ["doc", "chap_ID"], "left_semi").select("key", "prefix")
    up = closure(keyed, "key", "up").withColumnRenamed("node", "key")
    nodes = leaves.join(up, "key").select("prefix", F.col("ancestor").alias("key")).distinct()
    return nodes.join(keyed.filter(F.col("chap_PID") != 0), "key").join(counts, ["doc", "chap_ID"], "left").filter(
        F.size(natural_order(F.col("chap_code"))) >= 3).select(
        "prefix", "doc", "chap_ID", "chap_Name", "chap_code", F.coalesce("norms", F.lit(0)).cast("long").alias("row_count"))


def sections_with_chapters(sections: DataFrame, chapters: DataFrame) -> DataFrame:
    return sections.join(chapters, "chapter_id")


def section_tables(items: DataFrame) -> DataFrame:
    """Sub-items of a section with row count, first page and position by first id.

    The shown table id is section*1000 + position where a section has several sub-items, else
    the section id; section and position stay separate columns, as ids of 1000 and more clash.
    """
    subs = items.groupBy("section_id", "subitem_title").agg(
        F.count(F.lit(1)).alias("row_count"), F.min_by("page", "id").alias("page"), F.min("id").alias("first_id"))
    shape = subs.groupBy("section_id").agg(F.count(F.lit(1)).alias("subitems"), F.sum("row_count").alias("section_rows"))
    placed = numbered(subs, [F.col("first_id")], "_pos", ["section_id"])
    pos = (F.col("_pos") - 1).cast("long")
    return placed.join(shape, "section_id").select(
        "section_id", "subitem_title", "row_count", "page", "section_rows", "subitems", pos.alias("position"),
        F.when(F.col("subitems") > 1, F.col("section_id") * 1000 + pos).otherwise(F.col("section_id")).alias("table_id"))


MIX_KIND_ORDER = {"工日": 0, "台班": 2}


def mix_prices(aliases: DataFrame, resources: DataFrame, prices: DataFrame, volume: str) -> DataFrame:
    """Price by source name and the alias's own unit for one source volume; of several aliases the highest resource id counts."""
    named = aliases.filter(F.col("src_vol") == volume).join(resources.select("res_ID"), "res_ID", "left_semi").join(
        prices.select("res_ID", "price"), "res_ID", "left")
    return named.groupBy("src_Name").agg(F.max_by(F.struct("price", "unit_factor", "src_Unit"), F.col("res_ID")).alias("r")).select(
        "src_Name", "r.*")


def mix_lines(items: DataFrame, prices: DataFrame) -> DataFrame:
    """Mix lines with their unit price in the line's own unit; the stored base price stays unpriced."""
    price = prices.select(F.col("src_Name").alias("cost_item"), "price", "unit_factor", F.col("src_Unit").alias("src_unit"))
    joined = items.join(price, "cost_item", "left")
    unit = F.coalesce("cost_item_unit", F.lit(""))
    worth = F.col("price") * F.col("unit_factor") * unit_bridge(F.col("src_unit"), unit)
    return joined.withColumn("unit_price", F.when(F.col("cost_item") != "基价", worth))


def mix_rates(lines: DataFrame) -> DataFrame:
    """Rate of every mix, split by the unit of its lines; exact decimals, as sums may end on half a cent."""
    amount = F.coalesce("amount", F.lit(0.0)).cast("decimal(12,4)") * F.col("unit_price").cast("decimal(20,8)")
    kind = F.when(F.col("cost_item_unit") == "工日", "labour").when(F.col("cost_item_unit") == "台班", "mech").otherwise("materials")
    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0)), 2).cast("double")
    return lines.filter(F.coalesce("norms_code", F.lit("")) != "").groupBy("table_id", "norms_code").agg(
        total(amount).alias("rate"), *[total(F.when(kind == k, amount)).alias(k) for k in L.RATE_CLASSES])


def mix_order() -> list[Column]:
    """Labour, materials, machines, the base price last; otherwise as stored."""
    unit = F.col("cost_item_unit")
    rank = F.when(F.col("cost_item") == "基价", 3).when(unit == "工日", 0).when(unit == "台班", 2).otherwise(1)
    return [rank, F.col("sort_order"), F.col("id")]


def mix_names(tables: DataFrame, items: DataFrame) -> DataFrame:
    """Shown name of every mix from its first line's attributes."""
    labels = [c for i in range(1, 5) for c in (f"attr{i}_label", f"attr_level{i}")]
    first = items.groupBy("table_id", "norms_code").agg(F.min_by(F.struct(*labels), F.struct("sort_order", "id")).alias("a"))
    pairs = [(F.col(f"a.attr{i}_label"), F.col(f"a.attr_level{i}")) for i in range(1, 5)]
    return first.join(tables.select(F.col("id").alias("table_id"), "subsection_title"), "table_id").select(
        "table_id", "norms_code", mix_name(F.col("subsection_title"), pairs).alias("cost_item"))


def priced_lines(content: DataFrame, consumption: DataFrame, prices: DataFrame, on: list[str]) -> DataFrame:
    """Content lines with consumption and price; the two catalogues meet first."""
    price = prices.select(F.col("res_ID").alias("master_res_ID"), "price")
    return content.join(shuffled(consumption.join(price, "master_res_ID", "left")), on)


def line_costs(lines: DataFrame) -> DataFrame:
    return lines.groupBy("norm_ID").agg(*cost_columns(F.col("cons_Style"), F.col("cont_Amount"), F.col("price")))
