"""Chapter trees: ancestor chains, descendant sets, and what is rolled up or rewritten along them.

Chains are built by pointer doubling: n joins reach 2**n levels.  Three are planned at once; where a chain is still open after
them, which one look at the rows tells, more follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costbook.operators import tours
from costbook.session import settle

DOUBLINGS = 3


def _doubled(current: DataFrame) -> DataFrame:
    """Every open chain longer by that of the node it ends at."""
    # chains that are complete have no key to join on; the salt keeps them from meeting in one task
    salt = F.when(F.col("up").isNull(), F.pmod(F.xxhash64("node"), F.lit(256))).otherwise(F.lit(0).cast("long"))
    higher = current.select(F.col("node").alias("up"), F.lit(0).cast("long").alias("salt"), F.col("up").alias("up2"), F.col("path").alias("more"))
    return current.withColumn("salt", salt).join(higher, ["up", "salt"], "left").select(
        "node", F.col("up2").alias("up"), F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"))


def _open() -> Column:
    # up turns null where a parent row is missing, so one that is left stands for a real row
    return F.col("up").isNotNull() & (F.size(F.array_distinct("path")) == F.size("path"))


def _first_chains(chapters: DataFrame, carried: tuple[str, ...], node: str, parent: str) -> DataFrame:
    """(node, up, path) after DOUBLINGS, written once."""
    self_ = F.struct(F.col(node).alias("id"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in carried])
    above = F.when((F.col(parent).cast("string") != "0") & (F.col(parent) != F.col(node)), F.col(parent))
    current = chapters.select(F.col(node).alias("node"), above.alias("up"), F.array(self_).alias("path"))
    for _ in range(DOUBLINGS):
        current = _doubled(current)
    return settle(current)


def chains(chapters: DataFrame, carried: tuple[str, ...] = (), node: str = "chap_ID", parent: str = "chap_PID") -> DataFrame:
    """``node`` and ``chain``: structs from the root to the node.

    A parent that is 0, the node itself or missing ends the chain.  Cycles are cut at the
    first repeated node.  Chains of any length are followed to their end.
    """
    current = _first_chains(chapters, carried, node, parent)
    distinct = F.array_distinct("path")
    while not current.filter(_open()).isEmpty():
        current = settle(_doubled(current))
    return current.select("node", F.reverse(distinct).alias("chain"))


def chapter_paths(chapters: DataFrame, carried: tuple[str, ...] = ("chap_Name", "chap_code")) -> DataFrame:
    """Chain with names, codes, the joined path and the book it belongs to."""
    names = F.transform("chain", lambda x: x["chap_Name"])
    return chains(chapters, carried).select(
        F.col("node").alias("chap_ID"), "chain", names.alias("names"),
        F.transform("chain", lambda x: x["chap_code"]).alias("codes"),
        F.array_join(names, " > ").alias("path"), F.element_at(names, 1).alias("book"))


def split_levels(names: Column, fourth: bool = False) -> list[Column]:
    """Chapter, section and sub-section of a chain of names; the BOQ form names a fourth level too."""
    at = lambda i: F.coalesce(F.try_element_at(names, F.lit(i)), F.lit(""))
    sub = at(3) if fourth else F.when(F.size(names) > 2, F.element_at(names, -1)).otherwise(F.lit(""))
    parts = [at(1).alias("chapter"), at(2).alias("section"), sub.alias("subsection")]
    return [*parts, at(4).alias("level4")] if fourth else parts


def _pairs(current: DataFrame) -> DataFrame:
    up = current.select("node", F.posexplode(F.array_distinct("path")).alias("distance", "a"))
    return up.select("node", F.col("a.id").alias("ancestor"), F.col("distance"))


def closure(chapters: DataFrame, node: str = "chap_ID", parent: str = "chap_PID") -> DataFrame:
    """Every node with each of its ancestors, itself included at distance 0."""
    up = chains(chapters, (), node, parent).select("node", F.posexplode(F.reverse("chain")).alias("distance", "a"))
    return up.select("node", F.col("a.id").alias("ancestor"), F.col("distance"))


class Subtrees:
    """Answers about subtrees.  Where no chain is longer than the planned doublings reach, a node has a bounded number of ancestors and all pairs
    are at hand; in deeper trees interval labels answer (see ``tours``), and only nodes on or below a circle keep their pairs."""

    def __init__(self, chapters: DataFrame, node: str = "chap_ID", parent: str = "chap_PID"):
        current = _first_chains(chapters, (), node, parent)
        self.places = None
        if current.filter(_open()).isEmpty():
            self.pairs = _pairs(current)
        else:
            self.places = tours.tour(chapters, node, parent)
            circles = chapters.join(self.places.select(F.col("node").alias(node)), node, "left_anti")
            self.pairs = closure(settle(circles), node, parent)

    def totals(self, weights: DataFrame) -> DataFrame:
        """(node, total): sum of ``weights`` (node, weight) over each subtree; nodes whose subtree has no weight may lack."""
        of_pairs = self.pairs.join(weights, "node").groupBy(F.col("ancestor").alias("node")).agg(F.sum("weight").alias("total"))
        return of_pairs if self.places is None else of_pairs.unionByName(tours.below(self.places, weights))

    def below(self, roots: DataFrame) -> DataFrame:
        """(ancestor, node) for each of ``roots`` (node) and every node of its subtree."""
        of_pairs = self.pairs.join(roots.select(F.col("node").alias("ancestor")).distinct(), "ancestor").select("ancestor", "node")
        return of_pairs if self.places is None else of_pairs.unionByName(tours.inside(self.places, roots))

    def covered(self, roots: DataFrame) -> DataFrame:
        """The nodes (node) of the subtrees of ``roots`` (node), each once."""
        of_pairs = self.pairs.join(roots.select(F.col("node").alias("ancestor")).distinct(), "ancestor").select("node").distinct()
        return of_pairs if self.places is None else of_pairs.unionByName(tours.covered(self.places, roots))


def descendants(chapters: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes below the roots (column ``root``), roots included."""
    return Subtrees(chapters).below(roots.select(F.col("root").alias("node"))).select(F.col("ancestor").alias("root"), F.col("node").alias("chap_ID"))


def nearest_mapped(chapters: DataFrame, mapping: DataFrame, key: str = "domain") -> DataFrame:
    """Key of the nearest ancestor that the mapping (chap_ID, key) names; the node itself counts."""
    named = closure(chapters).join(mapping.select(F.col("chap_ID").alias("ancestor"), key), "ancestor")
    return named.groupBy(F.col("node").alias("chap_ID")).agg(F.min_by(key, "distance").alias(key))


def leaves(chapters: DataFrame, roots: DataFrame, with_norms: DataFrame | None = None) -> DataFrame:
    """Childless nodes below the roots, optionally only those that hold given norms."""
    parents = chapters.select(F.col("chap_PID").alias("chap_ID")).distinct()
    found = descendants(chapters, roots).join(parents, "chap_ID", "left_anti")
    return found if with_norms is None else found.join(with_norms.select("chap_ID").distinct(), "chap_ID", "left_semi")


def direct_counts(norms: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Norms plus list items that hang directly on a chapter."""
    counted = norms.groupBy("chap_ID").agg(F.count(F.lit(1)).alias("direct"))
    if items is None:
        return counted
    more = items.groupBy("chap_ID").agg(F.count(F.lit(1)).alias("direct"))
    return counted.unionByName(more).groupBy("chap_ID").agg(F.sum("direct").alias("direct"))


def subtree_counts(chapters: DataFrame, direct: DataFrame) -> DataFrame:
    """Direct count, count of the whole subtree, and the badge shown in the tree."""
    own = chapters.join(direct, "chap_ID", "left").withColumn("direct", F.coalesce("direct", F.lit(0)).cast("long"))
    below = Subtrees(chapters).totals(direct.select(F.col("chap_ID").alias("node"), F.col("direct").alias("weight"))).select(F.col("node").alias("chap_ID"), F.col("total").alias("subtree"))
    parent = direct.select(F.col("chap_ID").alias("chap_PID"), F.col("direct").alias("above"))
    total = F.coalesce("subtree", F.lit(0)).cast("long")
    badge = F.when((total == 0) & (F.col("chap_PID") != 0), F.coalesce("above", F.lit(0))).otherwise(total)
    return own.join(below, "chap_ID", "left").join(parent, "chap_PID", "left").select(
        "chap_ID", "chap_PID", "direct", total.alias("subtree"), badge.cast("long").alias("badge"))


def reparent(chapters: DataFrame, moves: DataFrame, retired: DataFrame) -> DataFrame:
    """Hangs chapters (chap_ID, new_PID) elsewhere and drops the retired roots (chap_ID)."""
    kept = chapters.join(retired.select("chap_ID"), "chap_ID", "left_anti")
    return kept.join(moves, "chap_ID", "left").withColumn(
        "chap_PID", F.coalesce("new_PID", "chap_PID")).drop("new_PID").select(*chapters.columns)


def prune_empty(chapters: DataFrame, norms: DataFrame, prunable: Column | None = None) -> DataFrame:
    """Drops chapters whose subtree holds no norm, until nothing changes; roots stay.

    Removing empty leaves to a fixpoint keeps exactly the chapters above some norm, so one
    roll-up replaces the loop.  With ``prunable`` only matching chapters may go, and a
    chapter above one that must stay is not a leaf and stays as well.
    """
    may_go = F.lit(True) if prunable is None else prunable
    holders = norms.select(F.col("chap_ID")).distinct().withColumn("_holds", F.lit(True))
    flagged = chapters.join(holders, "chap_ID", "left")
    anchor = flagged.filter(F.col("_holds") | ~may_go | (F.col("chap_PID") == 0)).select(F.col("chap_ID").alias("node")).distinct()
    keep = Subtrees(chapters).totals(anchor.withColumn("weight", F.lit(1))).where("total > 0").select(F.col("node").alias("chap_ID"))
    return chapters.join(keep, "chap_ID", "left_semi")


def code_level(code: Column) -> Column:
    """Depth of a dotted code, its letter prefix aside."""
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit(1)).otherwise(
        F.size(F.split(F.regexp_replace(code, r"^[A-Z]\.", ""), r"\.")))


def natural_order(code: Column) -> Column:
    """Numeric parts of a dotted code; one part that is no number sends the code to the end."""
    parts = F.split(F.regexp_replace(F.coalesce(code, F.lit("")), r"^[A-Z]\.", ""), r"\.")
    numbers = F.transform(parts, lambda p: p.try_cast("int"))
    return F.when(F.exists(numbers, lambda n: n.isNull()), F.array(F.lit(999))).otherwise(numbers)


def override_subtree(chapters: DataFrame, by_prefix: dict[str, str], seed: Column, label: str) -> DataFrame:
    """Discipline by two-digit code prefix; subtrees below a seed chapter are labelled anew."""
    arms = F.lit(None).cast("string")
    for prefix, name in by_prefix.items():
        arms = F.when(F.substring("chap_code", 1, 2) == prefix, F.lit(name)).otherwise(arms)
    seeds = chapters.filter(seed).select(F.col("chap_ID").alias("root"))
    inside = Subtrees(chapters).covered(seeds.withColumnRenamed("root", "node")).select(F.col("node").alias("chap_ID"), F.lit(True).alias("_inside"))
    return chapters.join(inside, "chap_ID", "left").withColumn(
        "discipline", F.when(F.col("_inside"), F.lit(label)).otherwise(arms)).drop("_inside")


def under_retired(chapters: DataFrame, norms: DataFrame, retired: DataFrame) -> DataFrame:
    """Norms that still sit below roots that were to be emptied, per root."""
    counts = norms.groupBy(F.col("chap_ID").alias("node")).agg(F.count(F.lit(1)).alias("weight"))
    asked = retired.select(F.col("chap_ID").alias("node")).distinct()
    return Subtrees(chapters).totals(counts).join(asked, "node", "left_semi").where("total > 0").select(F.col("node").alias("root"), F.col("total").alias("norms"))


def orphans(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Rows that name a parent which does not exist."""
    known = df.select(F.col(child).alias(parent)).distinct()
    return df.filter(F.col(parent).isNotNull()).join(known, parent, "left_anti")


def with_offset(df: DataFrame, offset: int, columns: tuple[str, ...], root_stays: str | None = None) -> DataFrame:
    """Ids shifted into the range of another book; the root's parent stays 0."""
    out = df
    for c in columns:
        moved = F.col(c) + F.lit(offset)
        out = out.withColumn(c, F.when(F.col(c) == 0, F.lit(0).cast("long")).otherwise(moved) if c == root_stays else moved)
    return out


def copy_subtree(chapters: DataFrame, norms: DataFrame, content: DataFrame, consumption: DataFrame,
                 roots: DataFrame, offset: int, source_lib: str) -> dict[str, DataFrame]:
    """Chapters below the roots with their facts under shifted ids, and one lineage row per norm."""
    inside = Subtrees(chapters).covered(roots.select(F.col("root").alias("node"))).select(F.col("node").alias("chap_ID"))
    kept_norms = norms.join(inside, "chap_ID", "left_semi")
    kept_content = content.join(kept_norms.select("norm_ID"), "norm_ID", "left_semi")
    kept_cons = consumption.join(kept_content.select("cons_ID"), "cons_ID", "left_semi")
    paths = chapter_paths(chapters).select("chap_ID", "path", F.element_at("names", -1).alias("source_chap_name"))
    lineage = kept_norms.join(paths, "chap_ID", "left").select(
        (F.col("norm_ID") + F.lit(offset)).alias("norm_ID"), F.lit(source_lib).alias("source_lib"),
        F.col("norm_ID").alias("source_norm_id"), F.col("norm_Code").alias("source_norm_code"),
        F.col("chap_ID").alias("source_chap_id"), "source_chap_name", F.col("path").alias("source_chap_path"))
    return {
        "chapter": with_offset(chapters.join(inside, "chap_ID", "left_semi"), offset, ("chap_ID", "chap_PID"), "chap_PID"),
        "norm": with_offset(kept_norms, offset, ("norm_ID", "chap_ID")),
        "content": with_offset(kept_content, offset, ("norm_ID", "cons_ID")),
        "consumption": with_offset(kept_cons, offset, ("cons_ID",)),
        "norm_source": lineage,
    }


def id_collisions(existing: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """Ids that an added block shares with the book it joins; empty when the offset is right."""
    return added.select(key).join(existing.select(key), key, "left_semi").distinct()


def wbs_nodes(sheet: DataFrame, row: str = "row_no") -> DataFrame:
    """Level and parent of 12-digit segmented codes; of a repeated code the last row counts."""
    code = F.col("wbs_code")
    level = (F.when(F.substring(code, 10, 3) != "000", 5).when(F.substring(code, 7, 3) != "000", 4)
             .when(F.substring(code, 5, 2) != "00", 3).when(F.substring(code, 3, 2) != "00", 2).otherwise(1))
    cut = {5: 9, 4: 6, 3: 4, 2: 2}
    parent = F.lit(None).cast("string")
    for lv, n in cut.items():
        parent = F.when(F.col("level") == lv, F.rpad(F.substring(code, 1, n), 12, "0")).otherwise(parent)
    rest = [c for c in sheet.columns if c != "wbs_code"]
    last = sheet.filter(code.rlike("^[0-9]{12}$")).groupBy("wbs_code").agg(
        F.max_by(F.struct(*rest), row).alias("r")).select("wbs_code", "r.*")
    return last.withColumn("level", level).withColumn("parent_code", parent)


def first_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """First row per key along an order, chosen before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")

