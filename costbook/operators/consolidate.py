"""Source books mapped into one classification, with lineage and reports of what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costbook.functions.names import chapter_content
from costbook.operators.hierarchy import chapter_paths

EXTENSION_NOTE = "【备注】企业定额扩展分项（非 GB2024 官方清单）"


def coded_tree(divisions: DataFrame, subs: DataFrame, items: DataFrame, extensions: DataFrame) -> dict[str, DataFrame]:
    """Three-level tree with ids from codes: division*1e6 + sub*1000 + sequence.

    Item codes have four parts; extensions that meet an existing id are left out and reported.
    """
    div_id = F.col("division").cast("long") * 1_000_000
    sub_id = div_id + F.col("sub").cast("long") * 1000
    zero = F.lit(0).cast("long")
    node = lambda own, up, name, content, code: [own.alias("chap_ID"), up.alias("chap_PID"), name.alias("chap_Name"), content.alias("chap_Content"), code.alias("chap_code")]
    top = divisions.select(*node(div_id, zero, F.col("name"), F.lit(""), F.col("division")))
    middle = subs.select(*node(sub_id, div_id, F.concat_ws(" ", F.concat_ws(".", "division", "sub"), "name"), F.lit(""), F.concat_ws(".", "division", "sub")))

    def leaf(df: DataFrame, extra: bool) -> DataFrame:
        parts = F.split("code", r"\.")
        valid = df.filter(F.size(parts) == 4)
        content = chapter_content(F.col("item_feature"), F.col("calc_rule"), F.col("work_content"), F.lit(None) if extra else F.col("gb_ref"))
        content = F.concat_ws("\n", F.nullif(content, F.lit("")), F.lit(EXTENSION_NOTE)) if extra else content
        return valid.select("code", *node(sub_id + F.element_at(parts, 4).cast("long"), sub_id, F.concat_ws(" ", "code", "name"), content,
                                          F.concat_ws(".", "division", "sub", F.element_at(parts, 4))))

    official, added = leaf(items, False), leaf(extensions, True)
    clash = added.join(official.select("chap_ID"), "chap_ID", "left_semi")
    accepted = added.join(official.select("chap_ID"), "chap_ID", "left_anti")
    leaves = official.unionByName(accepted)
    return {"chapter": top.unionByName(middle).unionByName(leaves.drop("code")), "targets": leaves.select("code", "chap_ID"), "clashes": clash.select("code", "chap_ID")}


def map_norms(norms: DataFrame, defaults: DataFrame, rules: DataFrame, targets: DataFrame) -> DataFrame:
    """Target of every norm: its chapter's default code, refined by the first rule whose pattern its name fits.

    ``defaults`` (chap_ID, default_code), ``rules`` (chap_ID, rule_no, pattern, code).  A refined code
    that does not exist falls back to the default; a default that does not exist drops the norm.
    Patterns are tested once per distinct name of a chapter, and rules per chapter are few.
    """
    known = targets.select(F.col("code").alias("default_code"), F.col("chap_ID").alias("default_ID"))
    base = norms.join(defaults, "chap_ID").join(known, "default_code")
    names = norms.join(rules.select("chap_ID").distinct(), "chap_ID", "left_semi").select("chap_ID", "norm_Name").distinct()
    hits = names.join(rules, "chap_ID").filter(F.expr("norm_Name rlike pattern"))
    first = hits.groupBy("chap_ID", "norm_Name").agg(F.min_by("code", "rule_no").alias("code")).join(
        targets.select("code", F.col("chap_ID").alias("refined_ID")), "code")
    mapped = base.join(first.withColumnRenamed("code", "refined_code"), ["chap_ID", "norm_Name"], "left")
    return mapped.select(
        "norm_ID", "norm_Code", "norm_Name", "chap_ID", F.coalesce("refined_code", "default_code").alias("target"),
        F.coalesce("refined_ID", "default_ID").alias("target_ID"), F.col("refined_ID").isNotNull().alias("refined"))


def map_items(norms: DataFrame, mapping: DataFrame, targets: DataFrame) -> DataFrame:
    """Norm-by-norm mapping (norm_ID, code) to existing targets."""
    return norms.join(mapping, "norm_ID").join(targets.select("code", F.col("chap_ID").alias("target_ID")), "code")


def split_counts(mapped: DataFrame, rules: DataFrame) -> DataFrame:
    """Norms per source chapter and target, for chapters that have rules."""
    return mapped.join(rules.select("chap_ID").distinct(), "chap_ID", "left_semi").groupBy("chap_ID", "target").agg(F.count(F.lit(1)).alias("norms"))


def unmapped_chapters(norms: DataFrame, defaults: DataFrame) -> DataFrame:
    """Chapters that hold norms and have no default, with their norm counts."""
    counts = norms.groupBy("chap_ID").agg(F.count(F.lit(1)).alias("norms"))
    return counts.join(defaults.select("chap_ID"), "chap_ID", "left_anti")


def referenced(content: DataFrame, consumption: DataFrame, norms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Content of the kept norms and the consumption rows it names."""
    kept = content.join(norms.select("norm_ID"), "norm_ID", "left_semi")
    return kept, consumption.join(kept.select("cons_ID"), "cons_ID", "left_semi")


def build_book(norms: DataFrame, content: DataFrame, consumption: DataFrame, chapters: DataFrame, defaults: DataFrame,
               rules: DataFrame, tree: dict[str, DataFrame], source_lib: str) -> dict[str, DataFrame]:
    """A whole book: tree, mapped norms, what they reference, lineage, and reports."""
    mapped = map_norms(norms, defaults, rules, tree["targets"])
    facts, resources = referenced(content, consumption, mapped)
    paths = chapter_paths(chapters).select("chap_ID", F.element_at("names", -1).alias("source_chap_name"), F.col("path").alias("source_chap_path"), "book")
    lineage = mapped.join(paths, "chap_ID", "left").select(
        "norm_ID", F.lit(source_lib).alias("source_lib"), F.col("norm_Code").alias("source_norm_code"), F.col("chap_ID").alias("source_chap_id"),
        "source_chap_name", "source_chap_path", F.col("book").alias("source_book"))
    return {"chapter": tree["chapter"], "norm": mapped, "content": facts, "consumption": resources, "norm_source": lineage,
            "unmapped": unmapped_chapters(norms, defaults), "split": split_counts(mapped, rules)}


def discipline_view(classes: DataFrame, mapping: DataFrame, discipline: str) -> DataFrame:
    """Classes of a discipline with the norms mapped to them."""
    return classes.filter(F.col("discipline") == discipline).join(mapping, "wbs_code", "left")


def backfill_discipline(norms: DataFrame, chapters: DataFrame) -> DataFrame:
    """Discipline of every norm from its chapter, per source."""
    return norms.join(chapters.select("source_id", "chap_ID", "discipline"), ["source_id", "chap_ID"], "left")


def distribution(df: DataFrame, *by: str | Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
