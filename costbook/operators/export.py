"""Sinks: items, indexes, texts, trees and flat pools as JSON rows and files."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costbook.operators.norms import blank_nulls
from costbook.operators.ordered import numbered
from costbook.session import settle

ITEM_TEXTS = ("norms_code", "attr_level1", "attr_level2", "attr_level3", "attr_level4", "attr1_label", "attr2_label", "attr3_label", "attr4_label",
              "cost_item", "cost_item_unit")


def publish(frames: Mapping[str, DataFrame], path: str, by: Mapping[str, str] | None = None) -> str:
    """Writes a set of frames as JSON to a folder of its own below ``path`` and, when all are there, adds the row that makes it the current one.

    A run that fails leaves the set before it readable, and its own folder behind; a rerun starts a new one.  ``by`` names the column
    that a frame's files are divided by.  Returns the name of the version.
    """
    spark = next(iter(frames.values())).sparkSession
    version = f"v-{os.urandom(8).hex()}"
    for name, frame in frames.items():
        writer = frame.write.option("ignoreNullFields", False)
        (writer.partitionBy(by[name]) if by and name in by else writer).json(f"{path}/{version}/{name}")
    # the number decides, so that two versions never count at once
    number = 1 + max((r["number"] for r in _versions(spark, path)), default=0)
    spark.createDataFrame([(number, version)], "number long, version string").coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def _versions(spark: SparkSession, path: str) -> list:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return []
    return spark.read.schema("number long, version string").json(f"{path}/manifest").collect()  # a row for each run


def read_published(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A frame of the current set, without order."""
    current = max(_versions(spark, path), key=lambda r: r["number"])["version"]
    return spark.read.schema(schema).json(f"{path}/{current}/{name}")


def item_rows(items: DataFrame) -> DataFrame:
    """Items as exported: missing texts as '', a missing amount stays empty."""
    texts = [F.col(c) if c in items.columns else F.lit("").alias(c) for c in ITEM_TEXTS]
    return blank_nulls(items.select("table_id", "sort_order", "id", *texts, "amount"))


def write_items(items: DataFrame, path: str) -> None:
    """One JSON set per table, rows in their stored order; a rerun replaces the tables it holds."""
    rows = item_rows(items).repartition("table_id").sortWithinPartitions("table_id", "sort_order", "id").drop("sort_order", "id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).partitionBy("table_id").json(path)


def index_rows(chapters: DataFrame, tables: DataFrame, pages: DataFrame, codes: DataFrame) -> DataFrame:
    """The four parts of a book's index as JSON rows (part, ord, value)."""
    part = lambda df, name, order: df.select(F.lit(name).alias("part"), order.cast("string").alias("ord"), F.to_json(F.struct(*df.columns)).alias("value"))
    return (part(chapters, "chapters", F.col(chapters.columns[0])).unionByName(part(tables, "tables", F.col(tables.columns[0])))
            .unionByName(part(pages, "pages", F.concat_ws("/", "doc", "page"))).unionByName(part(codes, "code_index", F.col("norms_code"))))


def write_index(chapters: DataFrame, tables: DataFrame, pages: DataFrame, codes: DataFrame, path: str) -> str:
    """The four parts of a book's index, published together."""
    return publish({"chapters": chapters, "tables": tables, "pages": pages, "code_index": codes}, path)


def text_pages(texts: DataFrame) -> DataFrame:
    """Pages that hold text, as JSON rows."""
    kept = texts.filter(F.coalesce("content", F.lit("")) != "")
    return kept.select("page", F.to_json(F.struct("page", "type", "content")).alias("value"))


def write_text_pages(texts: DataFrame, path: str) -> str:
    """Pages that hold text, published as (page, type, content)."""
    return publish({"pages": texts.filter(F.coalesce("content", F.lit("")) != "").select("page", "type", "content")}, path)


def write_class_tree(trees: DataFrame, path: str) -> str:
    """The trees of ``class_tree``, divided by discipline."""
    return publish({"tree": trees}, path, {"tree": "discipline"})


def write_pool(frames: dict[str, DataFrame], path: str) -> str:
    """The five projections of ``pool``, published together."""
    return publish(frames, path)


def class_tree(nodes: DataFrame, attributes: tuple[str, ...], depth: int = 5) -> DataFrame:
    """Nested tree per discipline as JSON: (discipline, wbs_code, tree); nodes without a parent row become roots.

    ``nodes`` (wbs_code, parent_code, level, discipline, attributes).  Built bottom up, one pass per
    level; a node's children are bounded by the digits of its code segment.
    """
    nodes = settle(nodes.select("wbs_code", "parent_code", "level", "discipline", *[a for a in attributes if a != "level"]))
    known = nodes.select(F.col("wbs_code").alias("parent_code"), F.lit(True).alias("has_parent"))
    rows = nodes.join(known, "parent_code", "left").withColumn("has_parent", F.coalesce("has_parent", F.lit(False))).withColumn(
        "head", F.to_json(F.struct("wbs_code", *attributes)))
    none = F.array().cast("array<struct<wbs_code:string,json:string>>")
    # children collected so far, keyed by their parent
    below = None
    finished = []
    for level in range(depth, 0, -1):
        own = rows.filter(F.col("level") == level)
        own = own.withColumn("kids", none) if below is None else own.join(below, "wbs_code", "left").withColumn("kids", F.coalesce("kids", none))
        json = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"children":['), F.array_join(F.transform("kids", lambda k: k["json"]), ","), F.lit("]}"))
        built = own.select("wbs_code", "parent_code", "discipline", "has_parent", json.alias("json"))
        finished.append(built.filter(~F.col("has_parent")))
        mine = built.filter("has_parent").select(F.col("parent_code").alias("wbs_code"), F.struct("wbs_code", "json").alias("kid"))
        carried = mine if below is None else mine.unionByName(waiting)
        collected = carried.groupBy("wbs_code").agg(F.array_sort(F.collect_list("kid")).alias("kids"))
        below = collected
        # a parent may sit more than one level up, so what this level did not take waits for the next
        taken = rows.filter(F.col("level") == level - 1).select("wbs_code")
        waiting = carried.join(taken, "wbs_code", "left_anti")
    roots = finished[0]
    for frame in finished[1:]:
        roots = roots.unionByName(frame)
    return roots.select("discipline", "wbs_code", F.col("json").alias("tree"))


def pool(chapters: DataFrame, norms: DataFrame, page_chapters: DataFrame, tables: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """Five flat projections for browsing whole source books, each with its stable order."""
    pick = lambda df, order, **renamed: df.select(*[F.col(c).alias(n) for n, c in renamed.items()]).orderBy(*order)
    return {
        "bj_chapters": pick(chapters, ["source_id", "chap_ID"], source_id="source_id", chap_ID="chap_ID", chap_PID="chap_PID", chap_code="chap_code", chap_Name="chap_Name"),
        "bj_norms": pick(norms, ["source_id", "chap_ID", "norm_ID"], source_id="source_id", norm_ID="norm_ID", chap_ID="chap_ID", norm_Code="norm_Code", norm_Name="norm_Name", other="norm_OtherPrice"),
        "jts_chapters": pick(page_chapters, ["source_id", "id"], source_id="source_id", id="id", parent_id="parent_id", level="level", title="title"),
        "jts_norms_tables": pick(tables, ["source_id", "id"], source_id="source_id", id="id", chapter_id="chapter_id", section_title="section_title", subsection_title="subsection_title"),
        "jts_items": pick(items, ["source_id", "id"], source_id="source_id", id="id", table_id="table_id", norms_code="norms_code", a1="attr_level1", a2="attr_level2",
                          cost_item="cost_item", unit="cost_item_unit", amount="amount"),
    }


def all_columns_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns))


def publish_list(rows: DataFrame, order: list[Column], path: str, number: str = "no") -> None:
    """A list in its whole order for paging: numbered from 1, each file a range of numbers, rows in order."""
    numbered(rows, order, number).repartitionByRange(F.col(number)).sortWithinPartitions(number).write.mode("error").parquet(path)


def read_page(spark: SparkSession, path: str, page: int, size: int, number: str = "no") -> DataFrame:
    """A page (from 1) of a published list.  Its numbers are a filter that the files' statistics answer, so a late page reads as little as the first."""
    return spark.read.parquet(path).where(F.col(number).between((page - 1) * size + 1, page * size))


def rows_after(rows: DataFrame, order: list[tuple[str, bool]], last: Mapping[str, object] | None, size: int) -> DataFrame:
    """The ``size`` rows after the one with the keys ``last`` in an order of (column, descending) whose keys no two rows share; without
    ``last`` the first ones.  Nulls come first where it ascends and last where it descends.  Rows before are filtered, not sorted and skipped."""
    keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order]
    if last is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for c, down in order:
            value = F.lit(last[c])
            if last[c] is None:
                step = F.lit(False) if down else F.col(c).isNotNull()
            else:
                step = (F.col(c) < value) | F.col(c).isNull() if down else F.col(c) > value
            beyond = beyond | (equal & F.coalesce(step, F.lit(False)))
            equal = equal & F.col(c).eqNullSafe(value)
        rows = rows.where(beyond)
    return rows.orderBy(*keys).limit(size)
