"""Reading whole libraries, stacking source books, optional columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Document keys and the table family each belongs to.
PAGE_FAMILY = ("document", "chapter", "section_text", "appendix_table", "appendix_row", "norms_table",
               "norms_item", "page_index")
NORM_FAMILY = ("chapter", "Norm", "Consumption", "Content", "enterprise_item", "norm_source",
               "division", "sub_division", "nrm_item")
SECTION_FAMILY = ("chapters", "sections", "quota_items", "quota_consumptions")
MASTER_FAMILY = ("resource", "resource_alias", "resource_usage", "resource_price", "price_pack",
                 "price_quote", "quote_match", "price_anchor", "benchmark_obs")


def resolve_document(doc: str, families: Mapping[str, tuple[str, ...]]) -> tuple[str, tuple[str, ...]]:
    """Document key to (key, tables); ``nrm_<doc>`` reads the book ``<doc>``."""
    key = doc[4:] if doc.startswith("nrm_") and doc not in families else doc
    if key not in families:
        raise KeyError(f"unknown document: {doc}")
    return key, families[key]


def read_library(spark: SparkSession, root: str, doc: str,
                 families: Mapping[str, tuple[str, ...]]) -> dict[str, DataFrame]:
    """Tables of one document below ``root/<table>`` partitioned by ``doc``; absent tables are left out."""
    key, tables = resolve_document(doc, families)
    found = {t: spark.read.parquet(f"{root}/{t}").filter(F.col("doc") == key)
             for t in tables if path_exists(spark, f"{root}/{t}")}
    if not found:
        raise FileNotFoundError(f"no table of {doc} below {root}")
    return found


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def stack_sources(sources: Mapping[str, DataFrame], columns: list[str]) -> DataFrame:
    """Chosen columns of every source book under its source id; absent columns become null."""
    parts = [df.select(F.lit(source).alias("source_id"), *[col_or(df, c, None).alias(c) for c in columns])
             for source, df in sources.items()]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def replace_sources(df: DataFrame, path: str) -> None:
    """Writes stacked sources; a rerun replaces the source ids it holds and no others."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("source_id").parquet(path))


def col_or(df: DataFrame, name: str, default: object) -> Column:
    """The column where the table has it, else the default."""
    return F.col(name) if name in df.columns else F.lit(default)
