"""One query per operator over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costbook.llm import chat, credentials, decontaminate, lines, manifest, mixing, near, packing, shards, topk, toxicity, tries, urls
from costbook.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-shards")
    shards.write_shards(table(spark, folder, "documents"), path, vocabulary("word_bpe_49k.json"), end=2)
    return shards.read_shards(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "shard")


@query
def op8_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), capacity=2048, end=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


@query
def op2_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup_lines(table(spark, folder, "documents")).select("doc_id", "text", "removed_lines")


SQL["op2_line_spread"] = lines.SQL


@query
def op3_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("row")


SQL["op3_benchmark_leaks"] = decontaminate.SQL


RULES = (urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/"))


@query
def op4_url_words(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), RULES)


@query
def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return topk.top_k(asked, rows, k=20, scale=64)


SQL["op5_exact_top_k"] = topk.SQL


@query
def op6_reply_trees(spark: SparkSession, folder: str) -> DataFrame:
    own = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.format_trees(chat.linear_nodes(turns), keep=1))


SQL["op6_reply_trees"] = chat.SQL


@query
def op7_secret_formats(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.digest(credentials.find_secrets(table(spark, folder, "documents")))


@query
def op9_toxicity_ftrl(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op10_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near.classes(table(spark, folder, "documents")).select("doc_id", "class_id")


@query
def op11_threshold_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_counts(table(spark, folder, "documents"))


SQL["op11_threshold_mix"] = mixing.SQL


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return tries.prefix_nodes(tries.rebuilt(tries.conversations(table(spark, folder, "conversations"))))


SQL["op12_prefix_trie"] = tries.SQL


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.verify(table(spark, folder, "documents"), manifest.tampered())


SQL["op13_merkle_manifest"] = manifest.sql(tries.crc32_sql("CAST(doc_id AS VARCHAR)"))
