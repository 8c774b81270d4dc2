"""Block packing in chunks against one plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from costbook.operators import blocks as B


def plain(items, capacity):
    out, group, block, held = [], None, 1, set()
    for g, pos, nid, labels in sorted(items, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        if g != group or group is None and not out:
            group, block, held = g, 1, set()
        wanted = list(dict.fromkeys(x for x in labels or [] if x is not None))
        new = [x for x in wanted if x not in held]
        if held and len(held) + len(new) > capacity:
            block, held, new = block + 1, set(), wanted
        for at in range(0, max(len(new), 1), capacity):
            if at:
                block, held = block + 1, set()
            held |= set(new[at:at + capacity])
            out.append((g, nid, block, len(new[at:at + capacity])))
    return out


def run(spark, items, capacity, chunk):
    frame = spark.createDataFrame(items, "g string, pos long, norm_ID long, labels array<string>").repartition(5)
    got = B.pack(frame, ["g"], [F.col("pos"), F.col("norm_ID")], "norm_ID", capacity, chunk)
    return sorted((tuple(r) for r in got.select("g", "norm_ID", "block", "kept").collect()), key=repr)


@pytest.mark.parametrize("capacity,chunk", [(5, 3), (7, 10), (3, 1)])
def test_equals_one_walk(spark, capacity, chunk):
    dice = random.Random(capacity)
    pick = lambda n, of: [f"r{dice.randrange(of)}" for _ in range(n)]
    items = [("hot", k, k, pick(dice.randrange(4), 12)) for k in range(200)]
    items += [("wide", k, 1000 + k, pick(dice.choice([0, 0, 1, 2, 17]), 40)) for k in range(60)]
    items += [("empty first", k, 2000 + k, [] if k < 8 else pick(12, 30)) for k in range(14)]
    items += [("few labels", k, 3000 + k, pick(2, 3)) for k in range(40)] + [(None, 1, 4000, ["a", None, "a"]), (None, 1, 4001, None), ("one", 1, 5000, pick(30, 90))]
    assert run(spark, items, capacity, chunk) == sorted(plain(items, capacity), key=repr)


def test_no_items(spark):
    assert run(spark, [], 5, 3) == []


def test_a_hot_list_runs_in_many_tasks(spark):
    items = spark.range(4000).select(F.lit("hot").alias("g"), F.col("id").alias("pos"), F.col("id").alias("norm_ID"), F.array(F.concat(F.lit("r"), F.col("id") % 97)).alias("labels"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    packed = B.pack(items, ["g"], [F.col("pos"), F.col("norm_ID")], "norm_ID", 55, 100)
    tasks = packed.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) > 1 and packed.agg(F.max("block")).first()[0] == -(-4000 // 55)
