"""Subtree questions by interval labels and by pairs, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from costbook.operators import hierarchy as H
from costbook.operators import tours as T


def forest(dice, n):
    rows = [(k, 0 if k < 4 else dice.randrange(max(0, k - 6), k)) for k in range(1, n)]
    return [*rows, (9001, 9002), (9002, 9003), (9003, 9001), (9004, 9001), (9005, 9004), (9100, 7777), (9101, 9100), (9200, 9200)]


def ancestors(rows):
    up = dict(rows)
    out = {}
    for v in up:
        seen = []
        while v is not None and v not in seen:
            seen.append(v)
            p = up[v]
            v = p if p != 0 and p != v and p in up else None
        out[seen[0]] = seen
    return out


@pytest.mark.parametrize("width", [5, 4096])
def test_deep_trees_and_circles(spark, monkeypatch, width):
    monkeypatch.setattr(T, "WIDTH", width)
    dice = random.Random(3)
    rows = forest(dice, 80)
    up = ancestors(rows)
    assert max(map(len, up.values())) > 8
    frame = spark.createDataFrame(rows, "chap_ID long, chap_PID long")
    sub = H.Subtrees(frame)
    assert sub.places is not None
    weights = {v: dice.randrange(5) for v in up if dice.random() < 0.6}
    w = spark.createDataFrame(list(weights.items()), "node long, weight long")
    got = {r["node"]: r["total"] for r in sub.totals(w).collect()}
    for v in up:
        assert got.get(v, 0) == sum(x for u, x in weights.items() if v in up[u]), v
    roots = [4, 7, 11, 9001, 9100, 9200, 12345]
    asked = spark.createDataFrame([(r,) for r in roots], "node long")
    assert sorted(map(tuple, sub.below(asked).collect())) == sorted((r, v) for v in up for r in roots if r in up[v])
    assert sorted(r["node"] for r in sub.covered(asked).collect()) == sorted(v for v in up if set(roots) & set(up[v]))


def test_a_long_chain_makes_no_pairs(spark):
    n = 1500
    frame = spark.range(1, n + 1).select(F.col("id").alias("chap_ID"), (F.col("id") - 1).alias("chap_PID"))
    sub = H.Subtrees(frame)
    assert sub.pairs.isEmpty()
    got = {r["node"]: r["total"] for r in sub.totals(frame.select(F.col("chap_ID").alias("node"), F.lit(1).alias("weight"))).collect()}
    assert got == {v: n - v + 1 for v in range(1, n + 1)}


def test_empty(spark):
    frame = spark.createDataFrame([], "chap_ID long, chap_PID long")
    assert H.Subtrees(frame).below(spark.createDataFrame([(1,)], "node long")).count() == 0 and T.tour(frame).count() == 0
