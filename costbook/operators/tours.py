"""Interval labels of trees: each node's place at the start and the end of a walk around its tree.

A subtree is what lies between a node's two places, so roll-ups are differences of running sums and no row
is made for every node and ancestor.  The places come from list ranking: each step of the walk knows the next one, and pointer jumping counts the
steps to the end in a logarithmic number of rounds, whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costbook.operators.ordered import chunk_of, numbered, scan
from costbook.session import settle

WIDTH = 4096  # places of a stretch by which intervals and nodes meet


def _steps(chapters: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, side, to, to_side): the walk's next step after entering (side 0) and after leaving (side 1) each node; none after a root."""
    own = chapters.select(F.col(node).alias("node"), F.when((F.col(parent).cast("string") != "0") & (F.col(parent) != F.col(node)), F.col(parent)).alias("up"))
    known = own.select(F.col("node").alias("up"), F.lit(True).alias("known"))
    own = settle(own.join(known, "up", "left").select("node", F.when(F.col("known"), F.col("up")).alias("up")))
    kids = settle(numbered(own.where("up is not null"), [F.col("node")], "nth", ["up"]).select("up", "node", "nth"))
    first = kids.where("nth = 1").select(F.col("up").alias("node"), F.col("node").alias("to"))
    enter = own.select("node").join(first, "node", "left").select("node", F.lit(0).alias("side"), F.coalesce("to", "node").alias("to"), F.when(F.col("to").isNull(), 1).otherwise(0).alias("to_side"))
    after = kids.select("up", (F.col("nth") - 1).alias("nth"), F.col("node").alias("sibling"))
    leave = kids.join(after, ["up", "nth"], "left").select("node", F.lit(1).alias("side"), F.coalesce("sibling", "up").alias("to"), F.when(F.col("sibling").isNull(), 1).otherwise(0).alias("to_side"))
    ends = own.where("up is null").select("node", F.lit(1).alias("side"), F.lit(None).alias("to"), F.lit(None).cast("int").alias("to_side"))
    return enter.unionByName(leave).unionByName(ends)


def tour(chapters: DataFrame, node: str = "chap_ID", parent: str = "chap_PID") -> DataFrame:
    """(node, root, enter, leave) of every node that hangs on a root.  A parent that is 0, the node itself or missing makes a root; nodes on
    or below a circle have no root and no row.  Places count from 0 in each root's tree."""
    steps = settle(_steps(chapters, node, parent))
    rounds = steps.count().bit_length() + 1
    blank = F.when(F.col("to").isNull(), F.col("node"))
    now = settle(steps.select("node", "side", "to", "to_side", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("left"), blank.alias("root")))
    for _ in range(rounds):
        if now.where("root is null").isEmpty():
            break
        then = now.select(F.col("node").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("to2"), F.col("to_side").alias("to_side2"), F.col("left").alias("left2"), F.col("root").alias("root2"))
        # steps that know the way to the end have no key to meet at any more
        moved = now.where("root is null").join(then, ["to", "to_side"]).select(
            "node", "side", F.col("to2").alias("to"), F.col("to_side2").alias("to_side"), (F.col("left") + F.col("left2")).alias("left"), F.col("root2").alias("root"))
        now = settle(now.where("root is not null").unionByName(moved))
    done = now.where("root is not null")
    last = done.groupBy("root").agg(F.max("left").alias("last"))
    placed = done.join(last, "root").select("node", "root", "side", (F.col("last") - F.col("left")).alias("place"))
    return settle(placed.groupBy("node", "root").agg(F.min("place").alias("enter"), F.max("place").alias("leave")))


def _running(places: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, before, upto): the running sum of ``weights`` (node, enter_weight, leave_weight) along the walk before a node is entered and after it is left."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    both = places.join(weights, "node", "left").select("node", "root", F.explode(F.array(
        F.struct(F.col("enter").alias("place"), F.lit(0).alias("side"), zero("enter_weight").alias("w")), F.struct(F.col("leave").alias("place"), F.lit(1).alias("side"), zero("leave_weight").alias("w")))).alias("e"))
    rows = both.select("node", "root", "e.place", "e.side", "e.w")
    summed = scan(rows, ["root"], [F.col("place")], chunk_of(F.col("place")), total={"sum": F.col("w")})
    return summed.groupBy("node").agg(F.max(F.when(F.col("side") == 0, F.col("sum") - F.col("w"))).alias("before"), F.max(F.when(F.col("side") == 1, F.col("sum"))).alias("upto"),
                                      F.max(F.when(F.col("side") == 0, F.col("sum"))).alias("inside"))


def below(places: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, total): sum of ``weights`` (node, weight), one row a node at most, over each node's subtree, itself included."""
    sums = _running(places, weights.select("node", F.col("weight").alias("enter_weight"), F.lit(0).alias("leave_weight")))
    return sums.select("node", (F.col("upto") - F.col("before")).alias("total"))


def covered(places: DataFrame, seeds: DataFrame) -> DataFrame:
    """The nodes (node) of the subtrees of ``seeds`` (node), each once."""
    own = seeds.select("node").distinct()
    sums = _running(places, own.select("node", F.lit(1).alias("enter_weight"), F.lit(-1).alias("leave_weight")))
    return sums.where("inside > 0").select("node")


def inside(places: DataFrame, roots: DataFrame) -> DataFrame:
    """(ancestor, node) for each of ``roots`` (node) and every node of its subtree, itself included.  Intervals meet nodes by stretches of places."""
    asked = roots.select("node").distinct().join(places, "node").select(F.col("node").alias("ancestor"), "root", F.col("enter").alias("from"), F.col("leave").alias("to"))
    asked = asked.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("from") / WIDTH), F.floor(F.col("to") / WIDTH))))
    held: Column = F.col("enter").between(F.col("from"), F.col("to"))
    return asked.join(places.select("root", "node", "enter", F.floor(F.col("enter") / WIDTH).alias("stretch")), ["root", "stretch"]).where(held).select("ancestor", "node")
