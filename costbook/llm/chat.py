"""Chat formatting: the best branches of reply trees as training conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costbook.session import settle

# The marks around a turn of each role; any other role is named between the first two.
ROLES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>")
CONTROL = r"<</?(?:SYS|ROLE|TURN)>>|\[/?INST\]|</?s>"
TURN = r"(?s)(<<SYS>>|\[INST\] |<s>|<<ROLE>>.*?<</ROLE>>)(.*?)(<</SYS>>| \[/INST\]|</s>|<</TURN>>)"


def escape(text: Column) -> Column:
    r"""No control string is left in the text: each ``\`` is doubled, then a ``\`` goes in after a control string's first sign."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"(?=(?:{CONTROL}))(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node on the way from each leaf to its root, ``up`` steps above the leaf.

    Iterative self-joins by doubling: a table of jumps by 1, 2, 4, ... steps, until no jump is left, then from the longest
    jump down each way is filled in.  Rounds grow with the logarithm of the depth.  Joins are on (tree, node), which is
    unique on one side; the other side's frequent keys are nodes with many replies, whose rows Spark's skew join splits.
    """
    link = settle(nodes.where("parent is not null").select("tree", "node", F.col("parent").alias("to")))
    # a parent that is not there ends the way
    known = nodes.select("tree", F.col("node").alias("to"))
    jumps = [settle(link.join(known, ["tree", "to"], "left_semi"))]
    # no way is longer than there are nodes
    rounds = jumps[0].count().bit_length() + 1
    while not jumps[-1].isEmpty():
        if len(jumps) > rounds:
            raise ValueError("a node is its own ancestor")
        jump = jumps[-1]
        further = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("end"))
        jumps.append(settle(jump.join(further, ["tree", "to"]).select("tree", "node", F.col("end").alias("to"))))
    leaves = nodes.join(link.select("tree", F.col("to").alias("node")).distinct(), ["tree", "node"], "left_anti")
    way = settle(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    for k in range(len(jumps) - 2, -1, -1):
        step = way.join(jumps[k], ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        way = settle(way.unionByName(step))  # else the plan doubles each round
    return way


def best_branches(nodes: DataFrame, keep: int | None) -> DataFrame:
    """(tree, leaf, rank, turns): the ``keep`` branches of each tree (None: all) with the highest sum of scores, ties to the
    smaller leaf; turns: array of (up, role, text), root first."""
    way = paths(nodes)
    on_way = way.join(nodes.select("tree", "node", "role", "text", "score"), ["tree", "node"])
    branches = on_way.groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0))).alias("total"))
    ranked = branches.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")))
    if keep is not None:
        ranked = ranked.where(F.col("rank") <= keep)
    turn = F.struct((-F.col("up")).alias("at"), "role", "text")
    return on_way.join(ranked.select("tree", "leaf", "rank"), ["tree", "leaf"]).groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_branches(branches: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): the template's text, and the spans (start, length, in code points) of the
    assistant's texts in it."""
    role, text = (lambda t: F.coalesce(t["role"], F.lit(""))), (lambda t: escape(F.coalesce(t["text"], F.lit(""))))

    def opening(t: Column) -> Column:
        out = F.concat(F.lit(OTHER[0]), escape(role(t)), F.lit(OTHER[1]))
        for name, (mark, _) in ROLES.items():
            out = F.when(role(t) == name, F.lit(mark)).otherwise(out)
        return out

    def closing(t: Column) -> Column:
        out = F.lit(OTHER[2])
        for name, (_, mark) in ROLES.items():
            out = F.when(role(t) == name, F.lit(mark)).otherwise(out)
        return out

    parts = branches.select("tree", "leaf", "rank", F.transform("turns", lambda t: F.struct(
        opening(t).alias("open"), text(t).alias("body"), closing(t).alias("close"), (role(t) == "assistant").alias("learn"))).alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["open"])
        span = F.array(F.struct(begin.alias("start"), F.length(p["body"]).alias("length")))
        return F.struct((begin + F.length(p["body"]) + F.length(p["close"])).alias("at"),
                        F.when(p["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return parts.select("tree", "leaf", "rank", F.array_join(F.transform("parts", lambda p: F.concat(p["open"], p["body"], p["close"])), "").alias("formatted"),
                        F.aggregate("parts", start, step, lambda s: s["spans"]).alias("loss"))


def format_trees(nodes: DataFrame, keep: int | None = 1) -> DataFrame:
    """Conversations from reply trees: nodes (tree, node, parent, role, text, score) to (tree, leaf, rank, formatted, loss).

    A node with a null parent, or with one that is not in the table, is a root; nodes without replies are leaves; each chosen branch
    is one conversation.  A null text or role is empty, a null score 0; a null tree or node takes no part; of repeated (tree, node) rows one (the least)
    stays; a circle of parents without a leaf gives nothing, one with a leaf fails; other columns are ignored; an empty table gives no rows.
    A conversation is one value of its row.
    """
    own = nodes.select("tree", "node", "parent", "role", "text", "score").where("tree is not null and node is not null")
    one = own.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("n")).select("tree", "node", "n.*")
    return format_branches(best_branches(settle(one), keep))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    def turn(x: Column) -> Column:
        mark, body = F.regexp_extract(x, TURN, 1), F.regexp_extract(x, TURN, 2)
        role = unescape(F.regexp_extract(mark, rf"(?s)^{OTHER[0]}(.*){OTHER[1]}$", 1))
        for name, (open_, _) in ROLES.items():
            role = F.when(mark == open_, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), 0), turn)


def linear_nodes(turns: DataFrame) -> DataFrame:
    """Conversations by turn (conv_id, turn, role, text) as trees of one branch; equal turns in order of role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.where("conv_id is not null").select(F.col("conv_id").alias("tree"), "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digest(conversations: DataFrame) -> DataFrame:
    """Counts and hashes of formatted conversations, all read back from the formatted text and the spans."""
    back = conversations.select(F.col("tree").alias("conv_id"), "formatted", read_back(F.col("formatted")).alias("turns"), unescape(F.array_join(
        F.transform("loss", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["length"])), "")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
WITH turn AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '<</?(?:SYS|ROLE|TURN)>>|\[/?INST\]|</?s>'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 26 + length(role) END AS chars FROM turn)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""
