"""Similarity joins over postings: texts are sets of numbered tokens, rarest first, and meet at the first one they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costbook.operators.ordered import numbered
from costbook.session import settle

PAIRS = 1 << 20  # pairs of postings of one key that one task should see
SHORT = 12  # texts of so many tokens, which make at most 66 keys of two
SIGN_BITS = 21  # a sign's code point takes at most so many bits
Keys = Callable[[Column], Column]


def characters(text: Column) -> Column:
    """The characters of a text, each with the number of the same before it, so that what two such sets share is what two texts share."""
    whole = F.coalesce(text, F.lit(""))
    chars = F.filter(F.split(whole, ""), lambda c: c != "")

    def nth(c: Column, i: Column) -> Column:
        before = F.substr(whole, F.lit(1), i)
        return F.concat(c, (F.length(before) - F.length(F.replace(before, c, F.lit("")))).cast("string"))

    return F.transform(chars, nth)


def codes(signs: Column) -> Column:
    """Distinct signs as ascending code points."""
    return F.sort_array(F.transform(signs, lambda c: F.ascii(c).cast("long")))


def choices(side: DataFrame, points: str, size: int) -> DataFrame:
    """A row for each choice of ``size`` (at most 3) of a text's code points, as one number ``key`` in place of ``points``."""
    keep = [c for c in side.columns if c != points]
    out = side.select("*", F.lit(0).cast("long").alias("key"), F.lit(1).alias("_from"))
    # sign by sign, as nested lambdas over arrays take many times as long
    for _ in range(size):
        rest = F.posexplode(F.slice(points, F.col("_from"), F.size(points)))
        out = out.select("*", rest.alias("_at", "_sign")).select(
            *keep, points, (F.shiftleft("key", SIGN_BITS) + F.col("_sign")).alias("key"), (F.col("_from") + F.col("_at") + 1).alias("_from"))
    return out.select(*keep, "key")


def numbered_tokens(*sides: DataFrame) -> list[DataFrame]:
    """The sides (id, tokens of strings, more) with their tokens as ascending numbers, the rarest token having the lowest one."""
    exploded = [s.select("id", F.explode("tokens").alias("token")) for s in sides]
    every = exploded[0].select("token")
    for e in exploded[1:]:
        every = every.unionByName(e.select("token"))
    # one row per token of the alphabet
    ranks = numbered(every.groupBy("token").agg(F.count(F.lit(1)).alias("n")), [F.col("n"), F.col("token")], "number")
    ranks = ranks.select("token", F.col("number").cast("int").alias("number"))
    out = []
    for s, e in zip(sides, exploded):
        lists = e.join(ranks, "token").groupBy("id").agg(F.sort_array(F.collect_list("number")).alias("tokens"))
        out.append(settle(s.drop("tokens").join(lists, "id")))
    return out


def common_numbers(left: DataFrame, right: DataFrame) -> DataFrame:
    """(token, number) of the tokens that both sides hold, the rarest having the lowest number; the others bring no texts together."""
    counts = [s.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias(n)) for s, n in ((left, "_l"), (right, "_r"))]
    both = counts[0].join(counts[1], "token").select("token", (F.col("_l") + F.col("_r")).alias("n"))
    return numbered(both, [F.col("n"), F.col("token")], "number").select("token", F.col("number").cast("int").alias("number"))


def _sized(side: DataFrame, p: str) -> DataFrame:
    """The side with the sizes of its sets, where tokens that the other side lacks are left out and counted before."""
    return side if f"{p}_n" in side.columns else side.withColumn(f"{p}_n", F.size(f"{p}_tokens"))


def _postings(side: DataFrame, p: str, keys: Keys, width: int) -> DataFrame:
    """A row for each key: one or two of the foremost tokens, with the number of tokens that the key and what is behind it hold."""
    own, n = _sized(side, p), F.size(f"{p}_tokens")
    # tokens that are left out are never among the shared ones
    first = F.slice(f"{p}_tokens", F.lit(1), F.greatest(keys(F.col(f"{p}_n")) - F.col(f"{p}_n") + n, F.lit(0)).cast("int"))
    if width == 1:
        return own.select("*", F.posexplode(first).alias("_at", "token")).withColumn(f"{p}_left", n - F.col("_at")).drop("_at")
    twos = F.flatten(F.transform(first, lambda x, i: F.transform(
        F.slice(first, i + 2, F.size(first)), lambda y, j: F.struct((n - i - j).alias("left"), (F.shiftleft(x.cast("long"), 32) + y).alias("token")))))
    return own.select("*", F.explode(twos).alias("_key")).select("*", F.col("_key.left").alias(f"{p}_left"), F.col("_key.token").alias("token")).drop("_key")


def meet(left: DataFrame, right: DataFrame, by: Sequence[str], l_keys: Keys, r_keys: Keys, enough: Callable[[Column, Column, Column], Column], also: Column | None = None,
         width: int = 1) -> DataFrame:
    """Pairs of left (by, l_id, l_tokens, more) and right (by, r_id, r_tokens, more), with l_n, r_n and shared, that pass ``enough`` (n, n, shared).

    ``l_keys`` and ``r_keys`` tell from a text's size how many of its foremost tokens are keys; of a pair that passes, the first
    shared token must be one on both sides.  A pair appears once, at that token.  With a ``width`` of 2 the keys are two tokens each, and the first two shared
    ones must be among the foremost on both sides.  Each posting bounds what the pair can share by
    what is left behind it, so most pairs end before their tokens are compared.  Numbers alone take part, no texts.
    Sides may leave out tokens that the other lacks, if l_n and r_n count them.
    A key whose postings make too many pairs is split: one side's postings are dealt out, the other's are repeated.
    """
    l, r = _postings(left, "l", l_keys, width), _postings(right, "r", r_keys, width)
    on = [*by, "token"]
    counts = l.groupBy(*on).agg(F.count(F.lit(1)).alias("_l")).join(r.groupBy(*on).agg(F.count(F.lit(1)).alias("_r")), on)
    hot = counts.select(*on, F.ceil(F.col("_l") * F.col("_r") / PAIRS).cast("int").alias("_split")).where("_split > 1")
    parts = F.coalesce("_split", F.lit(1))
    l = l.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_split")
    r = r.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64("r_id"), parts).cast("int")).drop("_split")
    met = l.join(r, [*on, "_part"])
    if also is not None:
        met = met.where(also)
    met = met.where(enough(F.col("l_n"), F.col("r_n"), F.least("l_left", "r_left")))
    common = lambda i: F.get("_common", F.lit(i))
    first = common(0) if width == 1 else F.shiftleft(common(0).cast("long"), 32) + common(1)
    met = met.withColumn("_common", F.array_intersect("l_tokens", "r_tokens")).where(first == F.col("token"))
    met = met.withColumn("shared", F.size("_common")).where(enough(F.col("l_n"), F.col("r_n"), F.col("shared")))
    return met.drop("_common", "_part", "token", "l_left", "r_left", "l_tokens", "r_tokens")


def behind(least: Column, n: Column) -> Column:
    """How many foremost tokens of n hold one of any ``least`` shared ones."""
    return n - least + 1


def contained(left: DataFrame, right: DataFrame, by: Sequence[str], share: float, least: int, enough: Callable[[Column, Column, Column], Column], also: Column | None = None,
              short: bool = True) -> DataFrame:
    """Pairs that share at least ``share`` of the smaller set and ``least`` tokens: the smaller one's foremost tokens meet any of the larger one's.

    Where two tokens must be shared, sets of at most ``SHORT`` meet at keys of two, so a frequent token alone brings none together;
    without ``short`` pairs of such sets are left out.
    """
    every: Keys = lambda n: n
    left, right = _sized(left, "l"), _sized(right, "r")

    def met(l: DataFrame, r: DataFrame, width: int) -> DataFrame:
        some: Keys = lambda n: behind(F.greatest(F.lit(least), F.ceil(n * share - 1e-9)), n) + (width - 1)
        l_size, r_size = F.col("l_n"), F.col("r_n")
        l_short, r_short = (l, r) if least < 2 else (l.where(l_size <= SHORT), r.where(r_size <= SHORT)) if width == 2 else (l.where(l_size > SHORT), r.where(r_size > SHORT))
        extra = l_size <= r_size
        small_left = meet(l, r_short, by, some, every, enough, extra if also is None else extra & also, width)
        extra = l_size > r_size
        return small_left.unionByName(meet(l_short, r, by, every, some, enough, extra if also is None else extra & also, width))

    # the larger set's size tells how a pair meets
    return met(left, right, 1) if least < 2 or not short else met(left, right, 1).unionByName(met(left, right, 2))


def overlapping(left: DataFrame, right: DataFrame, by: Sequence[str], ratio: Column | float, also: Column | None = None) -> DataFrame:
    """Pairs with 2 * shared >= ratio * (n + m); ``ratio``, above 0, may be a column of the left side.  Right sides give keys for the least ratio asked."""
    ratio = F.lit(ratio) if isinstance(ratio, float) else ratio
    own = left.withColumn("_ratio", ratio)
    lowest = own.agg(F.min("_ratio")).first()[0]
    if lowest is None:
        return meet(left.limit(0), right, by, lambda n: n, lambda n: n, lambda n, m, s: F.lit(True))
    # a partner has at least ratio / (2 - ratio) of the tokens, and so many are shared
    l_keys: Keys = lambda n: behind(F.ceil(n * F.col("_ratio") / (2 - F.col("_ratio")) - 1e-9), n)
    r_keys: Keys = lambda n: behind(F.ceil(n * (lowest / (2 - lowest)) - 1e-9), n)
    enough = lambda n, m, s: 2 * s >= F.col("_ratio") * (n + m) - 1e-9
    return meet(own, right, by, l_keys, r_keys, enough, also).drop("_ratio")
