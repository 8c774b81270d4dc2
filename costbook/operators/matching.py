"""Fuzzy matching: unpriced resources to quotes, norms and chapters to the leaves of another tree.

Names repeat far more often than they differ, so distinct texts are compared and the results joined back.  Texts
are ids and sets of numbered characters until the best are known.  Candidates are sought in rounds of falling
thresholds: what a round cannot reach scores less than its threshold, so a text that has enough above it is done, and
only the others meet more partners in the next round.  The last round has no threshold, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costbook.functions import names as A
from costbook.functions import similarity as S
from costbook.operators import postings as P
from costbook.operators.coverage import gap_ranking
from costbook.operators.provenance import top_per_key
from costbook.session import settle, stored

ROUGH = 40
MIN_SCORE = 0.34
ROUGH_ROUNDS = (0.7, 0.35, 0.0)
SCORE_ROUNDS = (S.CONTAINED, 0.6, 0.35, 0.0)
ANY = 1e-9  # a ratio that one shared token reaches
LIFT = 0.15  # for each category that two chapters share


def _with_id(rows: DataFrame) -> DataFrame:
    """The rows written with an id of their own."""
    return settle(rows.withColumn("id", F.monotonically_increasing_id()))


def _rough(n: Column, m: Column, shared: Column) -> Column:
    """The prefilter from sizes: larger of Jaccard and 0.7 times containment, 0 below two shared characters."""
    return F.when(shared < 2, F.lit(0.0)).otherwise(F.greatest(shared / (n + m - shared), shared / F.least(n, m) * 0.7))


def _sides(targets: DataFrame, quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets (l_id, l_n, l_signs) and quote texts (r_id, r_n, r_signs, quotes) as code points."""
    l = targets.select(F.col("id").alias("l_id"), F.size("tokens").alias("l_n"), P.codes(F.col("tokens")).alias("l_signs"))
    r = quotes.select(F.col("id").alias("r_id"), F.size("tokens").alias("r_n"), P.codes(F.col("tokens")).alias("r_signs"), "quotes")
    return l.where(F.col("l_n") >= 2), r.where(F.col("r_n") >= 2)


def _foremost(pairs: DataFrame, rough: int) -> DataFrame:
    """The ``rough`` best quote texts of each target; equal scores go to the text with the lower quote id."""
    return top_per_key(pairs, ["l_id"], [F.col("rough").desc(), F.col("r_id")], rough, "_p").drop("_p")


def short_pairs(targets: DataFrame, quotes: DataFrame, rough: int) -> DataFrame:
    """As ``leading_pairs`` for texts of 2 to ``SHORT`` signs, each target's ``rough`` best.

    Texts meet at each three signs that they share, which rarely are many, and their number tells how many signs they share.  Where exactly two signs are
    shared the sizes tell the score, so of all quote texts of one size that hold two signs only the ``rough`` first can count: those share two signs at least.
    """
    l, r = _sides(targets, quotes)
    l, r = l.where(F.col("l_n") <= P.SHORT), r.where(F.col("r_n") <= P.SHORT)
    n, m = F.col("l_n"), F.col("r_n")

    # the targets' keys are far fewer, so the quotes' need no sort
    met = P.choices(r, "r_signs", 3).join(P.choices(l, "l_signs", 3).hint("shuffle_hash"), "key").select("l_id", "r_id", "l_n", "r_n", "quotes")
    times = met.repartition("l_id").groupBy(*met.columns).agg(F.count(F.lit(1)).alias("times"))
    # s signs make s * (s - 1) * (s - 2) / 6 threes
    shared = F.round(F.cbrt(6 * F.col("times")) + 1)
    of_three = stored(_foremost(times.select("l_id", "r_id", _rough(n, m, shared).alias("rough"), "quotes"), rough), "pairs")
    lowest = of_three.groupBy("l_id").agg(F.when(F.count(F.lit(1)) >= rough, F.min("rough")).otherwise(0.0).alias("least"))
    sizes = F.array(*[F.lit(x["r_n"]) for x in r.select("r_n").distinct().collect()]).cast("array<int>")  # at most ``SHORT`` of them
    of_two = lambda size: _rough(n, size, F.lit(2))
    asked = l.join(lowest, "l_id", "left").select(
        "l_id", "l_n", "l_signs", F.explode(F.filter(sizes, lambda size: of_two(size) >= F.coalesce("least", F.lit(0.0)) - 1e-9)).alias("r_n"))
    first = top_per_key(P.choices(r, "r_signs", 2), ["key", "r_n"], [F.col("r_id")], rough, "_k").drop("_k")
    more = first.join(P.choices(asked, "l_signs", 2), ["key", "r_n"]).select("l_id", "r_id", of_two(m).alias("rough"), "quotes")
    # some of these share more signs, then the better score is the true one
    both = of_three.unionByName(more).repartition("l_id").groupBy("l_id", "r_id", "quotes").agg(F.max("rough").alias("rough"))
    return _foremost(both, rough)


def leading_pairs(targets: DataFrame, quotes: DataFrame, rough: int, rounds: Sequence[float] = ROUGH_ROUNDS) -> DataFrame:
    """(l_id, r_id, rough, quotes) of target and quote texts, for each target at least those that hold its ``rough`` best quotes.

    ``targets`` (id, tokens), ``quotes`` (id, tokens, quotes), where quotes counts the quotes of a text (enough: up to ``rough``) and ids ascend with the texts' lowest quote ids.
    """
    found = short_pairs(targets, quotes, rough)
    lengthy = [not side.where(F.size("tokens") > P.SHORT).isEmpty() for side in (targets, quotes)]
    if not any(lengthy):
        return found
    # pairs with a longer text, in rounds
    found = stored(found, "pairs")
    t_side, q_side = P.numbered_tokens(targets.select("id", "tokens"), quotes.select("id", "tokens", "quotes"))
    open_ = t_side.select(F.col("id").alias("l_id"), F.col("tokens").alias("l_tokens"))
    right = q_side.select(F.col("id").alias("r_id"), F.col("tokens").alias("r_tokens"), "quotes")
    done = [found]
    for least in rounds:
        # a prefilter of ``least`` needs this share of the smaller text's characters
        share = min(least / 0.7, 2 * least / (1 + least))
        enough = lambda n, m, s, least=least: (s >= 2) & (_rough(n, m, s) >= least - 1e-9)
        met = P.contained(open_, right, [], share, 2, enough, short=False)
        pairs = met.select("l_id", "r_id", _rough(F.col("l_n"), F.col("r_n"), F.col("shared")).alias("rough"), "quotes")
        if least == rounds[-1]:
            done.append(pairs)
            break
        pairs = settle(pairs)
        known = pairs.unionByName(found.where(F.col("rough") >= least))
        full = known.groupBy("l_id").agg(F.sum("quotes").alias("n")).where(F.col("n") >= rough).select("l_id")
        done.append(pairs.join(full, "l_id", "left_semi"))
        open_ = settle(open_.join(full, "l_id", "left_anti"))
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def match_gaps(gaps: DataFrame, quotes: DataFrame, n: int = 6, rough: int = ROUGH, min_score: float = MIN_SCORE) -> DataFrame:
    """Best quotes of every unpriced resource: character prefilter, ``rough`` best, sequence ratio, threshold, n best.

    ``gaps`` (res_ID, name, unit), ``quotes`` (quote_ID, name, unit).  Ties go to the lower quote id.
    """
    squeeze = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    g = gaps.select("res_ID", squeeze("name").alias("t_text"), F.trim(F.coalesce("unit", F.lit(""))).alias("t_unit"))
    q = quotes.select("quote_ID", squeeze("name").alias("q_text"), F.trim(F.coalesce("unit", F.lit(""))).alias("q_unit"))
    t_texts = stored(g.groupBy("t_text").agg(F.collect_set("t_unit").alias("t_units")).withColumn("id", F.monotonically_increasing_id()), "targets")
    # a text's first quotes are all its ranking can use, so hot texts stay bounded
    first = top_per_key(q, ["q_text"], [F.col("quote_ID")], rough, "_q").groupBy("q_text").agg(F.sort_array(F.collect_list(F.struct("quote_ID", "q_unit"))).alias("first"))
    lowest = F.col("first")[0]["quote_ID"]
    ordered = first.repartitionByRange(lowest, F.col("q_text")).sortWithinPartitions(lowest, F.col("q_text"))
    q_texts = stored(ordered.withColumn("id", F.monotonically_increasing_id()).withColumn("quotes", F.size("first")), "quotes")
    pairs = leading_pairs(t_texts.select("id", S.norm_chars(F.col("t_text")).alias("tokens")), q_texts.select("id", S.norm_chars(F.col("q_text")).alias("tokens"), "quotes"), rough)
    # the rough best quotes come from the texts that lead by score, then by their lowest quote id
    leading = _foremost(pairs, rough)
    # of these at most ``rough`` texts, those behind enough better-scored quotes add none
    better = Window.partitionBy("l_id").orderBy(F.col("rough").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tied = Window.partitionBy("l_id", "rough")
    needed = leading.withColumn("_ahead", F.sum("quotes").over(better) - F.sum("quotes").over(tied)).filter(F.col("_ahead") < rough)
    # only now the texts themselves are fetched
    named = needed.select("l_id", "r_id", "rough").join(q_texts.select(F.col("id").alias("r_id"), "q_text", "first"), "r_id")
    offers = top_per_key(named.select("l_id", "rough", "q_text", F.inline("first")), ["l_id"], [F.col("rough").desc(), F.col("quote_ID")], rough, "_r")
    rated = offers.join(t_texts.withColumnRenamed("id", "l_id"), "l_id").withColumn("ratio", S.sequence_ratio(F.col("t_text"), F.col("q_text")))
    same = (F.col("t_unit") != "") & (F.col("t_unit") == F.col("q_unit"))
    score = F.round(F.least(F.lit(1.0), F.col("ratio") + F.when(same, S.UNIT_BONUS).otherwise(0.0)), 3)
    scored = rated.select("*", F.explode("t_units").alias("t_unit")).select(
        "l_id", "t_text", "t_unit", "quote_ID", "rough", score.alias("score"), same.alias("same_unit")).filter(F.col("score") >= min_score)
    # ranked once per distinct text and unit, then handed to every resource of that name
    best = top_per_key(scored, ["l_id", "t_unit"], [F.col("score").desc(), F.col("same_unit").desc(), F.col("rough").desc(), F.col("quote_ID")], n)
    return g.join(best, ["t_text", "t_unit"]).select("res_ID", "quote_ID", "score", "same_unit", "rank")


def _forms(df: DataFrame, name: str, out: str) -> DataFrame:
    """A name's cleaned form and the form without ordinals, worked out once per name and not per pair."""
    cleaned = df.withColumn(out, A.clean_name(F.col(name)))
    return cleaned.withColumn(f"{out}_bare", A.strip_cn_ordinal(F.col(out)))


def _score(a: str, b: str) -> Column:
    return S.match_score(F.col(a), F.col(b), F.col(f"{a}_bare"), F.col(f"{b}_bare"))


def _dealt(pairs: DataFrame, *by: str) -> DataFrame:
    """The pairs dealt to as many tasks as a shuffle has: they are few bytes and much work, so Spark would put them into one or two."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _sets(texts: DataFrame, form: str, lift: Column | None = None) -> DataFrame:
    """The character sets of each text's form and bare form: (text_id, domain, bare, differs, lift, tokens)."""
    kinds = F.explode(F.array(F.struct(F.lit(False).alias("bare"), F.col(form).alias("form")), F.struct(F.lit(True).alias("bare"), F.col(f"{form}_bare").alias("form"))))
    differs = F.col(form) != F.col(f"{form}_bare")
    rows = texts.select(F.col("id").alias("text_id"), "domain", differs.alias("differs"), (F.lit(0.0) if lift is None else lift).alias("lift"), kinds.alias("k"))
    return rows.select("text_id", "domain", "differs", "lift", "k.bare", P.characters(F.col("k.form")).alias("tokens"))


def _left_sets(left: DataFrame, numbers: DataFrame) -> DataFrame:
    """The sets (l_id, domain, bare, l_differs, lift, l_n, l_tokens), their tokens as numbers; a set that meets nothing is kept, empty."""
    own = _with_id(left.where(F.size("tokens") > 0))
    lists = own.select("id", F.explode("tokens").alias("token")).join(numbers, "token").groupBy("id").agg(F.sort_array(F.collect_list("number")).alias("l_tokens"))
    return settle(own.join(lists, "id", "left").select(F.col("text_id").alias("l_id"), "domain", "bare", F.col("differs").alias("l_differs"), "lift", F.size("tokens").alias("l_n"),
                                                       F.coalesce("l_tokens", F.array().cast("array<int>")).alias("l_tokens")))


def _right_classes(right: DataFrame, numbers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts with the same numbered tokens are one class, as they meet the same texts: sets of the classes, named r_id, and members (class, r_id)."""
    own = right.select("text_id", "domain", "differs", "bare", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    marks = own.join(numbers, "token").groupBy("text_id", "domain", "differs").agg(F.sort_array(F.collect_list(F.struct("bare", "n", "number"))).alias("marks"))
    named = settle(marks.withColumn("class", F.md5(F.to_json(F.struct("domain", "differs", "marks")))))

    def kind(bare: bool) -> Column:
        held = F.filter("marks", lambda m: m["bare"] == (F.col("differs") & F.lit(bare)))
        return F.struct(F.lit(bare).alias("bare"), F.get(held, F.lit(0))["n"].alias("r_n"), F.transform(held, lambda m: m["number"]).alias("r_tokens"))

    classes = named.dropDuplicates(["class"]).select(F.col("class").alias("r_id"), "domain", F.col("differs").alias("r_differs"), F.explode(F.array(kind(False), kind(True))).alias("k"))
    sets = settle(classes.select("r_id", "domain", "r_differs", "k.*").where(F.size("r_tokens") > 0))
    return sets, named.select("class", F.col("text_id").alias("r_id"))


def _best(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Highest score per key; of equal scores the lowest leaf."""
    return scores.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("leaf_ID")).alias("neg"))).alias("b")).select(
        *keys, (-F.col("b.neg")).alias("leaf_ID"), F.col("b.score").alias("score"))


def best_leaves(left: DataFrame, right: DataFrame, score: Callable[[DataFrame], DataFrame], more: Callable[[DataFrame, float], DataFrame] | None = None,
                rounds: Sequence[float] = SCORE_ROUNDS) -> DataFrame:
    """(l_id, leaf_ID, score): for each text of ``left`` its best leaf of ``right`` with a score above 0.

    ``left`` and ``right`` are sets of characters (see ``_sets``), several for a text where several of its forms count.  What two forms share bounds
    their ratio; a form that holds the other counts as 0.85 at least, and then shares all its characters.  A score exceeds its ratios
    by at most the left side's lift.  ``score`` adds leaf_ID and score to pairs (l_id, r_id), some of them twice, and may drop pairs; ``more`` gives pairs that may reach a
    threshold without shared characters.
    """
    # where the bare form is the form itself, its set is too
    right = right.where(~F.col("bare") | F.col("differs"))
    numbers = settle(P.common_numbers(left, right))
    l_sets = _left_sets(left, numbers)
    r_sets, members = _right_classes(right, numbers)
    # where no form has ordinals, the bare forms say nothing new
    also = ~F.col("bare") | F.col("l_differs") | F.col("r_differs")
    ids, by = ["l_id", "r_id"], ["domain", "bare"]
    done = []
    for least in rounds:
        near = P.overlapping(l_sets, r_sets, by, F.greatest(F.lit(least) - F.col("lift"), F.lit(ANY)), also).select(*ids)
        if least > 0:
            near = near.unionByName(P.contained(l_sets, r_sets, by, 1.0, 1, lambda n, m, s: s >= F.least(n, m), also).select(*ids))
        # a class is met by its sets, once for all its texts
        near = near.distinct().withColumnRenamed("r_id", "class").join(members, "class").select(*ids)
        if more is not None:
            near = near.unionByName(more(l_sets, least).select(*ids))
        best = _best(score(near).where("score > 0"), ["l_id"])
        if least == rounds[-1]:
            done.append(best)
            break
        best = settle(best.where(F.col("score") >= least))
        done.append(best)
        l_sets = settle(l_sets.join(best.select("l_id"), "l_id", "left_anti"))
        if l_sets.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def _best_by_name(texts: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """(domain, text, leaf_ID, score): the best of ``names`` (domain, target_name, leaf_ID) for each distinct text; none where no character is shared."""
    left = _with_id(_forms(texts.select("domain", text).distinct(), text, "l_form"))
    right = _with_id(_forms(names.select("domain", "target_name", "leaf_ID"), "target_name", "r_form"))
    l_names = left.select(F.col("id").alias("l_id"), "l_form", "l_form_bare")
    r_names = right.select(F.col("id").alias("r_id"), "leaf_ID", "r_form", "r_form_bare")

    def score(pairs: DataFrame) -> DataFrame:
        named = pairs.join(l_names, "l_id").join(r_names, "r_id")
        # leaves that look alike to a text score alike, so the lowest stands for all
        seen = named.select("l_id", "l_form", "l_form_bare", "leaf_ID", *[S.seen_by(F.col(c), F.col("l_form")).alias(c) for c in ("r_form", "r_form_bare")])
        alike = seen.groupBy("l_id", "l_form", "l_form_bare", "r_form", "r_form_bare").agg(F.min("leaf_ID").alias("leaf_ID"))
        return _dealt(alike, "l_form", "r_form").select("l_id", "leaf_ID", _score("l_form", "r_form").alias("score"))

    best = best_leaves(_sets(left, "l_form"), _sets(right, "r_form"), score)
    return left.select(F.col("id").alias("l_id"), "domain", text).join(best, "l_id").drop("l_id")


def leaf_names(leaves: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    """Names a leaf can be found by: its own and those of the norms already in it.

    ``leaves`` (domain, leaf_ID, leaf_name).  Of leaves that share a name the lowest id wins
    every tie, so one row per domain and name is enough.
    """
    names = leaves.select("domain", "leaf_ID", A.strip_code_prefix(F.col("leaf_name")).alias("target_name"))
    if norms is not None:
        held = leaves.select("domain", "leaf_ID").join(
            norms.select(F.col("chap_ID").alias("leaf_ID"), F.col("norm_Name").alias("target_name")), "leaf_ID")
        names = names.unionByName(held.select("domain", "leaf_ID", "target_name"))
    return names.groupBy("domain", "target_name").agg(F.min("leaf_ID").alias("leaf_ID"))


def _first_leaf(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("domain").agg(F.min("leaf_ID").alias("first_leaf"))


def _placed(rows: DataFrame, best: DataFrame, keys: list[str], leaves: DataFrame) -> DataFrame:
    """Rows with their best leaf, else the first leaf of the domain with score 0."""
    joined = rows.join(best, keys, "left").join(_first_leaf(leaves), "domain")
    return joined.withColumn("met", F.col("score").isNotNull()).withColumn("leaf_ID", F.coalesce("leaf_ID", "first_leaf")).withColumn(
        "score", F.coalesce("score", F.lit(0.0)))


def match_leaves(norms: DataFrame, leaves: DataFrame, held: DataFrame, accepted: float = 0.6) -> DataFrame:
    """Best leaf of every norm inside its domain, by leaf name or the names already in the leaf.

    Scores of ``accepted`` and more count as matched, lower ones are kept as fallback, and a
    norm that meets nothing goes to the domain's first leaf.
    """
    best = _best_by_name(norms, "norm_Name", leaf_names(leaves, held))
    kind = F.when(F.col("score") >= accepted, "matched").when(F.col("met"), "fallback").otherwise("first")
    return _placed(norms, best, ["domain", "norm_Name"], leaves).select("norm_ID", "domain", "leaf_ID", "score", kind.alias("kind"))


def match_leaves_with_parent(norms: DataFrame, leaves: DataFrame, held: DataFrame) -> DataFrame:
    """As ``match_leaves``, also scoring the parent's name and parent plus name against the leaf's name."""
    keys = ["domain", "norm_Name", "parent_name"]
    named = norms.withColumn("parent_name", F.coalesce("parent_name", F.lit("")))
    texts = settle(named.select(*keys).distinct().withColumn("parent", A.clean_name(F.col("parent_name"))))
    joint = texts.filter(F.col("parent") != "").withColumn("joint", F.concat_ws(" ", "parent", "norm_Name"))
    # the best leaf of each text alone is all the final choice needs
    of_name = _best_by_name(texts, "norm_Name", leaf_names(leaves, held))
    above = joint.select(*keys, F.explode(F.array("parent", "joint")).alias("text"))
    of_above = _best_by_name(above, "text", leaf_names(leaves))
    offers = (texts.join(of_name, ["domain", "norm_Name"]).select(*keys, "leaf_ID", "score")
              .unionByName(above.join(of_above, ["domain", "text"]).select(*keys, "leaf_ID", "score")))
    return _placed(named, _best(offers, keys), keys, leaves).select("norm_ID", "domain", "leaf_ID", "score")


def match_chapters(chapters: DataFrame, leaves: DataFrame) -> DataFrame:
    """Best existing leaf of every source chapter, category by category.

    ``chapters`` (chap_ID, name, parent_name, domain).  Incompatible categories never meet;
    shared ones add 0.15 each; chapters left without a leaf are tried again unfiltered, then
    take the domain's first leaf with score 0.
    """
    keys = ["domain", "name", "parent_name"]
    named = chapters.withColumn("parent_name", F.coalesce("parent_name", F.lit("")))
    # categories of the name come first and those of the parent are added, as both count
    own, above = A.semantic_categories(F.col("name")), A.semantic_categories(F.col("parent_name"))
    texts = named.select(*keys).distinct().withColumn("cats", F.array_union(own, above)).withColumn(
        "joint", F.concat_ws(" ", "parent_name", "name"))
    targets = leaves.groupBy("domain", "leaf_name").agg(F.min("leaf_ID").alias("leaf_ID")).withColumn(
        "target_name", A.strip_code_prefix(F.col("leaf_name"))).withColumn("leaf_cats", A.semantic_categories(F.col("leaf_name")))
    left = _with_id(_forms(_forms(_forms(texts, "name", "n_form"), "parent_name", "p_form"), "joint", "j_form"))
    right = _with_id(_forms(targets, "target_name", "r_form"))
    l_names, r_names = left.drop("domain").withColumnRenamed("id", "l_id"), right.drop("domain").withColumnRenamed("id", "r_id")

    def score(pairs: DataFrame) -> DataFrame:
        both = pairs.join(l_names, "l_id").join(r_names, "r_id")
        fit = both.where((F.size("cats") == 0) | (F.size("leaf_cats") == 0) | A.compatible(F.col("cats"), F.col("leaf_cats")))
        # leaves that look alike to a text and share as many categories with it score alike, so the lowest stands for all
        forms, signs = [f"{c}{b}" for c in ("n_form", "p_form", "j_form") for b in ("", "_bare")], F.concat("n_form", "p_form", "j_form")
        seen = fit.select("l_id", "leaf_ID", "parent_name", F.size(F.array_intersect("cats", "leaf_cats")).alias("shared"), *forms,
                          *[S.seen_by(F.col(c), signs).alias(c) for c in ("r_form", "r_form_bare")])
        alike = seen.groupBy("l_id", "parent_name", "shared", *forms, "r_form", "r_form_bare").agg(F.min("leaf_ID").alias("leaf_ID"))
        raw = _dealt(alike, "j_form", "r_form").select("l_id", "leaf_ID", "parent_name", "shared", _score("n_form", "r_form").alias("by_name"),
                                                       _score("p_form", "r_form").alias("by_parent"), _score("j_form", "r_form").alias("by_joint"))
        lifted = F.when(F.col("shared") > 0, F.least(F.col("by_name") + LIFT * F.col("shared"), F.lit(1.0))).otherwise(F.col("by_name"))
        of_parent = F.when(F.col("parent_name") != "", F.greatest("by_parent", "by_joint")).otherwise(0.0)
        return raw.select("l_id", "leaf_ID", F.greatest(lifted, of_parent).alias("score"))

    def by_category(open_: DataFrame, least: float) -> DataFrame:
        # shared categories lift a score above 0 even where no character is shared
        some = left.select(F.col("id").alias("l_id"), "domain", "cats").where(F.size("cats") * LIFT >= least).join(open_.select("l_id").distinct(), "l_id", "left_semi")
        held = right.select(F.col("id").alias("r_id"), "domain", F.explode("leaf_cats").alias("cat"))
        return some.select("l_id", "domain", F.explode("cats").alias("cat")).join(held, ["domain", "cat"])

    sets = _sets(left, "n_form", F.size("cats") * LIFT)
    for form in ("p_form", "j_form"):
        sets = sets.unionByName(_sets(left.where("parent_name <> ''"), form))
    found = settle(best_leaves(sets, _sets(right, "r_form"), score, by_category))
    best = left.select(F.col("id").alias("l_id"), *keys).join(found, "l_id").drop("l_id")
    again = left.where(F.size("cats") > 0).join(found.withColumnRenamed("l_id", "id"), "id", "left_anti")
    relaxed = again.select(*keys).join(_best_by_name(again, "name", right.select("domain", "target_name", "leaf_ID")), ["domain", "name"]).select(*best.columns)
    return _placed(named, best.unionByName(relaxed), keys, leaves).select("chap_ID", "name", "domain", "leaf_ID", "score")


def quality_band(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.6, "mid").when(score > 0, "low").otherwise("zero")


def quality_histogram(matched: DataFrame) -> DataFrame:
    return matched.groupBy(quality_band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def misassigned(matched: DataFrame, leaves: DataFrame, pairs: tuple = A.EXCLUSIONS) -> DataFrame:
    """Per exclusion, how many chapters of the first category ended under a leaf of the second."""
    joined = matched.join(leaves.select("leaf_ID", "leaf_name").distinct(), "leaf_ID")
    mine, other = A.semantic_categories(F.col("name")), A.semantic_categories(F.col("leaf_name"))
    hit = lambda a, b: F.array_contains(mine, a) & F.array_contains(other, b)
    counts = joined.agg(*[F.count_if(hit(a, b)).alias(f"{a}>{b}") for a, b in pairs])
    return counts.unpivot([], counts.columns, "exclusion", "chapters")


def gap_report(gaps: DataFrame, quotes: DataFrame, limit: int | None = None, n: int = 6, min_score: float = MIN_SCORE) -> DataFrame:
    """The gaps with their best quotes, all of them or the ``limit`` most referenced; how many there are and how many are not shown."""
    shown = gaps if limit is None else gaps.orderBy(F.col("refs").desc(), "res_ID").limit(limit)
    best = match_gaps(shown.select("res_ID", "name", "unit"), quotes, n, min_score=min_score)
    beyond = F.lit(0) if limit is None else F.greatest(F.col("total") - limit, F.lit(0))
    totals = gaps.agg(F.count(F.lit(1)).alias("total")).withColumn("truncated", beyond.cast("long"))
    # one row of totals
    return shown.join(best, "res_ID", "left").join(F.broadcast(totals), F.lit(True)).select(
        "res_ID", "name", "refs", "quote_ID", "score", "same_unit", "rank", "total", "truncated")


def gap_match(usage: DataFrame, prices: DataFrame, resources: DataFrame, quotes: DataFrame, pack: str, vol: str | None = None, cls: int | None = None, specialty: str | None = None,
              limit: int | None = None, cand: int = 6, min_score: float = MIN_SCORE) -> DataFrame:
    """The report of a pack's unpriced resources and the quotes that may price them (see ``gap_report``), most referenced first where ``limit`` cuts.

    ``usage`` is the ledger in scope, narrowed to a volume and a class where these are given; ``quotes`` (quote_ID, name, unit) to a pattern of their
    ``specialty``.  A resource is found by its name and standard.
    """
    for column, wanted in (("vol", vol), ("cons_Style", cls)):
        if wanted is not None:
            usage = usage.where(F.col(column) == wanted)
    if specialty is not None:
        quotes = quotes.where(F.col("specialty").like(specialty))
    gaps = gap_ranking(usage, prices, resources, pack, None)
    named = gaps.select("res_ID", F.concat_ws(" ", "res_Name", "res_Standard").alias("name"), F.col("res_Unit").alias("unit"), "refs")
    return gap_report(named, quotes, limit, cand, min_score)
