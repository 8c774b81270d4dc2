"""Fuzzy matching against all pairs, with and without hot tokens that are split."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from costbook.functions import names as A
from costbook.functions import similarity as S
from costbook.operators import matching as M
from costbook.operators import postings as P

WORDS = ["桩基", "打桩", "砖墙", "管道", "阀门", "沥青", "路面", "种植", "一、土方", "预制", "现浇", "混凝土梁", "钢筋", "bc", "a"]


def words(dice, least=1, most=3):
    return "".join(dice.sample(WORDS, dice.randint(least, most)))


def all_scores(spark, left, right):
    """Every pair's score by the column functions alone."""
    a = M._forms(spark.createDataFrame([(x,) for x in sorted(set(left))], "a string"), "a", "l")
    b = M._forms(spark.createDataFrame([(x,) for x in sorted(set(right))], "b string"), "b", "r")
    both = a.crossJoin(b).where("l <> '' and r <> ''").select("a", "b", M._score("l", "r").alias("s"))
    return {(r["a"], r["b"]): r["s"] for r in both.collect()}


def categories(spark, names):
    rows = spark.createDataFrame([(x,) for x in sorted(set(names))], "n string").select("n", A.semantic_categories(F.col("n")).alias("c")).collect()
    return {r["n"]: r["c"] for r in rows}


@pytest.fixture(params=[3])
def pairs_per_task(request, monkeypatch):
    monkeypatch.setattr(P, "PAIRS", request.param)


def test_best_leaf_and_parent(spark, pairs_per_task):
    dice = random.Random(11)
    leaves = [(k % 3, k, words(dice)) for k in range(45)]
    norms = [(100 + k, k % 3, words(dice), dice.choice(["", None, words(dice)])) for k in range(60)] + [(500, 1, "", ""), (501, 2, "zz", "zz"), (502, 9, "桩基", "")]
    held = [(dice.randrange(45), words(dice)) for _ in range(40)]
    n = spark.createDataFrame(norms, "norm_ID long, domain long, norm_Name string, parent_name string")
    lv = spark.createDataFrame(leaves, "domain long, leaf_ID long, leaf_name string")
    h = spark.createDataFrame(held, "chap_ID long, norm_Name string")
    stripped = {r["x"]: r["y"] for r in lv.select(F.col("leaf_name").alias("x"), A.strip_code_prefix(F.col("leaf_name")).alias("y")).collect()}
    cleaned = {r["x"]: r["y"] for r in n.select(F.coalesce("parent_name", F.lit("")).alias("x"), A.clean_name(F.col("parent_name")).alias("y")).collect()}
    asked = {x for r in norms for p in [cleaned[r[3] or ""] or ""] for x in (r[2], p, f"{p} {r[2]}")}
    scores = all_scores(spark, asked, [*stripped.values(), *(x for _, x in held)])

    def best(text, targets):
        offers = [(scores.get((text, t), 0.0), -leaf) for leaf, t in targets]
        return max(offers, default=(0.0, 0))

    got = {r["norm_ID"]: (r["leaf_ID"], round(r["score"], 9)) for r in M.match_leaves(n.drop("parent_name"), lv, h).collect()}
    with_parent = {r["norm_ID"]: (r["leaf_ID"], round(r["score"], 9)) for r in M.match_leaves_with_parent(n, lv, h).collect()}
    assert got.keys() == with_parent.keys() == {r[0] for r in norms if r[1] < 3}
    for id_, domain, name, parent in norms:
        if domain < 3:
            own = [(leaf, stripped[x]) for d, leaf, x in leaves if d == domain]
            more = [(leaf, x) for leaf, x in held if leaf % 3 == domain]
            first = min(leaf for leaf, _ in own)
            s, leaf = best(name, own + more)
            assert got[id_] == ((-leaf if s > 0 else first), round(s, 9))
            p = cleaned[parent or ""] or ""
            offers = [(s, leaf)] + ([best(p, own), best(f"{p} {name}", own)] if p else [])
            s, leaf = max(offers)
            assert with_parent[id_] == ((-leaf if s > 0 else first), round(s, 9))


def test_chapters_by_category(spark, pairs_per_task):
    dice = random.Random(5)
    names = ["现浇混凝土梁", "预制混凝土柱", "绿化种植", "草坪", "打桩", "灌注桩", "沥青路面", "电缆", "一、钢筋", "zz", "砌砖墙"]
    pick = lambda: dice.choice(names) + dice.choice(["", "工程", "a", words(dice)])
    leaves = [(k % 2, k, pick()) for k in range(30)]
    chapters = [(k, pick(), dice.choice([None, "", pick()]), k % 2) for k in range(60)]
    frame = spark.createDataFrame(chapters, "chap_ID long, name string, parent_name string, domain long")
    lv = spark.createDataFrame(leaves, "domain long, leaf_ID long, leaf_name string")
    got = {r["chap_ID"]: (r["leaf_ID"], round(r["score"], 9)) for r in M.match_chapters(frame, lv).collect()}
    stripped = {r["x"]: r["y"] for r in lv.select(F.col("leaf_name").alias("x"), A.strip_code_prefix(F.col("leaf_name")).alias("y")).collect()}
    scores = all_scores(spark, {x for _, n, p, _ in chapters for x in (n, p or "", f"{p or ''} {n}")}, stripped.values())
    cats = categories(spark, [*(x for _, n, p, _ in chapters for x in (n, p or "")), *(x for _, _, x in leaves)])
    pairs = spark.createDataFrame([(c[0], leaf[1], cats[c[1]] + [x for x in cats[c[2] or ""] if x not in cats[c[1]]], cats[leaf[2]]) for c in chapters for leaf in leaves],
                                  "c long, l long, mine array<string>, other array<string>")
    fits = {(r["c"], r["l"]): r["ok"] for r in pairs.select("c", "l", ((F.size("mine") == 0) | (F.size("other") == 0) | A.compatible(F.col("mine"), F.col("other"))).alias("ok")).collect()}
    assert any(fits.values()) and not all(fits.values())
    for id_, name, parent, domain in chapters:
        mine = set(cats[name]) | set(cats[parent or ""])
        best, relaxed = (0.0, 0), (0.0, 0)
        for d, leaf, text in leaves:
            if d != domain:
                continue
            by_name = scores.get((name, stripped[text]), 0.0)
            shared = len(mine & set(cats[text]))
            of_parent = max(scores.get((x, stripped[text]), 0.0) for x in (parent, f"{parent} {name}")) if parent else 0.0
            if fits[id_, leaf]:
                best = max(best, (max(min(by_name + 0.15 * shared, 1.0) if shared else by_name, of_parent), -leaf))
            relaxed = max(relaxed, (by_name, -leaf))
        if best[0] == 0 and mine:
            best = relaxed
        first = min(leaf for d, leaf, _ in leaves if d == domain)
        assert got[id_] == ((-best[1] if best[0] > 0 else first), round(best[0], 9)), (name, parent)


def test_gap_match_of_many_names(spark, pairs_per_task):
    dice = random.Random(2)
    text = lambda: "".join(dice.choices("abcdefghijklmnopqrstuvwxyz电缆铜线阀门管道", k=dice.randint(1, 9)))
    gaps = [(k, text(), "m") for k in range(40)] + [(90, None, None), (91, "", "m"), (92, "Ω", "m")]
    quotes = [(1000 + k, text(), dice.choice(["m", "t", None])) for k in range(900)]
    got = M.match_gaps(spark.createDataFrame(gaps, "res_ID long, name string, unit string"), spark.createDataFrame(quotes, "quote_ID long, name string, unit string"), n=4, rough=25, min_score=0.0)
    rough = lambda a, b: 0.0 if len(a & b) < 2 else max(len(a & b) / len(a | b), len(a & b) / min(len(a), len(b)) * 0.7)
    want = []
    for res, name, unit in gaps:
        t = name or ""
        lead = sorted(((-rough(set(t), set(q)), id_, q, u) for id_, q, u in quotes if rough(set(t), set(q)) > 0))[:25]
        rated = sorted((-round(min(1.0, S._ratio(t, q) + (0.08 if unit and unit == (u or "") else 0.0)), 3), not (unit and unit == (u or "")), r, id_) for r, id_, q, u in lead)
        want += [(res, id_, -s, k) for k, (s, _, _, id_) in enumerate(rated[:4], 1)]
    assert sorted(tuple(r) for r in got.select("res_ID", "quote_ID", "score", "rank").collect()) == sorted(want)


def test_pairs_meet_without_texts_or_products(spark):
    texts = spark.createDataFrame([(k, list("abcdef"[k % 4:])) for k in range(20)], "id long, tokens array<string>")
    plan = M.leading_pairs(texts, texts.withColumn("lowest", F.col("id")).withColumn("quotes", F.lit(1)), 5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "text" not in plan


def test_frequent_tokens_alone_bring_no_short_texts_together(spark, monkeypatch):
    dice = random.Random(4)
    sets = lambda first: [(first + i, sorted(dice.sample(range(300), 30 if i % 40 == 0 else dice.randint(4, 8)))) for i in range(300)]
    left, right = sets(0), sets(1000)
    meet, tried = P.meet, []

    def counted(l, r, by, l_keys, r_keys, enough, also=None, *width):
        tried.append(P._postings(l, "l", l_keys, *width).join(P._postings(r, "r", r_keys, *width), "token").count())
        return meet(l, r, by, l_keys, r_keys, enough, also, *width)

    monkeypatch.setattr(P, "meet", counted)
    met = P.contained(spark.createDataFrame(left, "l_id long, l_tokens array<int>"), spark.createDataFrame(right, "r_id long, r_tokens array<int>"), [], 0.0, 2,
                      lambda n, m, s: s >= 2).select("l_id", "r_id", "shared").collect()
    shared = {(a, b): len(set(x) & set(y)) for a, x in left for b, y in right}
    assert sorted(tuple(r) for r in met) == sorted((a, b, n) for (a, b), n in shared.items() if n >= 2)
    # in either direction texts of few tokens are only compared where two of them are the same
    long = sum(n for (a, b), n in shared.items() if a % 40 == 0 or b % 40 == 0)
    assert sum(tried) <= 2 * long + 2 * sum(n * (n - 1) // 2 for n in shared.values())


def test_a_text_is_compared_once_with_leaves_that_look_alike_to_it(spark, monkeypatch):
    # the leaves' numbers hold no sign of the norm's name
    compared = spark.sparkContext.accumulator(0)
    plain = M._score

    @F.udf("boolean")
    def counted(_):
        compared.add(1)
        return True

    monkeypatch.setattr(M, "_score", lambda a, b: F.when(counted.asNondeterministic()(F.col(b)), plain(a, b)))
    leaves = spark.createDataFrame([(1, 1000 + k, f"砖墙 {k:04d}") for k in range(300)], "domain long, leaf_ID long, leaf_name string")
    norms = spark.createDataFrame([(1, 1, "砖墙砌体", "砖墙")], "norm_ID long, domain long, norm_Name string, parent_name string")
    held = spark.createDataFrame([], "chap_ID long, norm_Name string")
    assert [r["leaf_ID"] for r in M.match_leaves_with_parent(norms, leaves, held).collect()] == [1000]
    assert 0 < compared.value < 50
    compared.value = 0
    chapters = spark.createDataFrame([(1, "砖墙砌体", "砖墙", 1)], "chap_ID long, name string, parent_name string, domain long")
    assert [r["leaf_ID"] for r in M.match_chapters(chapters, leaves).collect()] == [1000]
    assert 0 < compared.value < 50


def test_hidden_signs_keep_every_score(spark):
    dice = random.Random(5)
    texts = ["".join(dice.choice("ab一、土(1)" + S.HIDDEN * (k % 3 == 0)) for _ in range(dice.randint(0, 9))) + "一、" * (k % 2) for k in range(60)]
    long = ["".join(dice.choice("abcdxyz0123456789") for _ in range(230)) for _ in range(4)]
    a = M._forms(spark.createDataFrame([(x,) for x in [*texts, *long, "xab1", "桩3"]], "a string"), "a", "l")
    b = M._forms(spark.createDataFrame([(x + y,) for x in texts[:30] for y in ("", "zq7桩")] + [(x,) for x in long], "b string"), "b", "r")
    both = a.crossJoin(b).withColumn("plain", M._score("l", "r"))
    hidden = both.withColumns({c: S.seen_by(F.col(c), F.col("l")) for c in ("r", "r_bare")}).withColumn("seen", M._score("l", "r"))
    assert hidden.where("plain <> seen or plain is null").count() == 0
    assert hidden.select("l", "r").distinct().count() < both.select("l", "r").distinct().count()


def test_choices_of_signs(spark):
    sides = spark.createDataFrame([(1, list("dbca")), (2, list("zy")), (3, list("電a\U0001F600b1"))], "id long, signs array<string>")
    for size in (2, 3):
        got = P.choices(sides.select("id", P.codes(F.col("signs")).alias("points")), "points", size).collect()
        want = [(id_, sum(ord(c) << 21 * (size - 1 - k) for k, c in enumerate(some))) for id_, signs in ((1, "dbca"), (2, "zy"), (3, "電a\U0001F600b1"))
                for some in combinations(sorted(signs), size)]
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_frequent_signs_leave_as_many_pairs_as_can_count(spark):
    # all quotes share two signs with the targets, a few share three: no target meets more than ``rough`` of them
    signs = lambda k: ["a", "b", "c"] if k % 50 == 0 else ["a", "b", chr(0x4E00 + k)]
    quotes = spark.createDataFrame([(k, signs(k), k, 1) for k in range(1, 301)], "id long, tokens array<string>, lowest long, quotes int")
    targets = spark.createDataFrame([(k, ["a", "b", "c", chr(0x3041 + k)]) for k in range(3)], "id long, tokens array<string>")
    got = sorted((r["l_id"], -r["rough"], r["r_id"]) for r in M.leading_pairs(targets, quotes, 8).select("l_id", "rough", "r_id").collect())
    three, two = max(3 / 4, 0.7), max(2 / 5, 2 / 3 * 0.7)
    assert got == [(k, *x) for k in range(3) for x in [(-three, r) for r in range(50, 301, 50)] + [(-two, r) for r in (1, 2)]]
