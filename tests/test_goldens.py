"""Hand-made goldens and comparisons with plain Python on small frames."""

from __future__ import annotations

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from costbook.functions import names as A
from costbook.functions import numbers as U
from costbook.functions import similarity as S
from costbook.operators import hierarchy as H
from costbook.operators import markdown as MD
from costbook.operators import matching as M
from costbook.operators import ordered as O
from costbook.operators import pages as P
from costbook.operators import pricing as R
from costbook.operators import rates as RT
from costbook.sources import pages as SP
from costbook.sources import tables as ST


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_norm_costs_skip_unpriced_lines(spark):
    lines = spark.createDataFrame([(1, 3, 1, 2.0), (1, 4, 2, 3.0), (1, 5, 3, 1.0), (1, 7, None, 1.0)],
                                  "norm_ID long, cons_Style int, master_res_ID long, cont_Amount double")
    prices = spark.createDataFrame([(1, 10.0), (2, 5.0)], "res_ID long, price double")
    got = R.norm_costs(lines, prices, ["norm_ID"]).first()
    assert (got.man, got.mat, got.mach, got.main_mat, got.unpriced) == (20.0, 15.0, 0.0, 0.0, 2)


def test_latest_price_differs_from_latest_row(spark):
    prices = spark.createDataFrame([(1, "p", "2024-01-01", 5.0), (1, "p", "2025-01-01", None)], "res_ID long, pack string, price_date string, price double")
    prices = prices.withColumn("price_date", F.col("price_date").cast("date"))
    assert R.latest_price(prices).first().price == 5.0
    assert R.latest_price_row(prices).first().price is None


def test_packs_give_different_amounts(spark):
    lines = spark.createDataFrame([(1, 3, 1, 2.0)], "norm_ID long, cons_Style int, master_res_ID long, cont_Amount double")
    amounts = {p: R.norm_costs(lines, spark.createDataFrame([(1, v)], "res_ID long, price double"), ["norm_ID"]).first().man
               for p, v in (("a", 1.0), ("b", 2.0), ("c", 3.0))}
    assert len(set(amounts.values())) == 3


def test_gap_clusters(spark):
    values = spark.createDataFrame([(1, float(v)) for v in (1, 2, 10, 11, 30)], "page long, y double")
    for frame in (P.cluster_centres(values, ["page"], "y", 2.0),
                  O.gap_groups(values, ["page"], F.col("y"), F.col("y"), 2.0, O.chunk_of(F.col("y"), 4)).groupBy("group_no").agg(F.avg("y").alias("centre"))):
        assert sorted(r.centre for r in frame.collect()) == [1.5, 10.5, 30.0]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_scan_equals_a_plain_walk(spark, size):
    random.seed(size)
    data = [(k, i, random.choice([None, i]), random.randint(0, 3)) for k in "ab" for i in range(40)]
    df = spark.createDataFrame(data, "k string, i long, v long, n long")
    got = O.scan(df, ["k"], [F.col("i")], O.chunk_of(F.col("i"), size), carry={"c": F.col("v")}, total={"t": F.col("n")},
                 previous={"p": F.col("v")}, top={"m": F.col("n")})
    want = []
    for _, group in itertools.groupby(data, key=lambda r: r[0]):
        carried, total, before, top = None, 0, None, None
        for k, i, v, n in group:
            carried = v if v is not None else carried
            total, top = total + n, n if top is None else max(top, n)
            want.append((k, i, carried, total, before, top))
            before = v
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in got.select("k", "i", "c", "t", "p", "m").collect()), key=key) == sorted(want, key=key)


def test_numbering_by_ranges(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(50)], "i long, g long").repartition(6)
    place = lambda i: (i % 7 == 0, -(i % 3) if i % 7 else 0, i)
    got = {r.i: r.no for r in O.numbered(df, [F.col("g").desc_nulls_last(), F.col("i")], "no").collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(50), key=place), 1)}
    got = {r.i: r.no for r in O.numbered(df, [F.col("i").desc()], "no", ["g"]).collect()}
    same = lambda i: {j for j in range(50) if (j % 3 if j % 7 else None) == (i % 3 if i % 7 else None)}
    assert got == {i: sum(j >= i for j in same(i)) for i in range(50)}
    assert O.numbered(df.limit(0), [F.col("i")], "no").count() == 0


def test_numbering_by_key(spark, monkeypatch):
    monkeypatch.setattr(O, "WHOLE", 9)
    worked_out = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def dear(i):
        worked_out.add(1)
        return i

    # the null key and key 2 are numbered whole, 0 and 1 are dealt by ranges; key 3 is larger than told
    key = lambda i: None if i < 5 else 2 if i < 10 else 3 if i < 30 else i % 2
    df = spark.createDataFrame([(i, key(i)) for i in range(80)], "i long, g long").repartition(4)
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(F.col("g") == 3, 9).otherwise(F.col("n")))
    out = O.numbered_by_key(df, [F.col("i").desc()], "no", ["g"], sizes)
    assert out.columns == ["no", "i", "g"] and dict(out.dtypes)["no"] == "bigint"
    got = {r.i: r.no for r in out.collect()}
    assert got == {i: sum(j >= i for j in range(80) if key(j) == key(i)) for i in range(80)}
    # where no key is large the rows are worked out once
    rows = df.select(dear.asNondeterministic()("i").alias("i"), "g")
    got = {r.i: r.no for r in O.numbered_by_key(rows, [F.col("i").desc()], "no", ["g"], sizes.withColumn("n", F.lit(9))).collect()}
    assert got == {i: sum(j >= i for j in range(80) if key(j) == key(i)) for i in range(80)}
    assert worked_out.value == 80


def test_chains_split_and_depth(spark):
    chapters = spark.createDataFrame([(1, 0, "r", "01"), (2, 1, "s", "01.01"), (3, 2, "t", "01.01.01"), (4, 9, "lost", "x")], "chap_ID long, chap_PID long, chap_Name string, chap_code string")
    got = {r.chap_ID: (r.path, r.chapter, r.section, r.subsection) for r in H.chapter_paths(chapters).select("chap_ID", "path", *H.split_levels(F.col("names"))).collect()}
    assert got == {1: ("r", "r", "", ""), 2: ("r > s", "r", "s", ""), 3: ("r > s > t", "r", "s", "t"), 4: ("lost", "lost", "", "")}
    deep = spark.createDataFrame([(i, i - 1, "n", "c") for i in range(1, 13)], "chap_ID long, chap_PID long, chap_Name string, chap_code string")
    assert {r.node: len(r.chain) for r in H.chains(deep).collect()} == {i: i for i in range(1, 13)}


def test_cycles_are_cut(spark):
    loop = spark.createDataFrame([(1, 2), (2, 1)], "chap_ID long, chap_PID long")
    assert sorted(r.n for r in H.chains(loop).select(F.size("chain").alias("n")).collect()) == [2, 2]


def test_wbs_level_and_parent(spark):
    sheet = spark.createDataFrame([(1, "010203000000"), (2, "01")], "row_no long, wbs_code string")
    got = H.wbs_nodes(sheet).collect()
    assert [(r.wbs_code, r.level, r.parent_code) for r in got] == [("010203000000", 3, "010200000000")]


def test_prefilter_and_numbers(spark):
    one = spark.range(1)
    arr = lambda s: F.array(*[F.lit(c) for c in s])
    assert one.select(S.prefilter(arr("abc"), arr("bcde"))).first()[0] == pytest.approx(max(2 / 5, 0.7 * 2 / 3))
    texts = spark.createDataFrame([("(10.20)",), ("920-1560",), ("0,15",), ("—",), ("abc",)], "t string")
    got = [(r.value, r.quality, r.shown) for r in texts.select(U.clean_amount(F.col("t")).alias("a")).select("a.*").collect()]
    assert got == [(10.2, "raw", None), (None, "range", "920-1560"), (0.15, "raw", None), (None, "raw", None), (None, "unparseable", None)]


def test_roman_numerals_longest_first(spark):
    df = spark.createDataFrame([("III类",), ("II类",), ("I类",)], "t string")
    assert [r[0] for r in df.select(A.normalize_text(F.col("t"))).collect()] == ["Ⅲ类", "Ⅱ类", "Ⅰ类"]


def _prefilter(a, b):
    shared = a & b
    return 0.0 if len(shared) < 2 else max(len(shared) / len(a | b), len(shared) / min(len(a), len(b)) * 0.7)


def test_gap_match_equals_brute_force(spark):
    random.seed(5)
    words = ["steel", "pipe", "valve", "cable", "铜线", "电缆", "水泵", "阀门", "m2", "x"]
    name = lambda: " ".join(random.sample(words, random.randint(1, 3)))
    gaps = [(i, name(), random.choice(["m", "t", ""])) for i in range(25)]
    quotes = [(100 + i, name(), random.choice(["m", "t"])) for i in range(120)]
    got = M.match_gaps(spark.createDataFrame(gaps, "res_ID long, name string, unit string"), spark.createDataFrame(quotes, "quote_ID long, name string, unit string"), n=6, rough=15)
    squeeze = lambda s: s.replace(" ", "")
    want = []
    for res, text, unit in gaps:
        t = squeeze(text)
        rough = [(_prefilter(set(t), set(squeeze(q))), qid, squeeze(q), u) for qid, q, u in quotes]
        best = sorted((r for r in rough if r[0] > 0), key=lambda r: (-r[0], r[1]))[:15]
        scored = []
        for r, qid, q, u in best:
            same = bool(unit) and unit == u
            s = round(min(1.0, SequenceMatcher(None, t, q).ratio() + (0.08 if same else 0.0)), 3)
            if s >= 0.34:
                scored.append((-s, not same, -r, qid))
        want += [(res, qid, -s, rank) for rank, (s, _, _, qid) in enumerate(sorted(scored)[:6], 1)]
    assert rows(got.select("res_ID", "quote_ID", "score", "rank")) == sorted(want)


def _score(a, b):
    ratio = SequenceMatcher(None, a, b).ratio()
    return max(ratio, 0.85) if a in b or b in a else ratio


def test_leaf_match_equals_brute_force(spark):
    random.seed(7)
    words = ["桩基", "打桩", "砖墙", "管道", "阀门", "沥青", "路面", "种植"]
    name = lambda: "".join(random.sample(words, random.randint(1, 3)))
    leaves = [(i % 2, i, name()) for i in range(12)]
    norms = [(100 + i, i % 2, name()) for i in range(30)]
    held = [(random.randint(0, 11), name()) for _ in range(20)]
    got = M.match_leaves(spark.createDataFrame(norms, "norm_ID long, domain long, norm_Name string"), spark.createDataFrame(leaves, "domain long, leaf_ID long, leaf_name string"),
                         spark.createDataFrame(held, "chap_ID long, norm_Name string"))
    want = []
    for nid, domain, text in norms:
        offers = [(_score(text, n), -leaf) for d, leaf, n in leaves if d == domain]
        offers += [(_score(text, n), -leaf) for leaf, n in held if leaf % 2 == domain]
        best = max(o for o in offers)
        want.append((nid, -best[1] if best[0] > 0 else domain, best[0]))
    assert [(a, b, pytest.approx(c)) for a, b, c in rows(got.select("norm_ID", "leaf_ID", "score"))] == sorted(want)


def test_chapter_match_honours_categories(spark):
    leaves = spark.createDataFrame([(1, 10, "现浇混凝土梁"), (1, 11, "预制混凝土柱"), (1, 12, "绿化种植")], "domain long, leaf_ID long, leaf_name string")
    chapters = spark.createDataFrame([(1, "预制混凝土梁", None, 1), (2, "草坪", None, 1), (3, "zz", None, 1)], "chap_ID long, name string, parent_name string, domain long")
    got = {r.chap_ID: (r.leaf_ID, round(r.score, 4)) for r in M.match_chapters(chapters, leaves).collect()}
    ratio = SequenceMatcher(None, "预制混凝土梁", "预制混凝土柱").ratio()
    assert got == {1: (11, round(min(ratio + 0.15, 1.0), 4)), 2: (12, 0.15), 3: (10, 0.0)}


def test_block_packing_equals_a_plain_walk(spark):
    random.seed(3)
    items = [("c", "s", g, i, i, random.sample([f"r{j}" for j in range(12)], random.randint(1, 7))) for i, g in enumerate(sorted(random.choices("xyz", k=40)))]
    df = spark.createDataFrame(items, "chapter string, section string, subsection string, pos long, norm_ID long, labels array<string>").repartition(5)
    want = []
    for g, group in itertools.groupby(items, key=lambda r: r[2]):
        block, held = 1, set()
        for *_, nid, labels in group:
            new = [x for x in labels if x not in held]
            if held and len(held) + len(new) > 6:
                block, held, new = block + 1, set(), labels
            held.update(new[:6])
            want.append((nid, block, min(len(new), 6)))
            if len(new) > 6:
                block, held = block + 1, set(new[6:])
                want.append((nid, block, len(new) - 6))
    assert rows(RT.pack_blocks(df, 6).select("norm_ID", "block", "kept")) == sorted(want)


def test_an_item_of_sixty_labels_loses_none(spark):
    df = spark.createDataFrame([("c", "s", "g", 1, 7, [f"r{j}" for j in range(130)])], "chapter string, section string, subsection string, pos long, norm_ID long, labels array<string>")
    assert rows(RT.pack_blocks(df).select("norm_ID", "block", "kept")) == [(7, 1, 55), (7, 2, 55), (7, 3, 20)]


def test_rows_by_anchor(spark):
    ys = [0.0, 4.0, 6.0, 7.0, 20.0, 23.0, 26.0]
    lines = spark.createDataFrame([(1, i, y) for i, y in enumerate(ys)], "page long, line_no long, y double")
    got = [r.row_no for r in P.rows_by_anchor(lines, ["page"], 5, "first").orderBy("line_no").collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4]
    assert [r.row_no for r in P.rows_by_anchor(lines, ["page"], 5, "mean").orderBy("line_no").collect()] == [1, 1, 1, 1, 2, 2, 2]


def test_block_fusion_keeps_the_longer_text(spark):
    blocks = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, 10.0, "ab", 0.9), ("d", 1, 0.5, 0.0, 10.5, 10.0, "abc", 0.8), ("d", 1, 50.0, 0.0, 60.0, 10.0, "z", 0.5)],
                                   "doc string, page long, x1 double, y1 double, x2 double, y2 double, text string, confidence double")
    assert [r.text for r in P.fuse_blocks(blocks).orderBy("x1").collect()] == ["abc", "z"]


def test_table_page_to_records(spark):
    cells = [(20, 0, "一、打桩"), (20, 60, "工程内容：(1)打桩"), (40, 0, "定额编号"), (40, 120, "10001"), (40, 220, "10002"), (60, 120, "桩长20m"), (90, 120, "Ⅱ类土"), (90, 220, "Ⅲ类土"),
             (110, 0, "1 人工 工日"), (110, 120, "2.5"), (110, 220, "3.5"), (130, 0, "2 板枋材"), (130, 120, "0.1 0.2"), (135, 0, "m3"), (150, 0, "注：略")]
    lines = spark.createDataFrame([("d", 1, i, float(x), float(x + 40), float(y), t) for i, (y, x, t) in enumerate(cells)],
                                  "doc string, page long, line_no long, x double, x2 double, y double, text string")
    columns = P.code_columns(lines)
    zones = P.table_zones(lines, columns)
    got = rows(P.table_records(lines, columns, zones).select("code", "item", "unit", "amount"))
    assert got == [("10001", "人工", "工日", "2.5"), ("10001", "板枋材", "m3", "0.1"), ("10002", "人工", "工日", "3.5"), ("10002", "板枋材", "m3", "0.2")]
    attrs = rows(P.header_attributes(lines, columns, zones).select("code", "name", "value"))
    assert attrs == [("10001", "土壤类别", "Ⅱ类土"), ("10001", "桩长", "20m"), ("10002", "土壤类别", "Ⅲ类土"), ("10002", "桩长", "20m")]


def test_markdown_tables(spark):
    text = ("---\npage: 7\nchapter: 第一章\n---\n## 打桩\n- **单位**: m3\n| 定额编号 | 分部工程 | 分项工程 | 桩长 | 费用项目 | 单位 | 数量 |\n|---|---|---|---|---|---|---|\n"
            "| 1001 | a | b | 20 | 人工 | 工日 | 2.5 |\n| 1001 | a | b | 型钢 |  | (1.5) |\n\n| 定额编号 | 费用项目 | 数量 |\n|---|---|---|\n| 1002 | 基价 | x |\n\n| no | table |\n")
    pages = SP.markdown_pages(spark.createDataFrame([(7, text)], "page long, text string"))
    assert pages.select(SP.front_number(F.col("front"), "page")).first()[0] == 7
    table = MD.table_rows(pages)
    assert rows(table.select("table_no", "row_pos", "heading")) == [(1, 2, "打桩"), (1, 3, "打桩"), (2, 2, "")]
    items = rows(MD.norm_items(table).select("norms_code", "attr_level1", "cost_item", "cost_item_unit", "amount", "data_quality"))
    assert items == [("1001", "", "型钢", "kg", 1.5, "raw"), ("1001", "20", "人工", "工日", 2.5, "raw"), ("1002", "", "基价", "元", None, "unparseable")]


def test_sources_and_sinks_round_trip(spark, tmp_path):
    from costbook.operators import export as E
    items = spark.createDataFrame([(1, 2, 2, "c2", "b", None), (1, 1, 1, "c1", "a", 1.5), (2, 1, 3, "c3", "x", 2.0)], "table_id long, sort_order int, id long, norms_code string, cost_item string, amount double")
    E.write_items(items, str(tmp_path / "items"))
    back = spark.read.schema(SP.ITEM + ", table_id long").json(str(tmp_path / "items"))
    assert rows(back.select("table_id", "norms_code", "attr_level1", "amount").fillna(-1.0)) == [(1, "c1", "", 1.5), (1, "c2", "", -1.0), (2, "c3", "", 2.0)]
    lib = str(tmp_path / "lib")
    spark.createDataFrame([("a", 1), ("b", 2)], "doc string, id long").write.partitionBy("doc").parquet(f"{lib}/Norm")
    families = {"a": ("Norm", "chapter"), "b": ("Norm",)}
    assert rows(ST.read_library(spark, lib, "nrm_b", families)["Norm"].select("id")) == [(2,)]
    with pytest.raises(KeyError):
        ST.read_library(spark, lib, "zz", families)
    (tmp_path / "pg").mkdir()
    (tmp_path / "pg" / "page_0012.json").write_text('{"page": 12, "page_height": 600, "lines": [{"x": 1, "y": 2, "x2": 3, "y2": 4, "text": "t"}]}')
    assert [tuple(r) for r in SP.read_page_lines(spark, str(tmp_path / "pg")).select("page", "line_no", "text").collect()] == [(12, 0, "t")]
    (tmp_path / "ocr").mkdir()
    (tmp_path / "ocr" / "ocr_0031.json").write_text('[{"x1": 1, "text": "a", "confidence": 0.5}, {"x1": 2, "text": "b", "confidence": 0.7}]')
    assert rows(SP.read_blocks(spark, str(tmp_path / "ocr")).select("page", "text")) == [(31, "a"), (31, "b")]
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "page_0007.md").write_text("---\nk: v\n---\nbody")
    assert [tuple(r) for r in SP.read_markdown(spark, str(tmp_path / "md")).select("page", "front.k", "body").collect()] == [(7, "v", "body")]


def test_replacing_one_source_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "stack")
    frame = lambda s, n: ST.stack_sources({s: spark.createDataFrame([(n,)], "id long")}, ["id", "missing"])
    for s, n in (("a", 1), ("b", 2), ("a", 3)):
        ST.replace_sources(frame(s, n), path)
    assert rows(spark.read.parquet(path).select("source_id", "id")) == [("a", 3), ("b", 2)]


def test_appendix_levels_equal_a_plain_walk(spark):
    from costbook.operators import appendix as X
    random.seed(8)
    lines = []
    for k in range(240):
        kind = random.random()
        x, text = (60.0, f"{random.choice([1, 1, 2, 3])}. rock{k}") if kind < 0.35 else (20.0, random.choice(["V", "VI"])) if kind < 0.55 else (70.0, f"more{k}") if kind < 0.65 else (260.0, str(k))
        lines.append((f"D{k % 3}", k // 60, k, x, 200.0 + k, text))
    got = {(r.doc, r.line_no): (r.level_no, r.rock_no) for r in X.place(X.data_lines(spark.createDataFrame(
        lines, "doc string, page_idx long, line_no long, x double, y double, text string"))).collect()}
    want = {}
    for doc in ("D0", "D1", "D2"):
        level, rock, marked, done = 1, 0, False, 0
        for d, _, line, x, _, text in lines:
            if d != doc:
                continue
            if x < 50:
                marked = True
            elif x == 60.0:
                if text.startswith("1.") and marked and done > 1:
                    level, marked, done = level + 1, False, 0
                rock, done = rock + 1, done + 1
            want[d, line] = (level, rock)
    assert got == want and max(v[0] for v in want.values()) > 3
