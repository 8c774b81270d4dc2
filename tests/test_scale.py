"""Steps that have to stay bounded on larger tables, each on a small frame."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from costbook.operators import blocks as B
from costbook.operators import markdown as M
from costbook.operators import norms as N
from costbook.operators import pages as P
from costbook.operators import pricing as R
from costbook.operators import provenance as V
from costbook.operators import quality as Q
from costbook.operators import rates as U
from costbook.plans import pages as PP
from costbook.plans.registry import REGISTRY
from costbook.session import scratch_path, stored
from costbook.sources import pages as S
from costbook.sources.bindings import Tables

FOLDER = "/root/testdata/sf0.001"


def physical(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


JOINS = {
    "resource_lines": lambda t, c: U.resource_lines(c, t.consumption, ["vol", "cons_ID"]),
    "expand_norms": lambda t, c: R.expand_norms(c, t.consumption, ["vol", "cons_ID"]),
    "priced_lines": lambda t, c: N.priced_lines(c, t.consumption, t.resource_price.select("res_ID", "price"), ["vol", "cons_ID"]),
    "norms_using": lambda t, c: V.norms_using(t.consumption, t.content, t.norm, 3),
    "live_aliases": lambda t, c: V.live_aliases(t.resource_alias, t.consumption.select(F.col("master_res_ID").alias("res_ID"), "vol", "cons_ID", F.lit(1).alias("refs"))),
}


@pytest.mark.parametrize("name", JOINS)
def test_consumption_is_never_broadcast(spark, name):
    t = Tables(spark, FOLDER)
    plan = physical(JOINS[name](t, V.volume_content(t.content, t.norm)))
    # it holds every part five times, which Spark's guess of its size does not see
    joins = [line for line in plan.splitlines() if re.search(r"Join \[.*cons_ID#", line)]
    assert joins and all("SortMergeJoin" in line for line in joins), joins


def test_short_lists_are_walked_whole(spark, monkeypatch):
    # lists that a task can hold need no chains of chunks, each of which costs a Python pass over all items
    monkeypatch.setattr(B, "chains", None)
    monkeypatch.setattr(B, "_pack_long", None)
    items = spark.range(400).select(F.concat(F.lit("g"), F.col("id") % 40).alias("g"), F.col("id").alias("pos"), F.col("id").alias("norm_ID"), F.array(F.concat(F.lit("r"), F.col("id") % 97)).alias("labels"))
    packed = B.pack(items, ["g"], [F.col("pos")], "norm_ID", 4)
    assert sorted(tuple(r) for r in packed.groupBy("g").agg(F.max("block"), F.sum("kept")).collect())[:2] == [("g0", 3, 10), ("g1", 3, 10)]
    assert "SortMergeJoin" not in physical(packed)


def test_many_pages_in_a_file(spark, tmp_path):
    (tmp_path / "md.json").write_text('{"name": "page_0007.md", "text": "---\\npage: 7\\n---\\nbody"}\n{"name": "page_0008.md", "text": "---\\npage: 8\\nbody"}\n'
                                      '{"name": "notes.md", "text": "x"}\n{"name": "page_0009.md", "text": "no front matter"}\n{"name": "page_0010.md"}\n{"name"\n')
    found = S.scan_markdown(spark, str(tmp_path / "md.json"), whole_files=False)
    assert sorted((r["page"], r["body"]) for r in found.rows.collect()) == [(7, "body"), (9, "no front matter")] and found.bad.count() == 4
    (tmp_path / "blocks.json").write_text('{"name": "ocr_0012.json", "blocks": [{"x1": 1, "text": "a"}, {"x1": 2, "text": "b"}]}\n{"name": "ocr_0013.json", "blocks": []}\n'
                                          '{"name": "ocr_0014.json", "blocks": [{"x1": "left"}]}\n{"name": "other.json", "blocks": [{"x1": 2}]}\n{"name": "ocr_0015.json", "blocks": [{\n')
    found = S.scan_blocks(spark, str(tmp_path / "blocks.json"), multi_line=False)
    assert sorted(tuple(r) for r in found.rows.select("page", "x1", "text").collect()) == [(12, 1.0, "a"), (12, 2.0, "b")] and found.bad.count() == 3


@pytest.mark.parametrize("name", ["src05_block_pages", "src06_markdown_pages"])
def test_page_sources_do_not_write_a_file_a_page(spark, monkeypatch, name):
    roots = []
    monkeypatch.setattr(PP, "scratch_path", lambda s, n: roots.append(scratch_path(s, n)) or roots[-1])
    REGISTRY[name].run(Tables(spark, FOLDER))
    assert [folders for _, folders, _ in os.walk(roots[0])] == [[]]


def test_grid_steps_read_the_blocks_once(spark):
    cells = P.grid_cells(Tables(spark, FOLDER).book_block)
    assert cells.count() and "FileScan" not in physical(cells)


def fused_plainly(blocks, overlap, first_box):
    """The fold of one page in plain Python: blocks (x1, y1, x2, y2, text, confidence, label)."""
    def iou(a, b):
        inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter + 1e-6)

    kept = []
    for b in sorted(set(blocks), key=lambda b: (-b[5], -len(b[4]), *b)):
        hit = next((k for k in kept if iou(b, k) > overlap), None)
        if hit is None:
            kept.append(b)
        elif len(b[4]) > len(hit[4]):
            kept[kept.index(hit)] = (*hit[:4], *b[4:]) if first_box else b
    return kept


@pytest.mark.parametrize("first_box", [False, True])
def test_blocks_are_fused_a_page_at_a_time(spark, first_box):
    dice = random.Random(5)
    pages = {}
    for k in range(400):
        x, y = dice.randrange(60) / 2, dice.randrange(30) / 2
        block = (x, y, x + dice.choice([0, 8, 10]), y + dice.choice([6, 7]), "ab甲d"[:dice.randint(0, 4)], dice.randrange(5) / 4, dice.choice(["gray", "binary"]))
        pages.setdefault((dice.choice(["a", None]), k % 3 if k > 40 else k), []).append(block if first_box else (*block[:6], ""))
    rows = [(*key, *b) for key, found in pages.items() for b in found]
    frame = spark.createDataFrame(rows, "doc string, page long, x1 double, y1 double, x2 double, y2 double, text string, confidence double, pass_label string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # pages that go on in the next batch
    try:
        fused = P.fuse_blocks(frame, first_box=first_box)
        assert "MapInArrow" in physical(fused)
        got = Counter(tuple(r) for r in fused.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = Counter((*key, *b[:6], *b[6:] * first_box) for key, found in pages.items() for b in fused_plainly(found, 0.5, first_box))
    assert got == want


def test_pairs_of_boxes_in_strips(monkeypatch):
    dice = random.Random(6)
    boxes = np.array([[x, y, x + 10, y + 7] for x, y in [(dice.randrange(40), dice.randrange(20)) for _ in range(50)]], float).T
    whole = [(i, h.tolist()) for i, h in P._overlapping(*boxes, 0.3)]
    monkeypatch.setattr(P, "STRIP", 130)
    assert whole == [(i, h.tolist()) for i, h in P._overlapping(*boxes, 0.3)] and any(h for _, h in whole)


@pytest.mark.parametrize("name", ["d05_header_attributes", "d06_table_records", "u06_attribute_order"])
def test_page_lines_are_built_once(spark, monkeypatch, name):
    built = []
    monkeypatch.setattr(PP, "stored", lambda df, n: built.append(stored(df, n)) or built[-1])
    out = REGISTRY[name].run(Tables(spark, FOLDER))
    assert len(built) == 1 and out.count()
    assert all("/lines-" in path for path in built[0].inputFiles()) and "lineitem" not in physical(out)


def test_values_of_markdown_rows_are_worked_out_once(spark):
    page = "## t\n| 定额编号 | 分部工程 | 分项工程 | 桩长 | 级别 | 费用项目 | 单位 | 数量 |\n|---|---|---|---|---|---|---|---|\n| 10001 | a | 人工 | 工日 | 3 |\n| 1 | 2 kg | x |\n"
    rows = M.table_rows(spark.createDataFrame([(1, page)], "page long, body string"))
    items = M.norm_items(rows)
    assert [r["cells"] for r in rows.orderBy("row_pos").collect()] == [["10001", "a", "", "", "", "人工", "工日", "3"], ["1", "", "", "", "", "", "2 kg", "x"]]
    assert [(r["norms_code"], r["cost_item"], r["amount"]) for r in items.collect()] == [("10001", "人工", 3.0)]
    # the dear searches, for the marks of a cost item and for its misreadings, do not stand in the plan once for every use
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("设施摊销费") == 1 and plan.count("定型板面") <= 2


def test_page_checks_read_the_rows_once(spark):
    t = Tables(spark, FOLDER)
    checked = Q.check_pages(t.md_front, t.md_code, t.md_front.select(F.col("continued_from").alias("page")))
    # rows of a code repeat, so none of the checks joins or scans them as they are
    assert checked.count() and "l_suppkey" not in physical(checked)


def test_bill_items_are_worked_out_once(spark):
    rows = REGISTRY["d13_boq_compat_rows"].run(Tables(spark, FOLDER))
    # their texts and numbers are parsed before, so the plan needs no more of the bill than the definitions do
    assert rows.count() and "o_orderpriority" not in physical(rows)
