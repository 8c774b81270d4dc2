"""Sources with records that cannot be read, sets of files that are replaced whole, and lists that are read by pages."""

import pytest
from pyspark.sql import functions as F

from costbook.operators import export as E
from costbook.sources import pages as S


def put(folder, **files):
    folder.mkdir()
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


def test_broken_files_are_told_apart(spark, tmp_path):
    pages = put(tmp_path / "p", page_0001__json='{"page": 1, "lines": [{"x": 1, "text": "a"}, {"x": 2, "text": "b"}]}', page_0002__json='{"page": 2, "lines": [{"x"', page_0003__json='{"page": "three", "lines": []}')
    found = S.scan_page_lines(spark, pages)
    assert [r["text"] for r in found.rows.orderBy("line_no").collect()] == ["a", "b"]
    assert sorted(r["file"][-9:] for r in found.bad.collect()) == ["0002.json", "0003.json"]
    blocks = put(tmp_path / "b", ocr_0012__json='[{"x1": 1, "text": "a"}]', ocr_0013__json="[{", other__json='[{"x1": 2, "text": "no page"}]')
    found = S.scan_blocks(spark, blocks)
    assert [tuple(r) for r in found.rows.select("page", "text").collect()] == [(12, "a")] and found.bad.count() == 2
    items = put(tmp_path / "i", **{"148__json": '[{"norms_code": "1", "amount": 2.5}]', "149__json": '[{"norms_code": "1", "amount": "x"}]'})
    found = S.scan_items(spark, items)
    assert [tuple(r) for r in found.rows.select("table_id", "amount").collect()] == [(148, 2.5)] and found.bad.count() == 1
    md = put(tmp_path / "m", page_0007__md="---\npage: 7\n---\nbody", page_0008__md="---\npage: 8\nbody", page_0009__md="no front matter", notes__md="x")
    found = S.scan_markdown(spark, md)
    assert sorted((r["page"], r["body"]) for r in found.rows.collect()) == [(7, "body"), (9, "no front matter")]
    assert sorted(r["file"].rsplit("/", 1)[1] for r in found.bad.collect()) == ["notes.md", "page_0008.md"]


def test_a_failed_rerun_leaves_the_old_set(spark, tmp_path):
    root = str(tmp_path / "set")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    E.publish({"x": one, "y": one.where("id = 1")}, root)
    broken = one.withColumn("text", F.when(F.col("id") == 2, F.raise_error(F.lit("half way"))).otherwise("new"))
    with pytest.raises(Exception, match="half way"):
        E.publish({"x": one.withColumn("text", F.lit("new")), "y": broken}, root)
    read = lambda name: sorted(map(tuple, E.read_published(spark, root, name, "id long, text string").collect()))
    assert read("x") == [(1, "a"), (2, "b")] and read("y") == [(1, "a")]
    E.publish({"x": one.where("id = 2"), "y": one.limit(0)}, root)
    assert read("x") == [(2, "b")] and read("y") == []


def test_writers_round_trip(spark, tmp_path):
    one = spark.createDataFrame([(1, "t", "x\ny"), (2, "t", ""), (3, None, None)], "page long, type string, content string")
    E.write_text_pages(one, str(tmp_path / "t"))
    assert [tuple(r) for r in E.read_published(spark, str(tmp_path / "t"), "pages", "page long, type string, content string").collect()] == [(1, "t", "x\ny")]
    nodes = spark.createDataFrame([("010000000000", None, 1, "01", "root"), ("010100000000", "010000000000", 2, "01", "kid"), ("020101000000", "020100000000", 3, "02", "orphan")],
                                  "wbs_code string, parent_code string, level int, discipline string, name_cn string")
    E.write_class_tree(E.class_tree(nodes, ("name_cn",)), str(tmp_path / "w"))
    got = sorted(map(tuple, E.read_published(spark, str(tmp_path / "w"), "tree", "discipline string, wbs_code string, tree string").select("discipline", "wbs_code", "tree").collect()))
    assert [g[:2] for g in got] == [("01", "010000000000"), ("02", "020101000000")] and '"children":[{"wbs_code":"010100000000"' in got[0][2]


def test_pages_by_number_and_by_key(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 37 % 100).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("b"))
    order = [F.col("a").desc(), F.col("b").asc(), F.col("id").asc()]
    want = [tuple(r) for r in rows.orderBy(*order).collect()]
    E.publish_list(rows, order, str(tmp_path / "list"))
    page = E.read_page(spark, str(tmp_path / "list"), 7, 30)
    assert [tuple(r)[1:] for r in page.orderBy("no").collect()] == want[180:210]
    assert "PushedFilters: [IsNotNull(no), GreaterThanOrEqual(no,181), LessThanOrEqual(no,210)]" in page._jdf.queryExecution().toString()
    keys, last, seen = [("a", True), ("b", False), ("id", False)], None, []
    for _ in range(4):
        part = E.rows_after(rows, keys, last, 70).collect()
        seen += [tuple(r) for r in part]
        last = part[-1].asDict()
    assert seen == want[:280]
