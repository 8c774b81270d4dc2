"""Plan shapes: no product of two tables and no window over a whole table."""

import os
import re

import pytest

import costbook.plans  # noqa: F401
from costbook.operators import rates as U
from costbook.plans.registry import REGISTRY
from costbook.sources.bindings import Tables

FOLDER = "/root/testdata/sf0.001"
# queries that attach a one-row total to every row
ONE_ROW = {"e03_price_list", "e07_gap_match_report", "e13_export_summary"}
WRITES = {"src01_read_library", "d05_header_attributes", "d06_table_records", "u06_attribute_order", "snk04_class_tree_export"}


NAMES = sorted(set(REGISTRY) - WRITES)
# all of them with COSTBOOK_ALL=1
CHOSEN = NAMES if os.environ.get("COSTBOOK_ALL") else NAMES[::5]


def plan_of(spark, name):
    frame = REGISTRY[name].run(Tables(spark, FOLDER))
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", CHOSEN)
def test_plan_shape(spark, name):
    plan = plan_of(spark, name)
    if name not in ONE_ROW:
        assert not re.search(r"Join (Inner|Cross)(?!,)\s*$", plan, re.M) and "Join Cross" not in plan
    for spec in re.findall(r"windowspecdefinition\(([^,]*),", plan):
        assert not re.search(r"\b(ASC|DESC)\b", spec), spec


def test_detail_rows_are_numbered_as_they_are_worked_out(spark):
    # no chapter is large, so nothing is sampled, written and read again
    plan = plan_of(spark, "w07_running_sort_order")
    assert "Window" in plan and "LogicalRDD" not in plan and "RepartitionByExpression" not in plan


def test_rates_of_some_norms_carry_no_texts(spark):
    vols = ["A", "B"]
    consumption = spark.createDataFrame([(v, c, c, 3 + c % 5, "01", ["steel", "sand", "", "crane"][c % 4], ["x", None][c % 2], ["t", "", None][c % 3]) for v in vols for c in range(12)],
                                        "vol string, cons_ID long, master_res_ID long, cons_Style int, kind_Code string, cons_Name string, cons_Standard string, cons_Units string")
    content = spark.createDataFrame([(vols[k % 2], k % 9, (k * 7) % 12, None if k % 11 == 0 else k / 4) for k in range(80)], "vol string, norm_ID long, cons_ID long, cont_Amount double")
    content = content.where("(norm_ID % 2 = 0) = (vol = 'A')")
    prices = spark.createDataFrame([(c, None if c == 4 else 2.5 * c) for c in range(1, 9)], "res_ID long, price double")
    wanted = spark.createDataFrame([(1,), (4,), (7,), (8,), (99,)], "norm_ID long")
    all_rates = U.rates(U.price_lines(U.resource_lines(content, consumption, ["vol", "cons_ID"]), prices))
    got = U.rates_of(wanted, content, consumption, prices)
    want = sorted(tuple(r) for r in all_rates.join(wanted, "norm_ID", "left_semi").collect())
    assert want and sorted(tuple(r) for r in got.select(*all_rates.columns).collect()) == want
    dealt = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line]
    assert len(dealt) == 1 and "cons_Name" not in got._jdf.queryExecution().executedPlan().toString()
