"""Registered queries against their SQL; all of them with COSTBOOK_ALL=1, a cross-section otherwise."""

import os

import oracle
import pytest

import costbook.plans  # noqa: F401
from costbook.plans.registry import REGISTRY

FOLDER = os.environ.get("COSTBOOK_FOLDER", "/root/testdata/sf0.001")
CROSS_SECTION = ("a07_", "a11_", "a12_", "a16_", "a23_", "a27_", "e06_", "e13_export_unit", "e14_", "h01_", "h08_", "h10_", "j08_", "j13_", "j18_", "j19_", "j31_",
                 "q04_", "src06_", "u02_", "w02_", "w05_", "w06_", "w10_", "w15_", "x21_", "x23_", "x40_")
WITH_SQL = [n for n, q in REGISTRY.items() if q.sql is not None]
CHOSEN = WITH_SQL if os.environ.get("COSTBOOK_ALL") else [n for n in WITH_SQL if n.startswith(CROSS_SECTION)]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, con, name):
    message = oracle.difference(spark, con, FOLDER, name)
    assert message is None or (message == "no rows" and os.environ.get("COSTBOOK_ALL")), message


def test_entry_points_agree():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 230


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 25
