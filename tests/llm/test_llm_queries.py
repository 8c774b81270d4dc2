"""Queries against their SQL, and the names of all operators."""

from collections import Counter

import oracle
import pytest

from costbook.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = Counter(tuple(oracle._cell(r[c]) for c in columns) for r in frame.collect())
    cursor = oracle.connect(FOLDER).execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(oracle._cell(r[names.index(c)]) for c in columns) for r in cursor.fetchall()) and got
