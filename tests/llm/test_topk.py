"""Top-k search against all pairs."""

import math

import numpy as np
import pytest

from costbook.llm import topk


def plain(queries, rows, k):
    def whole(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(64 * x) for x in v]

    out = []
    for q, v in {(q, None if v is None else tuple(v)) for q, v in queries}:
        a = whole(v)
        if q is None or a is None:
            continue
        pairs = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, w in rows if i is not None and i != q and (b := whole(w)) is not None and len(b) == len(a))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(pairs[:k])]
    return out


def run(spark, queries, rows, k):
    q = spark.createDataFrame([(*x, 1) for x in queries], "query_id long, vector array<float>, dims int")
    r = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, vector array<float>, g int")
    return sorted(tuple(x) for x in topk.top_k(q, r, k, 64).collect())


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 200)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "TILE", 2)
    dice = np.random.default_rng(1)
    rows = [(int(k), [float(x) for x in dice.normal(0, 0.1, 24)]) for k in range(900)]
    rows += [(1000 + k, list(rows[5][1])) for k in range(40)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 24), (2003, [float("inf")] * 24), (None, rows[0][1]), (2004, [1.0, 2.0]), (2005, [0.5, -2.0]), (2006, []), (7, rows[8][1])]
    queries = rows[::11] + rows[-9:]
    queries = [x for k, x in enumerate(queries) if x[0] not in {y[0] for y in queries[:k]}]
    assert run(spark, queries, rows, 20) == sorted(plain(queries, rows, 20))


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = [(k, [0.25, float(k)]) for k in range(n)]
    assert run(spark, rows, rows, 20) == sorted(plain(rows, rows, 20))


def test_large_components_score_in_whole_numbers(spark):
    dice = np.random.default_rng(4)
    rows = [(k, [float(np.float32(x)) for x in dice.normal(0, 10.0 ** (k % 9), 6)]) for k in range(60)] + [(k, [2.0**30, x, 0.0, 0.0, 0.0, 0.0]) for k, x in ((100, 1.0), (101, 2.0), (102, 1.0))]
    got, want = run(spark, rows[::4] + rows[-3:], rows, 5), sorted(plain(rows[::4] + rows[-3:], rows, 5))
    hold = lambda s: min(max(s, -2**63), 2**63 - 1)
    assert all(-2**63 <= s < 2**63 for *_, s in got)
    assert sorted((q, s) for q, _, _, s in got) == sorted((q, hold(s)) for q, _, _, s in want)
    assert [r for r in got if r[0] in {q for q, _, _, _ in want if all(abs(s) < 2**63 for p, _, _, s in want if p == q)}] == [
        r for r in want if all(abs(s) < 2**63 for p, _, _, s in want if p == r[0])]


def test_scores_beyond_64_bits_are_held_at_the_end(spark):
    rows = [(1, [2.0**100]), (2, [2.0**101]), (3, [-(2.0**100)]), (4, [2.0])]
    assert run(spark, rows[:1], rows, 5) == [(1, 1, 2, 2**63 - 1), (1, 2, 4, 2**63 - 1), (1, 3, 3, -2**63)]


def test_no_block_passes_a_window(spark):
    rows = spark.createDataFrame([(k, [0.5, float(k)]) for k in range(10)], "vec_id long, vector array<float>")
    plan = topk.top_k(rows.withColumnRenamed("vec_id", "query_id"), rows, 3, 64)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Window" in line and "columns" in line]
