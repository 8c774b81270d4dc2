"""Source mixing against a plain walk over the sorted documents."""

import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from costbook.llm import mixing


def sizes(docs):
    return [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16)) for i, t, s in docs]


def plain_targets(docs, weights, share, most):
    total = defaultdict(int)
    for _, s, n, _ in sizes(docs):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, rest, target = set(order), Fraction(share) * sum(total.values()), {}
    while left:
        per = rest / sum(weight[s] for s in left)
        full = {s for s in left if per * weight[s] > most * total[s]}
        if not full:
            target |= {s: per * weight[s] for s in left}
            break
        target |= {s: Fraction(most * total[s]) for s in full}
        rest -= sum(target[s] for s in full)
        left -= full
    return total, target


def plain(docs, weights=(3, 1, 2), share=1.5, most=2):
    total, target = plain_targets(docs, weights, share, most)
    out = []
    for s in total:
        own = sorted((x for x in sizes(docs) if x[1] == s), key=lambda x: x[3])
        copies = [0] * len(own)
        for tier in range(most):
            budget, used = min(max(target[s] - tier * total[s], 0), total[s]), 0
            for k, (_, _, n, _) in enumerate(own):
                if used + n <= budget or used <= budget and 2 * (budget - used) >= n:
                    copies[k] += n > 0
                used += n
        out += [(i, s, n, total[s], round(float(target[s]), 6), c * n) for (i, _, n, _), c in zip(own, copies)]
    return sorted(out, key=repr)


def run(spark, docs):
    frame = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, source string, size int, `key` string")
    rows = mixing.mix_counts(frame).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    return sorted(((*r[:4], round(r[4], 6), r[5]) for r in rows), key=repr)


def test_equals_the_plain_walk(spark):
    docs = [(k, " ".join(f"w{j}" for j in range(k * 7919 % 83)) or None, f"s{k % 7}" if k % 9 else None) for k in range(600)]
    docs += [(1000 + k, "one long text " * 40, "big") for k in range(900)]
    assert run(spark, docs) == plain(docs)


def test_hot_source_of_repeated_rows(spark):
    docs = [(5, "same row each time", "a")] * 500 + [(None, None, "a"), (7, "", None), (None, "x", "b"), (8, "x y \x0bz\x1f", "c")] + [(k, "w " * (k % 5), "d") for k in range(100)]
    assert run(spark, docs) == plain(docs)
    assert run(spark, docs) == run(spark, docs[::-1])


@pytest.mark.parametrize("docs", [[], [(1, None, "a")], [(1, "a b", "x"), (2, "c d e", None)]])
def test_few_rows(spark, docs):
    assert run(spark, docs) == plain(docs)


def test_mixture_repeats_rows(spark):
    docs = [(k, f"text {k} " * (k % 11), f"s{k % 4}") for k in range(200)] + [(3, "text 3 " * 3, "s3")] * 2
    frame = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, source string, at int, whole string")
    mixed = mixing.mixture(frame)
    assert mixed.columns == frame.columns
    words = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert words == sum(x[-1] for x in plain(docs))


def test_a_later_hash_level_is_reached(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BITS", 3)
    docs = [(k, "w " * (k % 6), f"s{k % 3}") for k in range(300)]
    assert run(spark, docs) == plain(docs)
