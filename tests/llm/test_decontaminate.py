"""Benchmark leaks against all windows of all texts."""

import random
import re
from collections import Counter

import pytest

from costbook.llm import decontaminate

DOCS = "doc_id long, text string, id long, row string, size int"
ITEMS = "item_id long, text string, print long"


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    return [tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))] if words else []


def plain(docs, items, least=0.8):
    out = set()
    for doc, text in docs:
        own = shingles(text)
        for item, passage in items:
            want = shingles(passage)
            best = 0
            for a in range(max(len(own) - len(want), 0) + 1 if own and want else 0):
                x, y = Counter(own[a:a + len(want)]), Counter(want)
                both = sum((x & y).values())
                best = max(best, both / (sum(x.values()) + sum(y.values()) - both))
            if best >= least:
                out.add((doc, item, round(best, 9)))
    return out


def prose(dice, n):
    return " ".join(dice.choice(["the", "of", "a", *(f"w{k}" for k in range(60))]) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    dice = random.Random(3)
    items = [(k, prose(dice, n)) for k, n in enumerate((30, 31, 60, 90, 200, 5, 6, 3, 1))] + [(20, None), (21, ""), (22, "... !"), (30, "the the the the the the the the of a"), (None, prose(dice, 20))]
    items.append(items[0])
    docs = []
    for item, passage in items:
        words = (passage or "").split()
        for change in range(6):
            own = list(words)
            for _ in range(change // 2):
                if own:
                    at = dice.randrange(len(own))
                    own[at:at + 1] = [] if change % 2 else [prose(dice, 1), prose(dice, 1)]
            docs.append((len(docs), f"{prose(dice, dice.randrange(50))} {', '.join(own).upper()}\n{prose(dice, dice.randrange(50))}"))
    docs += [(900, None), (901, ""), (902, items[2][1]), (903, prose(dice, 20_000) + " " + items[3][1]), (None, items[0][1]), (904, items[0][1]), (904, items[0][1]), (905, items[7][1])]
    return docs, items


def test_finds_what_all_windows_hold(spark, tables):
    docs, items = tables
    found = decontaminate.leaks(spark.createDataFrame([(*d, 1, "r", 2) for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS)).collect()
    got = {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in found}
    want = plain([d for d in docs if d[0] != 903], items)
    assert {g for g in got if g[0] != 903} == want and (903, 3, 1.0) in got and len(want) > 30
    assert len(found) == len(got)


def test_drops_only_leaking_rows(spark, tables):
    docs, items = tables
    frame = spark.createDataFrame([(*d, 1, "r", 2) for d in docs], DOCS)
    kept = decontaminate.decontaminate(frame, spark.createDataFrame([(*i, 1) for i in items], ITEMS))
    bad = {d for d, *_ in plain([d for d in docs if d[0] != 903], items)} | {903}
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in docs if d not in bad)


def test_empty_tables(spark, tables):
    docs, items = tables
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some_d, some_i = spark.createDataFrame([(*d, 1, "r", 2) for d in docs[:3]], DOCS), spark.createDataFrame([(*i, 1) for i in items[:3]], ITEMS)
    assert decontaminate.leaks(none_d, some_i).count() == 0 and decontaminate.leaks(some_d, none_i).count() == 0
    assert decontaminate.decontaminate(some_d, none_i).count() == 3


def test_order_of_the_passage_does_not_matter(spark):
    dice = random.Random(11)
    items, docs = [], []
    for size in (45, 57, 60, 90, 200):
        words = [f"x{dice.randrange(10**6)}" for _ in range(size)]
        items.append((size, " ".join(words)))
        halves = words[size // 2:] + words[:size // 2]
        docs += [(len(docs), " ".join(halves)), (len(docs) + 1, f"{prose(dice, 70)} {' '.join(halves)} {prose(dice, 130)}")]
        edited = list(halves)
        edited[3] = "other"
        docs.append((len(docs), f"{prose(dice, 9)} {' '.join(edited)}"))
    found = decontaminate.leaks(spark.createDataFrame([(*d, 1, "r", 2) for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS)).collect()
    want = plain(docs, items)
    assert {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in found} == want and len(want) >= 10
