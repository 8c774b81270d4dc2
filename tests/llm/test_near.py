"""Near-duplicate classes against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from costbook.llm import near
from costbook.llm.hashed import Words

SCHEMA = "doc_id long, text string, row string, id int, label string"


def bag(text):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return Counter(tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))) if words else Counter()


def plain(rows):
    """class of each row by all pairs: the least id (None last) of its connected set."""
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            n, m = sum(bags[i].values()), sum(bags[j].values())
            if min(n, m) < 0.8 * max(n, m) or find(i) == find(j):
                continue
            both = sum((bags[i] & bags[j]).values())
            if both >= 0.8 * (n + m - both):
                root[find(i)] = find(j)
    sets = {}
    for k in range(len(rows)):
        sets.setdefault(find(k), []).append(k)
    return {k: min((rows[x][0] for x in own if rows[x][0] is not None), default=None) for own in sets.values() for k in own}


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(11)

    def prose(n):
        return [f"w{dice.randrange(3000)}" for _ in range(n)]

    out, passage = [], prose(60)
    for k in range(60):  # texts that share a passage of half their length, and are no duplicates
        out.append(prose(45) + passage + prose(10))
    base = prose(120)
    for k in range(80):  # a large group of near copies around the threshold
        own = list(base)
        for _ in range(dice.randrange(4)):
            own[dice.randrange(len(own))] = prose(1)[0]
        out.append(own)
    for n in (1, 2, 4, 5, 6, 8, 30, 400, 3000):
        one = prose(n)
        two = list(one)
        two[n // 2] = "changed"
        out += [one, list(one), two, one + ["more"]]
    out += [["same"] * 500, ["same"] * 420, ["same"] * 300]
    texts = [(k, " ".join(x)) for k, x in enumerate(out)]
    dice.shuffle(texts)
    texts += [(1000, None), (1001, ""), (1002, " ,. "), (None, texts[0][1]), (None, "nobody else has this"), (texts[1][0], texts[1][1]), (1003, texts[2][1].upper() + "!")]
    return texts


def test_equals_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(near, "FEW", 6)
    frame = spark.createDataFrame([(*r, "r", 1, "l") for r in rows], SCHEMA)
    got = Counter((r["doc_id"], r["class_id"]) for r in near.classes(frame).collect())
    want = plain(rows)
    assert got == Counter((rows[k][0], want[k]) for k in range(len(rows)))


def test_one_of_each_class_stays(spark, rows):
    frame = spark.createDataFrame([(*r, "r", 1, "l") for r in rows], SCHEMA)
    kept = near.keep_one(frame)
    assert kept.columns == frame.columns
    want = plain(rows)
    classes = {(want[k], None if want[k] is not None else rows[k][1]) for k in range(len(rows))}
    got = kept.collect()
    assert len(got) == len(classes) and {r["doc_id"] for r in got} == {c for c, _ in classes}


def test_nothing(spark):
    assert near.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near.keep_one(spark.createDataFrame([(1, None, "r", 1, "l")], SCHEMA)).count() == 1


def test_signatures_estimate_similarity():
    dice = np.random.default_rng(0)
    for similarity in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            n = int(dice.integers(3, 2000))
            same = max(1, round(2 * n * similarity / (1 + similarity)))
            units = dice.integers(0, 2**63, 2 * n - same).astype(np.uint64)
            with np.errstate(over="ignore"):
                one, two = near.dart_signature(units[:n], 128), near.dart_signature(units[n - same:], 128)
            errors.append((one == two).mean() - same / (2 * n - same))
        assert abs(np.mean(errors)) < 0.025


def test_strips_count_repeats():
    words = Words()
    with np.errstate(over="ignore"):
        assert len(np.unique(near.strips(words.of("a " * 20), 5))) == 16
        assert len(near.strips(words.of("a b"), 5)) == 1 and len(near.strips(words.of("  "), 5)) == 0
