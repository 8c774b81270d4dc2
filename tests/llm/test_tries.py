"""Prefix tries against a plain dictionary of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from costbook.llm import tries

COLUMNS = "conv_id long, turn long, role string, text string, key string, depth int"


def plain_rebuilt(rows, group=100, longest=6):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % longest
        out[c] = own.get(c - c % group, [])[:h] + v[h:]
    return out


def plain_nodes(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    below, kids = defaultdict(lambda: [0, 0]), defaultdict(int)
    for key in members:
        if key:
            kids[key[:-1]] += 1
    for key, m in members.items():
        for d in range(len(key) + 1):
            below[key[:d]][0] += key not in kids
            below[key[:d]][1] += (len(m) - 1) * len(key[-1][1]) if key else 0
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids.get(k, 0), *below[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
                  for k, m in members.items())


def run(spark, rows, turns=tries.TURNS):
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], COLUMNS)
    nodes = tries.prefix_nodes(tries.rebuilt(tries.conversations(frame)), turns).select(*tries.RESULT)
    return sorted(map(tuple, nodes.collect()))


def talk(n, dice, words=4, longest=7):
    return [(c, k, "user" if k % 2 == 0 else None, f"turn {dice.integers(words)}" if dice.random() < 0.9 else "") for c in range(n) for k in range(dice.integers(1, longest + 1))]


@pytest.mark.parametrize("turns", [1, 40, tries.TURNS])
def test_equals_plain_prefixes(spark, monkeypatch, turns):
    monkeypatch.setattr(tries, "PIECE", 3)
    dice = np.random.default_rng(turns)
    rows = talk(700, dice)
    # a third are copies of one conversation; one is long; ids, roles, texts and turns may be null
    rows += [(2000 + c, k, "user", f"copy {k}") for c in range(300) for k in range(6)]
    rows += [(3001, k, "user", f"long {k % 5}") for k in range(500)] + [(3002, k, "user", f"long {k % 5}") for k in range(450)]
    rows += [(None, 0, "user", "no conversation"), (3003, None, None, None), (3003, None, "user", "null turn"), (3003, 1, "user", "ü🙂"), (3003, 1, "user", "ü🙂"), (3105, 7, None, None)]
    assert run(spark, rows, turns) == plain_nodes(plain_rebuilt(rows))


def test_turnless_conversations(spark):
    rows = [(c, 0, "user", "x") for c in range(1, 60)]  # heads of an absent conversation
    got = run(spark, rows)
    assert got == plain_nodes(plain_rebuilt(rows)) and got[0][3] == 59


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []


def test_double_array_keeps_every_child():
    dice = np.random.default_rng(5)
    trie, nodes = tries.DoubleArray(4), np.array([0])
    want = {}
    for _ in range(6):
        pairs = np.array(sorted({(int(p), int(c)) for p in dice.choice(nodes, 60) for c in dice.integers(1, 500, dice.integers(1, 9))}))
        slots = trie.add(pairs[:, 0], pairs[:, 1])
        want |= {(int(p), int(c)): int(s) for (p, c), s in zip(pairs, slots)}
        nodes = slots
    assert len(set(want.values())) == len(want)
    keys = np.array(list(want))
    assert trie.step(keys[:, 0], keys[:, 1]).tolist() == list(want.values())
    with pytest.raises(AssertionError):
        trie.step(keys[:1, 0], np.array([501]))
