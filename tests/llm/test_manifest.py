"""Merkle manifests against a tree built by hand."""

import hashlib
import zlib

import numpy as np
import pytest

from costbook.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place int, tree string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    parts = []
    for x in row:
        parts.append("-" if x is None else f"{len(str(x).encode())}:{x}")
    return sha("".join(parts))


def tree(nodes):
    """The root, and for each node the runs it goes through."""
    way, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k in range(len(nodes)):
            a = at[k] // 8 * 8
            way[k].append((level[a:at[k]], level[at[k] + 1:a + 8]))
        at = [x // 8 for x in at]
        level = [sha("".join(level[k:k + 8])) for k in range(0, len(level), 8)]
    return level[0], way


def plain(docs):
    langs = {}
    for d in docs:
        langs.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, leaf_of(d), d))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted(langs[x], key=lambda r: r[:3]) for x in order}
    trees = {x: tree([r[2] for r in own[x]]) for x in order}
    root, above = tree([trees[x][0] for x in order]) if order else (None, [])
    out = []
    for k, x in enumerate(order):
        for (_, _, leaf, d), way in zip(own[x], trees[x][1]):
            runs = way + above[k]
            changed = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 and d[4] is not None
            f = leaf_of((*d[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in d[4]))) if changed else leaf
            for a, b in runs:
                f = sha("".join(a) + f + "".join(b))
            out.append((d[0], leaf, trees[x][0], root, sha("".join("".join(a + b) for a, b in runs)), f, f == root))
    return sorted(out, key=repr)


def run(spark, docs):
    frame = spark.createDataFrame([(*d, 1, "t") for d in docs], SCHEMA)
    return sorted(map(tuple, manifest.verify(frame, manifest.tampered()).collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 4])
def test_equals_the_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    langs = [None, "", "de", "en", "ö", "z", "a", "b", "c", "d"]
    docs = [(k, f"s{k % 3}" if k % 5 else None, langs[min(k % 23, 9)] if k % 2 else "en", k if k % 7 else None, None if k % 11 == 0 else ["", "Text ÄB", "lower", "UPPER 🙂\n"][k % 4] * (k % 3)) for k in range(700)]
    docs += [(5, "r", "en", 1, "Repeated")] * 20 + [(None, None, None, None, None), (None, "x", "en", 2, "A"), (-3, "x", "single", 2, "A")]
    assert run(spark, docs) == plain(docs)


@pytest.mark.parametrize("n", [0, 1, 9, 64])
def test_sizes(spark, n):
    docs = [(k, "s", "en", 1, f"Text {k}") for k in range(n)]
    assert run(spark, docs) == plain(docs)


def test_queue_spills_and_merges(tmp_path):
    queue, dice = manifest.LabelQueue(str(tmp_path), held=5), np.random.default_rng(3)
    early = [(int(dice.integers(40)), k, f"m{k}") for k in range(200)]
    late = [(20 + int(dice.integers(40)), k, f"m{k}") for k in range(200, 300)]
    for x in early:
        queue.push(*x)
    assert len(queue.near) <= 5 and any(tmp_path.iterdir())
    got = []
    while (label := queue.first()) is not None:
        got += [(label, *x) for x in queue.take(label)]
        while late and label < 20:
            queue.push(*late.pop())
    assert [x[:2] for x in got] == sorted(x[:2] for x in got) and len(got) == 300
    assert sorted(x for x in got if x[1] < 200) == sorted(early)
    assert not any(tmp_path.iterdir())


def test_few_messages_wait():
    class Watched(manifest.LabelQueue):
        most = 0

        def push(self, *x):
            super().push(*x)
            Watched.most = max(Watched.most, len(self.near))

    leaves = [sha(str(k)) for k in range(4096)]
    block = manifest.Block(4096, 4)
    top, tape = block.forward(leaves, Watched("/nowhere"))
    ways = dict(block.backward(tape, None, Watched("/nowhere")))
    assert top == tree(leaves)[0] and sorted(ways) == list(range(4096)) and Watched.most <= 8 * 5
    assert [list(manifest.steps(ways[k])) for k in (0, 77, 4095)] == [[("".join(a), "".join(b)) for a, b in tree(leaves)[1][k]] for k in (0, 77, 4095)]
