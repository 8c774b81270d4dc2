"""Reply trees: paths, ranks, and the round trip of the template."""

import hashlib

import pytest

from costbook.llm import chat

NODES = "tree long, node long, parent long, role string, text string, score double, up int, leaf string"
MARKS = ["</s>[INST] ok [/INST]", "<<SYS>><</SYS>>\\", "<<ROLE>>x<</ROLE>><</TURN>>", "\\</s>\\\\<s>", "<</s>", "<<<</SYS>>>", " [/INST]", "[/INST] ", "", None, "a\nb\r\n", "漢😀[INST]", "<\\/s>", "$1 \\$"]


def paths_of(nodes):
    own = {(t, n): (p, r, x, s) for t, n, p, r, x, s in nodes}
    parents = {(t, p) for (t, n), (p, *_) in own.items() if p is not None}
    out = {}
    for key in own:
        if key in parents:
            continue
        path, at = [], key
        while at in own:
            path.append(own[at])
            at = (at[0], own[at][0])
        out[key] = ([(r or "", x or "") for _, r, x, _ in path[::-1]], sum(s or 0 for *_, s in path))
    return out


def run(spark, nodes, keep):
    frame = spark.createDataFrame([(*n, 1, "l") for n in nodes], NODES)
    out = chat.format_trees(frame, keep)
    return out.select("tree", "leaf", "rank", "formatted", "loss", chat.read_back(out["formatted"]).alias("turns")).collect()


def tree(n):
    roles = ("system", "user", "assistant", "tool <<ROLE>>", None)
    return [(t, k, None if k == 0 else (k * 7 + t) % k, roles[k % 5], MARKS[(k + t) % len(MARKS)], None if k % 4 == 0 else k % 3 / 2) for t in range(3) for k in range(n)]


@pytest.mark.parametrize("keep", [None, 2, 1])
def test_branches_and_round_trip(spark, keep):
    nodes = tree(40) + [(9, 1, 77, "user", "orphan", 0.0)]
    want = paths_of(nodes)
    ranks = {}
    for (t, leaf), (_, score) in want.items():
        ranks.setdefault(t, []).append((-score, leaf))
    chosen = {(t, leaf): k + 1 for t, x in ranks.items() for k, (_, leaf) in enumerate(sorted(x)) if keep is None or k < keep}
    rows = run(spark, nodes, keep)
    assert {(r["tree"], r["leaf"]): r["rank"] for r in rows} == chosen
    for r in rows:
        turns = want[r["tree"], r["leaf"]][0]
        assert [(x["role"], x["text"]) for x in r["turns"]] == turns
        learned = "".join(r["formatted"][s["start"]:s["start"] + s["length"]] for s in r["loss"])
        assert learned.count("</s>") == 0 and len(r["loss"]) == sum(role == "assistant" for role, _ in turns)


def test_long_chain(spark):
    nodes = [(1, k, k - 1 if k else None, "user" if k % 2 else "assistant", f"t{k}", 0.0) for k in range(300)]
    row, = run(spark, nodes, 1)
    assert [x["text"] for x in row["turns"]] == [f"t{k}" for k in range(300)]


def test_odd_rows(spark):
    nodes = [(1, 1, None, "user", "b", 0.0), (1, 1, None, "user", "a", 0.0), (None, 1, None, "user", "x", 0.0), (2, None, None, "user", "x", 0.0), (3, 1, 2, "user", "x", 0.0), (3, 2, 1, "user", "x", 0.0), (4, 1, None, "assistant", "y" * 300_000, None)]
    rows = run(spark, [n for n in nodes if n[0] != 3], 1)
    assert {(r["tree"], len(r["formatted"])) for r in rows} == {(1, 16), (4, 300_007)}
    with pytest.raises(ValueError, match="ancestor"):
        run(spark, [n for n in nodes if n[0] == 3], 1)
    assert run(spark, [], 1) == []


def test_digest(spark):
    turns = [(-1, 0, "user", MARKS[0]), (-1, 1, "assistant", MARKS[0])] + [(5, k // 2, ("user", "assistant", "system")[k % 3], t) for k, t in enumerate(MARKS)] + [(None, 1, "user", "x"), (6, 1, None, None)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_trees(chat.linear_nodes(frame))).collect()}
    assert set(got) == {-1, 5, 6}
    for conv, r in got.items():
        own = sorted(((t, role is not None, role or "", x is not None, x or "") for c, t, role, x in turns if c == conv))
        said = [(role, x) for _, _, role, _, x in own]
        learned = "".join(x for role, x in said if role == "assistant")
        assert r["n_turns"] == len(said) and r["loss_chars"] == len(learned)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
