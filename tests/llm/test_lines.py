"""Line dedup against a plain computation."""

from collections import defaultdict

from costbook.llm import lines

SCHEMA = "doc_id long, text string, source string, id long, row long, gone string, Kept string, removed_lines string"


def plain(rows, least):
    sites, first = defaultdict(set), {}
    for doc, text, site in rows:
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            sites[line].add(site or "")
            order = (doc is None, doc if doc is not None else 0)
            first[line] = min(first.get(line, order), order)
    out = []
    for doc, text, site in rows:
        if text is None:
            out.append((doc, None, 0))
            continue
        kept, seen = [], set()
        for line in text.split("\n"):
            key = line.strip(" ")
            wide = key and len(sites[key]) >= least
            if not wide or (first[key] == (doc is None, doc if doc is not None else 0) and key not in seen):
                kept.append(line)
            seen.add(key)
        out.append((doc, "\n".join(kept), len(text.split("\n")) - len(kept)))
    return out


def order(rows):
    return sorted(rows, key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, 2, "g", "k", "r") for r in rows], SCHEMA)
    out = lines.dedup_lines(docs, **options)
    assert out.columns == ["doc_id", "text", "source", "id", "row", "gone", "Kept", "removed_lines"]
    return order((r["doc_id"], r["text"], r["removed_lines"]) for r in out.collect())


def test_removes_wide_lines_but_one(spark):
    rows = [(k, f"own {k}\n common \n\nnear {k % 9}\ncommon", f"s{k % 13}") for k in range(40)]
    rows += [(100, None, "s1"), (101, "", None), (102, "\n\n", ""), (None, "common\nnew", "s2"), (None, "common", None), (103, "common", "s3"), (104, "x\n" * 5000 + "common", "s4")]
    for least in (2, 10, 13):
        assert run(spark, rows, min_sites=least) == order(plain(rows, least))


def test_many_sites_need_the_estimate(spark):
    rows = [(k, f"wide\n{'half' if k % 2 else 'other'}\n{'few' if k < 299 else 'rest'}", f"s{k}") for k in range(900)]
    assert run(spark, rows, min_sites=300, precision=8) == order(plain(rows, 300))


def test_rows_alike_are_treated_alike(spark):
    rows = [(1, "a\nb", "s1"), (1, "a\nb", "s1"), (2, "a", "s2")]
    assert run(spark, rows, min_sites=2) == order([(1, "a\nb", 0), (1, "a\nb", 0), (2, "", 1)])


def test_nothing(spark):
    assert run(spark, []) == []


def test_long_lines_need_fewer_sites(spark):
    long, short = "many words " * 10, "few words"
    rows = [(k, f"own {k}\n{long}\n{short}", f"s{k % 4}") for k in range(20)] + [(k, f"pair {long}\nown {k}", f"s{k % 2}") for k in range(20, 24)]
    got = run(spark, rows)
    assert got == order([(0, f"own 0\n{long}\n{short}", 0)] + [(k, f"own {k}\n{short}", 1) for k in range(1, 20)] + [(k, t, 0) for k, t, _ in rows[20:]])
    assert run(spark, rows, long_sites=10) == order(plain(rows, 10)) and run(spark, rows, min_sites=2) == order(plain(rows, 2))
