"""The url filter against a plain computation."""

import math
import re
from collections import Counter

import pytest

from costbook.llm import urls
from costbook.llm.queries import RULES

SCHEMA = "page_id long, url string, html string, host string, raw string, score int"
HTML = "<p>the cat sat on the mat</p><b>cat pills pills cheap cheap cheap</b> The dog eats catalogues"
PAGES = [(1, "http://A.cheappills.NET/x/1?q=/de/#y", HTML), (2, "https://example.net/en/thecat", HTML), (3, "ftp://example.net?x", None), (4, "http://example.com/de/a/b", ""),
         (5, "http://mat.org/fr/cat", HTML), (6, "http://mat.org/frog/cat", HTML), (7, None, HTML), (8, "no scheme", HTML), (None, "http://cheapcheap.info/pills/12", HTML), (10, "http://thecatsat.info/mat/999", HTML),
         (10, "http://thecatsat.info/mat/999", HTML), (11, "http://notexample.com/de/x", HTML), (12, "http://net/x", HTML), (13, "://", HTML), (14, "http://x.net", HTML), (15, "http://" + "thecat" * 2000 + ".info/", HTML)]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def segment(token, counts):
    total = sum(counts.values()) or 1
    best = [(0, 0)]
    for end in range(1, len(token) + 1):
        options = [(best[end - 1][0] + round(1000 * (math.log(total) + 3)), end - 1)]
        options += [(best[b][0] + round(1000 * (math.log(total) - math.log(counts[token[b:end]]))), b) for b in range(max(0, end - 20), end) if token[b:end] in counts]
        best.append(min(options))
    out, end = [], len(token)
    while end:
        out.append(token[best[end][1]:end])
        end = best[end][1]
    return out[::-1]


def plain(pages):
    counts = Counter(w for _, _, html in pages for w in re.split(r"[^a-z]+", re.sub("<[^>]*>", " ", (html or "").lower())) if 1 <= len(w) <= 20)
    judged = []
    for page, url, _ in pages:
        host, path = parts(url)
        tokens = [(kind, w) for kind, text in (("h", host), ("p", path)) for t in re.findall(r"[a-z]+|[0-9]+", text.lower()) for w in (["0"] if t[0].isdigit() else segment(t, counts))]
        judged.append((page, host, path, rule_of(host, path), tokens))
    seen = {v: Counter(t for *_, r, ts in judged if r and r.verdict == v for t in ts) for v in ("block", "allow")}
    n = {v: sum(1 for *_, r, _ in judged if r and r.verdict == v) for v in seen}
    words = {t for *_, ts in judged for t in ts}
    size = {v: sum(seen[v].values()) + len(words) + 1 for v in seen}
    out = []
    for page, host, path, rule, tokens in judged:
        score = round(1000 * math.log((n["block"] + 1) / (n["allow"] + 1)))
        score += sum(round(1000 * (math.log((seen["block"][t] + 1) / (seen["allow"][t] + 1)) + math.log(size["allow"]) - math.log(size["block"]))) for t in tokens)
        out.append((page, host, path, rule and rule.host + rule.path, rule.verdict if rule else ("block" if score > 0 else "allow"), score / 1000))
    return out


@pytest.mark.parametrize("pages", [PAGES, PAGES[:1], PAGES[6:8], []])
def test_equals_the_plain_computation(spark, pages):
    frame = spark.createDataFrame([(*p, "h", "r", 1) for p in pages], SCHEMA)
    got = [tuple(r) for r in urls.judge(frame, RULES).collect()]
    # a sum of thousands of rounded weights is compared as it is
    assert sorted(got, key=repr) == sorted(plain(pages), key=repr)


def test_words_inside_hosts(spark):
    counts = spark.createDataFrame([("cheap", 50), ("pills", 40), ("the", 900), ("a", 500), ("heap", 5)], "word string, count long")
    tokens = spark.createDataFrame([("cheappills",), ("thepills",), ("xyz",)], "token string")
    got = {r["token"]: r["words"] for r in urls.segments(tokens, counts).collect()}
    assert got == {"cheappills": ["cheap", "pills"], "thepills": ["the", "pills"], "xyz": ["x", "y", "z"]}
