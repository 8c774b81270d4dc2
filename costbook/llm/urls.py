"""URL filter: rules by host and path, and for other urls a naive Bayes score over segmented words."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costbook.llm.rows import small
from costbook.session import settle

LONGEST_WORD = 20
UNITS = 1000  # scores are whole thousandths of a nat, so sums do not depend on their order


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (from the first :// up to /, ? or #, A-Z lower-cased) and path (then up to ? or #); empty without ://."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(length, rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path starts
    the url's; null if none fits."""
    fits = [F.when(((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path)),
                   F.struct(F.lit(len(r.host + r.path)).alias("length"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in rules]
    return F.array_max(F.array_compact(F.array(*fits)))


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, count) over the whole html of all pages, tags left out."""
    plain = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "))
    return pages.select(F.explode_outer(F.split(plain, r"[^\p{L}]+")).alias("word")).where(F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def _segment(tokens: list[str], edges: list[list[dict]], unknown: int) -> Iterator[list[str]]:
    for token, own in zip(tokens, edges):
        by_end: dict[int, list[tuple[int, int]]] = {}
        for e in own or ():
            by_end.setdefault(e["end"], []).append((e["begin"], e["cost"]))
        best, back = [0], [0]
        for end in range(1, len(token) + 1):
            cost, begin = min((best[b] + c, b) for b, c in [*by_end.get(end, ()), (end - 1, unknown)])
            best.append(cost)
            back.append(begin)
        out, end = [], len(token)
        while end:
            out.append(token[back[end]:end])
            end = back[end]
        yield out[::-1]


def segments(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, words): the most likely split of each distinct token under a unigram model of ``counts`` (Viterbi).

    A token's substrings of up to 20 letters meet the counts in a join, so no vocabulary is sent around; only the words inside a token come to its row.
    An unknown letter costs more than the rarest word.  Ties go to the longer last word.
    """
    total = counts.agg(F.sum("count")).first()[0] or 1
    unknown = round(UNITS * (math.log(total) + 3))
    cost = F.round(UNITS * (math.log(total) - F.log("count"))).cast("long")
    length = F.length("token")
    parts = F.flatten(F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), length - i)),
        lambda n: F.struct(F.substring(F.col("token"), i + 1, n).alias("word"), i.alias("begin"), (i + n).alias("end")))))
    parts = tokens.where(length > 0).select("token", F.explode_outer(parts).alias("part")).select("token", "part.*")
    edges = parts.join(counts.select("word", cost.alias("cost")), "word").groupBy("token").agg(F.collect_list(F.struct("begin", "end", "cost")).alias("edges"))

    @F.arrow_udf("array<string>")
    def viterbi(token: pa.Array, own: pa.Array) -> pa.Array:
        return pa.array(_segment(token.to_pylist(), own.to_pylist(), unknown), pa.list_(pa.string()))

    return tokens.join(edges, "token", "left").select("token", viterbi("token", "edges").alias("words"))


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every page (page_id, url, html).

    A url that a rule fits gets the verdict of the longest one.  These urls also teach a multinomial naive Bayes
    model (add-one smoothing) over the words of hosts and of paths; its score, in nats for "block", judges the rest: above 0 is block.
    Runs of digits count as the word 0; runs of letters are split by ``segments``, with counts over all pages.

    The list of rules is an argument and of its size.  A null url, or one without ``://``, has empty host and path and only the class
    prior; repeated rows and null ids are judged row by row; an empty table gives no rows; other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("by", ruled(F.col("host"), F.col("path"), rules))

    def raw(text: str, kind: str) -> Column:
        return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\p{Nd}+"), 0), lambda x: F.struct(
            F.lit(kind).alias("kind"), F.when(x.rlike(r"^\p{Nd}"), F.lit("0")).otherwise(x).alias("token")))

    # one row per distinct host and per distinct shape of a path; pages of one host are counted, not repeated
    parts = judged.select("page_id", "host", "path", "by", F.concat(raw("host", "h"), raw("path", "p")).alias("raw"))
    shapes = settle(parts.groupBy(F.col("raw"), F.col("by.verdict").alias("verdict")).agg(F.count(F.lit(1)).alias("n")))
    counted = settle(shapes.select(F.explode("raw").alias("raw"), "verdict", "n").groupBy("raw").agg(
        F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("block"), F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("allow")))
    split_ = segments(counted.select(F.col("raw.token").alias("token")).distinct(), settle(word_counts(pages)))
    spelled = settle(counted.join(split_, counted["raw.token"] == split_["token"]).select("raw", "block", "allow", F.explode("words").alias("word")))
    per_word = spelled.groupBy("raw.kind", "word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    size = per_word.agg(F.count(F.lit(1)).alias("words"), F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    docs = {r["verdict"]: r["n"] for r in shapes.groupBy("verdict").agg(F.sum("n").alias("n")).collect()}  # three rows at most
    prior = round(UNITS * math.log((docs.get("block", 0) + 1) / (docs.get("allow", 0) + 1)))
    offset = math.log((size["allow"] or 0) + size["words"] + 1) - math.log((size["block"] or 0) + size["words"] + 1)
    weight = F.round(UNITS * (F.log((F.col("block") + 1) / (F.col("allow") + 1)) + offset)).cast("long")
    weights = per_word.select("kind", "word", weight.alias("weight"))
    per_raw = spelled.select("raw", F.col("raw.kind").alias("kind"), "word").join(weights, ["kind", "word"]).groupBy("raw").agg(F.sum("weight").alias("weight"))
    scored = shapes.select("raw").distinct().select(F.col("raw").alias("shape"), F.explode("raw").alias("raw")).join(small(per_raw), "raw").groupBy("shape").agg(F.sum("weight").alias("sum"))
    score = (F.coalesce("sum", F.lit(0)) + prior) / UNITS
    out = parts.join(small(scored), parts["raw"] == scored["shape"], "left").withColumn("score", score)
    return out.select("page_id", "host", "path", F.col("by.rule").alias("rule"),
                      F.coalesce("by.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
