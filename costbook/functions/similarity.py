"""Name similarity: a character-set prefilter as columns, a sequence ratio as a pandas UDF."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Signs that carry no meaning in a resource name.
PUNCTUATION = r"[\s()（）\[\]【】,，、/\\·\-—_+]"
UNIT_BONUS = 0.08
CONTAINED = 0.85
# Fixed value: the sign that stands for all signs the other text lacks; a private one.
HIDDEN = "\uE000"


def norm_chars(text: Column) -> Column:
    """Distinct characters of a name, punctuation aside."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), PUNCTUATION, "")
    return F.array_distinct(F.filter(F.split(kept, ""), lambda c: c != ""))


def prefilter(a: Column, b: Column) -> Column:
    """Larger of Jaccard and 0.7 times containment, 0 below two shared characters."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(shared < 2, F.lit(0.0)).otherwise(
        F.greatest(shared / union, shared / F.least(F.size(a), F.size(b)) * 0.7))


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _pairwise(a: pd.Series, b: pd.Series, score) -> pd.Series:
    # a batch repeats few distinct pairs, each is compared once
    seen: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a.fillna(""), b.fillna("")):
        if pair not in seen:
            seen[pair] = score(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio(target: pd.Series, candidate: pd.Series) -> pd.Series:
    """Order-sensitive ratio of two texts; the first one is the target."""
    return _pairwise(target, candidate, _ratio)


def rerank(target: Column, candidate: Column, same_unit: Column) -> Column:
    """Ratio with a bonus for equal units, at most 1, three places."""
    return F.round(F.least(F.lit(1.0), sequence_ratio(target, candidate) + F.when(same_unit, UNIT_BONUS).otherwise(0.0)), 3)


def _floored(a: str, b: str) -> float:
    ratio = _ratio(a, b)
    return max(ratio, CONTAINED) if a in b or b in a else ratio


@F.pandas_udf(DoubleType())
def floored_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio, at least 0.85 where one text holds the other."""
    return _pairwise(a, b, _floored)


def seen_by(text: Column, other: Column) -> Column:
    """All that a comparison with ``other`` sees of a text: signs that ``other`` lacks match nothing, so they are one sign here."""
    foreign = F.call_function("translate", text, other, F.lit(""))
    hidden = F.call_function("translate", text, foreign, F.repeat(F.lit(HIDDEN), F.length(foreign)))
    return F.when(other.contains(HIDDEN), text).otherwise(hidden)


def match_score(a: Column, b: Column, bare_a: Column, bare_b: Column) -> Column:
    """Score of two cleaned names; tried again without their ordinals where either has one."""
    direct, again = floored_ratio(a, b), (a != bare_a) | (b != bare_b)
    # null where there is nothing new to compare
    return F.when(again, F.greatest(direct, floored_ratio(F.when(again, bare_a), F.when(again, bare_b)))).otherwise(direct)
