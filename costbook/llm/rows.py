"""Small helpers of the operators: row identity, words and shingles as columns, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def text_key(text: Column | str) -> Column:
    """64 bits of a text.  With doc_id it names a row, so that rows without an id, or many rows of one id, do
    not meet in one task; rows alike in both are treated alike."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame marked for broadcast if a count shows that it has at most ``rows`` rows, else as it is.
    For frames of a few numbers a row that are cheap to compute twice."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put in front until the frame has none of them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Runs of letters, marks and digits in lower case; of null none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def shingles(words: Column, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words in order; of fewer words one of all, of none none."""
    def one(i: Column) -> Column:
        return F.xxhash64(*(F.get(words, i + k) for k in range(size)))

    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))), one)).otherwise(
        F.array().cast("array<bigint>"))
