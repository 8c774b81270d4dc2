"""Toxicity by logistic regression over hashed n-grams, learned by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costbook.llm.hashed import joined, worker_words

BITS = 20
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 12.0, 0.01, 8
MAX_ROWS = 16_384
CHARS = 1 << 22  # of the texts whose words are looked up at once


class Model(NamedTuple):
    """The non-zero weights (at most 2 ** BITS) and the bias; no weights and no bias if nothing was learned."""

    index: np.ndarray
    weight: np.ndarray
    bias: float | None


def parts(texts: list[str | None], chars: int = CHARS) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about ``chars`` characters, so that what is worked out of one stays small."""
    part, held = [], 0
    for x in texts:
        part.append(x)
        held += len(x or "")
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def features(words: np.ndarray) -> np.ndarray:
    """Distinct feature numbers of a text: its words, pairs of neighbours, and pairs with one word between them."""
    return np.unique(np.concatenate(_kinds(words)))


def _kinds(words: np.ndarray) -> list[np.ndarray]:
    """Feature numbers by kind, each at the place of its first word."""
    kinds = [joined(words), joined(words[:-1], words[1:]), joined(words[:-2], words[2:] + np.uint64(1))]
    return [(x >> np.uint64(64 - BITS)).astype(np.uint32) for x in kinds]


def weighted_features(texts: list[str | None], weighted: np.ndarray) -> list[np.ndarray]:
    """Of each text the distinct features that have a weight, as ``weighted`` tells, ascending."""
    words, text = worker_words().of_all(texts)
    found = []
    for k, at in enumerate(_kinds(words)):
        # neighbours must be of one text
        keep = np.flatnonzero(weighted[at] & (text[:len(at)] == text[k:]))
        found.append((text[keep] << BITS) + at[keep])
    every = np.unique(np.concatenate(found))
    return np.split(every & ((1 << BITS) - 1), np.searchsorted(every, np.arange(1, len(texts)) << BITS))


def fit(examples: list[tuple[int, np.ndarray]], passes: int = PASSES) -> Model:
    """FTRL-proximal over (label, features), in the order given: each coordinate has a rate of its own that shrinks with its
    squared gradients, and L1 keeps coordinates without evidence at zero."""
    if not examples:
        return Model(np.zeros(0, np.uint32), np.zeros(0), None)
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    positive = sum(y for y, _ in examples)
    # the rarer class counts as much as the other
    cost = {1: len(examples) / (2 * max(positive, 1)), 0: len(examples) / (2 * max(len(examples) - positive, 1))}

    def solved(z_: np.ndarray, n_: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z_) <= L1, 0.0, -(z_ - np.sign(z_) * L1) / ((BETA + np.sqrt(n_)) / ALPHA + L2))

    for _ in range(passes):
        for y, at in examples:
            zi, ni = z[at], n[at]
            w = solved(zi, ni)
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y) * cost[y]
            more = np.sqrt(ni + g * g)
            z[at] = zi + g - (more - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
            more = np.sqrt(bias_n + g * g)
            bias_z += g - (more - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    weight = solved(z, n)
    index = np.flatnonzero(weight)
    return Model(index.astype(np.uint32), weight[index], float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for ids whose crc32 (of the id as text) is divisible by ``folds``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, passes: int = PASSES) -> Model:
    """The model of labelled rows that are not held out.

    labels: (doc_id, toxic).  A sample of at most ``max_rows`` labelled ids, those with the smallest hashes, is learned from; of
    repeated labels the higher counts, of repeated documents the least text.  Null ids and labels are left out.
    The texts become features where they lie; one task then runs the bounded sample through the learner in order of hash.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("order", F.xxhash64("doc_id")).orderBy("order").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "order").agg(F.min("text").alias("text"))

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words()
        for b in batches:
            found = [features(words.of(x.as_py())).tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["order", "toxic", "features"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit([(y, np.frombuffer(x.as_py(), np.uint32)) for b in batches for y, x in zip(b.column(0).to_pylist(), b.column(1))], passes)
        if model.bias is not None:
            yield pa.RecordBatch.from_arrays([pa.array([model.index.tobytes()]), pa.array([model.weight.tobytes()]), pa.array([model.bias])], ["index", "weight", "bias"])

    rows = sample.select("order", "toxic", "text").mapInArrow(feature_rows, "order long, toxic int, features binary")
    got = rows.repartition(1).sortWithinPartitions("order", "toxic").select("toxic", "features").mapInArrow(fitted, "index binary, weight binary, bias double").first()
    return fit([]) if got is None else Model(np.frombuffer(got["index"], np.uint32), np.frombuffer(got["weight"]), got["bias"])


def score(model: Model, text: Column) -> Column:
    """Probability of toxicity of each whole text (null: empty); 0 if nothing was learned."""
    index, weight, bias = model

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.zeros(1 << BITS)
        table[index] = weight
        weighted = table != 0
        for batch in batches:
            if bias is None:
                yield pa.array(np.zeros(len(batch)))
                continue
            sums = np.array([table[at].sum() for part in parts(batch.to_pylist()) for at in weighted_features(part, weighted)])
            yield pa.array(1 / (1 + np.exp(-np.clip(sums + bias, -35, 35))))

    return scored(text)


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5) for every row of ``docs`` (doc_id, text).

    Scores come from texts alone.  Null and empty texts get the bias; null ids and repeated rows are scored row by row; other columns are
    ignored; without usable labels every score is 0; an empty table gives no rows.
    """
    model = learn(docs, labels, **options)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with a score under 0.5, with all their columns."""
    return docs.where(score(learn(docs, labels, **options), F.col("text")) < 0.5)
