"""Toxicity: held-out accuracy, and what may not matter."""

import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from costbook.llm import toxicity
from costbook.llm.hashed import Words

DOCS = "doc_id long, text string, lang string, source string, score double, order int"


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(4)
    out = []
    for k in range(900):
        words = [f"w{dice.randrange(300)}" for _ in range(dice.randrange(20, 120))]
        if k % 5 == 0:
            for _ in range(6):
                words.insert(dice.randrange(len(words)), dice.choice(["idiot", "scum", "moron", "clown"]))
        out.append((k, " ".join(words), int(k % 5 == 0)))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", "s", 0.5, 1) for k, t, _ in rows] + [(None, None, "en", "s", 0.1, 2), (5000, "", None, None, None, None), (5001, "w1 " * 100_000 + "idiot", "en", "s", 0.0, 0), (5000, "", "x", "y", 1.0, 1)], DOCS)
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows] + [(None, 1, 1), (7000, 0, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark, rows):
    docs, labels = frames(spark, rows)
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == len(rows) + 4
    truth = {k: y for k, _, y in rows}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held) > 100
    assert len({r["score"] for r in got if r["doc_id"] == 5000}) == 1


def test_held_out_labels_and_other_columns_do_not_matter(spark, rows):
    docs, labels = frames(spark, rows[:300])
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    scores = [sorted((r["score"], r["predicted"]) for r in toxicity.judge(d, x).collect()) for d, x in ((docs, labels), (docs, changed), (other, labels))]
    assert scores[0] == scores[1] == scores[2]


def test_weights_are_sparse_and_bounded(spark, rows):
    docs, labels = frames(spark, rows)
    model = toxicity.learn(docs, labels, max_rows=200)
    assert 0 < len(model.index) < 2000


def test_nothing_to_learn_from(spark, rows):
    docs, labels = frames(spark, rows[:10])
    assert {r["score"] for r in toxicity.judge(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.without_toxic(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.judge(docs.limit(0), labels).count() == 0


def test_texts_scored_together_have_the_features_of_each():
    dice = np.random.default_rng(3)
    odd = [None, "", " _ ", "x", "x Y", "a_b-C", "ÄÖ İı ſ 中文字 ½x ①", "\U0001F600 a\U00010400b", "Ωσς² ٣", "été"]
    every = "".join(chr(c) + " " for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    texts = [*odd, *(" ".join(dice.choice(["ab", "Cd", "ef_g", "中", "x,y"], dice.integers(1, 40))) for _ in range(200)), every]
    words, text = Words().of_all(texts)
    alone = [Words().of(x) for x in texts]
    assert (words == np.concatenate(alone)).all() and (text == np.repeat(range(len(texts)), [len(x) for x in alone])).all()
    weighted = dice.random(1 << toxicity.BITS) < 0.3
    for some in (texts, odd[:3], ["x"]):
        found = [at for part in toxicity.parts(some, 500) for at in toxicity.weighted_features(part, weighted)]
        assert len(found) == len(some)
        for x, at in zip(some, found):
            own = toxicity.features(Words().of(x))
            assert at.tolist() == own[weighted[own]].tolist()
