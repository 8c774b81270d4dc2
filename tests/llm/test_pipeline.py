"""The pipeline's stages over the small tables, each against what it must have done."""

import numpy as np
import pytest

import corpus_pipeline
from costbook.llm import decontaminate, near, toxicity
from costbook.session import scratch_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    path, out = scratch_path(spark, "stages"), [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], FOLDER).write.parquet(f"{path}/{k}")
        out.append(spark.read.parquet(f"{path}/{k}"))
    return out


def ids(frame):
    return {r["doc_id"] for r in frame.select("doc_id").collect()}


def test_columns(stages):
    for frame in stages[:5]:
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    judged = toxicity.judge(stages[0], labels).collect()
    assert ids(stages[1]) == {r["doc_id"] for r in judged if not r["predicted"]}


def test_line_dedup_keeps_rows_and_content(stages):
    before, after = ({r["doc_id"]: r["text"] for r in f.collect()} for f in stages[1:3])
    assert before.keys() == after.keys()
    words = [{x.strip(" ") for t in f.values() for x in t.split("\n")} - {""} for f in (before, after)]
    assert words[0] == words[1]
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_one_of_each_class(spark, stages):
    classes = near.classes(stages[2]).collect()
    assert ids(stages[3]) == {r["class_id"] for r in classes}
    assert stages[3].count() == len({r["class_id"] for r in classes})


def test_leaking_documents_go(spark, stages):
    found = decontaminate.leaks(stages[3], spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()
    assert ids(stages[4]) == ids(stages[3]) - {r["doc_id"] for r in found}


def test_everything_left_is_packed(stages):
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == ids(stages[4])
    total = {r["doc_id"]: r["doc_tokens"] for r in rows}
    for doc, n in total.items():
        pieces = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist() and sum(r["length"] for r in pieces) == n


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, FOLDER).count() == stages[5].count()
