"""The pipeline's stages against plain Python, each on its own input, over the smallest tables."""

import os

import pytest

import corpus_pipeline
from tamarack.llm import quality

from .test_small import MODEL, brute_near

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR) or not os.path.exists(MODEL), reason="no tables or no tokenizer files")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, rows = docs.columns, [[r for r in docs.collect()]]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows.append(docs.collect())
        if name != "sentencepiece":
            assert docs.columns == columns
    whole, good, once, apart, clean, encoded = rows
    ids = [{r["doc_id"] for r in x} for x in rows]
    assert all(len(i) == len(x) for i, x in zip(ids, rows, strict=True))

    verdict = quality.classify(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    assert ids[1] == {r["doc_id"] for r in verdict.filter("not rejected").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    best = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in ids[1] for i in best) >= 0.98 * len(best)

    first: dict[str, int] = {}
    for r in sorted(good, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r["doc_id"])
    assert ids[2] == set(first.values())
    assert ids[3] == {i for i, c in brute_near([(r["doc_id"], r["text"], "") for r in once]) if i == c}

    split = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    items = [" ".join(split(r["text"])) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    for r in apart:
        text = f" {' '.join(split(r['text']))} "
        if any(f" {i} " in text for i in items):
            assert r["doc_id"] not in ids[4]
    assert len(ids[3] - ids[4]) <= 10
    assert ids[5] == ids[4] and all(r["round_trip"] for r in encoded) and len(whole) >= len(clean)
