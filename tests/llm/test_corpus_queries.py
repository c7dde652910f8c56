"""The corpus queries against their SQL in DuckDB, and against plain Python, over the smallest tables."""

import hashlib
import os
import zlib

import pytest

from tamarack.llm import pii, queries

from .test_small import MODEL, brute_pii

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR) or not os.path.exists(MODEL), reason="no tables or no tokenizer files")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    want = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    found = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(str, map(tuple, found.select(*(f"`{n}`" for n in names)).collect()))) == sorted(str(tuple(r)) for r in want.fetchall())


def test_personal_data(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in queries.op9_pii(spark, SF_DIR).collect():
        base = brute_pii(texts[r["doc_id"]] or "")
        listed = ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[1] == i for x in base) for i in range(4)]
        assert r["n_spans"] == len([x for x in r["spans"].split(",") if x]) == len([x for x in r["scores"].split(",") if x])


def test_languages(spark):
    larger = os.path.join(os.path.dirname(SF_DIR), "sf0.01")
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    rows = queries.op3_language_id(spark, larger).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows) and len(rows) == len(langs)
    held = [r for r in rows if r["held_out"] and langs[r["doc_id"]]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_token_totals(spark):
    from collections import Counter

    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{os.path.dirname(MODEL)}/byte_bpe_50k.json")
    want = Counter()
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        if n := len(other.encode(r["text"] or "", add_special_tokens=False).ids):
            want[r["source"], r["lang"]] += n
    assert {(r["source"], r["lang"]): r["n_tokens"] for r in queries.op1_token_counts(spark, SF_DIR).collect()} == dict(want)
