"""Queries over whole given tables, against their SQL or the given table."""

from __future__ import annotations

import hashlib

import duckdb
import public_tokenizers
import pytest

from airlume.llm.bpe import vocabulary
from airlume.llm.queries import ORACLES, QUERIES
from oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    assert compare(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()) == ""


def test_bpe_digests(spark):
    encoding, _ = vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = encoding.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    got = QUERIES["op7_byte_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["op2_token_counts", "op5_url_filter", "op6_secret_scan", "op8_quality_classifier"])
def test_one_row_per_row(spark, name):
    table = "pages" if name.startswith("op5") else "documents"
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
