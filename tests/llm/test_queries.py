"""Registered queries over the smallest given tables: against their SQL, or against the library itself."""

import zlib
from pathlib import Path

import numpy as np
import pytest

from conformance.check import connect, duckdb_rows, spark_rows
from evalspark.llm.queries import ORACLE, QUERIES
from evalspark.llm.vocabulary import load, public_path

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the given tables are not here")


@pytest.mark.parametrize("name", ["op4_benchmark_decontamination", "op6_substring_dedup", "op9_quality_rules", "op10_secret_scan"])
def test_query_and_sql(spark, name):
    found, expected = spark_rows(QUERIES[name](spark, FOLDER)), duckdb_rows(connect(FOLDER), ORACLE[name])
    assert found == expected and found[1]


def test_token_queries_and_the_library(spark):
    tokenizer = load(public_path("byte_bpe_50k.json"))
    texts = {row.doc_id: row.text or "" for row in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    ids = {doc: tokenizer.encode(text, add_special_tokens=False).ids for doc, text in texts.items()}
    counted = {tuple(row) for row in QUERIES["op5_token_counts"](spark, FOLDER).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    assert counted == {(doc, len(text.encode()), len(ids[doc]), len(ids[doc]) > 1024) for doc, text in texts.items()}
    expected, start = set(), 0
    for doc in sorted(ids):
        data = np.array([*ids[doc], 0], "<u4")
        expected.add((doc, start, len(data), zlib.crc32(data.tobytes())))
        start += len(data)
    assert {tuple(row) for row in QUERIES["op8_token_id_output"](spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == expected
