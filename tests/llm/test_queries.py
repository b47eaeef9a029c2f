"""The registered queries on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.llm import common
from tessera.llm import queries as Q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables aren't here")


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql_has_the_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = c.sql(Q.ORACLES[name])
    cols = sorted(want.columns)
    got = Q.QUERIES[name](spark, DIR).select(*cols).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.select(*cols).fetchall()))


#: The columns that each query has at least, in this order.
CONTRACTS = {
    "op1_contamination": "doc_id:bigint item_id:bigint",
    "op2_jaccard": "doc_id:bigint n_shingles:bigint component_id:bigint",
    "op3_shards": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op4_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op5_chunks": "doc_id:bigint n_chars:bigint edited_sha256:string fingerprint:string edited_fingerprint:string near_edited:double near_next:double",
    "op6_ppm": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op7_warc": "page_id:bigint payload_bytes:bigint payload_digest:string record_type:string refers_to:bigint",
    "op8_secrets": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    "op9_bpe": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op10_urls": "page_id:bigint host:string path:string rule:string verdict:string",
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract(spark, name):
    df = Q.QUERIES[name](spark, DIR)
    want = [x.split(":") for x in CONTRACTS[name].split()]
    assert [list(x) for x in df.dtypes[: len(want)]] == want
    if name not in ("op1_contamination",):
        t = "pages" if name in ("op7_warc", "op10_urls") else "documents"
        assert df.count() == common.table(spark, DIR, t).count()
