"""Queries of the graph engine against DuckDB on the smallest tables; the driver compares all of them."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tessera import queries

DIR = "/root/testdata/sf0.001"
NAMES = ("a9_metrics", "a20_blast_radius", "a23_impact_by_file", "d1_changes", "d2_streamed", "d3_bursts", "e11_replies", "f22_resolve_symbol", "g1_bfs_tree", "g3_callers_deep", "g6_impact_nested", "g17_random_walk", "g20_flow", "g21_seeds", "j11_by_name", "j5_dependency_files", "k4_appended_refs", "k5_deleted_files", "k10_index", "r11_camel", "r14_find", "r22_clusters", "t5_ranked_files", "w7_within_budget", "w8_uncovered", "x15_script_edges", "x19_client_uses", "x21_resolved_edges")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables aren't here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(table) -> tuple[list[str], list[str]]:
    d = table.to_pydict()
    cols = sorted(d)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return cols, sorted(repr(tuple(map(plain, r))) for r in zip(*(d[c] for c in cols), strict=True))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, db, name):
    want = db.sql(queries.ORACLES[name]).arrow()
    assert rows(queries.QUERIES[name](spark, DIR).toArrow()) == rows(want.read_all() if hasattr(want, "read_all") else want)


def test_every_oracle_has_its_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
