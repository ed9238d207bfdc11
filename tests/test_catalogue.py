"""Every SQL-backed query of the library against DuckDB, and the one-way order of its modules."""

import ast
import glob
import os

import pytest

from quillmesh.plans.catalogue import ORACLES, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHEAP = ["neighbor_drift", "drift_pivot", "edge_merge", "entity_churn", "betweenness", "alias_candidates", "alias_clusters", "vector_topk", "text_normalize", "mention_extract", "page_chunks", "candidate_status", "node_frame", "kpi_summary"]


@pytest.mark.parametrize("name", CHEAP)
def test_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    plain = lambda rows, names: sorted(str([repr(float(v)) if isinstance(v, float) else str(v) for _, v in sorted(zip(names, r))]) for r in rows)
    got = QUERIES[name](spark, sf)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)


def imports(path):
    for node in ast.walk(ast.parse(open(path).read())):
        if isinstance(node, ast.ImportFrom) and node.module:
            yield node.module
            yield from (f"{node.module}.{a.name}" for a in node.names)
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


def test_layers():
    rank = {"schemas": 0, "functions": 1, "sources": 2, "operators": 3, "plans": 4, "jobs": 5}
    for path in glob.glob(f"{ROOT}/quillmesh/**/*.py", recursive=True):
        layer = os.path.relpath(path, f"{ROOT}/quillmesh").split(os.sep)[0].removesuffix(".py")
        for name in imports(path):
            parts = name.split(".")
            if parts[0] == "quillmesh" and len(parts) > 1 and layer in rank:
                assert parts[1] != "llm", path
                assert name.startswith("quillmesh.plans.lineage") or rank.get(parts[1], 0) <= rank[layer], (path, name)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
