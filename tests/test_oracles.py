"""Registered queries against their DuckDB SQL on the smallest tables: a sample of each topic, and the registry itself."""

import math

import duckdb
import pytest

from tidemark import registry
from tidemark.sources.views import TABLES

SF = "/root/testdata/sf0.001"
registry.load()
#: One or two of each topic; the driver compares all of them.
SAMPLE = ["src_list", "src_timeline", "flt_visible", "prd_policy", "fn_structural", "fn_overlap", "jn_evidence", "agg_profile", "win_budget", "set_dedup", "fts_bm25", "stg_merge_graph", "pipe_semantic", "pipe_precision", "leg_retrieve", "rt_rules", "gr_bfs", "gr_lineage", "snk_create_batch", "snk_context_move", "job_candidates", "job_decay_audit", "job_finalize", "job_repair", "rt_agent", "str_session", "agg_ir"]


def _norm(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(registry.QUERIES) > 230


@pytest.mark.parametrize("key", SAMPLE)
def test_equal(spark, duck, key):
    df = registry.QUERIES[key](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(_norm(r[c]) for c in columns) for r in df.collect())
    got = duck.execute(registry.ORACLES[key])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(_norm(r[names.index(c)]) for c in columns) for r in got.fetchall())
    assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
