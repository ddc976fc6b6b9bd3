"""A walk's levels are made once, and what asks for no text makes no text index; a retry isn't told by the last bit of a sum."""

from tidemark import registry
from tidemark.catalog import retrieval
from tidemark.operators import graphs
from tidemark.plans import pipelines


def test_levels_are_made_once(spark):
    relations = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n0", f"x{i}") for i in range(9)], "source_id string, target_id string")
    seeds = spark.createDataFrame([(1, "n0"), (2, "n3")], "query_id int, entity_id string")
    walked = graphs.walk(relations, seeds, 3, most=5)
    assert {(r.query_id, r.entity_id, r.depth) for r in walked.collect()} == {(1, "n0", 0), (1, "n1", 1)} | {(1, f"x{i}", 1) for i in range(9)} | {(2, f"n{i}", abs(i - 3)) for i in range(1, 6)}
    assert "Exchange" not in walked._jdf.queryExecution().executedPlan().toString()


def test_no_text_no_index(spark, monkeypatch):
    registry.load()

    def never(v):
        raise AssertionError("an index is made")

    monkeypatch.setattr(retrieval, "text_index", never)
    for key in ("gr_bfs_capped", "top_vec", "flt_min_score"):
        assert registry.QUERIES[key](spark, "/root/testdata/sf0.001").columns


def test_equal_sums_are_not_better(spark):
    one, two = (0.1 + 0.2) + 0.05, 0.1 + (0.2 + 0.05)
    low, high = sorted((one, two)) if one != two else (0.15, 0.15000000000000002)
    made = lambda *rows: spark.createDataFrame(rows, "query_id int, id string, score double")
    found = pipelines.retried(made((1, "a", low), (2, "b", 0.2)), made((1, "c", high), (2, "d", 0.25)), least=0.5)
    assert {(r.query_id, r.id) for r in found.collect()} == {(1, "a"), (2, "d")}
