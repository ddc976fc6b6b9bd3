"""The exact vector search in shares against the plain sums of each pair."""

import math

import numpy as np
import pytest

from tidemark.operators import vectorsearch

ODD = [("n1", None), ("n2", [1.0, None, 2.0, 0.5]), ("n3", [0.0] * 4), ("n4", [float("nan"), 1.0, 0.0, 1.0]), ("n5", [1.0, 2.0]), ("n6", [float("inf"), 0.0, 1.0, 0.0]), ("n7", []), ("n8", [1e-150, 2e-150, 0.0, 1e-150])]


def plain(rows, asked, limit, least):
    out = {}
    for q, query in asked:
        met = []
        for i, v in rows:
            if v is None or query is None or len(v) != len(query):
                continue
            score = 0.0
            if None not in v and None not in query:
                total = one = other = 0.0
                for x, y in zip(v, query):
                    total, one, other = total + x * y, one + x * x, other + y * y
                length = math.sqrt(one) * math.sqrt(other)
                score = total / length if length and length < math.inf else float("nan") if length else 0.0
            met.append((-math.inf if math.isnan(score) else -score, i, score))
        best = [m for m in sorted(met) if least is None or not m[2] < least][:limit]
        out |= {(q, n): (i, repr(score)) for n, (_, i, score) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("limit, least, block", [(3, None, 16_384), (3, None, 20), (5, 0.3, 7), (100, 0.9, 50)])
def test_nearest(spark, monkeypatch, limit, least, block):
    monkeypatch.setattr(vectorsearch, "_BLOCK", block)
    monkeypatch.setattr(vectorsearch, "_SHARES", 3)
    rng = np.random.default_rng(5)
    some = rng.normal(size=(60, 4)).tolist()
    rows = [(f"r{i:03d}", some[i % 45]) for i in range(90)] + [(f"c{i}", [x * 2.0 for x in some[0]]) for i in range(9)] + ODD
    asked = [(i, v) for i, v in enumerate(some[:20])] + [(100 + i, v) for i, (_, v) in enumerate(ODD)]
    frames = spark.createDataFrame(rows, "id string, embedding array<double>"), spark.createDataFrame(asked, "query_id int, query array<double>")
    got = {(r.query_id, r.nth): (r.id, repr(r.score)) for r in vectorsearch.search(*frames, limit, least).collect()}
    assert got == plain(rows, asked, limit, least)


def test_what_is_sorted_grows_with_the_queries(spark):
    """Each share of rows gives limit rows a query, however many rows it holds: before, every pair was sorted."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(4000, 4)).tolist())], "id long, embedding array<double>")
    found = vectorsearch._nearest(rows, rows.filter("id < 5").selectExpr("id AS query_id", "embedding AS query"), 2, None)
    assert found.count() <= 5 * 2 * vectorsearch._SHARES
