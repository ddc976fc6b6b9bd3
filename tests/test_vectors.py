"""The vector index, pairs within groups and clusters against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import selection, vectorindex, vectorsearch

ODD = [("z1", None), ("z2", [0.0] * 16), ("z3", [float("nan")] + [1.0] * 15), ("z4", [None] + [1.0] * 15), ("z5", [float("inf")] + [1.0] * 15)]


def clustered_rows(seed, n, groups, spread=0.25):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, 16))
    return [(f"r{i:05d}", (middles[i % groups] + spread * rng.normal(size=16)).tolist()) for i in range(n)]


def exact(rows, queries, limit):
    ids, matrix = [i for i, _ in rows], np.array([v for _, v in rows])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    out = {}
    for q, v in queries:
        score = unit @ (np.array(v) / np.linalg.norm(v))
        out[q] = [ids[i] for i in sorted(range(len(ids)), key=lambda i: (-round(score[i], 12), ids[i]))[:limit]]
    return out


@pytest.fixture(scope="module")
def made():
    rows = clustered_rows(1, 6000, 80)
    return rows + [("r00000b", rows[0][1])], [(k, v) for k, (_, v) in enumerate(rows[::150])]


def frames(spark, made):
    return spark.createDataFrame(made[0] + ODD, "id string, embedding array<double>"), spark.createDataFrame([*made[1], (90, [0.0] * 16), (91, None), (92, [1.0, 2.0])], "query_id int, query array<double>")


def found_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.nth)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_index(spark, made, monkeypatch):
    monkeypatch.setattr(vectorindex, "TILE", 100)
    vectors, queries = frames(spark, made)
    index, want = vectorindex.VectorIndex.build(vectors), exact(*made, 10)
    assert found_of(index.search(queries, 10)) == want
    near = found_of(index.search(queries, 10, probes=8))
    recall = np.mean([len(set(near[q]) & set(want[q])) / 10 for q in want])
    compared = {r.query_id: r.rows for r in index.compared(queries, probes=8).collect()}
    assert recall >= 0.95 and set(compared) == set(want) and max(compared.values()) < len(made[0]) / 2
    assert {r.query_id: r.rows for r in index.compared(queries).collect()} == dict.fromkeys(want, len(made[0]))
    nothing = vectorindex.VectorIndex.build(vectors.limit(0))
    assert nothing.search(queries).count() == 0 and vectorindex.VectorIndex.build(vectors.filter("id LIKE 'z%'")).search(queries).count() == 0
    assert {tuple(r) for r in vectorsearch.search(vectors.filter("id LIKE 'r%'"), queries.filter("query_id < 90"), 10).select("query_id", "id", "nth").collect()} == {tuple(r) for r in index.search(queries, 10).select("query_id", "id", "nth").collect()}


def test_pairs_meet_only_near_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectorindex, "TILE", 40)
    rows = [("hot" if k % 10 else "cold", *r) for k, r in enumerate(clustered_rows(2, 1500, 30, 0.1))] + [("hot", *r) for r in ODD] + [(None, "n", [1.0] * 16)]
    pairs = vectorindex.close_pairs(spark.createDataFrame(rows, "g string, id string, embedding array<double>"), "g", 0.9, 0.99)
    want = set()
    fine = [r for r in rows if r[0] and not r[1].startswith("z")]
    for g in ("hot", "cold"):
        own = [r for r in fine if r[0] == g]
        unit = np.array([r[2] for r in own])
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        cosine = unit @ unit.T
        want |= {(g, own[i][1], own[j][1]) for i, j in zip(*np.nonzero((cosine >= 0.9) & (cosine <= 0.99))) if own[i][1] < own[j][1]}
    assert {(r.g, r.one, r.other) for r in pairs.found.collect()} == want and want
    met, every = pairs.met.filter("near").count(), pairs.met.count()
    assert 0 < met < every / 4
    assert vectorindex.close_pairs(spark.createDataFrame([], "g string, id string, embedding array<double>"), "g", 0.9).found.count() == 0


def test_nearest_in_group(spark, monkeypatch):
    monkeypatch.setattr(vectorindex, "TILE", 30)
    rows = [(k % 2, *r) for k, r in enumerate(clustered_rows(3, 200, 9))] + [(5, "alone", [1.0] * 16)] + [(0, "r00000b", clustered_rows(3, 1, 9)[0][1])]
    got = {r.id: r.other_id for r in vectorindex.nearest_in_group(spark.createDataFrame(rows, "g int, id string, embedding array<double>"), "g").collect()}
    for g in (0, 1):
        own = [(i, v) for k, i, v in rows if k == g]
        for i, v in own:
            assert got[i] == exact([x for x in own if x[0] != i], [(0, v)], 1)[0][0]
    assert "alone" not in got


def test_components_of_long_chains(spark):
    chain = [("g", f"n{i:04d}", f"n{i + 1:04d}") for i in range(300)] + [("h", "n0001", "n0002"), ("g", "x", "y")]
    got = {(r.g, r.id): r.component for r in vectorindex.components(spark.createDataFrame(chain, "g string, one string, other string"), ["g"]).collect()}
    assert all(got["g", f"n{i:04d}"] == "n0000" for i in range(301)) and got["h", "n0002"] == "n0001" and got["g", "y"] == "x" and len(got) == 305


@pytest.mark.parametrize("threshold", [0.9, 0.0])
def test_clusters_of_a_large_group(spark, threshold):
    rows = [(1, *r) for r in clustered_rows(4, 2500 if threshold else 60, 90, 0.15)] + [(2, *r) for r in clustered_rows(5, 40, 4)] + [(1, "z1", None), (1, "z2", [0.0] * 16)]
    got = {(r.g, r.cluster_id, r.id) for r in selection.clustered(spark.createDataFrame(rows, "g int, id string, embedding array<double>"), "g", threshold).collect()}
    want = set()
    for g in (1, 2):
        own = sorted((i, v) for k, i, v in rows if k == g)
        labels = selection.average_linkage([None if v is None else np.array(v) for _, v in own], threshold)
        sizes = np.bincount(labels, minlength=len(own))
        want |= {(g, own[c][0], i) for (i, _), c in zip(own, labels) if sizes[c] >= 2}
    assert got == want and want
