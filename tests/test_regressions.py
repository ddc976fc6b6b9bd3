"""The gate holds three measures of a run against the saved report of another: before, one against a number."""

import math

import duckdb
import numpy as np
import pytest

from tidemark import registry
from tidemark.operators import relations

registry.load()
SCHEMA = "vec_id long, embedding array<float>, label int"


def test_three_measures(spark):
    made = lambda rows: spark.createDataFrame(rows, "label string, hit_rate double, mrr double, ndcg_10 double")
    before = made([("all", 70.0, 0.6, 0.55), ("a", 100.0, 0.52, 0.52), (None, 50.0, 0.5, 0.5), ("gone", 9.0, 0.9, 0.9)])
    now = made([("all", 65.0, 0.55, 0.55), ("a", 98.0, 0.5, 0.5), (None, 50.0, 0.6, 0.4), ("new", 0.0, 0.0, 0.0)])
    got = {(r.label, r.metric): (r.baseline, r.current, round(r.drop, 9)) for r in relations.regressions(now, before, "label").collect()}
    assert got == {("all", "hit_rate"): (70.0, 65.0, 5.0), ("all", "mrr"): (0.6, 0.55, 0.05), (None, "ndcg_10"): (0.5, 0.4, 0.1)}


def plain(rows):
    """Measures of each label and of all, of whole vectors and of their signs, and what fell."""

    def report(vectors):
        cases = []
        for i, v, label in vectors:
            if i % 50:
                continue
            score = lambda w: sum(x * y for x, y in zip(v, w)) / math.sqrt(sum(x * x for x in v)) / math.sqrt(sum(x * x for x in w))
            near = sorted((-round(score(w), 12), j, other) for j, w, other in vectors if j != i)[:10]
            cases.append((label, next((n for n, (_, _, other) in enumerate(near, 1) if other == label and label is not None), None)))
        out = {}
        for group in {"all", *(c[0] for c in cases)}:
            ranks = [r for label, r in cases if group in ("all", label)]
            mean = lambda f: sum(f(r) for r in ranks if r) / len(ranks)
            out[group] = {"hit_rate": mean(lambda r: 100.0), "mrr": mean(lambda r: 1 / r), "ndcg_10": mean(lambda r: 1 / math.log2(r + 1))}
        return out

    before, now = report(rows), report([(i, [1.0 if x > 0 else -1.0 for x in v], label) for i, v, label in rows])
    falls = {(g if g is None else str(g), m): (before[g][m], now[g][m]) for g in before for m in before[g]}
    return {k: (round(a, 6), round(b, 6), round(a - b, 6)) for k, (a, b) in falls.items() if round(a - b, 9) > (2.0 if k[1] == "hit_rate" else 0.02)}


def gate(spark, tmp_path, rows):
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/embeddings.parquet")
    got = {(r.label, r.metric): (r.baseline, r.current, r["drop"]) for r in registry.QUERIES["agg_regression"](spark, folder).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    asked = con.execute(registry.ORACLES["agg_regression"]).fetchall()
    assert {(r[0], r[1]): pytest.approx(r[2:]) for r in asked} == got
    return got


def test_runs_are_compared(spark, tmp_path):
    """Clusters that lie in one orthant: whole vectors tell them apart, signs don't."""
    rng = np.random.default_rng(8)
    centers = np.abs(rng.normal(size=(4, 6))) + 0.1
    rows = [(i, (centers[i // 7 % 4] * rng.uniform(0.9, 1.1, 6) * (1, -1)[i % 2]).astype(np.float32).tolist(), None if i % 400 == 0 else i // 7 % 4) for i in range(1000)]
    got = gate(spark, tmp_path, rows)
    want = plain(rows)
    assert {k[1] for k in want} == {"hit_rate", "mrr", "ndcg_10"} and ("all", "mrr") in want
    assert got == {k: pytest.approx(x) for k, x in want.items()}


def test_nothing_fell(spark, tmp_path):
    """Signs of signs are the same vectors: no measure falls, however low it is."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.choice([-1.0, 1.0], 6).tolist(), int(rng.integers(5))) for i in range(300)]
    assert gate(spark, tmp_path, rows) == {} == plain(rows)


def test_no_rows(spark, tmp_path):
    assert gate(spark, tmp_path, []) == {}
