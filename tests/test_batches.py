"""Batches of a source against the plain loop, most rows in one source."""

import random

import pytest

from tidemark.operators import order, selection


@pytest.mark.parametrize("seed, most, block", [(1, 100, 7), (2, 30, 4096), (3, 1, 50)])
def test_batches(spark, monkeypatch, seed, most, block):
    monkeypatch.setattr(order, "BLOCK", block)
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), i, rng.choice([0, 0, 1, 5, 20, 60, 99, 100, 101, 5000, None])) for i in range(900)]
    rows += [("zeros", i, 0) for i in range(50)] + [("one", 0, 7)]
    rng.shuffle(rows)
    got = {(r.source, r.id): r.batch for r in selection.batched(spark.createDataFrame(rows, "source string, id int, tokens long").repartition(5), "source", most).collect()}
    want = {}
    for source in {r[0] for r in rows}:
        own = sorted((i, n or 0) for g, i, n in rows if g == source)
        want |= {(source, i): b for (i, _), b in zip(own, selection.batches_of([n for _, n in own], most))}
    assert got == want


def test_no_rows(spark):
    assert selection.batched(spark.createDataFrame([], "source string, id int, tokens long"), "source", 10).count() == 0
