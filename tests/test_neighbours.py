"""Neighbours of all vectors: shares as matrices, no lists that every vector is sent to."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tidemark.catalog import lifecycle
from tidemark.operators import vectorindex, vectorsearch


def test_the_best_of_many_rows(spark):
    rng = np.random.default_rng(4)
    rows = rng.integers(-3, 4, (1500, 6)).astype(float)
    rows[700:900] = rows[5]
    asked = np.concatenate([rows[:40], rng.normal(size=(20, 6))])
    matrix = lambda m: vectorsearch._Matrix(pa.chunked_array([pa.array(m.tolist(), pa.list_(pa.float32()))]))
    one, other = matrix(rows), matrix(asked)
    for limit, least in ((11, None), (11, 0.9), (40, None)):
        at, to, score = vectorsearch.nearest_rows(one, other, limit, least)
        for q in range(len(asked)):
            every = vectorsearch._cosines(one, other, np.arange(1500), np.full(1500, q))
            order = [i for i in np.lexsort((np.arange(1500), -every)) if least is None or every[i] >= least][:limit]
            assert to[at == q].tolist() == order and score[at == q].tolist() == every[order].tolist()


def test_votes_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(vectorindex.VectorIndex, "build", None)  # before, each vector was sent to every list of an index
    rng = np.random.default_rng(6)
    held = [(f"m{i:02d}", [float(x) for x in rng.integers(-2, 3, 3)], None if i % 7 == 0 else i % 3) for i in range(60)]
    held += [("n0", None, 1), ("n1", [0.0, 0.0, 0.0], 1), ("n2", [1.0, None, 0.0], 1), ("n3", [1.0, float("nan"), 0.0], 1)]
    links = [(m, f"e{i % 9}") for i, (m, _, _) in enumerate(held)]
    views = SimpleNamespace(memory_embeddings=spark.createDataFrame(held, "memory_id string, embedding array<float>, label int"), memory_entities=spark.createDataFrame(links, "memory_id string, entity_id string"))
    fine = [(m, np.array(e), label) for m, e, label in held if e is not None and None not in e and np.isfinite(e).all() and any(e)]
    of, wanted = dict(links), {}
    for m, e, label in fine:
        if label is not None:
            near = sorted((-float(e @ o) / float(np.sqrt(e @ e) * np.sqrt(o @ o)), n) for n, o, _ in fine if n != m)[:10]
            for _, n in near:
                wanted[m, of[n]] = wanted.get((m, of[n]), 0) + 1
    got = {(r.memory_id, r.entity_id): r.votes for r in lifecycle._by_neighbours(views).collect()}
    assert got == {k: v for k, v in wanted.items() if v >= 2}
