"""Clusters merge in memory that goes with the rows, not with their pairs."""

import tracemalloc

import numpy as np

from tidemark.operators import selection


def plain(unit, most):
    label, groups = list(range(len(unit))), {i: [i] for i in range(len(unit))}
    while len(groups) > 1:
        mean = lambda a, b: round(float(np.mean([1 - unit[i] @ unit[j] for i in groups[a] for j in groups[b]])), 12)
        best, a, b = min((mean(a, b), a, b) for a in groups for b in groups if a < b)
        if best > most:
            break
        groups[a] += groups.pop(b)
    for a, rows in groups.items():
        for i in rows:
            label[i] = a
    return label


def test_merges_in_bounded_memory(monkeypatch):
    rng = np.random.default_rng(4)
    unit = lambda n, d: (x := rng.normal(size=(n, d))) / np.linalg.norm(x, axis=1, keepdims=True)
    few = unit(36, 3)
    few[5:9], few[20] = few[2], 0.0
    monkeypatch.setattr(selection, "CELLS", 50, raising=False)
    for most in (0.1, 0.5, 0.9):
        assert selection._merged(few, most).tolist() == plain(few, most)
    monkeypatch.setattr(selection, "CELLS", 1 << 18, raising=False)
    many = unit(4000, 8)
    tracemalloc.start()
    selection._merged(many, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(many) ** 2 * 8 / 4  # before, the matrix of all distances: len ** 2 * 8 and more
