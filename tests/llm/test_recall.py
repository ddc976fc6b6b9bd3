"""What approximate operators find, against brute force on a few thousand rows."""

import random

import numpy as np

from tidemark.llm import ann, jaccard


def _shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_planted_pairs_at_the_threshold(spark):
    rng = random.Random(3)
    rows, pairs = [], []
    for k in range(700):
        first = [f"w{rng.randrange(10**6)}" for _ in range(160)]
        second = list(first)
        for at in rng.sample(range(5, 155), rng.choice((2, 3))):
            second[at] = f"x{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(first)), (2 * k + 1, " ".join(second))]
        a, b = _shingles(rows[-1][1]), _shingles(rows[-2][1])
        if len(a & b) / len(a | b) >= 0.8:
            pairs.append(k)
    rows += [(10_000 + k, " ".join(f"y{rng.randrange(10**6)}" for _ in range(60))) for k in range(700)]
    assert sum(0.8 <= len(a & b) / len(a | b) < 0.86 for k in pairs for a, b in [(_shingles(rows[2 * k][1]), _shingles(rows[2 * k + 1][1]))]) > 100
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    met = sum(found[2 * k + 1] == (2 * k, 1) for k in pairs)
    assert met >= 0.99 * len(pairs)
    far = set(range(700)) - set(pairs)
    assert all(found[2 * k + 1] == (2 * k + 1, 0) for k in far) and all(found[i] == (i, 0) for i, _ in rows[1400:])


def test_nearest_of_ten_thousand(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(200, 32))
    x = centres[rng.integers(0, 200, 10_000)] + 0.4 * rng.normal(size=(10_000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.vec_id % 100 == 0).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for i in range(0, 10_000, 100):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & set(got[i]))
    assert hits >= 0.95 * 1000
