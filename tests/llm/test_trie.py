"""Operator 12 against plain Python, in small blocks so that every level of names and minima takes part."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import trie
from tidemark.operators import order

SCHEMA = "conv_id long, turn long, role string, text string, r int, d string, pos int, key int, len string, lo int, least double"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, key, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = tuple(own.get(head, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if made[c] == p)
        yield min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()


def conversations(seed, n, shared):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = c if c % 7 else -c
        if rng.random() < 0.05:
            continue
        turns = rng.randrange(1, 14) if rng.random() < 0.8 else rng.choice([1, 40])
        same = rng.random() < 0.3
        for t in range(turns):
            rows.append((c, t, rng.choice(["user", "bot"]) if not same else "user", (f"hello {t}" if same or t < shared else rng.choice(["é", "b", "c " * 9, "", None]))))
    return rows


ODD = [(None, 1, "user", "nobody's"), (3000, None, None, None), (3000, 1, "x", "y"), (3000, 1, "x", "y"), (3001, 2, "a", "b"), (3001, 2, "b", "a"), (3002, 0, "a:b", ""), (3003, 0, "a", ":b"), (3004, 0, "long", "word " * 50_000)]


def frame(spark, rows):
    rng = random.Random(0)
    rows = [(*r, 1, "d", 2, 3, "l", 4, 0.5) for r in rows]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def compare(spark, rows):
    got = [tuple(r) for r in trie.prefix_trie(*trie.rebuilt(frame(spark, rows))).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(trie, "SPAN", 3)
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "PIECE", 5)
    monkeypatch.setattr(order, "BLOCK", 7)


def test_trie_in_small_blocks(spark, small):
    compare(spark, conversations(1, 120, 0) + ODD)


def test_trie(spark):
    compare(spark, conversations(2, 150, 3) + ODD)


@pytest.mark.parametrize("rows", [[], [(None, 0, "a", "b")], [(1, 0, "a", "b")], [(7, t, "user", f"t{t}") for t in range(300)] + [(8, t, "user", f"t{t}") for t in range(300)]])
def test_few_conversations(spark, rows):
    compare(spark, rows)


@pytest.mark.parametrize("shape", ["random", "rising", "falling", "flat"])
def test_nearest_smaller_and_least(spark, small, shape):
    rng, n = random.Random(4), 90
    values = {"random": [rng.randrange(6) for _ in range(n)], "rising": list(range(n)), "falling": list(range(n, 0, -1)), "flat": [2] * n}[shape]
    table = spark.createDataFrame(list(enumerate(values)), "pos long, v long")
    for r in trie.nearest_smaller(table, n).collect():
        smaller = [i for i in range(r.pos) if values[i] < values[r.pos]]
        assert (r.left, r.left_v) == ((smaller[-1], values[smaller[-1]]) if smaller else (-1, -1))
    asked = {(a := rng.randrange(n), rng.randrange(a + 1, n + 1)) for _ in range(60)}
    got = {(r.lo, r.hi): r.least for r in trie.range_least(table, n, spark.createDataFrame(sorted(asked), "lo long, hi long")).collect()}
    assert got == {(a, b): min(values[a:b]) for a, b in asked}
