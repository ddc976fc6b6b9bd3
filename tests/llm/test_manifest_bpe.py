"""Operators 11 and 13 against plain Python, on nulls, ties, repeated rows, long texts, empty tables and clashing names."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bpe, merkle
from tidemark.llm.order import cumulative, numbered

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The contracts' columns, then names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp int, pos string, n int, digest string, ids int, content string, _at int, _part int, proof int"
PARTS = ["a", "b", "e", "s", "t", " ", "  ", "\n", "'s", "'", "é", "中", "文", "1", "23", "!", "...", "İ", "\U00011de0", "₏", "the", "ing", "    ", "\x1c", "\x85", "​", "😀", "A"]


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(nodes):
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(places):
            run = place // 8 * 8
            paths[i].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 8])))
            places[i] = place // 8
        nodes = [H("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def manifest(rows):
    def leaf(r, text):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    if not rows:
        return
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {x: sorted(((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)), r) for r in rows if r.lang == x) for x in langs}
    trees = {x: tree([k[2] for k, _ in members[x]]) for x in langs}
    root, above = tree([trees[x][0] for x in langs])
    for x, upper in zip(langs, above):
        sub, paths = trees[x]
        for ((_, _, digest), r), path in zip(members[x], paths):
            text = r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for left, right in path + upper:
                node = H(left + node + right)
            yield r.doc_id, digest, sub, root, H("".join(a + b for a, b in path + upper)), node, node == root


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(30))), rng.choice(["en", "en", "en", "de", "É"]), "s", i) for i in range(150)]
    rows += [(i, f"T{i}", f"l{i % 11}", None, None) for i in range(200, 240)]
    rows += [(None, "No Id", "en", "s", 1)] * 2 + [(5, "Again", "en", None, 5)] * 3 + [(7, None, None, None, None), (8, "", None, "", 0), (9, "Á BC" * 60_000, "de", "s", 3)]
    return spark.createDataFrame([(*r, 1, "p", 2, "d", 3, "c", 4, 5, 6) for r in rows], SCHEMA)


@pytest.mark.parametrize("chosen", ["true", "lang = 'de'", "doc_id = 8", "lang IN ('l1', 'l2')", "false"])
def test_manifest(docs, chosen):
    rows = docs.filter(chosen)
    got = [tuple(r) for r in merkle.verified_documents(rows).collect()]
    assert sorted(got, key=str) == sorted(manifest(rows.collect()), key=str)


def test_manifest_finds_any_change(docs):
    leaves = docs.filter("doc_id < 60").select("doc_id", "lang", merkle.digest(F.col("doc_id"), F.col("text")).alias("digest"))
    proofs = merkle.proofs(merkle.build(leaves, F.col("lang"), ["doc_id"]))
    other = merkle.digest(F.col("doc_id") + 1, F.lit("x"))
    told = proofs.select((merkle.fold(F.col("digest"), F.col("proof")) == F.col("root")).alias("same"), (merkle.fold(other, F.col("proof")) == F.col("root")).alias("changed")).collect()
    assert all(r.same and not r.changed for r in told) and told


def test_positions_and_sums(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(50)}", rng.choice([None, *range(40)]), i) for i in range(9000)]
    got = numbered(spark.createDataFrame(rows, "g string, o int, i int").repartition(7), ["g"], ["o", "i"]).collect()
    sizes = Counter(r[0] for r in rows)
    ranks, seen = {}, Counter()
    for g, _, i in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        ranks[i] = g, seen[g]
        seen[g] += 1
    assert {(r.i, r.pos, r.n) for r in got} == {(i, p, sizes[g]) for i, (g, p) in ranks.items()}
    values = [rng.randrange(100) for _ in range(9000)]
    summed = cumulative(spark.createDataFrame(list(enumerate(values)), "p long, v long"), "p", ["v"], len(values)).orderBy("p").collect()
    assert [r.before_v for r in summed] == [0, *accumulate(values[:-1])]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(PATH), special_tokens={})


def test_encoding(docs, library):
    got = bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), H(" ".join(map(str, ids))), H(r.text or "")))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_other_patterns(spark, library):
    pattern = r"\p{N}|[^\s\p{N}]+|\s+"
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=bpe.ranks_of(PATH), special_tokens={})
    texts = ["one  two 34\U00011de0 x", "", None, "  ", "the the"]
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), PATH, pattern).collect()
    assert {r.doc_id: r.ids for r in got} == {i: other.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_every_prefix_has_its_last_token(library):
    vocabulary = bpe.Vocabulary(bpe.ranks_of(PATH))
    rng = random.Random(5)
    for _ in range(200):
        piece = "".join(rng.choice("etaoinsh") for _ in range(rng.randrange(1, 40)))
        table = vocabulary.table(piece.encode())
        for end in range(1, len(piece) + 1):
            assert vocabulary.traced(table[:end]) == library.encode_ordinary(piece[:end])
        half = rng.randrange(len(piece))
        assert vocabulary.table(piece.encode(), table[:half]) == table


def test_appends_and_edits(spark, library):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(30)))
        at = rng.randrange(len(text) + 1)
        rows.append((i, text, *((len(text), len(text)) if i % 3 else (at, at + rng.randrange(5))), "".join(rng.choice(PARTS) for _ in range(rng.randrange(4)))))
    rows += [(400, None, 0, 0, "new"), (401, "stays", None, 0, "x"), (402, "y " * 50_000, 4, 5, "zz"), (403, "off", -5, 900, "on")]
    table = spark.createDataFrame(rows, "doc_id int, text string, a int, b int, new string")
    state = bpe.encode(table, PATH, public_tokenizers.PATTERN, state=True)
    done = bpe.edited(state.join(table.drop("text"), "doc_id"), F.col("a"), F.col("b"), F.col("new"), PATH, public_tokenizers.PATTERN)
    again = {r.doc_id: r for r in bpe.encode(done.select("doc_id", "text"), PATH, public_tokenizers.PATTERN, state=True).collect()}
    found = done.collect()
    assert len(found) == len(rows)
    for r in found:
        _, text, a, b, new = rows[r.doc_id]
        if a is not None:
            a = max(0, a)
            assert r.text == (text or "")[:a] + new + (text or "")[max(a, b) :]
        assert r.ids == library.encode_ordinary(r.text or "") and (r.ids, r.pieces, r.tail) == (again[r.doc_id].ids, again[r.doc_id].pieces, again[r.doc_id].tail)


def test_an_edit_encodes_only_what_is_near(library):
    made = bpe.Encoder(bpe.ranks_of(PATH), bpe.pattern_of(public_tokenizers.PATTERN), True)
    text = " ".join(f"word{i}" for i in range(5000))
    state, encoded = made.state(text), []
    table = made.vocabulary.table
    made.vocabulary.table = lambda piece, known=None: (encoded.append(piece), table(piece, known))[1]
    changed = made.edited(text, *state, 20_000, 20_003, "x y")
    assert changed[1] == library.encode_ordinary(changed[0]) and 0 < len(encoded) < 12
