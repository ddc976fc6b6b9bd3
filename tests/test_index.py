"""The index in segments against a new one, and words by a dictionary against all segmentations."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fulltext
from tidemark.operators.segmentation import Dictionary, segmenter
from tidemark.operators.segments import SegmentedIndex
from tidemark.session import fingerprint, shared_dir

ROWS = "id string, content string, excerpt string, summary string"
COMMON = ["alpha", "beta", "gamma", "delta", "of", "the"]


def text(rng):
    return " ".join(rng.choice(COMMON + [f"rare{rng.randrange(30)}"]) for _ in range(rng.randrange(0, 25)))


def ranks(rows, queries, index=None):
    found = fulltext.bm25(rows, fulltext.query_parts(queries), index=index).collect()
    return sorted((r.query_id, r.id, round(r.bm25, 8)) for r in found)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "alpha rare1"), (2, "beta gamma delta"), (3, "of the"), (4, "rare2 rare3 rare4"), (5, "nowhere"), (6, "")], "query_id int, text string")


def test_any_order_of_changes_ranks_as_a_new_index(spark, queries):
    rng = random.Random(1)
    index = SegmentedIndex(spark, f"{shared_dir(spark)}/changes")
    live: dict[str, tuple] = {}
    assert ranks(spark.createDataFrame([], ROWS), queries, index.index()) == []
    for step in range(9):
        kind = ("add", "add", "delete", "replace", "merge small", "restore", "delete", "merge", "add")[step]
        if kind in ("add", "replace", "restore"):
            ids = [f"r{rng.randrange(40)}" for _ in range(12)] if kind != "add" else [f"r{step * 20 + k}" for k in range(20)]
            batch = {i: (i, text(rng), rng.choice([None, text(rng)]), "") for i in ids}
            index.add(spark.createDataFrame(list(batch.values()), ROWS))
            live |= batch
        elif kind == "delete":
            gone = rng.sample(sorted(live), 9) + ["never there"]
            index.delete(spark.createDataFrame([(i,) for i in gone + gone[:2]], "id string"))
            live = {i: r for i, r in live.items() if i not in gone}
        else:
            index.merge(15 if kind == "merge small" else None)
        rows = spark.createDataFrame(list(live.values()), ROWS)
        assert ranks(rows, queries, index.index()) == ranks(rows, queries), (step, kind)
        version = index.version()
        assert version.rows == len(live)
    assert len(version.segments) == 2 and not [d for d in version.dead if all(n > d[1] for n, _ in version.segments)]


def test_a_batch_that_breaks_off_leaves_the_version_before(spark, queries):
    index = SegmentedIndex(spark, f"{shared_dir(spark)}/broken")
    rows = spark.createDataFrame([("a", "alpha beta", "", "")], ROWS)
    index.add(rows)
    fails = F.udf(lambda t: 1 / 0, "string")
    with pytest.raises(Exception):
        index.add(rows.select("id", fails("content").alias("content"), "excerpt", "summary"))
    assert ranks(rows, queries, index.index()) == ranks(rows, queries)
    index.add(spark.createDataFrame([("b", "alpha", None, None)], ROWS))
    assert index.version().rows == 2 and len(ranks(rows, queries, index.index())) == 3


def test_a_search_reads_the_folders_of_its_terms(spark):
    index = SegmentedIndex(spark, f"{shared_dir(spark)}/pruned")
    rng = random.Random(2)
    index.add(spark.createDataFrame([(f"r{i}", " ".join(f"w{rng.randrange(5000)}" for _ in range(50)), "", "") for i in range(200)], ROWS))
    held = index.index()
    asked = spark.createDataFrame([("w17",), ("w18",)], "term string")
    assert 0 < len(held.of_terms(asked).inputFiles()) and held.of_terms(asked).select("bucket").distinct().count() <= 2 < held.postings.select("bucket").distinct().count()
    plan = held.of_terms(asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_fingerprint_tells_a_changed_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(5).write.parquet(path)
    first = fingerprint(spark.read.parquet(path))
    assert first == fingerprint(spark.read.parquet(path))
    spark.range(6).write.mode("overwrite").parquet(path)
    assert first != fingerprint(spark.read.parquet(path))


WORDS = {"数据": 50, "数据库": 40, "据库": 3, "库": 5, "我们": 60, "我": 30, "们": 4, "讨论": 25, "论数": 1, "部署": 20, "的": 100, "迁移": 10}


def test_the_likeliest_path_of_all(spark):
    known, rng = Dictionary(WORDS), random.Random(3)
    total = math.log(sum(WORDS.values()) + 1)
    letters = sorted({c for w in WORDS for c in w}) + ["新", "a"]
    for _ in range(400):
        run = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 9)))
        paths = []
        for cuts in itertools.product([0, 1], repeat=max(0, len(run) - 1)):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + ([len(run)] if run else [])
            path = [run[a:b] for a, b in zip([0, *ends], ends)]
            if all(len(w) == 1 or w in WORDS for w in path):
                paths.append((sum(math.log(WORDS[w]) - total if w in WORDS else -total for w in path), path))
        best = max(p[0] for p in paths)
        chosen = known.cut(run)
        assert any(path == chosen and abs(value - best) < 1e-9 for value, path in paths), (run, chosen)
        ties = [path for value, path in paths if abs(value - best) < 1e-9]
        assert chosen == max(ties, key=lambda p: [len(w) for w in p])


def test_an_index_over_mixed_text_finds_words_inside_runs(spark):
    dictionary = spark.createDataFrame([*WORDS.items(), ("数据", 5), ("", 9), (None, 3), ("坏", 0)], "word string, count int")
    rows = spark.createDataFrame([("a", "我们讨论数据库的部署 with Postgres2", "", None), ("b", "数据迁移", "", ""), ("c", "部署 Deploy", None, ""), ("d", None, "", "")], ROWS)
    cut = segmenter(dictionary, stop_words=frozenset("的"))
    words = {r.id: r.words for r in cut(rows.select("id", "content"), "content", "words").collect()}
    assert words == {"a": ["我们", "讨论", "数据库", "部署", "with", "postgres2"], "b": ["数据", "迁移"], "c": ["部署", "deploy"], "d": []}
    index = SegmentedIndex(spark, f"{shared_dir(spark)}/chinese", tokenizer=cut)
    index.add(rows)
    asked = spark.createDataFrame([(1, "部署"), (2, "数据库"), (3, "数据"), (4, "POSTGRES2"), (5, "讨论数据库")], "query_id int, text string")
    found = fulltext.search(rows, asked, index=index.index(), tokenizer=cut).collect()
    assert {(r.query_id, r.id) for r in found} == {(1, "a"), (1, "c"), (2, "a"), (3, "b"), (4, "a"), (5, "a")}
    again = fulltext.search(rows, asked, tokenizer=cut).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    assert {(r.query_id, r.id) for r in fulltext.search(rows, asked).collect()} == {(1, "c"), (4, "a")}  # without a dictionary a run is one word


def test_a_dictionary_has_a_bound(spark, monkeypatch):
    from tidemark.operators import segmentation

    monkeypatch.setattr(segmentation, "MOST_WORDS", 2)
    with pytest.raises(ValueError):
        segmenter(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "word string, count int"))
