"""Chunks of postings: a word's row holds all rows of its chunk, and a task of a search keeps the best of each query only."""

import random

from pyspark.sql import functions as F

from tidemark.operators import fulltext, packed
from tidemark.operators.predicates import Identity
from tidemark.operators.segments import SegmentedIndex
from tidemark.plans import pipelines as pl
from tidemark.session import shared_dir

ROWS = "id string, content string, excerpt string, summary string"


def test_the_best_are_those_of_all_ranks(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["la", "sol", "de", "mar", "x's"]) for _ in range(rng.randrange(0, 9))) for _ in range(40)]
    rows = spark.createDataFrame([(f"r{i:04d}", rng.choice(texts), rng.choice([None, "la"]), "") for i in range(2500)], ROWS).repartition(2)
    index = SegmentedIndex(spark, f"{shared_dir(spark)}/chunks")
    index.add(rows)
    held = index.index()
    # before, each row's own: 2500 at least
    assert held.packed.count() < 200 and held.packed.selectExpr("max(size(at))").first()[0] <= packed.CHUNK_ROWS
    asked = fulltext.query_parts(spark.createDataFrame([(1, "la sol mar"), (2, "mar x's de"), (3, "of the"), (4, "de"), (5, "")], "query_id int, text string"))
    every = [tuple(r) for r in fulltext.bm25(rows, asked, index=held).collect()]
    wanted = {q: sorted((-s, i) for k, i, s in every if k == q)[:7] for q in (1, 2, 3, 4, 5)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")  # many batches: what a task holds is cut again and again
    try:
        for queries in (2048, 2):
            monkeypatch.setattr(fulltext, "QUERIES", queries)
            found = [tuple(r) for r in fulltext.bm25(rows, asked, index=held, most=7).collect()]
            assert {q: sorted((-s, i) for k, i, s in found if k == q) for q in wanted} == wanted
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_merge_takes_out_what_is_dead(spark):
    index = SegmentedIndex(spark, f"{shared_dir(spark)}/dead")
    index.add(spark.createDataFrame([(f"r{i}", f"la w{i} la sol", "", None) for i in range(30)], ROWS))
    index.delete(spark.createDataFrame([(f"r{i}",) for i in range(0, 30, 3)], "id string"))
    index.merge()
    left = {f"r{i}" for i in range(30) if i % 3}
    held = index.index()
    rows = held.packed.select("term", "at").collect()
    assert {r.term for r in rows} == {"la", "sol"} | {f"w{i[1:]}" for i in left} and sum(len(r.at) for r in rows if r.term == "la") == 20
    assert {(r.id, r.term, r.position) for r in held.postings.collect()} == {(i, t, p) for i in left for p, t in enumerate(["la", f"w{i[1:]}", "la", "sol"])}


def test_candidates_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def scored(n):
        made.add(1)
        return float(n)

    rows = spark.createDataFrame([(f"r{i}", f"la sol {i}", "", "") for i in range(30)], ROWS)
    store = pl.Store(rows, None, None, None, "2024-02-01 00:00:00", Identity("t", "u"))
    found = spark.range(30).select(F.lit(1).alias("query_id"), F.concat(F.lit("r"), "id").alias("id"), scored(F.col("id")).alias("score"), F.lit("x").alias("source"))
    queries = pl.Queries(spark.createDataFrame([(1, "la")], "query_id int, text string"))
    got = pl.by_overlap(store, queries, found).collect()
    # before, once for the first rows, once for their texts and once for the rest
    assert len(got) == 30 and made.value == 30
    assert pl.trimmed(store, found, 9).count() == 3 and made.value == 60


def test_few_rows_are_dealt_out_and_each_search_reads_them(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["la", "Sol", "ÉTÉ", "x_y", "漢字", *(f"rare{rng.randrange(900)}" for _ in range(5))]) for _ in range(rng.randrange(0, 12))) for _ in range(600)]
    rows = spark.createDataFrame([(f"r{i}", t, rng.choice([None, "", "sol  la"]), " ") for i, t in enumerate(texts)], ROWS).repartition(2)
    index = SegmentedIndex(spark, f"{shared_dir(spark)}/blocks")
    index.add(rows)
    held = index.index()
    # before, a row for each of about a thousand words was shuffled and sorted
    stored = spark.read.parquet(f"{index.path}/1/words").filter("column IS NOT NULL")
    assert stored.count() <= 4 * (64 + 2) and held.packed.count() > 900  # four chunks; 64 parts of contents, two words of excerpts
    plain = [(i, c, t, p) for i, c, t, p in fulltext.postings(rows, dict.fromkeys(("content", "excerpt", "summary"), 1.0)).select("id", "column", "term", "position").collect()]
    assert sorted(map(tuple, held.postings.select("id", "column", "term", "position").collect())) == sorted(plain)
    one = spark.createDataFrame([("été",)], "term string")
    assert {r.term for r in packed.listed(held.blocks_of(one)).select("term").distinct().collect()} < {r[2] for r in plain}
    assert held.of_terms(one).count() == sum(t == "été" for _, _, t, _ in plain) > 0
