"""Embeddings over runs and bulk jobs that were cut."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bulk


def test_only_new_texts_are_embedded(spark, tmp_path):
    cache, calls = f"file://{tmp_path}/cache", spark.sparkContext.accumulator(0)

    def embed(text):
        calls.add(1)
        return [float(len(text)), 1.0]

    rows = [(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, "")]
    first = bulk.embedded_once(spark.createDataFrame(rows, "id int, content string"), cache, "m1", embed)
    assert {r.id: (r.embedding[0], r.cached) for r in first.collect()} == {1: (1.0, False), 2: (2.0, False), 3: (1.0, False), 4: (0.0, False), 5: (0.0, False)} and calls.value == 3
    second = bulk.embedded_once(spark.createDataFrame([*rows, (6, "ccc"), (7, "bb")], "id int, content string"), cache, "m1", embed)
    assert {r.id: (r.embedding[0], r.cached) for r in second.collect()} == {1: (1.0, True), 2: (2.0, True), 3: (1.0, True), 4: (0.0, True), 5: (0.0, True), 6: (3.0, False), 7: (2.0, True)} and calls.value == 4
    assert not any(r.cached for r in bulk.embedded_once(spark.createDataFrame(rows, "id int, content string"), cache, "m2", embed).collect())
    assert bulk.embedded_once(spark.createDataFrame([], "id int, content string"), cache, "m1", embed).count() == 0


def test_a_cut_run_goes_on(spark, tmp_path):
    path, calls = f"file://{tmp_path}/done", spark.sparkContext.accumulator(0)

    def work(bad):
        def one(i):
            calls.add(1)
            if i == bad:
                raise ValueError("cut")
            return i * 2

        return lambda part: part.select("id", F.udf(one, "int")("id").alias("twice"))

    rows = spark.createDataFrame([(i,) for i in range(60)], "id int")
    got = bulk.resumed(rows, path, work(None), most=3)
    some = got.count()
    assert 0 < some < 60
    late = [r.id for r in rows.join(got, "id", "left_anti").orderBy(F.pmod(F.xxhash64("id"), F.lit(8)).desc()).limit(1).collect()][0]
    with pytest.raises(Exception):
        bulk.resumed(rows, path, work(late))
    before, held = calls.value, spark.read.parquet(path).count()
    assert some < held < 60
    more = rows.union(spark.createDataFrame([(100,)], "id int"))
    done = bulk.resumed(more, path, work(None))
    assert {(r.id, r.twice) for r in done.collect()} == {(i, 2 * i) for i in [*range(60), 100]} and done.count() == 61 and calls.value - before == 61 - held
    assert bulk.resumed(rows.limit(0), f"{path}-none", work(None)).count() == 0
