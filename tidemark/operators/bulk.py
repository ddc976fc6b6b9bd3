"""Work that a store does once for each row and keeps: embeddings by text, and bulk jobs that go on where they stopped."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CACHE = "model string, key string, run string, embedding array<double>"


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def embedded_once(rows: DataFrame, cache: str, model: str, embed: Callable[[str], list[float]], text: str = "content") -> DataFrame:
    """rows with embedding and cached, which tells whether an earlier run had made it.

    cache is the folder of a table by model and the text's SHA-256; only texts that aren't there are embedded, each
    once, and added. A null text counts as an empty one. A run that breaks off leaves the cache as it was.
    """
    spark = rows.sparkSession
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = rows.withColumn("_key", F.sha2(content, 256))
    known = _table(spark, cache, _CACHE).filter(F.col("model") == model)
    now = uuid.uuid4().hex
    missing = keyed.select(F.col("_key").alias("key"), content.alias("text")).dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [embed(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made, pa.list_(pa.float64()))], ["key", "embedding"])

    made = missing.mapInArrow(run, "key string, embedding array<double>").select(F.lit(model).alias("model"), "key", F.lit(now).alias("run"), "embedding")
    made.write.mode("append").parquet(cache)
    held = _table(spark, cache, _CACHE).filter(F.col("model") == model).select(F.col("key").alias("_key"), "embedding", (F.col("run") != now).alias("cached"))
    return keyed.join(held, "_key").select(*rows.columns, "embedding", "cached")


def resumed(rows: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], id_col: str = "id", batches: int = 8, most: int | None = None) -> DataFrame:
    """What work gives for all of rows, over runs: each batch's result is written under path before the next begins.

    A batch holds the rows whose id's hash falls to it, so a run that breaks off has lost one batch at most; the next
    run works on the rows whose id has no result yet, new rows among them. work keeps id_col and gives at least one
    row for each. most stops after so many batches that had something to do.
    """
    spark, made = rows.sparkSession, 0
    schema = work(rows.limit(0)).schema
    for batch in range(batches):
        part = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(batches)) == batch)
        done = f"{path}/batch={batch}"
        if _exists(spark, done):  # a run that broke off may have left it empty
            part = part.join(spark.read.schema(schema).parquet(done).select(id_col), id_col, "left_anti")
        if part.limit(1).count():
            work(part).write.mode("append").parquet(done)
            made += 1
            if most is not None and made >= most:
                break
    found = [p for b in range(batches) if _exists(spark, p := f"{path}/batch={b}")]
    return spark.read.schema(schema).parquet(*found) if found else work(rows.limit(0))
