"""What the operators share: staged tables, row identity, word sequences."""

from __future__ import annotations

import contextlib
import gc
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

#: A word, as every contract of this subpackage counts words.
WORD = r"[^\x20\x09-\x0D]+"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_made = threading.local()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder. It cuts lineage and outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    for paths in getattr(_made, "scopes", [])[-1:]:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files that nothing on the driver refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Remove what staged() wrote, once nothing reads it any more."""
    paths = {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}
    if paths:
        _remove(tables[0].sparkSession, sorted(paths))


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables staged inside are removed at its end, but those that the result, put into the list, reads."""
    scopes = _made.__dict__.setdefault("scopes", [])
    scopes.append([])
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        paths = scopes.pop()
        files = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for df in kept for f in df.inputFiles()}
        stay = [p for p in paths if p.split(":", 1)[-1].lstrip("/") in files]
        for outer in scopes[-1:]:
            outer.extend(stay)
        if gone := [p for p in paths if p not in stay]:
            _remove(spark, gone)
            release(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(doc_id: Column, text: Column) -> Column:
    """The same for two rows only if id and text agree, in every run: for joins back to rows with repeated ids."""
    return F.xxhash64(doc_id, text)


def wide_key(*columns: Column) -> Column:
    """As text_key, in 128 bits: for joins on nothing else."""
    return F.concat(F.hex(F.xxhash64(*columns)), F.lit("-"), F.hex(F.xxhash64(F.lit(7), *reversed(columns))))


def arrow_rows(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, so that few rows are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shielded(docs: DataFrame, drop: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """docs under plain numbered names, which no name of an operator clashes with, and the name of each column there.

    Columns named in drop are left out.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    return plain.select(*(n for c, n in names.items() if c not in drop)), {c: n for c, n in names.items() if c not in drop}


def unshielded(df: DataFrame, names: dict[str, str], *more: str) -> DataFrame:
    """df's columns under their own names again, and the added ones."""
    return df.select(*(F.col(n).alias(c) for c, n in names.items()), *more)
