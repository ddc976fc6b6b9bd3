"""Sessions, and the package on the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()

#: Rows of a written table at most that a join sends to every task.
SENT = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local one only if that is unset and no other machine takes part."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that what reads it often doesn't make it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; where it has few rows, a join sends it to the other side, which then need not be shuffled."""
    out = written(df, name)
    return F.broadcast(out) if out.limit(SENT + 1).count() <= SENT else out


def fingerprint(df: DataFrame) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of each file that df reads: another if the table has changed."""
    spark, out = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, found.getLen(), found.getModificationTime()))
    return tuple(out)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(path, "w") as file:
        for source in sorted(root.rglob("*.py")):
            file.write(source, source.relative_to(root.parent))
    context.addPyFile(path)


def session(name: str = "tidemark", master: str | None = None, partitions: int = 8) -> SparkSession:
    """A session with what the operators rely on: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    options = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=options).getOrCreate()
