"""Sources that are files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "query string, expected array<string>, category string, difficulty string"


def json_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, one object a line; what a case leaves out is empty, lines that are no object are left out."""
    lines = spark.read.schema(f"{CASES}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = lines.filter(F.col("query").isNotNull())
    return good.select("query", F.coalesce("expected", F.array().cast("array<string>")).alias("expected"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("difficulty", F.lit("")).alias("difficulty"))
