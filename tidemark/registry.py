"""Queries by key, each with the DuckDB SQL that says the same, where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, views: str = "", oracle: str | None = None) -> Callable:
    """Registers a function of Views under key; oracle may use the named views."""

    def register(function: Callable[[Views], DataFrame]) -> Callable:
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: function(Views(spark, sf_dir))
        if oracle:
            ORACLES[key] = with_views(views, oracle)
        return function

    return register


def load() -> None:
    """Imports every module that registers queries."""
    for name in ("reads", "scalars", "relations", "retrieval", "graphs", "lifecycle", "sequences", "streams"):
        importlib.import_module(f"tidemark.catalog.{name}")
