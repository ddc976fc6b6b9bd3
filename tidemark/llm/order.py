"""Positions and running sums over all rows of a table (see tidemark.operators.order), in this subpackage's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.llm.common import staged
from tidemark.operators import order
from tidemark.operators.order import cumulative

__all__ = ["cumulative", "numbered"]


def numbered(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """df with pos and n, by order.numbered()."""
    return order.numbered(df, group, columns, write=staged)
