"""Exact vector search and centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import dot, norm

#: Shares at least; rows or queries of a share at most, on the average of a hash; queries multiplied at once; rows of which the best is taken first.
_SHARES, _BLOCK, _STEP, _WIDE = 16, 16_384, 256, 64


def search(vectors: DataFrame, queries: DataFrame, limit: int | None = 30, least: float | None = None, condition=None) -> DataFrame:
    """For each query (query_id, query) the rows of vectors (id, embedding) nearest by cosine: query_id, id, score, nth.

    With limit None all rows count. Otherwise shares of rows and of queries, of bounded size, meet as two matrices,
    and each meeting gives at most limit rows a query, so what is sorted grows with the queries, not with the pairs.
    """
    rows = vectors if condition is None else vectors.filter(condition)
    scored = _pairs(rows, queries, least) if limit is None else _nearest(rows, queries, limit, least)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("nth", F.row_number().over(nearest))
    return (ranked if limit is None else ranked.filter(F.col("nth") <= limit)).select("query_id", "id", "score", "nth")


def _pairs(rows: DataFrame, queries: DataFrame, least: float | None) -> DataFrame:
    """(query_id, id, score) of all pairs. A small query set is sent to the rows, as Spark sees its size; a large one
    meets them in shares, so that the one key, the vectors' length, is no single task."""
    rows = rows.withColumn("_share", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int"))
    asked = queries.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(63))))
    rows, asked = rows.withColumn("_norm", norm(F.col("embedding"))), asked.withColumn("_asked_norm", norm(F.col("query")))
    scored = rows.join(asked, (rows["_share"] == asked["_share"]) & (F.size("embedding") == F.size("query")))
    lengths = F.col("_norm") * F.col("_asked_norm")
    scored = scored.withColumn("score", F.when(lengths > 0, dot(F.col("embedding"), F.col("query")) / lengths).otherwise(0.0))
    return (scored if least is None else scored.filter(F.col("score") >= least)).select("query_id", "id", "score")


def _nearest(rows: DataFrame, queries: DataFrame, limit: int, least: float | None) -> DataFrame:
    """(query_id, id, score): for each query at least its limit nearest rows, at most limit of each share of rows."""
    shares = lambda df, fewest: max(fewest, -(-df.count() // _BLOCK))
    of_rows, of_asked = shares(rows, _SHARES), shares(queries, 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    # floats are moved as they are
    doubles = lambda df, c: F.col(c) if df.schema[c].dataType.simpleString() == "array<float>" else F.col(c).cast("array<double>").alias(c)
    dealt = rows.filter("embedding IS NOT NULL").select("id", doubles(rows, "embedding"), F.size("embedding").alias("_size"), own("id", of_rows).alias("_share"), every(of_asked).alias("_pack"))
    asked = queries.filter("query IS NOT NULL").select("query_id", doubles(queries, "query"), F.size("query").alias("_size"), every(of_rows).alias("_share"), own("query_id", of_asked).alias("_pack"))
    keys = ("_share", "_pack", "_size")
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("query_id", queries), ("id", rows))}

    def best(found: pa.Table, wanted: pa.Table) -> pa.Table:
        if not found.num_rows or not wanted.num_rows:
            at, to, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            # rows in the order of their ids, so that a row's place tells ties apart
            found = found.take(pc.sort_indices(found["id"].combine_chunks(), null_placement="at_start"))
            at, to, score = nearest_rows(_Matrix(found["embedding"]), _Matrix(wanted["query"]), limit, least)
        return pa.Table.from_arrays([wanted["query_id"].take(pa.array(at)), found["id"].take(pa.array(to)), pa.array(score, pa.float64(), from_pandas=False)], ["query_id", "id", "score"])

    return dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(best, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")


class _Matrix:
    """Vectors of one length: columns, norms as running sums give them, rows of length one, and which hold a null or what the product can't tell."""

    def __init__(self, vectors: pa.ChunkedArray):
        flat = pc.list_flatten(vectors).combine_chunks().cast(pa.float64())
        shape = len(vectors), len(flat) // len(vectors)
        values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).reshape(shape)
        self.null = flat.is_null().to_numpy(zero_copy_only=False).reshape(shape).any(axis=1) if flat.null_count else np.zeros(len(values), bool)
        self.columns = np.ascontiguousarray(values.T)
        with np.errstate(all="ignore"):
            total = np.zeros(len(values))
            for column in self.columns:
                total += column * column
            self.norm = np.sqrt(total)
            self.odd = ~((total > 1e-200) & (total < 1e200))
            self.none = self.null | (self.norm == 0)
            flat = self.odd | self.none
            self.unit = np.where(flat[:, None], 0.0, values / np.where(flat, 1.0, self.norm)[:, None])


def _cosines(rows: _Matrix, asked: _Matrix, to: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cosines of pairs by running sums in double precision, the same for equal vectors wherever they stand; 0 with a null or a zero vector."""
    total = np.zeros(len(at))
    with np.errstate(all="ignore"):
        for one, other in zip(rows.columns, asked.columns):
            total += one[to] * other[at]
        lengths = rows.norm[to] * asked.norm[at]
        return np.where((lengths == 0) | rows.null[to] | asked.null[at], 0.0, total / lengths)


def nearest_rows(rows: _Matrix, asked: _Matrix, limit: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of each query's limit nearest rows, ties to the smaller place.

    The product of unit vectors is off by less than slack; whatever it puts within that of a query's limit-th best, and
    every vector whose length it can't take, is measured by running sums.
    """
    slack, out = 1e-15 * (16 + 8 * len(rows.columns)), []
    n, strange = len(rows.norm), rows.odd & ~rows.none
    for start in range(0, len(asked.norm), _STEP):
        here = slice(start, start + _STEP)
        near = asked.unit[here] @ rows.unit.T
        near[(asked.odd & ~asked.none)[here]] = np.inf
        near[:, strange] = -np.inf
        # the limit-th of the best of _WIDE rows each is none above the limit-th of all, and found sooner
        few = near if n < limit * _WIDE else near[:, : n // _WIDE * _WIDE].reshape(len(near), -1, _WIDE).max(axis=2)
        m = few.shape[1]
        bound = np.full(len(near), -np.inf) if m <= limit else np.partition(few, m - limit, axis=1)[:, m - limit] - 2 * slack
        bound = bound if least is None else np.maximum(bound, least - 2 * slack)
        near[:, strange] = np.inf
        at, to = np.nonzero(near >= bound[:, None])
        score = _cosines(rows, asked, to, at + start)
        if least is not None:
            fine = ~(score < least)
            at, to, score = at[fine], to[fine], score[fine]
        # Spark puts NaN above all numbers
        order = np.lexsort((to, np.where(np.isnan(score), -np.inf, -score), at))
        at, to, score = at[order], to[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < limit
        out.append((at[keep] + start, to[keep], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def centroids(vectors: DataFrame, links: DataFrame) -> DataFrame:
    """entity_id with the mean of its rows' vectors, element by element, and their number."""
    joined = links.join(vectors, "memory_id").select("entity_id", "memory_id", F.posexplode("embedding").alias("at", "value"))
    means = joined.groupBy("entity_id", "at").agg(F.avg(F.col("value").cast("double")).alias("value"), F.count("*").alias("n"))
    return means.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).getField("value").alias("centroid"), F.max("n").alias("n"))
