"""Embedding near-duplicates by int8 tile products with error bounds (operator 3).

Equal vectors of a label are one representative with a count. A label's representatives are dealt into
tiles of bounded size by a hash, and every pair of tiles is one group of rows. Each vector is scaled to
length one and quantised to int8 with its own scale; with e its exact quantisation error and q its
quantised length, |u.v - U.V| <= e(u) + q(u) e(v), to which float rounding is added. Integer products
are exact in float32 blocks. A pair whose bound stays below the threshold is out, one whose bound stays
above is in, and only the pairs between are computed in double precision from the original vectors.

A tile pair gives out degrees, summed over counts, and stars of its local components, never its pairs.

Vectors that are null, zero, or hold null or non-finite components, and those with a null label, link
with nothing; neither do vectors of different length. A row with a null vec_id links as any other, but no
component is named after it. Repeated rows count as vectors of their own. Other columns are not read. An
empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.components import components, roots_of

TILE = 1024
#: Above what rounding can add to a product of unit vectors of a few thousand components in double precision.
_ROUNDING = 1e-9


def usable(vector: str) -> Column:
    """Whether the column's arrays are not null, not zero, and hold finite components only."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, their scale, the length of the error and the length of the quantised vector, for each row."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(unit - back, axis=1), np.linalg.norm(back, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows: no block of 1024 components leaves float32's integers."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        out += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return out


def links(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """A Boolean matrix: whether the cosine of x[i] and y[j] is at least threshold."""
    # by powers of two, which change no digit: squares of very large or small components stay finite and positive
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (x, y))
    x_len, y_len = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (a, a_scale, a_err, a_len), (b, b_scale, b_err, b_len) = quantised(x / x_len[:, None]), quantised(y / y_len[:, None])
    about = products(a, b) * a_scale[:, None] * b_scale
    bound = a_err[:, None] + a_len[:, None] * b_err + _ROUNDING
    linked = about - bound >= threshold
    i, j = np.nonzero(~linked & (about + bound >= threshold))
    for at in range(0, len(i), 16_384):
        ii, jj = i[at : at + 16_384], j[at : at + 16_384]
        linked[ii, jj] = np.einsum("ij,ij->i", x[ii], y[jj]) / (x_len[ii] * y_len[jj]) >= threshold
    return linked


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """A row for each row: vec_id, n_links, component_id, kept."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("usable", usable("embedding") & F.col("label").isNotNull())
    dims = F.size("embedding")
    rows = rows.withColumn("node", F.when(F.col("usable"), F.xxhash64("label", "embedding"))).withColumn("also", F.xxhash64("embedding", F.lit(1), "label"))
    rows = staged(rows.withColumn("dims", dims), "vectors")
    nodes = rows.filter("usable").groupBy("node", "also", "label", "dims").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    nodes = staged(nodes, "nodes")
    tiles = nodes.groupBy("label", "dims").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = nodes.join(tiles, ["label", "dims"]).withColumn("own", F.pmod(F.xxhash64("also"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf.one.iat[0], pdf.two.iat[0]
        pdf = pdf.sort_values("node")
        left, right = pdf[pdf.own == one], pdf[pdf.own == two]
        empty = pd.DataFrame({"node": np.array([], "i8"), "root": np.array([], "i8"), "links": np.array([], "i8")})
        if not len(left) or not len(right):
            return empty
        x, y = np.stack(left.embedding.to_list()), np.stack(right.embedding.to_list())
        degree, a, b = np.zeros(len(left) + len(right) * (one != two), "i8"), [], []
        for at in range(0, len(x), TILE):
            linked = links(x[at : at + TILE], y, threshold)
            if one == two:
                linked[np.arange(len(linked)), np.arange(at, at + len(linked))] = False
            degree[at : at + len(linked)] += linked @ right.n.to_numpy()
            if one != two:
                degree[len(left) :] += linked.T @ left.n.to_numpy()[at : at + TILE]
            i, j = np.nonzero(linked)
            a.append(i + at)
            b.append(j + (len(left) if one != two else 0))
        ids = np.concatenate([left.node, right.node]) if one != two else left.node.to_numpy()
        root = roots_of(np.concatenate(a), np.concatenate(b), len(ids))
        some = degree > 0
        return pd.DataFrame({"node": ids[some], "root": ids[root[some]], "links": degree[some]})

    found = dealt.select("label", "dims", "one", "two", "own", "node", "n", "embedding").groupBy("label", "dims", "one", "two").applyInPandas(compare, "node long, root long, links long")
    found = staged(found, "links")
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "vec_id", "n").join(degrees, "node", "left").join(parts, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    known = staged(known, "degrees")
    names = known.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    known = staged(known.join(names, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "classes")
    out = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
