"""Approximate nearest neighbours: a navigable small-world hierarchy per shard (operator 4).

Rows with equal vectors are one point that carries its smallest ids, as many as an answer can need, so
ties are settled exactly. A hash deals the points to shards of bounded size. A shard's hierarchy is
built in insertion order: the candidates of a new node are its nearest among the nodes before it, taken
from blocks of exact products, as a shard is small; neighbours are chosen among them for diversity and
linked back. It is stored as flat neighbour arrays, one row a shard. Queries are dealt in bounded blocks
and meet each shard once; each shard gives its nearest, and a window that limits on the map side merges
them.

Vectors that are null, zero, or hold null or non-finite components take no part. Rows that repeat id and
vector count once; a query never finds its own id. An id with several vectors is a query for each.
Vectors of different length never meet. Other columns are not read, whatever their names. An empty table, or one
without queries, gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.vectors import usable

SHARD = 4096
_BLOCK = 1024


class Graph:
    """levels[l]: the nodes of level l (those of level 0 are all) and their neighbour arrays, padded with -1."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.levels = vectors, levels
        self.place = [{int(v): i for i, v in enumerate(nodes)} for nodes, _ in levels[1:]]

    def neighbours(self, level: int, node: int) -> np.ndarray:
        at = self.levels[level][1][node if level == 0 else self.place[level - 1][node]]
        return at[at >= 0]

    def search(self, query: np.ndarray, k: int, width: int) -> list[int]:
        """About the k nearest nodes, by a best-first walk of the given width on level 0."""
        x = self.vectors
        distance = lambda nodes: ((x[nodes] - query) ** 2).sum(axis=1)
        now = int(self.levels[-1][0][0])
        best = float(distance([now])[0])
        for level in range(len(self.levels) - 1, 0, -1):
            while True:
                near = self.neighbours(level, now)
                if not len(near):
                    break
                d = distance(near)
                i = int(d.argmin())
                if d[i] >= best:
                    break
                now, best = int(near[i]), float(d[i])
        seen = np.zeros(len(x), bool)
        seen[now] = True
        todo, found = [(best, now)], [(-best, now)]
        flat = self.levels[0][1]
        while todo:
            d, node = heapq.heappop(todo)
            if len(found) >= width and d > -found[0][0]:
                break
            near = flat[node]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            ds = distance(near)
            if len(found) >= width:
                close = ds < -found[0][0]
                near, ds = near[close], ds[close]
            for e, m in zip(ds.tolist(), near.tolist()):
                if len(found) < width or e < -found[0][0]:
                    heapq.heappush(todo, (e, m))
                    heapq.heappush(found, (-e, m))
                    if len(found) > width:
                        heapq.heappop(found)
        return [m for _, m in sorted((-e, m) for e, m in found)[:k]]


def _diverse(x: np.ndarray, node: int, near: np.ndarray, most: int) -> np.ndarray:
    """At most most of near, nearest first, passing over those closer to one chosen than to node; those fill what is left."""
    y = x[near]
    d = ((y - x[node]) ** 2).sum(axis=1)
    order = np.argsort(d, kind="stable")
    if len(near) <= most:
        return near[order]
    near, d, y = near[order], d[order], y[order]
    norms = (y**2).sum(axis=1)
    between = norms[:, None] + norms - 2 * (y @ y.T)
    free, chosen = np.ones(len(near), bool), []
    while len(chosen) < most:
        i = int(free.argmax())
        if not free[i]:
            break
        chosen.append(i)
        free &= between[i] > d
        free[: i + 1] = False
    picked = np.zeros(len(near), bool)
    picked[chosen] = True
    rest = np.flatnonzero(~picked)[: most - len(chosen)]
    return near[np.concatenate([np.array(chosen, int), rest]).astype(int)]


def _layer(x: np.ndarray, nodes: np.ndarray, most: int, candidates: int) -> np.ndarray:
    """Neighbour arrays of one level's nodes, inserted in their order."""
    links: list[list[int]] = [[] for _ in nodes]
    own, norms = x[nodes], (x[nodes] ** 2).sum(axis=1)
    for start in range(0, len(nodes), 256):
        stop = min(start + 256, len(nodes))
        d = norms[start:stop, None] + norms[:stop] - 2 * (own[start:stop] @ own[:stop].T)
        for i in range(start, stop):
            if not i:
                continue
            row = d[i - start, :i]
            near = np.argpartition(row, candidates - 1)[:candidates] if i > candidates else np.arange(i)
            chosen = _diverse(own, i, near, most // 2).tolist()
            links[i].extend(chosen)
            for j in chosen:
                links[j].append(i)
                if len(links[j]) >= 2 * most:  # shrunk once in most additions
                    links[j] = _diverse(own, j, np.array(links[j]), most).tolist()
    out = np.full((len(nodes), most), -1, np.int32)
    for i, got in enumerate(links):
        if len(got) > most:
            got = _diverse(own, i, np.array(got), most)
        out[i, : len(got)] = nodes[np.asarray(got, int)] if len(got) else []
    return out


def build(vectors: np.ndarray, most: int = 16, candidates: int = 48, seed: int = 7) -> Graph:
    """A hierarchy over the vectors: most links on upper levels, twice as many on level 0."""
    rng = np.random.default_rng(seed)
    height = np.floor(-np.log(1 - rng.random(len(vectors))) / np.log(most)).astype(int)
    levels = []
    for level in range(int(height.max(initial=0)) + 1):
        nodes = np.flatnonzero(height >= level).astype(np.int32)
        levels.append((nodes, _layer(vectors, nodes, most if level else 2 * most, candidates)))
    return Graph(vectors, levels)


def _block(rows: Column, count: int, size: int) -> Column:
    return F.pmod(F.xxhash64(rows), F.lit(max(1, -(-count // size)))).cast("int")


_INDEX = "shard int, dims int, ids array<array<long>>, vectors binary, nodes array<binary>, links array<binary>, most array<int>"


def index(points: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row for each shard of points (ids array<long>, embedding array<double>): its flat arrays."""

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=[i[0] for i in pdf.ids]).sort_values("first")
        order = np.random.default_rng(5).permutation(len(pdf))
        pdf = pdf.iloc[order]
        vectors = np.ascontiguousarray(np.stack(pdf.embedding.to_list()))
        graph = build(vectors)
        return pd.DataFrame({
            "shard": [pdf.shard.iat[0]], "dims": [vectors.shape[1]], "ids": [[list(i) for i in pdf.ids]], "vectors": [vectors.astype("<f8").tobytes()],
            "nodes": [[n.tobytes() for n, _ in graph.levels]], "links": [[m.tobytes() for _, m in graph.levels]], "most": [[m.shape[1] for _, m in graph.levels]],
        })

    count = points.count()
    return points.withColumn("dims", F.size("embedding")).withColumn("shard", _block(F.col("embedding"), count, shard)).groupBy("shard", "dims").applyInPandas(built, _INDEX)


def _graph(row: pd.Series) -> Graph:
    vectors = np.frombuffer(row.vectors, "<f8").reshape(-1, row.dims)
    levels = [(np.frombuffer(n, np.int32), np.frombuffer(m, np.int32).reshape(-1, k)) for n, m, k in zip(row.nodes, row.links, row.most)]
    return Graph(vectors, levels)


def search(embeddings: DataFrame, queries: Column, k: int = 10, width: int = 128, shard: int = SHARD) -> DataFrame:
    """For each row that queries marks: query_id, rank, vec_id, score (Euclidean distance) of its k nearest."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), queries.alias("asks"))
    rows = rows.filter(usable("embedding") & F.col("vec_id").isNotNull()).withColumn("point", F.xxhash64("embedding")).withColumn("also", F.xxhash64("embedding", F.lit(1)))
    rows = staged(rows.dropDuplicates(["vec_id", "point", "also"]), "ann-rows")
    first = Window.partitionBy("point", "also").orderBy("vec_id")
    points = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
    points = points.groupBy("point", "also").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.any_value("embedding").alias("embedding"))
    shards = staged(index(staged(points.select("ids", "embedding"), "ann-points"), shard), "ann-index")
    asked = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "point", "embedding", F.size("embedding").alias("dims"))
    count = asked.count()
    blocks = max(1, -(-count // _BLOCK))
    n_shards = shards.agg(F.max("shard")).first()[0]
    asked = asked.withColumn("block", _block(F.col("query_id"), count, _BLOCK)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards or 0))))
    spread = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answers(shards: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shards) and len(asked):
            row = shards.iloc[0]
            graph, ids = _graph(row), row.ids
            for query, point, q in zip(asked.query_id, asked.point, asked.embedding):
                q = np.asarray(q)
                near = graph.search(q, k + 1, max(width, k + 1))
                scores = np.sqrt(((graph.vectors[near] - q) ** 2).sum(axis=1))
                found = sorted((s, int(i)) for s, m in zip(scores.tolist(), near) for i in ids[m] if i != query)[:k]
                out += [(query, point, i, s) for s, i in found]
        return pd.DataFrame(out, columns=["query_id", "point", "vec_id", "score"])

    by = ("shard", "block", "dims")
    found = spread.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(answers, "query_id long, point long, vec_id long, score double")
    nearest = Window.partitionBy("query_id", "point").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
