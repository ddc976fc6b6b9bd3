"""Vectors in tiles: an inverted-file index, pairs within a group, and components of pairs.

A tile holds at most some hundred vectors as one matrix, so a task multiplies two matrices at a time, whatever
the number of rows. Vectors that are null, zero, or hold null or non-finite components are near to nothing and
take no part; those of another length than a query's are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

#: Rows of a tile at most, on the average of a hash; rows whose clusters are learnt; clusters at most.
TILE, SAMPLE, LISTS = 512, 20_000, 1024


def _doubles(embedding: Column) -> Column:
    e = embedding.cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return F.when(fine, e)


def usable(embedding: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    return _doubles(embedding).isNotNull()


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def centers(vectors: DataFrame, lists: int, rounds: int = 8) -> np.ndarray:
    """At most lists directions that a bounded sample, the SAMPLE rows with the smallest hashes of their ids, gathers around."""
    few = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").collect()
    if not few:
        return np.zeros((0, 0))
    unit = _unit(np.array([r.embedding for r in few], float))
    chosen = unit[:: max(1, -(-len(unit) // lists))].copy()
    for _ in range(rounds):
        own = (unit @ chosen.T).argmax(axis=1)
        sums = np.zeros_like(chosen)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        chosen = np.where(size > 0, sums / np.where(size > 0, size, 1), chosen)
    return chosen


def _near_centers(rows: DataFrame, vector: str, chosen: np.ndarray, probes: int) -> DataFrame:
    """rows with an array lists of the probes nearest centers, nearest first."""
    sent = rows.sparkSession.sparkContext.broadcast(chosen)  # LISTS rows at most
    names = rows.columns
    at = names.index(vector)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(np.array(batch.column(at).to_pylist(), float))
                found = np.argsort(-(unit @ sent.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                ends = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, found.ravel())], [*names, "lists"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(assign, f"{schema}, lists array<int>")


def tiles(rows: DataFrame, keys: list[str], size: int = TILE) -> DataFrame:
    """(keys, tile, n, members): rows (keys, id, embedding) of equal keys dealt out by hash, size to a tile or so; members holds ids and vectors."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    dealt = rows.join(counts, keys).withColumn("tile", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / size)))
    packed = dealt.groupBy(*keys, "tile").agg(F.collect_list(F.struct("id", "embedding")).alias("members"))
    return packed.select(*keys, "tile", F.size("members").alias("n"), "members")


@dataclass
class VectorIndex:
    """Lists of vectors around centers, as tiles (list, tile, n, members)."""

    tiles: DataFrame
    centers: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, lists: int | None = None) -> VectorIndex:
        """The written index of vectors (id, embedding), in the root of their number of lists, LISTS at most, if not told otherwise."""
        fine = vectors.select("id", _doubles(F.col("embedding")).alias("embedding")).filter("embedding IS NOT NULL")
        chosen = centers(fine, min(LISTS, lists or max(1, int(fine.count() ** 0.5))))
        if not len(chosen):
            return cls(fine.limit(0).select(F.lit(0).alias("list"), F.lit(0).cast("long").alias("tile"), F.lit(0).alias("n"), F.array(F.struct("id", "embedding")).alias("members")), chosen)
        listed = _near_centers(fine, "embedding", chosen, 1).select("id", "embedding", F.element_at("lists", 1).alias("list"))
        return cls(written(tiles(written(listed, "listed"), ["list"]), "vector-index"), chosen)

    def probed(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query_id, query, list) for the lists that each query (query_id, query) looks into: the probes nearest, all if None."""
        asked = queries.select("query_id", _doubles(F.col("query")).alias("query")).filter((F.size("query") == self.centers.shape[1]) if len(self.centers) else F.lit(False))
        return _near_centers(asked, "query", self.centers, probes or len(self.centers)).select("query_id", "query", F.explode("lists").alias("list"))

    def compared(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query_id, rows): how many rows each query is compared with."""
        sizes = self.tiles.groupBy("list").agg(F.sum("n").alias("n"))
        return self.probed(queries, probes).join(sizes, "list").groupBy("query_id").agg(F.sum("n").alias("rows"))

    def search(self, queries: DataFrame, limit: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, nth): the limit nearest by cosine, ties to the smaller id, in the probed lists; exact if probes is None.

        Queries of a list meet its tiles as packs of some hundred; each pack and tile gives limit rows a query.
        """
        packs = tiles(self.probed(queries, probes).select("list", F.col("query_id").alias("id"), F.col("query").alias("embedding")), ["list"], 256)
        pairs = self.tiles.select("list", "members").join(packs.select("list", F.col("members").alias("asked")), "list").select("members", "asked")
        kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "id": self.tiles.schema["members"].dataType.elementType["id"].dataType.simpleString()}

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for members, asked in zip(batch.column("members"), batch.column("asked")):
                    ids, rows = _members(members)
                    who, wanted = _members(asked)
                    score = wanted @ rows.T / np.outer(np.linalg.norm(wanted, axis=1), np.linalg.norm(rows, axis=1))
                    order = np.argsort(np.array(ids, object), kind="stable")
                    score, ids = score[:, order], [ids[i] for i in order]
                    top = np.argsort(-score, axis=1, kind="stable")[:, :limit]
                    whose, which = ([w for w in who for _ in range(top.shape[1])], _kind(batch, "asked")), ([ids[i] for i in top.ravel()], _kind(batch, "members"))
                    yield pa.RecordBatch.from_arrays([pa.array(*whose), pa.array(*which), pa.array(np.take_along_axis(score, top, 1).ravel())], ["query_id", "id", "score"])

        found = pairs.mapInArrow(best, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
        nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= limit)


def _kind(batch: pa.RecordBatch, column: str) -> pa.DataType:
    """The type of the ids in a column of members."""
    return batch.schema.field(column).type.value_type.field("id").type


def _members(scalar: pa.Scalar) -> tuple[list, np.ndarray]:
    values = scalar.values
    ids = values.field("id").to_pylist()
    return ids, values.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


@dataclass
class Pairs:
    """found: (group, one, other, cosine) with one < other; met: (group, near) of each pair of tiles, near where they were multiplied."""

    found: DataFrame
    met: DataFrame


def close_pairs(vectors: DataFrame, group: str, least: float, most: float | None = None) -> Pairs:
    """The pairs within a group (not null) of vectors (group, id, embedding) whose cosine is least to most at the borders, both included.

    Tiles are of one neighbourhood (the nearest of some directions). Two tiles whose centers stand further apart than
    the bound and both their radii can't hold a pair, by the triangle inequality of angles, and are not multiplied.
    """
    fine = vectors.select(group, "id", _doubles(F.col("embedding")).alias("embedding")).filter(F.col("embedding").isNotNull() & F.col(group).isNotNull())
    kind, of_group = fine.schema["id"].dataType.simpleString(), fine.schema[group].dataType.simpleString()
    chosen = centers(fine, 64)
    none = vectors.sparkSession.createDataFrame([], f"{group} {of_group}, one {kind}, other {kind}, cosine double")
    if not len(chosen):
        return Pairs(none, none.select(group))
    near = _near_centers(fine, "embedding", chosen, 1).select(group, "id", "embedding", F.element_at("lists", 1).alias("list"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centre, radius = [], []
            for members in batch.column("members"):
                unit = _unit(_members(members)[1])
                mean = unit.sum(axis=0)
                size = np.linalg.norm(mean)
                mean = mean / size if size > 0 else unit[0]
                centre.append(mean.tolist())
                radius.append(float(np.arccos(np.clip(unit @ mean, -1, 1)).max()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centre, pa.list_(pa.float64())), pa.array(radius, pa.float64())], [*batch.schema.names, "center", "radius"])

    packed = tiles(written(near, "near"), [group, "list"]).withColumn("place", F.col("list").cast("long") * (1 << 40) + F.col("tile")).select(group, "place", "members")
    shape = written(packed.mapInArrow(measured, f"{group} {of_group}, place long, members {packed.schema['members'].dataType.simpleString()}, center array<double>, radius double"), "tiles")
    left, right = (shape.select(group, F.col("place").alias(f"place_{s}"), F.col("center").alias(f"center_{s}"), F.col("radius").alias(f"radius_{s}")) for s in "ab")
    dot = F.aggregate(F.zip_with("center_a", "center_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))) - F.col("radius_a") - F.col("radius_b")
    met = left.join(right, group).filter(F.col("place_a") <= F.col("place_b"))
    met = written(met.withColumn("near", apart <= float(np.arccos(np.clip(least, -1, 1))) + 1e-6).select(group, "place_a", "place_b", "near"), "met")
    matrices = lambda s: shape.select(group, F.col("place").alias(f"place_{s}"), F.col("members").alias(f"members_{s}"))
    both = met.filter("near").join(matrices("a"), [group, "place_a"]).join(matrices("b"), [group, "place_b"]).select(group, (F.col("place_a") == F.col("place_b")).alias("same"), "members_a", "members_b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, same, a, b in zip(batch.column(0), batch.column("same"), batch.column("members_a"), batch.column("members_b")):
                (ids, one), (others, two) = _members(a), _members(b)
                cosine = one @ two.T / np.outer(np.linalg.norm(one, axis=1), np.linalg.norm(two, axis=1))
                good = cosine >= least if most is None else (cosine >= least) & (cosine <= most)
                if same.as_py():
                    good &= np.triu(np.ones_like(good), 1)
                at, to = np.nonzero(good)
                pairs = [(min(ids[i], others[j]), max(ids[i], others[j])) for i, j in zip(at.tolist(), to.tolist())]
                keys = pa.array([key.as_py()] * len(pairs), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([keys, pa.array([p[0] for p in pairs], _kind(batch, "members_a")), pa.array([p[1] for p in pairs], _kind(batch, "members_a")), pa.array(cosine[at, to])], [group, "one", "other", "cosine"])

    return Pairs(both.mapInArrow(linked, f"{group} {of_group}, one {kind}, other {kind}, cosine double"), met.select(group, "near"))


def components(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, component): the smallest id that pairs (keys, one, other) reach from id. Labels move to neighbours and on to
    their own labels' labels in written rounds, so long chains take few."""
    edges = written(pairs.select(*keys, F.col("one").alias("a"), F.col("other").alias("b")).union(pairs.select(*keys, "other", "one")).distinct(), "edges")
    labels = written(edges.groupBy(*keys, F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("id")).agg(F.min("component").alias("_near"))
        moved = labels.join(near, [*keys, "id"]).select(*keys, "id", F.least("component", "_near").alias("_to"), F.col("component").alias("_was"))
        on = labels.select(*keys, F.col("id").alias("_to"), F.col("component").alias("_on"))
        now = written(moved.join(on, [*keys, "_to"], "left").select(*keys, "id", F.coalesce("_on", "_to").alias("component"), (F.coalesce("_on", "_to") != F.col("_was")).alias("changed")), "labels")
        labels = now.drop("changed")
        if not now.filter("changed").limit(1).count():
            return labels


def nearest_in_group(vectors: DataFrame, group: str) -> DataFrame:
    """(id, other_id, cosine): of each vector (group, id, embedding) the nearest other of its group, of equal ones that with the smaller id.

    Every two tiles of a group are multiplied; each gives one row a vector, not its pairs.
    """
    fine = vectors.select(group, "id", _doubles(F.col("embedding")).alias("embedding")).filter(F.col("embedding").isNotNull() & F.col(group).isNotNull())
    kind = fine.schema["id"].dataType.simpleString()
    packed = written(tiles(fine, [group]).select(group, "members"), "tiles")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, others in zip(batch.column("members"), batch.column("others")):
                (ids, one), (names, two) = _members(members), _members(others)
                order = sorted(range(len(names)), key=names.__getitem__)
                names, two = [names[i] for i in order], two[order]
                score = one @ two.T / np.outer(np.linalg.norm(one, axis=1), np.linalg.norm(two, axis=1))
                place = {n: i for i, n in enumerate(names)}
                own = [(i, place[n]) for i, n in enumerate(ids) if n in place]
                if own:
                    score[tuple(zip(*own))] = -np.inf
                top = score.argmax(axis=1)
                keep = np.flatnonzero(np.isfinite(score[np.arange(len(ids)), top])).tolist()
                yield pa.RecordBatch.from_pydict({"id": pa.array([ids[i] for i in keep], _kind(batch, "members")), "other_id": pa.array([names[top[i]] for i in keep], _kind(batch, "members")), "cosine": pa.array([float(score[i, top[i]]) for i in keep], pa.float64())})

    met = packed.join(packed.withColumnRenamed("members", "others"), group).select("members", "others").mapInArrow(best, f"id {kind}, other_id {kind}, cosine double")
    first = Window.partitionBy("id").orderBy(F.desc("cosine"), "other_id")
    return met.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
