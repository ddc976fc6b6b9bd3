"""Choosing among few candidates, one after the other: diversity, disclosure, batches and clusters.

What depends on earlier choices runs in applyInPandas, on groups that the stages before have cut to a
hundred rows or so, or on the components that near pairs make; batches come from doubled jumps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import cumulative, numbered
from tidemark.operators.vectorindex import close_pairs, components
from tidemark.session import written

#: Distances of clusters in memory at once.
CELLS = 1 << 21


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / n if n else 0.0


def diverse_order(ids: list[str], scores: list[float], vectors: list[np.ndarray | None], share: float, limit: int) -> list[int]:
    """Indices by maximal marginal relevance: the best first, then by score against the likeness to those chosen."""
    if not ids:
        return []
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))
    top = scores[order[0]] or 1.0
    chosen, rest = [order[0]], order[1:]
    while rest and len(chosen) < limit:

        def worth(i: int) -> float:
            relevance = share * scores[i] / top
            if vectors[i] is None:
                return relevance
            like = [_cosine(vectors[i], vectors[j]) for j in chosen if vectors[j] is not None]
            return relevance - (1 - share) * max(like, default=0.0)

        best = max(rest, key=lambda i: (worth(i), -rest.index(i)))
        chosen.append(best)
        rest.remove(best)
    return chosen


def diverse(candidates: DataFrame, vectors: DataFrame, share: float = 0.7, limit: int = 10) -> DataFrame:
    """(query_id, id, score) with place, from 1: at most limit of each query, for relevance and diversity."""
    joined = candidates.select("query_id", "id", "score").join(vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")), "id", "left")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        found = [None if e is None else np.asarray(e, float) for e in pdf.embedding]
        order = diverse_order(pdf.id.to_list(), pdf.score.to_list(), found, share, limit or 10)
        out = pdf.loc[order, ["query_id", "id", "score"]]
        return out.assign(place=range(1, len(out) + 1))

    kind = dict(candidates.dtypes)["query_id"]
    return joined.groupBy("query_id").applyInPandas(choose, f"query_id {kind}, id string, score double, place int")


#: The shares of the token budget for core rows, context and entities, by strategy; the time line has the rest.
SHARES = {"": (0.3, 0.4, 0.2), "precision": (0.6, 0.2, 0.1), "factual": (0.6, 0.2, 0.1), "exploration": (0.25, 0.25, 0.25), "temporal": (0.2, 0.15, 0.15)}


def disclose(rows: list[tuple[str, int, int, int]], budget: int, strategy: str = "") -> list[tuple[str, str, str, int]]:
    """(id, tokens of content, summary, excerpt) in order, to (id, bucket, form, tokens).

    Each row goes to the first bucket that has room for it in full, else as summary, else as excerpt. What fits
    nowhere, or has no content, stays a pointer.
    """
    parts = [int(budget * share) for share in SHARES.get(strategy, SHARES[""])]
    room = dict(zip(("core", "context", "entity", "timeline"), (*parts, budget - sum(parts))))
    out = []
    for key, full, summary, excerpt in rows:
        for bucket, left in room.items():
            forms = (("full", full),) if full <= left else (("summary", summary), ("excerpt", excerpt))
            form, size = next(((f, n) for f, n in forms if 0 < n <= left), ("", 0))
            if size:
                room[bucket] -= size
                out.append((key, bucket, form, size))
                break
        else:
            out.append((key, "overflow", "pointer", 0))
    return out


def disclosed(candidates: DataFrame, budget: int = 4096, strategy: str = "") -> DataFrame:
    """candidates: query_id, id, score, full, summary, excerpt (tokens). With bucket, form and tokens for each."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        got = disclose(list(zip(pdf.id, pdf.full, pdf.summary, pdf.excerpt)), budget, strategy)
        return pd.DataFrame(got, columns=["id", "bucket", "form", "tokens"]).assign(query_id=pdf.query_id.iat[0])[["query_id", "id", "bucket", "form", "tokens"]]

    kind = dict(candidates.dtypes)["query_id"]
    return candidates.groupBy("query_id").applyInPandas(choose, f"query_id {kind}, id string, bucket string, form string, tokens long")


def batches_of(tokens: list[int], most: int) -> list[int]:
    """The batch of each item, from 0: a batch ends before the item that would pass most."""
    out, batch, held = [], 0, 0
    for n in tokens:
        if held and held + n > most:
            batch, held = batch + 1, 0
        held += n
        out.append(batch)
    return out


def batched(rows: DataFrame, group: str, most: int) -> DataFrame:
    """rows: group, id, tokens (null: none; not below zero). With batch, as batches_of() counts it for each group in the order of ids.

    No task sees a whole group: rows are numbered by ranges, running sums of tokens tell where a batch that starts
    at a row would end, and jumps of that kind, doubled each round, mark the starts. The end is searched for in
    stretches of a bounded number of rows with tokens: the first row whose running sum passes the start's by most.
    """
    tokens = F.coalesce(F.col("tokens").cast("long"), F.lit(0))
    placed = written(numbered(rows.select(group, "id", tokens.alias("tokens")), [], [group, "id", "tokens"]), "numbered")
    n = placed.count()
    if not n:
        return placed.select(group, "id", F.lit(0).alias("batch"))
    groups = placed.groupBy(F.col(group).alias("_g")).agg(F.min("pos").alias("first"), (F.max("pos") + 1).alias("end"))
    placed = placed.join(groups, placed[group].eqNullSafe(groups["_g"])).select(group, "id", "tokens", "pos", "first", "end")
    placed = written(cumulative(placed, "pos", ["tokens"], n), "summed")
    # the first row of all whose running sum is above a value, with the sum before it: if that is the start's, the row still belongs to its batch
    stretch = 64 * max(1, most)
    stops = placed.filter("tokens > 0").select((F.col("before_tokens") + F.col("tokens")).alias("value"), F.struct("pos", "before_tokens").alias("stop"))
    none = F.lit(None).cast(stops.schema["stop"].dataType)
    goals = placed.select((F.col("before_tokens") + most).alias("value")).distinct().withColumn("stop", none)
    both = stops.union(goals).withColumn("part", F.floor(F.col("value") / stretch))
    later = Window.partitionBy("part").orderBy("value").rangeBetween(1, Window.unboundedFollowing)
    here = both.withColumn("found", F.min("stop").over(later)).filter("stop IS NULL").select("value", "part", "found")
    heads = stops.groupBy(F.floor(F.col("value") / stretch).alias("part")).agg(F.min("stop").alias("stop"))
    asked = here.filter("found IS NULL").select("part").distinct().withColumn("stop", none)
    # of the stretches only, a 64th of the batches at most
    follow = heads.union(asked).withColumn("next", F.min("stop").over(Window.orderBy("part").rangeBetween(1, Window.unboundedFollowing)))
    follow = follow.filter("stop IS NULL").select("part", "next")
    ends = written(here.join(follow, "part", "left").select((F.col("value") - most).alias("before_tokens"), F.coalesce("found", "next").alias("stop")), "ends")
    over = F.when(F.col("stop.before_tokens") == F.col("before_tokens"), F.col("stop.pos") + 1).otherwise(F.col("stop.pos"))
    jumps = placed.join(ends, "before_tokens").select("pos", "end", F.least("end", F.coalesce(over, "end")).alias("to"))
    jumps = written(jumps.filter(F.col("to") < F.col("end")).select("pos", "to"), "jumps")
    starts = written(placed.filter("pos = first").select("pos"), "starts")
    while jumps.limit(1).count():
        reached = starts.join(jumps, "pos").select(F.col("to").alias("pos"))
        starts = written(starts.union(reached).distinct(), "starts")
        jumps = written(jumps.join(jumps.select(F.col("pos").alias("to"), F.col("to").alias("on")), "to").select("pos", F.col("on").alias("to")), "jumps")
    marked = placed.join(starts.withColumn("start", F.lit(1)), "pos", "left").withColumn("start", F.coalesce("start", F.lit(0)).cast("long"))
    marked = written(cumulative(marked, "pos", ["start"], n), "marked")
    base = marked.filter("pos = first").select("first", F.col("before_start").alias("base"))
    return marked.join(base, "first").select(group, "id", (F.col("before_start") + F.col("start") - 1 - F.col("base")).cast("int").alias("batch"))


def _parts(unit: np.ndarray, least: float) -> list[np.ndarray]:
    """Indices of the components of pairs whose cosine is at least least, in ascending order."""
    out, rest = [], np.arange(len(unit))
    while len(rest):
        own, front, rest = [rest[:1]], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            step = max(1, (1 << 22) // len(rest))
            for at in range(0, len(front), step):
                near |= (unit[rest] @ unit[front[at : at + step]].T >= least).any(axis=1)
            front, rest = rest[near], rest[~near]
            own.append(front)
        out.append(np.sort(np.concatenate(own)))
    return out


def _mean_distances(sums: np.ndarray, size: np.ndarray, some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Between clusters of unit vectors: one less the product of their sums over that of their sizes. Rounded, so that equal ones are ties."""
    return np.round(1 - (sums[some] @ sums[others].T) / np.outer(size[some], size[others]), 12)


def _closest(sums: np.ndarray, size: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of some the least mean distance to another cluster, and the first cluster at it."""
    best, partner, every = np.full(len(some), np.inf), np.zeros(len(some), int), np.arange(len(sums))
    step = max(1, CELLS // len(sums))
    for at in range(0, len(some), step):
        part = some[at : at + step]
        mean = _mean_distances(sums, size, part, every)
        mean[np.arange(len(part)), part] = np.inf
        partner[at : at + step] = mean.argmin(axis=1)
        best[at : at + step] = mean.min(axis=1)
    return best, partner


def _merged(unit: np.ndarray, most: float) -> np.ndarray:
    """The cluster of each row: the closest two merge while their mean distance is at most most. Sums are kept, no distances.

    Two that are each other's closest merge, wherever others stand: no cluster comes closer to a third by merging,
    so this gives what merging the closest two of all, one pair after the other, gives. Memory goes with the rows.
    """
    n = len(unit)
    into, label, sums, size = np.arange(n), np.arange(n), unit.copy(), np.ones(n)
    best, partner = _closest(sums, size, label)
    while len(label) > 1:
        one = np.flatnonzero((partner[partner] == np.arange(len(label))) & (np.arange(len(label)) < partner))
        other = partner[one]
        near = 1 - np.einsum("ij,ij->i", sums[one], sums[other]) / (size[one] * size[other]) <= most
        one, other = one[near], other[near]
        if not len(one):
            break
        into[label[other]] = label[one]
        sums[one] += sums[other]
        size[one] += size[other]
        kept, moved = np.ones(len(label), bool), np.zeros(len(label), bool)
        kept[other], moved[one], moved[other] = False, True, True
        stale, place = (moved | moved[partner])[kept], np.cumsum(kept) - 1
        label, sums, size, best, partner = label[kept], sums[kept], size[kept], best[kept], place[partner[kept]]
        best[stale], partner[stale] = _closest(sums, size, np.flatnonzero(stale))
        rest, fresh = np.flatnonzero(~stale), place[one]
        step = max(1, CELLS // len(label))
        for at in range(0, len(fresh) if len(rest) else 0, step):
            part = fresh[at : at + step]
            mean = _mean_distances(sums, size, rest, part)
            who, value = part[mean.argmin(axis=1)], mean.min(axis=1)
            nearer = (value < best[rest]) | ((value == best[rest]) & (who < partner[rest]))
            best[rest[nearer]], partner[rest[nearer]] = value[nearer], who[nearer]
    for i in range(n):  # what a row merged into is before it
        into[i] = into[into[i]]
    return into


def average_linkage(vectors: list[np.ndarray | None], threshold: float) -> list[int]:
    """The cluster of each vector: the closest two merge while their mean distance is at most 1 - threshold.

    A vector that is missing is at distance one from all. Ties go to the smaller indices. Two clusters merge
    only if some pair between them is as near as that, so each component of such pairs is merged by itself.
    """
    width = next((len(v) for v in vectors if v is not None), 0)
    unit = np.array([np.zeros(width) if v is None else v for v in vectors], float).reshape(len(vectors), width)
    norm = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = np.divide(unit, norm, out=np.zeros_like(unit), where=norm > 0)
    out = np.zeros(len(vectors), int)
    for own in _parts(unit, threshold - 1e-9):
        out[own] = own[_merged(unit[own], 1 - threshold)]
    return out.tolist()


def clustered(rows: DataFrame, block: str, threshold: float = 0.7, least: int = 2) -> DataFrame:
    """rows: block, id, embedding. (block, cluster_id, id) of clusters of at least least rows, cluster_id their smallest id.

    Clusters lie within the components of pairs that are as near as threshold; pairs come from tiles over all tasks, and
    only a component's vectors meet in one. Where threshold is not above zero every pair is as near, and a vector
    that is missing or zero counts as at distance one from all: then a block is one component.
    """
    ids = rows.schema["id"].dataType.simpleString()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        found = average_linkage([None if e is None else np.asarray(e, float) for e in pdf.embedding], threshold)
        out = pd.DataFrame({block: pdf[block], "cluster_id": [pdf.id[c] for c in found], "id": pdf.id})
        return out[out.groupby("cluster_id").id.transform("size") >= least]

    vectors = rows.select(block, "id", F.col("embedding").cast("array<double>").alias("embedding"))
    if threshold <= 0:
        grouped = vectors.groupBy(block)
    else:
        parts = components(close_pairs(vectors, block, threshold - 1e-9).found, [block])
        grouped = vectors.join(parts, [block, "id"]).groupBy(block, "component")
    found = grouped.applyInPandas(choose, f"{block} {dict(rows.dtypes)[block]}, cluster_id {ids}, id {ids}")
    if least > 1 or threshold <= 0:
        return found
    alone = vectors.join(parts, [block, "id"], "left_anti")
    return found.union(alone.select(block, "id", "id"))
