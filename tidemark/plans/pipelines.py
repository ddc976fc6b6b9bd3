"""Retrieval pipelines: each composes stages into one lazy DataFrame over many queries at once."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.operators import fulltext, graphs, vectorsearch
from tidemark.operators.predicates import Identity, event_time, live, visible
from tidemark.operators.relations import ranked, trust, within_budget
from tidemark.operators.selection import diverse
from tidemark.session import small, written


@dataclass
class Store:
    """The tables that retrieval reads, the clock and the caller."""

    rows: DataFrame
    vectors: DataFrame  # id, embedding
    links: DataFrame  # memory_id, entity_id
    relations: DataFrame  # source_id, target_id
    now: str
    who: Identity
    alpha: float = 0.15
    decay: float = 0.01
    index: Callable[[], fulltext.Index] | None = None  # of all rows, made when a search first asks for it; without it, each search reads their texts
    filters: Column | None = None  # what a caller asks for besides

    def readable(self) -> Column:
        allowed = live() & visible(self.who)
        return allowed if self.filters is None else allowed & self.filters


@dataclass
class Queries:
    """text: query_id, text; vectors: query_id, query; seeds: query_id, entity_id; times: query_id, center, range_days."""

    text: DataFrame
    vectors: DataFrame | None = None
    seeds: DataFrame | None = None
    times: DataFrame | None = None


_COLUMNS = ("query_id", "id", "score", "source")


def _channel(found: DataFrame, source: str) -> DataFrame:
    return found.select("query_id", "id", "score", F.lit(source).alias("source"))


def fts(store: Store, queries: Queries, limit: int = 30) -> DataFrame:
    return _channel(fulltext.search(store.rows, queries.text, limit, store.readable(), index=store.index and store.index()), "fts")


def vector(store: Store, queries: Queries, limit: int = 30, least: float = 0.3) -> DataFrame:
    readable = store.vectors.join(store.rows.filter(store.readable()).select("id"), "id", "left_semi")
    return _channel(vectorsearch.search(readable, queries.vectors, limit, least), "vector")


def graph(store: Store, queries: Queries, depth: int = 2, limit: int = 30, per_entity: int = 10) -> DataFrame:
    visited = graphs.walk(store.relations, queries.seeds, depth)
    return _channel(graphs.collected(store.rows.filter(store.readable()), store.links, visited, store.now, per_entity, limit, store.decay), "graph")


def temporal(store: Store, queries: Queries, limit: int = 30) -> DataFrame:
    """Rows near each query's center: of the newest within three ranges, the best by distance."""
    rows = store.rows.filter(store.readable()).select("id", event_time().alias("_time"))
    # by days, so that the ranges meet the rows in an equality join
    day, reach = F.to_date("center"), F.ceil(F.col("range_days") * 3).cast("int") + 1
    times = queries.times.withColumn("_day", F.explode(F.sequence(F.date_sub(day, reach), F.date_add(day, reach))))
    met = rows.withColumn("_day", F.to_date("_time")).join(times, "_day").filter(F.abs(F.unix_micros("_time") - F.unix_micros(F.col("center"))) <= F.col("range_days") * 3 * 86_400_000_000)
    newest = Window.partitionBy("query_id").orderBy(F.desc("_time"), "id")
    met = met.withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") <= 2 * limit)
    days, reach = F.abs(F.unix_micros("_time") - F.unix_micros(F.col("center"))) / 86_400_000_000, F.greatest(F.col("range_days"), F.lit(1))
    met = met.withColumn("score", F.when(days <= reach, 1.0).otherwise(1 / (1 + days / reach)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return _channel(met.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= limit), "temporal")


def exhaustive(store: Store, queries: Queries, most: int = 200) -> DataFrame:
    """Every row of the entities asked for, oldest first; for queries without entities the newest rows."""
    rows = store.rows.filter(store.readable() & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(store.now).cast("timestamp")))).select("id", event_time().alias("_time"))
    owned = queries.seeds.join(store.links.select("entity_id", F.col("memory_id").alias("id")), "entity_id").select("query_id", "id").distinct().join(rows, "id")
    bare = queries.text.select("query_id").join(owned.select("query_id").distinct(), "query_id", "left_anti")
    newest = rows.orderBy(F.desc("_time"), "id").limit(most)
    few = newest.agg(F.collect_list(F.struct("id", "_time"))).scalar()  # most rows, one value for all
    found = owned.unionByName(bare.select("query_id", F.explode(few).alias("_row")).select("query_id", "_row.id", "_row._time"))
    oldest = Window.partitionBy("query_id").orderBy("_time", "id")
    return _channel(found.withColumn("_nth", F.row_number().over(oldest)).filter(F.col("_nth") <= most).withColumn("score", F.lit(1.0)), "exhaustive")


def merged(store: Store, channels: list[DataFrame], graph_aware: bool = False, k: int = 60, limit: int = 100) -> DataFrame:
    """Reciprocal ranks weighted by structure, and by trust if graph_aware; expired rows are left out. One channel keeps its scores."""
    alive = store.rows.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(store.now).cast("timestamp")))
    weights = alive.select("id", s.structural_weight(store.now, store.alpha).alias("_weight"))
    everything = channels[0]
    for other in channels[1:]:
        everything = everything.unionByName(other)
    if len(channels) == 1:
        scored = everything.join(weights, "id").groupBy("query_id", "id").agg(F.max(F.col("score") * F.col("_weight")).alias("score"), F.first("source").alias("source"))
    else:
        met = ranked(everything, "query_id").join(weights, "id").withColumn("_share", F.col("_weight") / (k + F.col("rank") + 1))
        scored = met.groupBy("query_id", "id").agg(F.sum("_share").alias("score"), F.collect_set("source").alias("_sources"))
        scored = scored.withColumn("score", F.col("score") * trust(F.col("_sources"))) if graph_aware else scored
        scored = scored.withColumn("source", F.lit("hybrid"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return scored.withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= limit).select(*_COLUMNS)


def above(candidates: DataFrame, ratio: float) -> DataFrame:
    """Those with at least ratio of their query's best score; all, where that isn't positive."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return candidates.withColumn("_top", top).filter((F.col("_top") <= 0) | (F.col("score") >= F.col("_top") * ratio)).drop("_top")


def _blend(candidates: DataFrame, weight: float, external: str) -> DataFrame:
    top = F.max("score").over(Window.partitionBy("query_id"))
    return candidates.withColumn("_top", F.when(top > 0, top).otherwise(1.0)).withColumn("score", (1 - weight) * F.col("score") / F.col("_top") + weight * F.col(external)).drop("_top")


def by_overlap(store: Store, queries: Queries, candidates: DataFrame, top: int = 20, weight: float = 0.7) -> DataFrame:
    """The first top of each query by base and overlap with its text; the rest keep their scores, behind them."""
    candidates = small(candidates, "candidates")  # read several times below, so not searched again
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    placed = candidates.withColumn("_place", F.row_number().over(best))
    head = placed.filter(F.col("_place") <= top)
    # both texts are put in form before the join, as a word's test would do it again for each word
    texts = store.rows.join(head.select("id").distinct(), "id", "left_semi").select("id", s.overlap_text(F.concat_ws(" ", "content", "excerpt", "summary")).alias("_document"))
    asked = queries.text.select("query_id", s.overlap_text(F.col("text")).alias("_asked")).withColumn("_words", F.array_distinct(F.split("_asked", " ")))
    external = s.overlap_score(F.col("_asked"), F.col("_words"), F.col("_document"))
    return _blend(head.join(texts, "id").join(asked, "query_id").withColumn("_external", external), weight, "_external").select(*_COLUMNS).unionByName(placed.filter(F.col("_place") > top).select(*_COLUMNS))


def by_graph(store: Store, queries: Queries, candidates: DataFrame, weight: float = 0.6, least: float = 0.2) -> DataFrame:
    """Those within two hops of the entities asked for, by base and nearness."""
    candidates = small(candidates, "candidates")
    near = graphs.hop_scores(store.links, store.relations, queries.seeds, candidates).filter(F.col("graph_score") >= least)
    return _blend(candidates.join(near, ["query_id", "id"]), weight, "graph_score").select(*_COLUMNS)


def by_scorer(candidates: DataFrame, scorer: Callable[[DataFrame], DataFrame], weight: float = 0.7, least: float | None = 0.3) -> DataFrame:
    """scorer gives (query_id, id, external) for candidates, as a model would; what it doesn't score follows unchanged."""
    scored = scorer(candidates).select("query_id", "id", "external").dropDuplicates(["query_id", "id"])
    joined = candidates.join(scored, ["query_id", "id"], "left")
    met = joined.filter("external IS NOT NULL") if least is None else joined.filter(F.col("external") >= least)
    return _blend(met, weight, "external").select(*_COLUMNS).unionByName(joined.filter("external IS NULL").select(*_COLUMNS))


def with_core(store: Store, queries: Queries, candidates: DataFrame, scopes: tuple[str, ...], per_scope: int = 5) -> DataFrame:
    """Core rows of the scopes that aren't among the candidates yet, with score 2."""
    best = Window.partitionBy("scope").orderBy(F.desc("reinforced_count"), F.desc("created_at"), "id")
    core = store.rows.filter(store.readable() & (F.col("memory_class") == "core") & F.col("scope").isin(*scopes)).withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= per_scope)
    few = core.agg(F.collect_list("id")).scalar()  # a few rows of each scope, one value for all
    asked = queries.text.select("query_id", F.explode(few).alias("id"))
    fresh = asked.join(candidates.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return fresh.select("query_id", "id", F.lit(2.0).alias("score"), F.lit("core").alias("source")).unionByName(candidates.select(*_COLUMNS))


def trimmed(store: Store, candidates: DataFrame, budget: int = 4096) -> DataFrame:
    candidates = small(candidates, "candidates")
    few = store.rows.join(candidates.select("id").distinct(), "id", "left_semi")  # tokens are counted in their texts only
    sized = candidates.join(few.select("id", s.estimated_tokens(F.col("content")).alias("_tokens")), "id")
    return within_budget(sized, F.col("_tokens"), budget, [F.desc("score"), F.col("id")], "query_id").select(*_COLUMNS)


@dataclass
class Pipeline:
    name: str
    run: Callable[[Store, Queries], DataFrame]
    fallback: str | None = None


def _precision(store: Store, q: Queries) -> DataFrame:
    return by_graph(store, q, above(merged(store, [graph(store, q), fts(store, q)], graph_aware=True), 0.3))


def _exploration(store: Store, q: Queries) -> DataFrame:
    channels = [graph(store, q), fts(store, q)] + ([temporal(store, q)] if q.times is not None else [])
    return by_overlap(store, q, above(merged(store, channels), 0.05))


def _semantic(store: Store, q: Queries) -> DataFrame:
    return by_overlap(store, q, above(merged(store, [vector(store, q), fts(store, q)]), 0.3))


def _association(store: Store, q: Queries) -> DataFrame:
    return above(by_graph(store, q, graph(store, q, depth=3)), 0.2)


def _full(store: Store, q: Queries) -> DataFrame:
    return by_overlap(store, q, above(merged(store, [graph(store, q), fts(store, q), vector(store, q)], graph_aware=True), 0.3))


PIPELINES = {p.name: p for p in (
    Pipeline("precision", _precision, "exploration"), Pipeline("exploration", _exploration), Pipeline("semantic", _semantic, "exploration"),
    Pipeline("association", _association, "precision"), Pipeline("fast", lambda store, q: above(fts(store, q, 10), 0.05)),
    Pipeline("full", _full, "precision"), Pipeline("aggregation", exhaustive),
)}


@dataclass
class Run:
    found: DataFrame
    traces: list[str] = field(default_factory=list)


def execute(store: Store, queries: Queries, name: str, depth: int = 3) -> Run:
    """A pipeline, and for queries that it leaves empty its fallback, at most depth times. With what ran."""
    pipeline, traces = PIPELINES[name], [name]
    found = written(pipeline.run(store, queries), "found")
    while pipeline.fallback and depth > 0:
        empty = written(queries.text.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id"), "empty")
        if not empty.limit(1).count():
            break
        pipeline, depth = PIPELINES[pipeline.fallback], depth - 1
        traces.append(pipeline.name)
        part = lambda df: None if df is None else df.join(empty, "query_id", "left_semi")  # noqa: B023, E731
        more = pipeline.run(store, Queries(part(queries.text), part(queries.vectors), part(queries.seeds), part(queries.times)))
        found = found.unionByName(written(more, "found"))
    return Run(found, traces)


def post_processed(store: Store, queries: Queries, candidates: DataFrame, scopes: tuple[str, ...], share: float = 0.7, limit: int = 10, budget: int = 4096) -> DataFrame:
    """Diversity, core rows, then the token budget."""
    chosen = small(diverse(candidates, store.vectors, share, limit).select("query_id", "id", "score", F.lit("hybrid").alias("source")), "chosen")
    return trimmed(store, with_core(store, queries, chosen, scopes), budget)


def direct(store: Store, queries: Queries, weights: tuple[float, float, float, float] = (1.0, 1.0, 0.8, 1.2), k: int = 60, limit: int = 10, memory_class: str = "") -> DataFrame:
    """The direct path: weighted reciprocal ranks of text, vector, graph and time, then kind, class, scope and strength."""
    channels = [(fts(store, queries), weights[0])]
    channels += [(vector(store, queries), weights[1])] if queries.vectors is not None else []
    channels += [(graph(store, queries, depth=1), weights[2])] if queries.seeds is not None else []
    channels += [(temporal(store, queries), weights[3])] if queries.times is not None else []
    everything = None
    for found, weight in channels:
        found = found.withColumn("_w", F.lit(weight))
        everything = found if everything is None else everything.unionByName(found)
    if len(channels) > 1:
        everything = ranked(everything, "query_id").groupBy("query_id", "id").agg(F.sum(F.col("_w") / (k + F.col("rank") + 1)).alias("score"))
    rows = store.rows.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(store.now).cast("timestamp")))
    rows = rows.filter(F.col("memory_class") == memory_class) if memory_class else rows
    strength = F.greatest(s.effective_strength(store.now, store.alpha), F.lit(0.05))
    scored = everything.select("query_id", "id", "score").join(rows.select("id", (s.direct_weight() * strength).alias("_weight")), "id").withColumn("score", F.col("score") * F.col("_weight"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= limit).select("query_id", "id", "score", "nth")


def retried(first: DataFrame, again: DataFrame, least: float = 0.3) -> DataFrame:
    """(query_id, id, score) of first; for queries whose best score is below least, those of again where its best is higher.

    again is the same search with wider filters: no time range, and 0.6 of the strength asked for.
    """
    first, again = small(first, "first"), small(again, "again")
    # rounded: the same sum of shares, added in another order, is no better
    top = lambda df, name: df.groupBy("query_id").agg(F.round(F.max("score"), 12).alias(name))
    tops = top(first, "_one").join(top(again, "_two"), "query_id")
    better = tops.filter((F.col("_one") < least) & (F.col("_two") > F.col("_one"))).select("query_id")
    columns = ("query_id", "id", "score")
    return first.select(*columns).join(better, "query_id", "left_anti").unionByName(again.select(*columns).join(better, "query_id", "left_semi"))


def reranked(store: Store, queries: Queries, limit: int = 10, top: int = 20, weight: float = 0.7) -> DataFrame:
    """The direct path's rows re-ranked by overlap: equal ends are told apart by the score before, then by place."""
    found = small(direct(store, queries, limit=limit), "direct")
    new = by_overlap(store, queries, found.withColumn("source", F.lit("direct")), top, weight).select("query_id", "id", F.col("score").alias("final"))
    several = found.groupBy("query_id").agg(F.count("*").alias("_n"))
    joined = found.join(new, ["query_id", "id"]).join(several, "query_id").withColumn("final", F.when(F.col("_n") > 1, F.col("final")).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("final", 12)), F.desc(F.round("score", 12)), "nth")
    return joined.select("query_id", "id", F.col("final").alias("score"), F.row_number().over(order).cast("long").alias("nth"))


@dataclass
class Breaker:
    """Lets calls through until three in a row fail, then none for a while, then one to try."""

    failures: int = 3
    cooldown: float = 30.0
    clock: Callable[[], float] = time.monotonic
    failed: int = 0
    opened: float | None = None

    def allows(self) -> bool:
        return self.opened is None or self.clock() - self.opened >= self.cooldown

    def told(self, success: bool) -> None:
        self.failed = 0 if success else self.failed + 1
        self.opened = None if success else self.clock() if self.failed >= self.failures else self.opened
