"""Joins over links, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.predicates import event_time, live


def evidence(rows: DataFrame, links: DataFrame, one: str, other: str, limit: int = 10) -> DataFrame:
    """Live rows linked to both entities, newest first."""
    both = links.filter(F.col("entity_id").isin(one, other)).groupBy(F.col("memory_id").alias("id")).agg(F.count_distinct("entity_id").alias("n")).filter("n = 2")
    return rows.filter(live()).join(both, "id", "left_semi").orderBy(F.desc("created_at"), "id").limit(limit)


def orphans(entities: DataFrame, links: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities without a link and without an edge at either end."""
    found = entities
    for other, column in ((links, "entity_id"), (relations, "source_id"), (relations, "target_id")):
        found = found.join(other.select(F.col(column).alias("id")), "id", "left_anti")
    return found


def cooccurring(links: DataFrame) -> DataFrame:
    """Pairs of entities, in the order of their ids, with the number of rows that hold both."""
    a, b = links.select("memory_id", F.col("entity_id").alias("source_id")), links.select("memory_id", F.col("entity_id").alias("target_id"))
    pairs = a.join(b, "memory_id").filter("source_id < target_id").distinct()
    return pairs.groupBy("source_id", "target_id").agg(F.count("*").alias("mention_count"))


def induced(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with both ends among the entities."""
    ids = entities.select("id")
    at = lambda c: ids.withColumnRenamed("id", c)
    return relations.join(at("source_id"), "source_id", "left_semi").join(at("target_id"), "target_id", "left_semi")


def enriched(results: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """results with names, sorted; without entities an empty array."""
    named = links.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").groupBy(F.col("memory_id").alias("id")).agg(F.sort_array(F.collect_list("name")).alias("names"))
    return results.join(named, "id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def trust(sources: Column) -> Column:
    """A graph hit that another channel confirms counts more, one of text or time alone less."""
    graph, several = F.array_contains(sources, "graph"), F.size(sources) > 1
    return F.when(graph & several, 1.5).when(graph | F.array_contains(sources, "vector"), 1.0).otherwise(0.8)


def ranked(candidates: DataFrame, *keys: str) -> DataFrame:
    """candidates with rank from 0 within each source, best first, ties by id."""
    within = Window.partitionBy(*keys, "source").orderBy(F.desc("score"), "id")
    return candidates.withColumn("rank", F.row_number().over(within) - 1)


def fused(candidates: DataFrame, *keys: str, k: int = 60, weight: Column | None = None) -> DataFrame:
    """Reciprocal ranks summed over sources; weight is a column of candidates, 1 without it. With sources, sorted."""
    share = (F.lit(1.0) if weight is None else weight) / (k + F.col("rank") + 1)
    return ranked(candidates, *keys).groupBy(*keys, "id").agg(F.sum(share).alias("score"), F.sort_array(F.collect_set("source")).alias("sources"))


def profile(rows: DataFrame, links: DataFrame, entity: str) -> dict[str, DataFrame]:
    """An entity's live rows by source, by month of what they tell of, and by scope."""
    own = links.filter(F.col("entity_id") == entity).select(F.col("memory_id").alias("id"))
    found = rows.filter(live()).join(own, "id", "left_semi")
    count = lambda c: found.groupBy(c.alias("key")).agg(F.count("*").alias("n"))
    return {"source": count(F.concat_ws(":", "source_type", "source_ref")), "month": count(F.date_format(event_time(), "yyyy-MM")), "scope": count(F.col("scope"))}


def votes(neighbours: DataFrame, links: DataFrame, least: int = 2) -> DataFrame:
    """For each query the entities that at least least of its neighbours (query_id, memory_id) are linked with."""
    return neighbours.join(links, "memory_id").groupBy("query_id", "entity_id").agg(F.count("*").alias("votes")).filter(F.col("votes") >= least)


def merged_layers(found: DataFrame) -> DataFrame:
    """(memory_id, entity_id, layer, confidence) to the best confidence, raised by 0.1 where layers agree, at most 1."""
    best = found.groupBy("memory_id", "entity_id").agg(F.max("confidence").alias("best"), F.count_distinct("layer").alias("layers"))
    return best.select("memory_id", "entity_id", F.least(F.lit(1.0), F.col("best") + F.when(F.col("layers") > 1, 0.1).otherwise(0.0)).alias("confidence"))


def rolled_up(clustered: DataFrame) -> DataFrame:
    """(cluster_id, id, strength, reinforced_count, scope, kind) to one row a cluster."""
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("id"))), F.lit(""))
    return clustered.groupBy("cluster_id").agg(F.least(F.lit(1.0), F.max("strength") * 1.1).alias("strength"), F.sum("reinforced_count").alias("reinforced_count"), first("scope").alias("scope"), first("kind").alias("kind"), F.count("*").alias("size"))


def within_budget(rows: DataFrame, tokens: Column, budget: int, order: list[Column], *keys: str) -> DataFrame:
    """Rows in order until the sum of tokens passes the budget; the first row of each group always stays."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumns({"_sum": F.sum(tokens).over(frame), "_nth": F.row_number().over(Window.partitionBy(*keys).orderBy(*order))})
    return kept.filter((F.col("_sum") <= budget) | (F.col("_nth") == 1)).drop("_sum", "_nth")


def time_slices(rows: DataFrame, now: str, sample: int, days: int = 7, reach: int = 365) -> DataFrame:
    """From each slice of days, back from now, sample rows by the hash of their ids; with slice, from 0."""
    age = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("created_at")) / 86_400_000_000)
    aged = rows.withColumn("_age", age).filter((F.col("_age") >= 0) & (F.col("_age") < reach)).withColumn("slice", F.floor(F.col("_age") / days))
    order = Window.partitionBy("slice").orderBy(F.md5("id"), "id")
    return aged.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= sample).drop("_age", "_nth")


def first_of_each(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_nth = 1").drop("_nth")


def quality(hits: DataFrame, *groups: str, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """hits: a row for each case with rank, from 1, or null. Hit rate in percent, MRR, NDCG@5, @10, and recall in shares."""
    found = F.col("rank").isNotNull()
    gain = lambda k: F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    measures = [F.count("*").alias("total"), (F.avg(F.when(found, 100.0).otherwise(0.0))).alias("hit_rate"), F.avg(F.when(found, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr")]
    measures += [F.avg(gain(k)).alias(f"ndcg_{k}") for k in (5, 10)]
    measures += [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in cutoffs]
    return hits.groupBy(*groups).agg(*measures)


#: What a measure may fall by: the hit rate in percentage points, the others in shares.
ALLOWED = {"hit_rate": 2.0, "mrr": 0.02, "ndcg_10": 0.02}


def regressions(now: DataFrame, before: DataFrame, key: str, allowed: dict[str, float] = ALLOWED) -> DataFrame:
    """(key, metric, baseline, current, drop) wherever a measure of the report before fell by more than allowed; null keys meet.

    Drops are compared in nine digits, so that one of just what is allowed is none however the means were summed.
    """
    was, is_now = (lambda m: F.col(f"before.{m}")), (lambda m: F.col(f"now.{m}"))
    falls = [F.struct(F.lit(m).alias("metric"), was(m).alias("baseline"), is_now(m).alias("current"), (was(m) - is_now(m)).alias("drop"), F.lit(float(a)).alias("allowed")) for m, a in allowed.items()]
    joined = now.alias("now").join(before.alias("before"), is_now(key).eqNullSafe(was(key)))
    return joined.select(is_now(key).alias(key), F.explode(F.array(*falls)).alias("d")).filter("round(d.drop, 9) > d.allowed").select(key, "d.metric", "d.baseline", "d.current", "d.drop")
