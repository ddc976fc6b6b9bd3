"""The entity graph: walks over undirected edges, what they collect, hops, lineage and clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import age_decay
from tidemark.operators.predicates import live
from tidemark.session import written


def both_ways(relations: DataFrame) -> DataFrame:
    one = relations.select(F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"))
    return one.union(one.select("to_id", "from_id")).distinct()


def walk(relations: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(query_id, entity_id, depth): what the seeds (query_id, entity_id) reach, with the least number of steps.

    most stops a query's walk once it has visited so many, whole levels at a time, in the order of ids.
    """
    edges = written(both_ways(relations), "edges")
    visited = written(seeds.select("query_id", "entity_id").distinct().withColumn("depth", F.lit(0)), "visited")
    front = visited
    for level in range(1, depth + 1):
        if most is not None:
            full = visited.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= most).select("query_id")
            front = front.join(full, "query_id", "left_anti")
        reached = front.join(edges, F.col("entity_id") == F.col("from_id")).select("query_id", F.col("to_id").alias("entity_id")).distinct()
        # each level is read by all later ones, so it is written, not walked again
        front = written(reached.join(visited.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_anti").withColumn("depth", F.lit(level)), "visited")
        visited = visited.unionByName(front)
    return visited


def collected(rows: DataFrame, links: DataFrame, visited: DataFrame, now: str, per_entity: int = 10, limit: int | None = 30, rate: float = 0.01) -> DataFrame:
    """(query_id, id, depth, score): the newest live rows of visited entities, with the least depth, aged; all of them with limit None."""
    newest = Window.partitionBy("entity_id").orderBy(F.desc("updated_at"), "memory_id")
    owned = links.select("entity_id", "memory_id").distinct().join(rows.filter(live()).select(F.col("id").alias("memory_id"), "updated_at"), "memory_id")
    owned = owned.withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") <= per_entity)
    near = owned.join(visited, "entity_id").groupBy("query_id", F.col("memory_id").alias("id")).agg(F.min("depth").alias("depth"))
    if limit is not None:
        first = Window.partitionBy("query_id").orderBy("depth", "id")
        near = near.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= limit).drop("_nth")
    aged = near.join(rows.select("id", "created_at"), "id")
    return aged.select("query_id", "id", "depth", (age_decay(F.col("created_at"), now, rate) / (F.col("depth") + 1)).alias("score"))


#: What a row counts by the hops between it and the entities asked for.
HOPS = {0: 1.0, 1: 0.7, 2: 0.4}


def hop_scores(links: DataFrame, relations: DataFrame, asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, id, graph_score) of candidates (query_id, id): the best over their entities, 0 beyond two hops."""
    near = walk(relations, asked, 2)
    score = F.lit(0.0)
    for hops, value in HOPS.items():
        score = F.when(F.col("depth") == hops, value).otherwise(score)
    best = candidates.join(links.withColumnRenamed("memory_id", "id").select("id", "entity_id"), "id").join(near, ["query_id", "entity_id"]).groupBy("query_id", "id").agg(F.max(score).alias("graph_score"))
    return candidates.select("query_id", "id").distinct().join(best, ["query_id", "id"], "left").withColumn("graph_score", F.coalesce("graph_score", F.lit(0.0)))


def lineage(edges: DataFrame, start: str, depth: int = 10, down: bool = True) -> DataFrame:
    """(id, depth) of what derives from start, or of what it derives from, by the shortest way; bounded, so cycles end."""
    here, there = ("source_id", "target_id") if down else ("target_id", "source_id")
    steps = edges.select(F.col(here).alias("from_id"), F.col(there).alias("to_id"))
    walked = """
        WITH RECURSIVE walk(id, depth) AS (
            SELECT CAST(:start AS STRING), 0
            UNION ALL SELECT e.to_id, w.depth + 1 FROM walk w JOIN {steps} e ON e.from_id = w.id WHERE w.depth < :most)
        SELECT id, min(depth) AS depth FROM walk GROUP BY id"""
    return edges.sparkSession.sql(walked, args={"start": start, "most": depth}, steps=steps)


def without_stale(relations: DataFrame, now: str, least: int = 3, days: int = 90) -> DataFrame:
    """Edges that were mentioned often or lately."""
    old = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    return relations.filter(~((F.col("mention_count") < least) & (F.col("last_seen_at") < old)))


def orphan_links(links: DataFrame, rows: DataFrame) -> DataFrame:
    """Links whose row is not there or deleted."""
    return links.join(rows.filter(live()).select(F.col("id").alias("memory_id")), "memory_id", "left_anti")
