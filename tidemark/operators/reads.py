"""Reads of the row store: lookups, ordered pages and link tables. Every order ends in the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.predicates import Identity, clamp, event_time, live, visible


def get(rows: DataFrame, key: str, who: Identity | None = None, everyone: bool = True) -> DataFrame:
    """The live row with that id, if everyone may see it or who does."""
    found = rows.filter((F.col("id") == key) & live())
    return found if everyone else found.filter(visible(who))


def batch_get(rows: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """Live rows of at most most ids, with pos, their place in the request; missing ids are left out."""
    wanted = keys[:most]
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col("id"))
    return rows.filter(F.col("id").isin(*wanted) & live()).withColumn("pos", (place - 1).cast("int")).orderBy("pos")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows in order, ties by id, from offset on."""
    return rows.orderBy(*order, "id").offset(offset).limit(limit)


def recent(rows: DataFrame, who: Identity, offset: int = 0, limit: int = 20) -> DataFrame:
    return page(rows.filter(live() & visible(who)), [F.desc("updated_at")], clamp(limit, 20, 200), offset)


def of_context(rows: DataFrame, context_id: str, limit: int = 100, turns: bool = True) -> DataFrame:
    """Rows of one context: by turn, or newest first."""
    order = [F.col("turn_number")] if turns else [F.desc("updated_at")]
    return page(rows.filter(F.col("context_id") == context_id), order, clamp(limit, 100, 200))


def timeline(rows: DataFrame, who: Identity | None, *, scope: str = "", source_ref: str = "", after: str = "", before: str = "", limit: int = 20) -> DataFrame:
    """Live visible rows by the time they tell of, newest first; both bounds belong to the range."""
    found = rows.filter(live() & visible(who)).withColumn("event_time", event_time())
    for name, value in (("scope", scope), ("source_ref", source_ref)):
        found = found.filter(F.col(name) == value) if value else found
    found = found.filter(F.col("event_time") >= F.lit(after).cast("timestamp")) if after else found
    found = found.filter(F.col("event_time") <= F.lit(before).cast("timestamp")) if before else found
    return page(found, [F.desc("event_time")], limit)


def missing_excerpt(rows: DataFrame, limit: int = 20) -> DataFrame:
    return page(rows.filter(live() & (F.coalesce("excerpt", F.lit("")) == "")), [F.desc("created_at")], limit)


def candidates(rows: DataFrame, limit: int = 50) -> DataFrame:
    return page(rows.filter(live() & (F.col("candidate_for") != "")), [F.desc("reinforced_count"), F.asc("created_at")], clamp(limit, 50, 200))


def core(rows: DataFrame, scope: str, limit: int = 10) -> DataFrame:
    found = rows.filter(live() & (F.col("memory_class") == "core") & (F.col("scope") == scope))
    return page(found, [F.desc("reinforced_count"), F.desc("created_at")], clamp(limit, 10, 20))


def expired(rows: DataFrame, now: str, limit: int = 100) -> DataFrame:
    return page(rows.filter(live() & (F.col("expires_at") <= F.lit(now).cast("timestamp"))), [F.asc("expires_at")], limit)


def weak(rows: DataFrame, below: float, limit: int = 100) -> DataFrame:
    return page(rows.filter(live() & (F.col("strength") < below)), [F.asc("strength")], limit)


def derived_from(rows: DataFrame, edges: DataFrame, source: str) -> DataFrame:
    """Live rows that an edge leads to from source."""
    targets = edges.filter(F.col("source_id") == source).select(F.col("target_id").alias("id"))
    return rows.filter(live()).join(targets, "id", "left_semi")


def of_entity(rows: DataFrame, links: DataFrame, entities: DataFrame, limit: int = 20) -> DataFrame:
    """For each row of entities (entity_id) its newest live rows, with nth from 1."""
    joined = links.join(entities.select("entity_id"), "entity_id", "left_semi").join(rows.filter(live()).withColumnRenamed("id", "memory_id"), "memory_id")
    newest = Window.partitionBy("entity_id").orderBy(F.desc("updated_at"), "memory_id")
    return joined.withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= limit)


def entity_names(links: DataFrame, entities: DataFrame) -> DataFrame:
    """memory_id with the names of its entities, sorted."""
    named = links.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    return named.groupBy("memory_id").agg(F.sort_array(F.collect_list("name")).alias("names"))


def by_name(entities: DataFrame, name: str, scope: str = "", limit: int = 5) -> DataFrame:
    found = entities.filter(F.lower("name") == name.lower())
    return page(found.filter(F.col("scope") == scope) if scope else found, [], limit)


def relations_of(relations: DataFrame, entity: str) -> DataFrame:
    return relations.filter((F.col("source_id") == entity) | (F.col("target_id") == entity))


def subtree(contexts: DataFrame, path: str) -> DataFrame:
    """What lies below path, without it. A name's wildcard characters mean themselves."""
    return contexts.filter(F.col("path").startswith(f"{path}/"))


def without(rows: DataFrame, others: DataFrame, key: str, other_key: str) -> DataFrame:
    """Live rows that no row of others refers to."""
    return rows.filter(live()).join(others.select(F.col(other_key).alias(key)), key, "left_anti")


def stale_sessions(sessions: DataFrame, now: str, age: str = "30 minutes", limit: int = 100) -> DataFrame:
    """Sessions that are active or wait for repair and were last seen longer ago than age."""
    open_states = F.col("state").isin("active", "pending_repair")
    return sessions.filter(open_states & (F.col("last_seen") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {age}"))).orderBy("last_seen", "session_id").limit(limit)


def promotable(candidates: DataFrame, hits: int) -> DataFrame:
    return candidates.filter(F.col("hit_count") >= hits).orderBy(F.desc("hit_count"), "name")
