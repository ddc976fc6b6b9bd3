"""Registered graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.retrieval import asked, register, store, text_index
from tidemark.operators import graphs, relations
from tidemark.plans import pipelines as pl
from tidemark.registry import query
from tidemark.sources.views import NOW

_SEEDS = "SELECT DISTINCT query_id, id AS entity_id FROM q JOIN entities e ON contains(lower(q.text), lower(e.name)) UNION SELECT query_id, entity_id FROM fts JOIN memory_entities ON memory_id = id WHERE nth <= 5"


def _seeds(v):
    """Entities that a query names, and those of its five best text hits."""
    text = asked(v).text
    words = text.select("query_id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}#]+")).alias("name")).distinct()
    named = words.join(v.entities.select(F.col("id").alias("entity_id"), F.lower("name").alias("name")), "name").select("query_id", "entity_id")
    from tidemark.operators import fulltext

    hits = fulltext.search(v.memories, text, 5, store(v).readable(), index=text_index(v)).select("query_id", F.col("id").alias("memory_id"))
    return named.union(hits.join(v.memory_entities, "memory_id").select("query_id", "entity_id")).distinct()


register("gr_seeds", "SELECT DISTINCT query_id, entity_id FROM fts JOIN memory_entities ON memory_id = id WHERE nth <= 5")(_seeds)
register("gr_bfs", "SELECT query_id, entity_id, depth FROM visited")(lambda v: graphs.walk(store(v).relations, asked(v).seeds, 2))
query("gr_bfs_capped")(lambda v: graphs.walk(store(v).relations, asked(v).seeds, 3, most=50))
register("gr_collect", "SELECT query_id, id, depth, round(score, 6) AS score FROM graph")(lambda v: _collected(v))
register("agg_min_depth", "SELECT query_id, id, min(depth) AS depth FROM owned JOIN visited USING (entity_id) GROUP BY 1, 2")(lambda v: _min_depth(v))
register("gr_legacy", "SELECT query_id, id, round(score, 6) AS score FROM graph1")(lambda v: pl.graph(store(v), asked(v), depth=1).select("query_id", "id", F.round("score", 6).alias("score")))
register("gr_hops", "SELECT query_id, depth, count(*) AS n FROM visited GROUP BY 1, 2")(lambda v: graphs.walk(store(v).relations, asked(v).seeds, 2).groupBy("query_id", "depth").agg(F.count("*").alias("n")))
query("gr_lineage", "", "WITH RECURSIVE down(n, depth) AS (SELECT 12, 0 UNION ALL SELECT n + 1, depth + 1 FROM down WHERE depth < 10 AND n % 12 <> 11 AND n + 1 < (SELECT count(*) FROM documents)) SELECT 'doc-' || lpad(CAST(n AS STRING), 8, '0') AS id, depth FROM down")(lambda v: graphs.lineage(v.memory_derivations, "doc-00000012"))
query("gr_stale", "entity_relations", f"SELECT source_id, target_id FROM entity_relations WHERE NOT (mention_count < 3 AND last_seen_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY)")(lambda v: graphs.without_stale(v.entity_relations, NOW).select("source_id", "target_id"))
query("gr_orphans", "entities entity_relations memory_entities", "SELECT id FROM entities WHERE id NOT IN (SELECT entity_id FROM memory_entities) AND id NOT IN (SELECT source_id FROM entity_relations WHERE relation_type = 'located_in') AND id NOT IN (SELECT target_id FROM entity_relations WHERE relation_type = 'located_in')")(lambda v: relations.orphans(v.entities, v.memory_entities, v.entity_relations.filter("relation_type = 'located_in'")).select("id"))
query("gr_purge", "entities", "SELECT id FROM entities WHERE entity_type <> 'org'")(lambda v: v.entities.withColumn("deleted_at", F.when(F.col("entity_type") == "org", F.lit("2023-12-01 00:00:00").cast("timestamp"))).filter(~F.coalesce(F.col("deleted_at") < F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 30 DAYS"), F.lit(False))).select("id"))
query("gr_orphan_links", "memories memory_entities", "SELECT memory_id, entity_id FROM memory_entities WHERE memory_id NOT IN (SELECT id FROM memories WHERE deleted_at IS NULL)")(lambda v: graphs.orphan_links(v.memory_entities, v.memories).select("memory_id", "entity_id"))


def _collected(v):
    st = store(v)
    found = graphs.collected(st.rows.filter(st.readable()), st.links, graphs.walk(st.relations, asked(v).seeds, 2), NOW)
    return found.select("query_id", "id", "depth", F.round("score", 6).alias("score"))


def _min_depth(v):
    st = store(v)
    return graphs.collected(st.rows.filter(st.readable()), st.links, graphs.walk(st.relations, asked(v).seeds, 2), NOW, limit=None).select("query_id", "id", "depth")
