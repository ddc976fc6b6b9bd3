"""Registered joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog.scalars import STRENGTH
from tidemark.functions import scalars as s
from tidemark.operators import predicates as p
from tidemark.operators import relations as r
from tidemark.operators import vectorindex
from tidemark.registry import query
from tidemark.sources.views import NOW

_LIVE = "deleted_at IS NULL"
_OWN = f"(SELECT * FROM memories WHERE {_LIVE} AND id IN (SELECT memory_id FROM memory_entities WHERE entity_id = 'nation-4'))"
_PROFILE = f"SELECT 'source' AS part, source_type || ':' || source_ref AS key, count(*) AS n FROM {_OWN} GROUP BY 1, 2 UNION ALL SELECT 'month', strftime(coalesce(happened_at, created_at), '%Y-%m'), count(*) FROM {_OWN} GROUP BY 1, 2 UNION ALL SELECT 'scope', scope, count(*) FROM {_OWN} GROUP BY 1, 2"
_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"

query("jn_entity_mem", "memories memory_entities", f"SELECT l.entity_id, m.id, l.role FROM memories m JOIN memory_entities l ON l.memory_id = m.id WHERE {_LIVE}")(lambda v: v.memories.filter(p.live()).join(v.memory_entities.withColumnRenamed("memory_id", "id"), "id").select("entity_id", "id", "role"))
query("jn_mem_entity", "entities memory_entities", "SELECT l.memory_id, e.name FROM entities e JOIN memory_entities l ON l.entity_id = e.id")(lambda v: v.memory_entities.join(v.entities.withColumnRenamed("id", "entity_id"), "entity_id").select("memory_id", "name"))
query("jn_tags", "memories memory_tags", f"SELECT t.tag, count(*) AS n FROM memory_tags t JOIN memories m ON m.id = t.memory_id WHERE {_LIVE} GROUP BY t.tag")(lambda v: v.memory_tags.join(v.memories.filter(p.live()).select(F.col("id").alias("memory_id")), "memory_id", "left_semi").groupBy("tag").agg(F.count("*").alias("n")))
query("jn_evidence", "memories memory_entities", f"SELECT id FROM memories WHERE {_LIVE} AND id IN (SELECT memory_id FROM memory_entities WHERE entity_id = 'nation-4') AND id IN (SELECT memory_id FROM memory_entities WHERE entity_id LIKE 'customer-%28') ORDER BY created_at DESC, id LIMIT 10")(lambda v: _evidence(v))
query("jn_anti_links", "memories memory_entities", "SELECT id FROM memories WHERE deleted_at IS NULL AND id NOT IN (SELECT memory_id FROM memory_entities WHERE role = 'mentioned')")(lambda v: v.memories.filter(p.live()).join(v.memory_entities.filter("role = 'mentioned'").select(F.col("memory_id").alias("id")), "id", "left_anti").select("id"))
query("jn_anti_orphan", "entities entity_relations memory_entities", "SELECT id, name FROM entities e WHERE NOT EXISTS (SELECT 1 FROM memory_entities l WHERE l.entity_id = e.id) AND NOT EXISTS (SELECT 1 FROM entity_relations x WHERE x.source_id = e.id AND x.mention_count > 3) AND NOT EXISTS (SELECT 1 FROM entity_relations x WHERE x.target_id = e.id AND x.mention_count > 3)")(lambda v: r.orphans(v.entities, v.memory_entities, v.entity_relations.filter("mention_count > 3")).select("id", "name"))
query("jn_semi_purge", "memories memory_tags", "SELECT memory_id, tag FROM memory_tags WHERE memory_id NOT IN (SELECT id FROM memories WHERE deleted_at IS NOT NULL AND deleted_at < TIMESTAMP '2024-01-02 00:00:00')")(lambda v: v.memory_tags.join(v.memories.filter(F.col("deleted_at") < F.lit("2024-01-02 00:00:00").cast("timestamp")).select(F.col("id").alias("memory_id")), "memory_id", "left_anti").select("memory_id", "tag"))
query("jn_in_list", "memory_entities", "SELECT memory_id, entity_id FROM memory_entities WHERE memory_id IN ('doc-00000001', 'doc-00000002', 'doc-00000010')")(lambda v: v.memory_entities.filter(F.col("memory_id").isin("doc-00000001", "doc-00000002", "doc-00000010")).select("memory_id", "entity_id"))
query("jn_cooccur", "memory_entities", "SELECT a.entity_id AS source_id, b.entity_id AS target_id, count(DISTINCT a.memory_id) AS mention_count FROM memory_entities a JOIN memory_entities b ON a.memory_id = b.memory_id AND a.entity_id < b.entity_id GROUP BY 1, 2")(lambda v: r.cooccurring(v.memory_entities.select("memory_id", "entity_id")))
query("jn_pair_sim", "memory_embeddings", f"SELECT a.memory_id, b.memory_id AS other_id, round({_COS}, 6) AS cosine FROM memory_embeddings a JOIN memory_embeddings b ON a.label = b.label AND a.memory_id < b.memory_id WHERE {_COS} BETWEEN 0.3 AND 0.95")(lambda v: _similar_pairs(v))
query("jn_induced", "entities entity_relations", "SELECT source_id, target_id FROM entity_relations WHERE source_id IN (SELECT id FROM entities WHERE entity_type IN ('location', 'org')) AND target_id IN (SELECT id FROM entities WHERE entity_type IN ('location', 'org'))")(lambda v: r.induced(v.entity_relations, v.entities.filter(F.col("entity_type").isin("location", "org"))).select("source_id", "target_id"))
query("jn_enrich", "memories memory_entities entities", "SELECT m.id, coalesce(string_agg(e.name, ',' ORDER BY e.name), '') AS names FROM memories m LEFT JOIN memory_entities l ON l.memory_id = m.id LEFT JOIN entities e ON e.id = l.entity_id GROUP BY m.id")(lambda v: r.enriched(v.memories.select("id"), v.memory_entities, v.entities).select("id", F.array_join("names", ",").alias("names")))
query("jn_core_dedup", "memories", "SELECT id FROM memories WHERE memory_class = 'core' AND deleted_at IS NULL AND id NOT IN (SELECT id FROM memories WHERE kind = 'rule')")(lambda v: v.memories.filter((F.col("memory_class") == "core") & p.live()).join(v.memories.filter("kind = 'rule'").select("id"), "id", "left_anti").select("id"))

query("agg_access", "access_log", "SELECT memory_id, count(*) AS accesses FROM access_log GROUP BY memory_id")(lambda v: v.access_log.groupBy("memory_id").agg(F.count("*").alias("accesses")))
query("agg_profile", "memories memory_entities", _PROFILE)(lambda v: _profile(v))
query("agg_graph_stats", "entities", "SELECT entity_type, count(*) AS n FROM entities GROUP BY entity_type")(lambda v: v.entities.groupBy("entity_type").agg(F.count("*").alias("n")))
query("agg_layer_merge", "memory_entities", "SELECT memory_id, entity_id, least(1.0, max(confidence) + CASE WHEN count(DISTINCT layer) > 1 THEN 0.1 ELSE 0 END)::DOUBLE AS confidence FROM (SELECT memory_id, entity_id, 1 AS layer, 0.9 AS confidence FROM memory_entities UNION ALL SELECT memory_id, entity_id, 2, 0.7 FROM memory_entities WHERE role = 'mentioned') GROUP BY 1, 2")(lambda v: r.merged_layers(_layers(v)).withColumn("confidence", F.round("confidence", 6)))
query("agg_cluster", "memories", f"SELECT cluster_id, round(least(1.0, max(strength) * 1.1), 6) AS strength, CAST(sum(reinforced_count) AS BIGINT) AS reinforced_count, arg_min(scope, id) AS scope, arg_min(kind, id) AS kind, count(*) AS size FROM (SELECT *, source_type AS cluster_id FROM memories WHERE {_LIVE}) GROUP BY cluster_id")(lambda v: r.rolled_up(v.memories.filter(p.live()).withColumn("cluster_id", F.col("source_type"))).withColumn("strength", F.round("strength", 6)))
query("agg_tags_map", "memory_tags", "SELECT memory_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM memory_tags GROUP BY memory_id")(lambda v: v.memory_tags.groupBy("memory_id").agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags")))
query("agg_token_usage", "", "SELECT source AS stage, CAST(sum((n_chars + 3) // 4) AS BIGINT) AS tokens FROM documents GROUP BY source")(lambda v: v.documents.groupBy(F.col("source").alias("stage")).agg(F.sum(F.floor((F.col("n_chars") + 3) / 4)).alias("tokens")))

query("win_rank", "memories", "SELECT id, source_type AS source, row_number() OVER (PARTITION BY source_type ORDER BY strength DESC, id) - 1 AS rank FROM memories")(lambda v: r.ranked(v.memories.select("id", F.col("source_type").alias("source"), F.col("strength").alias("score"))).select("id", "source", F.col("rank").cast("long").alias("rank")))
query("win_norm", "memories", "SELECT id, round(strength / CASE WHEN max(strength) OVER (PARTITION BY kind) <= 0 THEN 1 ELSE max(strength) OVER (PARTITION BY kind) END, 6) AS share FROM memories")(lambda v: v.memories.select("id", F.round(F.col("strength") / F.when(F.max("strength").over(Window.partitionBy("kind")) <= 0, 1.0).otherwise(F.max("strength").over(Window.partitionBy("kind"))), 6).alias("share")))
query("win_budget", "memories", "SELECT id, kind FROM (SELECT id, kind, sum((length(content) + 3) // 4) OVER w AS total, row_number() OVER w AS nth FROM memories WINDOW w AS (PARTITION BY kind ORDER BY strength DESC, id)) WHERE total <= 4096 OR nth = 1")(lambda v: r.within_budget(v.memories, s.estimated_tokens(F.col("content")), 4096, [F.desc("strength"), F.col("id")], "kind").select("id", "kind"))
query("win_topn_group", "memories", "SELECT id, scope FROM (SELECT id, scope, row_number() OVER (PARTITION BY scope ORDER BY updated_at DESC, id) AS nth FROM memories) WHERE nth <= 5")(lambda v: v.memories.withColumn("nth", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("updated_at"), "id"))).filter("nth <= 5").select("id", "scope"))
query("win_time_slices", "memories", f"SELECT id, slice FROM (SELECT id, CAST(age // 7 AS BIGINT) AS slice, row_number() OVER (PARTITION BY age // 7 ORDER BY md5(id), id) AS nth FROM (SELECT id, CAST(floor(date_diff('microsecond', created_at, TIMESTAMP '{NOW}') / 86400000000.0) AS BIGINT) AS age FROM memories) WHERE age >= 0 AND age < 365) WHERE nth <= 3")(lambda v: r.time_slices(v.memories, NOW, 3).select("id", "slice"))

query("srt_rrf", "memories", "SELECT id, round(strength, 12) AS score FROM memories ORDER BY round(strength, 12) DESC, id LIMIT 50")(lambda v: v.memories.select("id", F.round("strength", 12).alias("score")).orderBy(F.desc("score"), "id").limit(50))
query("srt_single", "memories", "SELECT id, strength FROM memories ORDER BY strength DESC, id LIMIT 30")(lambda v: v.memories.orderBy(F.desc("strength"), "id").limit(30).select("id", "strength"))
query("srt_depth", "contexts", "SELECT id, depth FROM contexts ORDER BY depth, id LIMIT 40")(lambda v: v.contexts.orderBy("depth", "id").limit(40).select("id", "depth"))
query("srt_blend", "memories", f"SELECT id, round(score, 6) AS score FROM (SELECT id, 0.3 * strength + 0.7 * {STRENGTH} AS score, row_number() OVER (ORDER BY id) AS place FROM memories) ORDER BY score DESC, place LIMIT 25")(lambda v: v.memories.select("id", (0.3 * F.col("strength") + 0.7 * s.effective_strength(NOW)).alias("score")).orderBy(F.desc("score"), "id").limit(25).withColumn("score", F.round("score", 6)))
query("lim_offset", "memories", "SELECT id FROM memories ORDER BY updated_at DESC, id LIMIT 30 OFFSET 10")(lambda v: v.memories.orderBy(F.desc("updated_at"), "id").offset(10).limit(30).select("id"))
query("set_union_all", "memories", "SELECT id, 'fts' AS source FROM memories WHERE kind = 'rule' UNION ALL SELECT id, 'graph' FROM memories WHERE scope = 'global'")(lambda v: v.memories.filter("kind = 'rule'").select("id", F.lit("fts").alias("source")).unionByName(v.memories.filter("scope = 'global'").select("id", F.lit("graph").alias("source"))))
query("set_dedup", "memories", "SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS nth FROM (SELECT id, 'fts' AS source, 1 AS place FROM memories WHERE kind = 'rule' UNION ALL SELECT id, 'graph', 2 FROM memories WHERE scope = 'project/p1')) WHERE nth = 1")(lambda v: r.first_of_each(v.memories.filter("kind = 'rule'").select("id", F.lit("fts").alias("source"), F.lit(1).alias("place")).unionByName(v.memories.filter("scope = 'project/p1'").select("id", F.lit("graph").alias("source"), F.lit(2).alias("place"))), "id", F.col("place")).select("id", "source"))
query("set_dedup_str", "memory_tags", "SELECT memory_id, count(DISTINCT substr(tag, 1, 6)) AS n FROM memory_tags GROUP BY memory_id")(lambda v: v.memory_tags.groupBy("memory_id").agg(F.size(F.array_distinct(F.collect_list(F.substring("tag", 1, 6)))).cast("long").alias("n")))
query("set_prepend", "memories", "SELECT id, score, row_number() OVER (ORDER BY first DESC, score DESC, id) AS place FROM (SELECT id, CASE WHEN memory_class = 'core' THEN 2.0::DOUBLE ELSE strength END AS score, CASE WHEN memory_class = 'core' THEN 1 ELSE 0 END AS first FROM memories WHERE scope = 'project/p1') ORDER BY first DESC, score DESC, id LIMIT 20")(lambda v: _prepended(v))
query("set_multi_scope", "memories", "SELECT id, scope FROM (SELECT id, scope, row_number() OVER (PARTITION BY scope ORDER BY reinforced_count DESC, id) AS nth FROM memories WHERE memory_class = 'core' AND scope IN ('project/p1', 'user/user_1')) WHERE nth <= 5")(lambda v: v.memories.filter((F.col("memory_class") == "core") & F.col("scope").isin("project/p1", "user/user_1")).withColumn("nth", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("reinforced_count"), "id"))).filter("nth <= 5").select("id", "scope"))


def _evidence(v):
    customers = v.memory_entities.filter(F.col("entity_id").like("customer-%28")).withColumn("entity_id", F.lit("customer"))
    nation = v.memory_entities.filter("entity_id = 'nation-4'")
    return r.evidence(v.memories, customers.unionByName(nation), "customer", "nation-4").select("id")


def _similar_pairs(v):
    found = vectorindex.close_pairs(v.memory_embeddings.select("label", F.col("memory_id").alias("id"), "embedding"), "label", 0.3, 0.95).found
    return found.select(F.col("one").alias("memory_id"), F.col("other").alias("other_id"), F.round("cosine", 6).alias("cosine"))


def _profile(v):
    parts = [df.select(F.lit(part).alias("part"), "key", "n") for part, df in r.profile(v.memories, v.memory_entities, "nation-4").items()]
    return parts[0].union(parts[1]).union(parts[2])


def _layers(v):
    links = v.memory_entities.select("memory_id", "entity_id", "role")
    return links.select("memory_id", "entity_id", F.lit(1).alias("layer"), F.lit(0.9).alias("confidence")).union(links.filter("role = 'mentioned'").select("memory_id", "entity_id", F.lit(2), F.lit(0.7)))


def _prepended(v):
    core = F.col("memory_class") == "core"
    rows = v.memories.filter("scope = 'project/p1'").select("id", F.when(core, 2.0).otherwise(F.col("strength")).alias("score"), core.cast("int").alias("first"))
    top = rows.orderBy(F.desc("first"), F.desc("score"), "id").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("first"), F.desc("score"), "id")).cast("long")).select("id", "score", "place")
