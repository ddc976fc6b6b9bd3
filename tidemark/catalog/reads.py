"""Registered reads, predicates and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import predicates as p
from tidemark.operators import reads as r
from tidemark.registry import query
from tidemark.sources.views import NOW, OWNER, TEAM

WHO = p.Identity(TEAM, OWNER)
_VISIBLE = "(visibility = 'public' OR (team_id = 'team_1' AND visibility = 'team') OR (team_id = 'team_1' AND visibility = 'private' AND (owner_id = 'user_1' OR owner_id = '')))"
_NOW = f"TIMESTAMP '{NOW}'"
_KEYS = ["doc-00000042", "doc-00000007", "doc-99999999", "doc-00000023", "doc-00000101"]

query("src_get", "memories", "SELECT id, content, kind FROM memories WHERE id = 'doc-00000007' AND deleted_at IS NULL")(lambda v: r.get(v.memories, "doc-00000007").select("id", "content", "kind"))
query("src_get_visible", "memories", f"SELECT id, visibility FROM memories WHERE id = 'doc-00000004' AND deleted_at IS NULL AND {_VISIBLE}")(lambda v: r.get(v.memories, "doc-00000004", WHO, everyone=False).select("id", "visibility"))
query("src_batch_get", "memories", f"SELECT m.id, k.pos FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {i})' for i, k in enumerate(_KEYS))}) k(id, pos) JOIN memories m ON m.id = k.id WHERE deleted_at IS NULL")(lambda v: r.batch_get(v.memories, _KEYS).select("id", "pos"))
query("src_list", "memories", f"SELECT id, strength FROM memories WHERE deleted_at IS NULL AND {_VISIBLE} ORDER BY updated_at DESC, id LIMIT 20 OFFSET 20")(lambda v: r.recent(v.memories, WHO, offset=20).select("id", "strength"))
query("src_list_ctx", "conversation_memories", "SELECT id, turn_number FROM conversation_memories WHERE context_id = 'conv-3' ORDER BY turn_number DESC, id LIMIT 100")(lambda v: r.page(v.conversation_memories.filter("context_id = 'conv-3'"), [F.desc("turn_number")], 100).select("id", "turn_number"))
query("src_list_ctx_ordered", "conversation_memories", "SELECT id, message_role, turn_number FROM conversation_memories WHERE context_id = 'conv-5' ORDER BY turn_number, id LIMIT 100")(lambda v: r.of_context(v.conversation_memories, "conv-5").select("id", "message_role", "turn_number"))
query("src_by_hash", "memories", "SELECT id, sha256(regexp_replace(trim(lower(content)), '\\s+', ' ', 'g')) AS content_hash FROM memories WHERE deleted_at IS NULL AND sha256(regexp_replace(trim(lower(content)), '\\s+', ' ', 'g')) IN (SELECT sha256(regexp_replace(trim(lower(content)), '\\s+', ' ', 'g')) FROM memories WHERE id = 'doc-00000011')")(lambda v: _by_hash(v, "doc-00000011"))
query("src_by_uri", "memories", "SELECT id, source_ref FROM memories WHERE source_ref = 'src3/en' AND deleted_at IS NULL")(lambda v: v.memories.filter((F.col("source_ref") == "src3/en") & p.live()).select("id", "source_ref"))
query("src_timeline", "memories", f"SELECT id, scope FROM memories WHERE deleted_at IS NULL AND {_VISIBLE} AND coalesce(happened_at, created_at) >= TIMESTAMP '2023-06-01 00:00:00' AND coalesce(happened_at, created_at) <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY coalesce(happened_at, created_at) DESC, id LIMIT 50")(lambda v: r.timeline(v.memories, WHO, after="2023-06-01 00:00:00", before="2024-01-20 00:00:00", limit=50).select("id", "scope"))
query("src_owner", "memories", "SELECT owner_id FROM memories WHERE id = 'doc-00000023'")(lambda v: v.memories.filter("id = 'doc-00000023'").select("owner_id"))
query("src_missing_excerpt", "memories", "SELECT id FROM (SELECT id, created_at, deleted_at, CASE WHEN kind = 'note' THEN '' ELSE excerpt END AS excerpt FROM memories) WHERE deleted_at IS NULL AND coalesce(excerpt, '') = '' ORDER BY created_at DESC, id LIMIT 20")(lambda v: r.missing_excerpt(v.memories.withColumn("excerpt", F.when(F.col("kind") == "note", "").otherwise(F.col("excerpt")))).select("id"))
query("src_by_source_ref", "memories", f"SELECT id, source_ref FROM memories WHERE source_ref = 'src3/en' AND deleted_at IS NULL AND {_VISIBLE} ORDER BY coalesce(happened_at, created_at) DESC, id LIMIT 20 OFFSET 2")(lambda v: r.page(v.memories.filter((F.col("source_ref") == "src3/en") & p.live() & p.visible(WHO)).withColumn("event_time", p.event_time()), [F.desc("event_time")], 20, 2).select("id", "source_ref"))
query("src_derived_from", "memories memory_derivations", "SELECT m.id, m.kind FROM memories m JOIN memory_derivations d ON m.id = d.target_id WHERE d.source_id = 'doc-00000012' AND m.deleted_at IS NULL")(lambda v: r.derived_from(v.memories, v.memory_derivations, "doc-00000012").select("id", "kind"))
query("src_consolidated_into", "memories", "SELECT id FROM (SELECT id, deleted_at, CASE WHEN kind = 'error' THEN 'doc-00000001' ELSE '' END AS consolidated_into FROM memories) WHERE consolidated_into = 'doc-00000001' AND deleted_at IS NULL")(lambda v: v.memories.withColumn("consolidated_into", F.when(F.col("kind") == "error", "doc-00000001").otherwise("")).filter((F.col("consolidated_into") == "doc-00000001") & p.live()).select("id"))
query("src_candidates", "memories", "SELECT id, candidate_for, reinforced_count FROM memories WHERE deleted_at IS NULL AND candidate_for <> '' ORDER BY reinforced_count DESC, created_at, id LIMIT 50")(lambda v: r.candidates(v.memories).select("id", "candidate_for", "reinforced_count"))
query("src_core", "memories", "SELECT id, reinforced_count FROM memories WHERE deleted_at IS NULL AND memory_class = 'core' AND scope = 'project/p1' ORDER BY reinforced_count DESC, created_at DESC, id LIMIT 10")(lambda v: r.core(v.memories, "project/p1").select("id", "reinforced_count"))
query("src_expired", "memories", f"SELECT id FROM memories WHERE deleted_at IS NULL AND expires_at <= {_NOW} ORDER BY expires_at, id LIMIT 100")(lambda v: r.expired(v.memories, NOW).select("id"))
query("src_weak", "memories", "SELECT id, strength FROM memories WHERE deleted_at IS NULL AND strength < 0.1 ORDER BY strength, id LIMIT 100")(lambda v: r.weak(v.memories, 0.1).select("id", "strength"))
query("src_vectors", "memory_embeddings", "SELECT memory_id, len(embedding) AS dims, label FROM memory_embeddings WHERE memory_id IN ('doc-00000001', 'doc-00000005', 'doc-99999999')")(lambda v: v.memory_embeddings.filter(F.col("memory_id").isin("doc-00000001", "doc-00000005", "doc-99999999")).select("memory_id", F.size("embedding").cast("long").alias("dims"), "label"))
query("src_entity", "entities", "SELECT id, name FROM entities WHERE entity_type = 'person' AND scope = 'global' ORDER BY id LIMIT 20")(lambda v: r.page(v.entities.filter("entity_type = 'person' AND scope = 'global'"), [], 20).select("id", "name"))
query("src_entity_name", "entities", "SELECT id, name FROM entities WHERE lower(name) = 'europe' AND scope = 'global' ORDER BY id LIMIT 5")(lambda v: r.by_name(v.entities, "EUROPE", "global").select("id", "name"))
query("src_relations", "entity_relations", "SELECT source_id, target_id, relation_type FROM entity_relations WHERE source_id = 'nation-3' OR target_id = 'nation-3'")(lambda v: r.relations_of(v.entity_relations, "nation-3").select("source_id", "target_id", "relation_type"))
query("src_relation", "entity_relations", "SELECT source_id, target_id, mention_count FROM entity_relations WHERE source_id = 'nation-3' AND relation_type = 'located_in'")(lambda v: v.entity_relations.filter("source_id = 'nation-3' AND relation_type = 'located_in'").select("source_id", "target_id", "mention_count"))
query("src_all_relations", "entity_relations", "SELECT source_id, target_id, mention_count FROM entity_relations ORDER BY mention_count DESC, source_id, target_id LIMIT 5000")(lambda v: v.entity_relations.orderBy(F.desc("mention_count"), "source_id", "target_id").limit(5000).select("source_id", "target_id", "mention_count"))
query("src_entity_memories", "memories memory_entities", "SELECT entity_id, memory_id, nth FROM (SELECT l.entity_id, l.memory_id, row_number() OVER (PARTITION BY l.entity_id ORDER BY m.updated_at DESC, l.memory_id) AS nth FROM memory_entities l JOIN memories m ON m.id = l.memory_id WHERE m.deleted_at IS NULL) WHERE nth <= 20")(lambda v: r.of_entity(v.memories, v.memory_entities, v.memory_entities.select("entity_id").distinct()).select("entity_id", "memory_id", F.col("nth").cast("long").alias("nth")))
query("src_memory_entities", "entities memory_entities", "SELECT l.memory_id, string_agg(e.name, ',' ORDER BY e.name) AS names FROM memory_entities l JOIN entities e ON e.id = l.entity_id GROUP BY l.memory_id")(lambda v: r.entity_names(v.memory_entities, v.entities).select("memory_id", F.array_join("names", ",").alias("names")))
query("src_tags", "memory_tags", "SELECT DISTINCT tag FROM memory_tags ORDER BY tag LIMIT 200")(lambda v: v.memory_tags.select("tag").distinct().orderBy("tag").limit(200))
query("src_memory_tags", "memories memory_tags", f"SELECT m.id, t.tag FROM memories m JOIN memory_tags t ON t.memory_id = m.id WHERE m.deleted_at IS NULL AND {_VISIBLE} AND t.tag = 'lang:de'")(lambda v: v.memories.filter(p.live() & p.visible(WHO)).join(v.memory_tags.filter("tag = 'lang:de'").withColumnRenamed("memory_id", "id"), "id").select("id", "tag"))
query("src_contexts", "contexts", "SELECT id, path, depth FROM contexts WHERE parent_id = 'region-2'")(lambda v: v.contexts.filter("parent_id = 'region-2'").select("id", "path", "depth"))
query("src_subtree", "contexts", "SELECT id, path, depth FROM contexts WHERE starts_with(path, '/EUROPE/')")(lambda v: r.subtree(v.contexts, "/EUROPE").select("id", "path", "depth"))
query("src_documents", "", "SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('de', 'fr') AND n_chars < 500")(lambda v: v.documents.filter(F.col("lang").isin("de", "fr") & (F.col("n_chars") < 500)).select("doc_id", "lang", "n_chars"))
_SESSIONS = "SELECT 'session-' || CAST(user_id AS STRING) AS session_id, CASE user_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'pending_repair' WHEN 2 THEN 'finalized' ELSE 'created' END AS state, max(ts) AS last_seen, CAST(count(*) AS BIGINT) AS n_events FROM events GROUP BY user_id"


def sessions(v):
    state = F.element_at(F.array(*map(F.lit, ("active", "pending_repair", "finalized", "created"))), (F.col("user_id") % 4 + 1).cast("int"))
    return v.events.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count("*").alias("n_events")).select(F.concat(F.lit("session-"), F.col("user_id").cast("string")).alias("session_id"), state.alias("state"), F.col("last_seen").cast("timestamp").alias("last_seen"), "n_events")


def _by_hash(v, key):
    from tidemark.functions.scalars import content_hash

    rows = v.memories.filter(p.live()).withColumn("content_hash", content_hash(F.col("content")))
    asked = v.memories.filter(F.col("id") == key).select(content_hash(F.col("content")).alias("content_hash"))
    return rows.join(asked, "content_hash", "left_semi").select("id", "content_hash")


query("src_sessions", "", f"SELECT session_id, state, n_events FROM ({_SESSIONS}) WHERE state IN ('active', 'pending_repair') AND last_seen < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 30 MINUTE ORDER BY last_seen, session_id LIMIT 100")(lambda v: r.stale_sessions(sessions(v), "2024-01-30 12:00:00").select("session_id", "state", "n_events"))
query("src_unfinalized", "", f"SELECT session_id, n_events FROM ({_SESSIONS}) WHERE state <> 'finalized' ORDER BY last_seen, session_id LIMIT 50")(lambda v: sessions(v).filter("state <> 'finalized'").orderBy("last_seen", "session_id").limit(50).select("session_id", "n_events"))
query("src_cursors", "", "SELECT conv_id, max(turn) AS last_turn, CAST(sum(strlen(text)) AS BIGINT) AS byte_offset FROM conversations GROUP BY conv_id")(lambda v: v.conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.sum(F.octet_length("text").cast("long")).alias("byte_offset")))
query("src_policy", "", "SELECT 'project/p' || CAST(n_nationkey AS STRING) AS scope, 'team_' || CAST(n_regionkey AS STRING) AS team_id FROM nation WHERE n_regionkey = 1")(lambda v: v.nation.filter("n_regionkey = 1").select(F.concat(F.lit("project/p"), F.col("n_nationkey").cast("string")).alias("scope"), F.concat(F.lit("team_"), F.col("n_regionkey").cast("string")).alias("team_id")))
query("src_idem", "", "SELECT event_type, user_id, min(event_id) AS resource_id FROM events WHERE user_id = 7 GROUP BY event_type, user_id")(lambda v: v.events.filter("user_id = 7").groupBy("event_type", "user_id").agg(F.min("event_id").alias("resource_id")))
query("src_promotable", "entity_candidates", "SELECT name, hit_count FROM entity_candidates WHERE hit_count >= 15 ORDER BY hit_count DESC, name")(lambda v: r.promotable(v.entity_candidates, 15).select("name", "hit_count"))
query("src_lineage_edges", "memory_derivations", "SELECT source_id, target_id FROM memory_derivations WHERE source_id = 'doc-00000013' OR target_id = 'doc-00000013'")(lambda v: v.memory_derivations.filter("source_id = 'doc-00000013' OR target_id = 'doc-00000013'"))
query("src_missing_entities", "memories memory_entities", "SELECT id FROM memories WHERE deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM memory_entities l WHERE l.memory_id = memories.id AND l.role = 'mentioned')")(lambda v: r.without(v.memories, v.memory_entities.filter("role = 'mentioned'"), "id", "memory_id").select("id"))
query("src_missing_vectors", "memories memory_embeddings", "SELECT id FROM memories WHERE deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM memory_embeddings e WHERE e.memory_id = memories.id)")(lambda v: r.without(v.memories, v.memory_embeddings, "id", "memory_id").select("id"))

# predicates
query("flt_visible", "memories", f"SELECT id, visibility, team_id, owner_id FROM memories WHERE {_VISIBLE}")(lambda v: v.memories.filter(p.visible(WHO)).select("id", "visibility", "team_id", "owner_id"))
query("flt_visible_vec", "memories", "SELECT id, visibility FROM memories WHERE visibility = 'public' OR (visibility = 'private' AND owner_id <> '' AND owner_id = 'user_1') OR (visibility = 'team' AND team_id <> '' AND team_id = 'team_1')")(lambda v: v.memories.filter(p.vector_visible(WHO)).select("id", "visibility"))
query("flt_search", "memories", f"SELECT id FROM memories WHERE scope = 'project/p1' AND kind = 'rule' AND strength >= 0.2 AND (expires_at IS NULL OR expires_at > {_NOW})")(lambda v: v.memories.filter(p.search_filters(NOW, scope="project/p1", kind="rule", min_strength=0.2)).select("id"))
query("flt_happened", "memories", "SELECT id FROM memories WHERE happened_at >= TIMESTAMP '2024-01-05 00:00:00' AND happened_at <= TIMESTAMP '2024-01-15 00:00:00'")(lambda v: v.memories.filter(p.search_filters(NOW, happened_after="2024-01-05 00:00:00", happened_before="2024-01-15 00:00:00", include_expired=True)).select("id"))
query("flt_source_prefix", "memories", "SELECT id, source_ref FROM memories WHERE starts_with(lower(source_ref), 'src1')")(lambda v: v.memories.filter(p.search_filters(NOW, source_ref="SRC1", include_expired=True)).select("id", "source_ref"))
query("flt_expired", "memories", f"SELECT id FROM memories WHERE expires_at IS NULL OR expires_at >= {_NOW}")(lambda v: v.memories.filter(p.not_expired(NOW)).select("id"))
query("flt_class", "memories", "SELECT id FROM memories WHERE memory_class = 'procedural'")(lambda v: v.memories.filter("memory_class = 'procedural'").select("id"))
query("flt_noise", "conversation_memories", "SELECT id FROM conversation_memories WHERE length(content) >= 40 AND content NOT IN ('ok', 'thanks')")(lambda v: v.conversation_memories.filter(p.not_noise(40, ("ok", "thanks"))).select("id"))
query("flt_entity_types", "entities", "SELECT id, entity_type FROM entities WHERE entity_type IN ('location', 'org') AND name <> '' ORDER BY id LIMIT 50")(lambda v: r.page(v.entities.filter(F.col("entity_type").isin("location", "org") & (F.col("name") != "")), [], 50).select("id", "entity_type"))
query("prd_write_policy", "memories", "SELECT id, memory_class NOT IN ('core', 'procedural') OR source_type IN ('reflect', 'session_summary', 'consolidation', 'system') AS may_write, scope = '' OR starts_with(scope, 'user/') OR starts_with(scope, 'project/') OR starts_with(scope, 'session/') OR starts_with(scope, 'agent/') AS valid_scope FROM memories")(lambda v: v.memories.select("id", p.may_write().alias("may_write"), p.valid_scope().alias("valid_scope")))
query("prd_core_write", "memories", "SELECT id, memory_class <> 'core' OR ((sub_kind = '' OR sub_kind IN ('user_profile', 'user_preferences', 'active_goals', 'current_project_state', 'operating_rules')) AND length(content) <= 500) AS core_write FROM memories")(lambda v: v.memories.select("id", p.core_write().alias("core_write")))
_POLICY = "SELECT * FROM (VALUES ('project/p1', ['user_0', 'user_2']), ('project/p2', ['user_1'])) p(scope, allowed_writers)"
query("prd_policy", "memories", f"SELECT m.id, CASE WHEN starts_with(m.scope, 'project/') AND p.scope IS NOT NULL AND NOT list_contains(p.allowed_writers, m.owner_id) THEN 'user/' || m.owner_id ELSE m.scope END AS actual_scope, coalesce(starts_with(m.scope, 'project/') AND NOT list_contains(p.allowed_writers, m.owner_id), false) AS downgraded FROM memories m LEFT JOIN ({_POLICY}) p ON p.scope = m.scope")(lambda v: p.writable_scope(v.memories, v.spark.createDataFrame([("project/p1", ["user_0", "user_2"]), ("project/p2", ["user_1"])], "scope string, allowed_writers array<string>")).select("id", "actual_scope", "downgraded"))
_ASKED = "SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'active' WHEN 2 THEN 'finalizing' ELSE 'pending_repair' END AS from_state, CASE event_id % 5 WHEN 0 THEN 'bootstrapped' WHEN 1 THEN 'finalizing' WHEN 2 THEN 'finalized' WHEN 3 THEN 'abandoned' ELSE 'active' END AS to_state FROM events"
_EDGES = ", ".join(f"('{a}', '{b}')" for a, b in p.TRANSITIONS)


def _asked(v):
    pick = lambda c, n, names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % n + 1).cast("int"))
    return v.events.select("event_id", pick("user_id", 4, ("created", "active", "finalizing", "pending_repair")).alias("from_state"), pick("event_id", 5, ("bootstrapped", "finalizing", "finalized", "abandoned", "active")).alias("to_state"))


query("prd_transition", "", f"SELECT event_id, from_state, to_state FROM ({_ASKED}) WHERE (from_state, to_state) IN ({_EDGES})")(lambda v: p.allowed_transitions(_asked(v)))
query("prd_limits", "", "SELECT doc_id, CASE WHEN doc_id % 300 - 20 > 0 THEN least(doc_id % 300 - 20, 200) ELSE 20 END AS rows_wanted FROM documents")(lambda v: v.documents.select("doc_id", F.when(F.col("doc_id") % 300 - 20 > 0, F.least(F.col("doc_id") % 300 - 20, F.lit(200))).otherwise(F.lit(20)).cast("long").alias("rows_wanted")))
