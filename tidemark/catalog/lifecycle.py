"""Registered snapshots and batch jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog.reads import _SESSIONS as SESSIONS
from tidemark.catalog.reads import _VISIBLE, WHO, sessions
from tidemark.catalog.scalars import STRENGTH
from tidemark.functions import scalars as s
from tidemark.operators import reads, relations, snapshots, vectorindex, vectorsearch
from tidemark.operators.predicates import live, visible
from tidemark.registry import query
from tidemark.session import written
from tidemark.sources.views import NOW

_T = f"TIMESTAMP '{NOW}'"
_D = "CASE retention_tier WHEN 'ephemeral' THEN 0.1 WHEN 'short_term' THEN 0.05 WHEN 'long_term' THEN 0.001 WHEN 'permanent' THEN 0.0 ELSE 0.01 END::DOUBLE"
_REQ = "SELECT 'new-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id, text AS content, CASE WHEN role = 'user' THEN 'conversation' ELSE 'note' END AS kind, CASE conv_id % 4 WHEN 0 THEN 'semantic' WHEN 1 THEN 'core' ELSE '' END AS memory_class, CASE conv_id % 3 WHEN 0 THEN 'project/p1' ELSE '' END AS scope FROM conversations"
_DEFAULTS = f"SELECT id, kind, memory_class, retention_tier, {_D} AS decay_rate, CASE WHEN scope = '' THEN 'default' ELSE scope END AS scope, CASE WHEN starts_with(scope, 'project/') AND kind <> 'observation' THEN 'team' ELSE 'private' END AS visibility, 1.0::DOUBLE AS strength, retention_tier = 'ephemeral' AS expires FROM (SELECT *, CASE WHEN kind = 'conversation' THEN 'ephemeral' ELSE CASE memory_class WHEN 'episodic' THEN 'short_term' WHEN 'procedural' THEN 'long_term' WHEN 'core' THEN 'permanent' ELSE 'standard' END END AS retention_tier FROM (SELECT id, content, kind, CASE WHEN memory_class = '' THEN 'episodic' ELSE memory_class END AS memory_class, scope FROM ({_REQ})))"
_NORM = "sha256(regexp_replace(trim(lower(content)), '\\s+', ' ', 'g'))"


def requests(v):
    n = F.col("conv_id")
    return v.conversations.select(
        F.concat_ws("-", F.lit("new"), n.cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("content"), F.when(F.col("role") == "user", "conversation").otherwise("note").alias("kind"),
        F.when(n % 4 == 0, "semantic").when(n % 4 == 1, "core").otherwise("").alias("memory_class"), F.when(n % 3 == 0, "project/p1").otherwise("").alias("scope"),
        F.lit("").alias("retention_tier"), F.lit("").alias("visibility"), F.lit(None).cast("double").alias("strength"),
    )


def _made(v):
    return snapshots.with_defaults(requests(v), NOW).select("id", "kind", "memory_class", "retention_tier", "decay_rate", "scope", "visibility", "strength", F.col("expires_at").isNotNull().alias("expires"))


def _brief(df):
    return df.select("id", "content")


query("prj_defaults", "", _DEFAULTS)(_made)
query("snk_create", "memories", f"SELECT id, content FROM memories UNION ALL SELECT id, content FROM ({_REQ}) WHERE id = 'new-0-0'")(lambda v: snapshots.inserted(_brief(v.memories), _brief(requests(v).filter("id = 'new-0-0'"))))
query("snk_create_batch", "memories", f"SELECT id, content FROM memories UNION ALL SELECT min(id) AS id, arg_min(content, id) FROM ({_REQ}) WHERE {_NORM} NOT IN (SELECT {_NORM} FROM memories WHERE deleted_at IS NULL) GROUP BY {_NORM}")(lambda v: snapshots.inserted_by_hash(v.memories, _like(v, requests(v))).select("id", "content"))
query("job_dedup_hash", "memories", f"SELECT content_hash, n, kept FROM (SELECT {_NORM} AS content_hash, count(*) AS n, arg_min(id, strftime(created_at, '%Y%m%d%H%M%S') || id) AS kept FROM memories WHERE deleted_at IS NULL GROUP BY 1) WHERE n > 1")(lambda v: v.memories.filter(live()).groupBy(s.content_hash(F.col("content")).alias("content_hash")).agg(F.count("*").alias("n"), F.min(F.struct("created_at", "id")).alias("first")).filter("n > 1").select("content_hash", "n", F.col("first.id").alias("kept")))
query("prj_patch", "memories", f"SELECT id, kind, CASE WHEN doc % 7 = 0 THEN 'long_term' ELSE retention_tier END AS retention_tier, CASE WHEN doc % 7 = 0 THEN 0.001 ELSE decay_rate END AS decay_rate FROM (SELECT *, CAST(substr(id, 5) AS BIGINT) AS doc FROM memories)")(lambda v: snapshots.patched(v.memories, v.memories.filter(F.substring("id", 5, 20).cast("long") % 7 == 0).select("id", F.lit("long_term").alias("retention_tier")), "retention_tier").select("id", "kind", "retention_tier", "decay_rate"))
query("snk_update", "memories", "SELECT id, CASE WHEN kind = 'note' THEN 'rule' ELSE kind END AS kind, strength FROM memories")(lambda v: snapshots.patched(v.memories, v.memories.filter("kind = 'note'").select("id", F.lit("rule").alias("kind")), "kind").select("id", "kind", "strength"))
query("snk_delete", "memories", "SELECT id FROM memories WHERE kind <> 'error'")(lambda v: snapshots.deleted(v.memories, v.memories.filter("kind = 'error'"), "id").select("id"))
query("snk_soft_delete", "memories", "SELECT id, deleted_at IS NOT NULL OR kind = 'goal' AS gone FROM memories")(lambda v: snapshots.soft_deleted(v.memories, F.col("kind") == "goal", NOW).select("id", F.col("deleted_at").isNotNull().alias("gone")))
query("snk_restore", "memories", "SELECT id, deleted_at IS NOT NULL AND scope <> 'default' AS gone FROM memories")(lambda v: snapshots.restored(v.memories, F.col("scope") == "default", NOW).select("id", F.col("deleted_at").isNotNull().alias("gone")))
query("snk_soft_delete_doc", "memories", "SELECT id, deleted_at IS NOT NULL OR source_type = 'src3' AS gone FROM memories")(lambda v: snapshots.soft_deleted(v.memories, F.col("source_type") == "src3", NOW).select("id", F.col("deleted_at").isNotNull().alias("gone")))
query("snk_soft_delete_ref", "memories", f"SELECT id, deleted_at IS NOT NULL OR (source_ref = 'src4/en' AND {_VISIBLE}) AS gone FROM memories")(lambda v: snapshots.soft_deleted(v.memories, (F.col("source_ref") == "src4/en") & visible(WHO), NOW).select("id", F.col("deleted_at").isNotNull().alias("gone")))
query("snk_restore_ref", "memories", "SELECT id, deleted_at IS NOT NULL AND NOT (source_ref = 'src3/en' AND team_id = 'team_1') AS gone FROM memories")(lambda v: snapshots.restored(v.memories, (F.col("source_ref") == "src3/en") & (F.col("team_id") == "team_1"), NOW).select("id", F.col("deleted_at").isNotNull().alias("gone")))
query("snk_cleanup_expired", "memories", f"SELECT id, deleted_at IS NOT NULL OR coalesce(expires_at <= {_T}, false) AS gone FROM memories")(lambda v: snapshots.soft_deleted(v.memories, F.col("expires_at") <= snapshots.at(NOW), NOW).select("id", F.col("deleted_at").isNotNull().alias("gone")))
query("job_expiry", "memories", f"SELECT count(*) AS expired FROM memories WHERE deleted_at IS NULL AND expires_at <= {_T}")(lambda v: v.memories.filter(live() & (F.col("expires_at") <= snapshots.at(NOW))).agg(F.count("*").alias("expired")))
query("snk_purge", "memories memory_tags", "SELECT id, (SELECT count(*) FROM memory_tags t WHERE t.memory_id = memories.id) AS tags FROM memories WHERE deleted_at IS NULL OR deleted_at >= TIMESTAMP '2024-01-02 00:00:00'")(lambda v: _purged(v))
query("snk_reinforce", "memories", "SELECT id, round(CASE WHEN kind = 'rule' AND deleted_at IS NULL THEN strength + 0.1 * (1 - strength) ELSE strength END, 6) AS strength, CAST(CASE WHEN kind = 'rule' AND deleted_at IS NULL THEN reinforced_count + 1 ELSE reinforced_count END AS INT) AS reinforced_count FROM memories")(lambda v: snapshots.reinforced(v.memories, F.col("kind") == "rule", NOW).select("id", F.round("strength", 6).alias("strength"), "reinforced_count"))
query("snk_access", "memories access_log", "SELECT m.id, CAST(m.access_count + coalesce(a.n, 0) AS INT) AS access_count FROM memories m LEFT JOIN (SELECT memory_id, count(*) AS n FROM access_log GROUP BY 1) a ON a.memory_id = m.id")(lambda v: snapshots.accessed(v.memories, v.access_log.groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("accesses"))).select("id", "access_count"))
query("snk_vec", "memory_embeddings", "SELECT memory_id, max(version) AS version FROM (SELECT memory_id, 1 AS version FROM memory_embeddings UNION ALL SELECT memory_id, 2 FROM memory_embeddings WHERE label = 3) GROUP BY 1")(lambda v: snapshots.latest(v.memory_embeddings.select("memory_id", F.lit(1).alias("version")).union(v.memory_embeddings.filter("label = 3").select("memory_id", F.lit(2))), "memory_id", order="version"))
query("snk_entity", "entities", "SELECT id, name FROM entities WHERE entity_type <> 'org' UNION ALL SELECT 'entity-new', 'NEW'")(lambda v: snapshots.inserted(snapshots.deleted(v.entities, v.entities.filter("entity_type = 'org'"), "id"), v.spark.createDataFrame([("entity-new", "NEW", "concept", "global")], "id string, name string, entity_type string, scope string")).select("id", "name"))
query("snk_relation", "entity_relations", "SELECT source_id, target_id FROM entity_relations WHERE relation_type = 'located_in'")(lambda v: snapshots.deleted(v.entity_relations, v.entity_relations.filter("relation_type = 'belongs_to'"), "source_id", "target_id", "relation_type").select("source_id", "target_id"))
query("snk_relation_stats", "entity_relations", "SELECT source_id, target_id, relation_type, CAST(sum(mention_count) AS BIGINT) AS mention_count FROM (SELECT source_id, target_id, relation_type, mention_count FROM entity_relations UNION ALL SELECT source_id, target_id, relation_type, 1 FROM entity_relations WHERE mention_count > 2) GROUP BY 1, 2, 3")(lambda v: snapshots.relation_stats(v.entity_relations, v.entity_relations.filter("mention_count > 2").drop("mention_count")).drop("last_seen_at"))
query("snk_link", "memory_entities", "SELECT memory_id, entity_id, 0.9::DOUBLE AS confidence FROM (SELECT DISTINCT memory_id, entity_id FROM memory_entities)")(lambda v: v.memory_entities.select("memory_id", "entity_id").dropDuplicates(["memory_id", "entity_id"]).withColumn("confidence", F.lit(0.9)))
query("snk_candidate", "", "SELECT event_type AS name, 'global' AS scope, count(*) AS hit_count, count(DISTINCT user_id) AS ids, coalesce(arg_min(CASE WHEN value > 50 THEN 'product' END, CASE WHEN value > 50 THEN 'u' || lpad(CAST(user_id AS STRING), 6, '0') END), 'concept') AS entity_type FROM events GROUP BY 1")(lambda v: snapshots.candidate_hits(v.events.select(F.col("event_type").alias("name"), F.lit("global").alias("scope"), F.when(F.col("value") > 50, "product").otherwise("concept").alias("entity_type"), F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("memory_id"))).select("name", "scope", "hit_count", F.size("memory_ids").cast("long").alias("ids"), "entity_type"))
query("snk_derivation", "memory_derivations", "SELECT DISTINCT source_id, target_id FROM memory_derivations")(lambda v: v.memory_derivations.union(v.memory_derivations).dropDuplicates())
query("snk_tags", "memory_tags", "SELECT memory_id, tag FROM memory_tags WHERE tag <> 'lang:en'")(lambda v: snapshots.deleted(v.memory_tags, v.memory_tags.filter("tag = 'lang:en'"), "memory_id", "tag").select("memory_id", "tag"))
query("snk_context", "contexts", "SELECT id, path, depth FROM contexts UNION ALL SELECT 'new-' || id, path || '/archive', depth + 1 FROM contexts WHERE depth = 1")(lambda v: v.contexts.select("id", "path", "depth").union(v.contexts.filter("depth = 1").select(F.concat(F.lit("new-"), "id"), F.concat("path", F.lit("/archive")), F.col("depth") + 1)))
query("snk_context_move", "contexts", "SELECT id, CASE WHEN path = '/EUROPE/FRANCE' OR starts_with(path, '/EUROPE/FRANCE/') THEN '/ASIA/FRANCE' || substr(path, 15) ELSE path END AS path, depth FROM contexts")(lambda v: snapshots.moved(v.contexts, "/EUROPE/FRANCE", "/ASIA").select("id", "path", "depth"))
query("snk_context_count", "conversation_memories", "SELECT context_id AS id, count(*) AS memory_count FROM conversation_memories GROUP BY 1")(lambda v: snapshots.counted(v.conversation_memories.select(F.col("context_id").alias("id")).distinct(), v.conversation_memories))
query("snk_document", "", "SELECT doc_id, CASE WHEN n_chars < 100 THEN 'failed' ELSE 'ready' END AS status FROM documents")(lambda v: snapshots.changed(v.documents.select("doc_id", "n_chars", F.lit("ready").alias("status")), F.col("n_chars") < 100, status=F.lit("failed")).select("doc_id", "status"))
query("snk_session", "", "SELECT 'session-' || CAST(user_id AS STRING) AS session_id, CASE WHEN max(ts) >= TIMESTAMP '2024-01-30 00:00:00' THEN 'active' ELSE 'created' END AS state FROM events GROUP BY user_id")(lambda v: snapshots.changed(sessions(v).withColumn("state", F.lit("created")), F.col("last_seen") >= F.lit("2024-01-30 00:00:00").cast("timestamp"), state=F.lit("active")).select("session_id", "state"))
query("snk_finalize", "", "SELECT user_id, max(event_id) AS version FROM events GROUP BY user_id")(lambda v: snapshots.latest(v.events.select("user_id", F.col("event_id").alias("version")), "user_id", order="version"))
query("snk_cursor", "", "SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id")(lambda v: snapshots.latest(v.conversations.select("conv_id", "turn"), "conv_id", order="turn"))
query("snk_idem", "", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")(lambda v: snapshots.earliest(v.events.select("user_id", "event_type", "event_id"), "user_id", "event_type", order="event_id"))
query("snk_policy", "", "SELECT n_name AS scope, CASE WHEN n_regionkey = 2 THEN 2 ELSE 1 END AS version FROM nation WHERE n_regionkey <> 3")(lambda v: snapshots.changed(snapshots.deleted(v.nation, v.nation.filter("n_regionkey = 3"), "n_nationkey").withColumn("version", F.lit(1)), F.col("n_regionkey") == 2, version=F.lit(2)).select(F.col("n_name").alias("scope"), "version"))
_TASKS = "SELECT event_id, CASE event_type WHEN 'error' THEN 'processing' ELSE 'pending' END AS status, CAST(user_id % 4 AS INT) AS retries FROM events"
query("snk_task", "", f"SELECT event_id, CASE WHEN status = 'processing' THEN CASE WHEN retries + 1 < 3 THEN 'pending' ELSE 'failed' END ELSE status END AS status, CASE WHEN status = 'processing' THEN retries + 1 ELSE retries END AS retries FROM ({_TASKS})")(lambda v: snapshots.failed_tasks(v.events.select("event_id", F.when(F.col("event_type") == "error", "processing").otherwise("pending").alias("status"), (F.col("user_id") % 4).cast("int").alias("retries")), F.col("status") == "processing"))

# jobs
query("job_decay_audit", "memories", f"SELECT id FROM (SELECT * FROM memories WHERE deleted_at IS NULL AND strength < 0.1 ORDER BY strength, id LIMIT 200) WHERE reinforced_count = 0 AND created_at < {_T} - INTERVAL 90 DAY AND retention_tier <> 'permanent' AND {STRENGTH} < 0.1")(lambda v: snapshots.decayed(v.memories, NOW))
query("job_promote_class", "memories", "SELECT id, CASE WHEN deleted_at IS NULL AND memory_class = 'episodic' AND reinforced_count >= 5 THEN 'semantic' ELSE memory_class END AS memory_class FROM memories")(lambda v: snapshots.changed(v.memories, live() & (F.col("memory_class") == "episodic") & (F.col("reinforced_count") >= 5), memory_class=F.lit("semantic")).select("id", "memory_class"))
_CRYSTAL = f"retention_tier <> 'permanent' AND kind NOT IN ('ephemeral', 'conversation') AND reinforced_count >= 5 AND strength >= 0.7 AND created_at <= {_T} - INTERVAL 720 HOUR"
query("job_promote_tier", "memories", f"SELECT id, CASE WHEN deleted_at IS NULL AND retention_tier = 'short_term' AND reinforced_count >= 2 AND kind <> 'conversation' AND created_at <= {_T} - INTERVAL 24 HOUR THEN 'standard' WHEN deleted_at IS NULL AND retention_tier = 'standard' AND {_CRYSTAL} THEN 'long_term' ELSE retention_tier END AS retention_tier FROM memories")(lambda v: snapshots.promoted_tiers(v.memories, NOW).select("id", "retention_tier"))
query("job_crystallize", "memories", f"SELECT id FROM memories WHERE {_CRYSTAL}")(lambda v: v.memories.filter(snapshots.crystallizes(NOW)).select("id"))
query("job_candidates", "memories", f"SELECT id, memory_class, CASE WHEN ready AND memory_class = 'semantic' AND retention_tier IN ('ephemeral', 'short_term') THEN 'standard' WHEN ready AND memory_class = 'procedural' AND retention_tier NOT IN ('long_term', 'permanent') THEN 'long_term' ELSE retention_tier END AS retention_tier FROM (SELECT id, retention_tier, ready, CASE WHEN ready THEN split_part(candidate_for, '_candidate', 1) ELSE memory_class END AS memory_class FROM (SELECT *, deleted_at IS NULL AND candidate_for <> '' AND reinforced_count >= 3 AND strength >= 0.6 AND created_at <= {_T} - INTERVAL 1 DAY AS ready FROM memories))")(lambda v: snapshots.promoted_candidates(v.memories, NOW).select("id", "memory_class", "retention_tier"))
query("job_entity_promote", "entity_candidates", "SELECT 'entity-' || name AS id, name, 'concept' AS entity_type FROM entity_candidates WHERE hit_count >= 15")(lambda v: reads.promotable(v.entity_candidates, 15).select(F.concat(F.lit("entity-"), "name").alias("id"), "name", F.lit("concept").alias("entity_type")))
_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
query("job_contradiction", "memory_embeddings", f"SELECT one, two, round(cos, 6) AS cosine FROM (SELECT a.memory_id AS one, b.memory_id AS two, {_COS} AS cos FROM memory_embeddings a JOIN memory_embeddings b ON a.label = b.label AND a.memory_id < b.memory_id) WHERE cos BETWEEN 0.25 AND 0.95 ORDER BY cos DESC, one, two LIMIT 50")(lambda v: _contradictions(v))
query("job_excerpt", "memories", "SELECT id, CASE WHEN length(content) <= 50 THEN content ELSE substr(content, 1, 100) END AS excerpt FROM memories WHERE deleted_at IS NULL AND kind = 'note' ORDER BY created_at DESC, id LIMIT 20")(lambda v: reads.missing_excerpt(v.memories.filter("kind = 'note'").withColumn("excerpt", F.lit(""))).select("id", s.excerpt(F.col("content")).alias("excerpt")))
query("job_dedup_vec", "memory_embeddings", f"SELECT id, other_id, CASE WHEN cos >= 0.95 THEN 'duplicate' WHEN cos >= 0.3 THEN 'near' ELSE 'new' END AS verdict FROM (SELECT a.memory_id AS id, b.memory_id AS other_id, {_COS} AS cos, row_number() OVER (PARTITION BY a.memory_id ORDER BY {_COS} DESC, b.memory_id) AS nth FROM memory_embeddings a JOIN memory_embeddings b ON a.label = b.label AND a.memory_id <> b.memory_id) WHERE nth = 1")(lambda v: _nearest_in_label(v))
query("job_resolve_l1", "entities", r"SELECT DISTINCT c.conv_id, e.id AS entity_id FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM conversations) c JOIN entities e ON lower(e.name) = c.term WHERE length(c.term) >= 2")(lambda v: v.conversations.select("conv_id", F.explode(s.indexed_terms(F.col("text"))).alias("term")).filter(F.char_length("term") >= 2).join(v.entities.select(F.col("id").alias("entity_id"), F.lower("name").alias("term")), "term").select("conv_id", "entity_id").distinct())
query("job_ingest_conv", "conversation_memories", "SELECT id, turn_number, 'standard' AS retention_tier, 'private' AS visibility FROM conversation_memories WHERE length(content) >= 10")(lambda v: v.conversation_memories.filter(F.char_length("content") >= 10).select("id", "turn_number", F.lit("standard").alias("retention_tier"), F.lit("private").alias("visibility")))
query("job_summarize", "conversation_memories", "SELECT context_id, count(*) AS turns, substr(string_agg(content, ' ' ORDER BY turn_number), 1, 100) AS summary FROM conversation_memories GROUP BY context_id HAVING count(*) >= 3")(lambda v: summarized(v.conversation_memories))
_ENDED = f"SELECT *, CASE state WHEN 'finalized' THEN 1 ELSE 0 END AS version, CAST(n_events % 5 AS INT) AS attempts FROM ({SESSIONS})"
query("job_finalize", "", f"SELECT session_id, CASE WHEN asked THEN 'finalized' ELSE state END AS state, CASE WHEN asked THEN 1 ELSE version END AS version FROM (SELECT *, session_id IN (SELECT 'session-' || CAST(user_id AS STRING) FROM events WHERE event_type = 'error' OR (event_type = 'signup' AND user_id % 3 <> 0)) AS asked FROM ({_ENDED}))")(lambda v: _finalized(v))
query("job_repair", "", f"SELECT session_id, CASE WHEN NOT due THEN state WHEN attempts >= 3 THEN 'abandoned' WHEN n_events % 7 = 0 THEN 'pending_repair' ELSE 'finalized' END AS state, CASE WHEN due AND attempts < 3 THEN attempts + 1 ELSE attempts END AS attempts, due AS swept FROM (SELECT *, state IN ('active', 'pending_repair') AND last_seen < {_T} - INTERVAL 30 MINUTE AS due FROM ({_ENDED}))")(lambda v: snapshots.repaired(_sessions(v), NOW, F.col("n_events") % 7 == 0, batch=None).select("session_id", "state", "attempts", (F.col("last_seen") == snapshots.at(NOW)).alias("swept")))
query("job_backfill", "memories memory_embeddings", "SELECT id FROM memories WHERE deleted_at IS NULL AND id NOT IN (SELECT memory_id FROM memory_embeddings WHERE label < 5)")(lambda v: reads.without(v.memories, v.memory_embeddings.filter("label < 5"), "id", "memory_id").select("id"))
query("job_resolve_l2", "memory_embeddings memory_entities", "SELECT memory_id, entity_id FROM (SELECT memory_id, entity_id, row_number() OVER (PARTITION BY memory_id ORDER BY cos DESC, entity_id) AS nth FROM (SELECT e.memory_id, c.entity_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.centroid) AS cos FROM memory_embeddings e CROSS JOIN (SELECT entity_id, list(value ORDER BY i) AS centroid FROM (SELECT l.entity_id, i, avg(CAST(x.embedding[i] AS DOUBLE)) AS value FROM memory_entities l JOIN memory_embeddings x ON x.memory_id = l.memory_id CROSS JOIN range(1, 65) r(i) WHERE l.role = 'mentioned' GROUP BY 1, 2) GROUP BY 1) c) WHERE cos >= 0.25) WHERE nth <= 10")(lambda v: _by_centroid(v))
query("job_resolve_l3", "memory_embeddings memory_entities", f"SELECT n.memory_id, entity_id, count(*) AS votes FROM (SELECT a.memory_id, b.memory_id AS near, row_number() OVER (PARTITION BY a.memory_id ORDER BY {_COS} DESC, b.memory_id) AS nth FROM memory_embeddings a JOIN memory_embeddings b ON a.memory_id <> b.memory_id WHERE a.label IS NOT NULL) n JOIN memory_entities l ON l.memory_id = n.near WHERE nth <= 10 GROUP BY 1, 2 HAVING count(*) >= 2")(lambda v: _by_neighbours(v))
query("job_resolve", "memory_entities", "SELECT a.entity_id AS source_id, b.entity_id AS target_id, count(DISTINCT a.memory_id) AS mention_count FROM memory_entities a JOIN memory_entities b ON a.memory_id = b.memory_id AND a.entity_id < b.entity_id GROUP BY 1, 2")(lambda v: relations.cooccurring(v.memory_entities.select("memory_id", "entity_id")))


def summarized(rows, least: int = 3, summarise=None):
    """A row for each context of at least least turns; summarise gives the text of a column, its beginning without it."""
    turns = rows.groupBy("context_id").agg(F.count("*").alias("turns"), F.array_join(F.array_sort(F.collect_list(F.struct("turn_number", "content"))).getField("content"), " ").alias("_text"))
    return turns.filter(F.col("turns") >= least).select("context_id", "turns", (summarise or (lambda c: F.substring(c, 1, 100)))(F.col("_text")).alias("summary"))


def _sessions(v):
    return sessions(v).withColumns({"version": F.when(F.col("state") == "finalized", 1).otherwise(0), "attempts": (F.col("n_events") % 5).cast("int")})


def _finalized(v):
    """Errors and sign-ups ask for the end of their user's session; the keys of every third user's sign-up are spent."""
    key = F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("key")
    asked = v.events.filter(F.col("event_type").isin("error", "signup")).select(F.concat(F.lit("session-"), F.col("user_id").cast("string")).alias("session_id"), key)
    used = v.events.filter("event_type = 'signup' AND user_id % 3 = 0").select(key).distinct()
    return snapshots.finalized(_sessions(v), asked, used).select("session_id", "state", "version")


def _like(v, requests_):
    """The requests with every column of the rows, empty where they have none."""
    have = set(requests_.columns)
    return requests_.select(*(F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in v.memories.dtypes))


def _purged(v):
    rows, tags = snapshots.purged(v.memories, "2024-01-02 00:00:00", (v.memory_tags, "memory_id"))
    return rows.join(tags.groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("tags")), "id", "left").select("id", F.coalesce("tags", F.lit(0)).alias("tags"))


def _labelled(v):
    return v.memory_embeddings.select("label", F.col("memory_id").alias("id"), "embedding")


def _contradictions(v):
    found = vectorindex.close_pairs(_labelled(v), "label", 0.25, 0.95).found.orderBy(F.desc("cosine"), "one", "other").limit(50)
    return found.select("one", F.col("other").alias("two"), F.round("cosine", 6).alias("cosine"))


def _nearest_in_label(v):
    near = vectorindex.nearest_in_group(_labelled(v), "label")
    return near.select("id", "other_id", F.when(F.col("cosine") >= 0.95, "duplicate").when(F.col("cosine") >= 0.3, "near").otherwise("new").alias("verdict"))


def _by_centroid(v):
    means = vectorsearch.centroids(v.memory_embeddings.select("memory_id", "embedding"), v.memory_entities.filter("role = 'mentioned'").select("memory_id", "entity_id"))
    found = vectorsearch.search(v.memory_embeddings.select(F.col("memory_id").alias("id"), "embedding"), means.select(F.col("entity_id").alias("query_id"), F.col("centroid").alias("query")), None, 0.25)
    best = Window.partitionBy("id").orderBy(F.desc("score"), "query_id")
    return found.withColumn("nth", F.row_number().over(best)).filter("nth <= 10").select(F.col("id").alias("memory_id"), F.col("query_id").alias("entity_id"))


def _by_neighbours(v):
    # written, as shares are counted and dealt out from it
    fine = written(v.memory_embeddings.filter(vectorindex.usable(F.col("embedding"))), "usable")
    few = fine.filter("label IS NOT NULL").select(F.col("memory_id").alias("query_id"), F.col("embedding").alias("query"))
    near = vectorsearch.search(fine.select(F.col("memory_id").alias("id"), "embedding"), few, 11).filter("id <> query_id")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("nth"))).filter("place <= 10")
    return relations.votes(near.select("query_id", F.col("id").alias("memory_id")), v.memory_entities.select("memory_id", "entity_id")).withColumnRenamed("query_id", "memory_id")
