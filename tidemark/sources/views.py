"""Derived views over the test tables, in SQL that Spark and DuckDB both run, and tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The clock and the caller that every registered query uses.
NOW, TEAM, OWNER = "2024-02-01 00:00:00", "team_1", "user_1"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "memories": """
SELECT 'doc-' || lpad(CAST(doc_id AS STRING), 8, '0') AS id, text AS content, substr(text, 1, 100) AS excerpt, '' AS summary,
 'team_' || CAST(doc_id % 3 AS STRING) AS team_id,
 CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'user_' || CAST(doc_id % 5 AS STRING) END AS owner_id,
 CASE doc_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'team' ELSE 'private' END AS visibility,
 CASE doc_id % 8 WHEN 0 THEN 'skill' WHEN 1 THEN 'rule' WHEN 2 THEN 'mental_model' WHEN 3 THEN 'preference' WHEN 4 THEN 'goal' WHEN 5 THEN 'note' WHEN 6 THEN 'event' ELSE 'error' END AS kind,
 CASE doc_id % 9 WHEN 0 THEN 'core_belief' WHEN 1 THEN 'working_memory' ELSE '' END AS sub_kind,
 CASE doc_id % 10 WHEN 0 THEN 'procedural' WHEN 1 THEN 'semantic' WHEN 2 THEN 'semantic' WHEN 3 THEN 'core' ELSE 'episodic' END AS memory_class,
 CASE doc_id % 6 WHEN 0 THEN 'session/s1' WHEN 1 THEN 'project/p1' WHEN 2 THEN 'user/user_1' WHEN 3 THEN 'agent/a1' WHEN 4 THEN 'global' ELSE 'default' END AS scope,
 CASE doc_id % 5 WHEN 0 THEN 'permanent' WHEN 1 THEN 'long_term' WHEN 2 THEN 'standard' WHEN 3 THEN 'short_term' ELSE 'ephemeral' END AS retention_tier,
 CASE doc_id % 5 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(0.001 AS DOUBLE) WHEN 2 THEN CAST(0.01 AS DOUBLE) WHEN 3 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS decay_rate,
 CAST(1 + doc_id * 37 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS strength,
 CAST(doc_id * 13 % 40 AS INT) AS access_count, CAST(doc_id * 5 % 8 AS INT) AS reinforced_count,
 source AS source_type, source || '/' || lang AS source_ref,
 CASE WHEN doc_id % 17 = 0 THEN 'semantic_candidate' WHEN doc_id % 19 = 0 THEN 'procedural_candidate' ELSE '' END AS candidate_for,
 TIMESTAMP '2023-03-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id * 7 % 8000 AS INT) AS created_at,
 TIMESTAMP '2023-03-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id * 7 % 8000 + doc_id % 24 AS INT) AS updated_at,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id * 11 % 720 AS INT) END AS happened_at,
 CASE WHEN doc_id % 7 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id * 3 % 740 AS INT) END AS last_accessed_at,
 CASE WHEN doc_id % 5 = 4 THEN TIMESTAMP '2024-01-20 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id % 600 AS INT) ELSE NULL END AS expires_at,
 CASE WHEN doc_id % 23 = 0 THEN TIMESTAMP '2023-12-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id % 1400 AS INT) ELSE NULL END AS deleted_at
FROM documents
""",
    "memory_embeddings": """
SELECT 'doc-' || lpad(CAST(e.vec_id AS STRING), 8, '0') AS memory_id, e.embedding AS embedding, e.label AS label
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
""",
    "conversation_memories": """
SELECT 'conv-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id, 'conv-' || CAST(conv_id AS STRING) AS context_id,
 role AS message_role, CAST(turn + 1 AS INT) AS turn_number, text AS content, 'conversation' AS source_type, CAST(conv_id AS STRING) AS source_ref
FROM conversations
""",
    "entities": """
SELECT 'region-' || CAST(r_regionkey AS STRING) AS id, r_name AS name, 'location' AS entity_type, 'global' AS scope FROM region
UNION ALL SELECT 'nation-' || CAST(n_nationkey AS STRING), n_name, 'location', 'global' FROM nation
UNION ALL SELECT 'customer-' || CAST(c_custkey AS STRING), c_name, 'person', 'global' FROM customer
UNION ALL SELECT 'supplier-' || CAST(s_suppkey AS STRING), s_name, 'org', 'global' FROM supplier
""",
    "entity_relations": """
SELECT 'nation-' || CAST(n_nationkey AS STRING) AS source_id, 'region-' || CAST(n_regionkey AS STRING) AS target_id, 'located_in' AS relation_type,
 CAST(1 AS BIGINT) AS mention_count, TIMESTAMP '2024-01-01 00:00:00' AS last_seen_at FROM nation
UNION ALL SELECT 'customer-' || CAST(c_custkey AS STRING), 'nation-' || CAST(c_nationkey AS STRING), 'belongs_to', CAST(1 + c_custkey % 5 AS BIGINT),
 TIMESTAMP '2023-09-01 00:00:00' + INTERVAL '1' HOUR * CAST(c_custkey % 3600 AS INT) FROM customer
UNION ALL SELECT 'supplier-' || CAST(s_suppkey AS STRING), 'nation-' || CAST(s_nationkey AS STRING), 'belongs_to', CAST(1 + s_suppkey % 5 AS BIGINT),
 TIMESTAMP '2023-09-01 00:00:00' + INTERVAL '1' HOUR * CAST(s_suppkey % 3600 AS INT) FROM supplier
""",
    "memory_entities": """
SELECT 'doc-' || lpad(CAST(doc_id AS STRING), 8, '0') AS memory_id, 'customer-' || CAST(doc_id * 7 % (SELECT count(*) FROM customer) AS STRING) AS entity_id, 'subject' AS role FROM documents
UNION ALL SELECT 'doc-' || lpad(CAST(doc_id AS STRING), 8, '0'), 'nation-' || CAST(doc_id % 25 AS STRING), 'mentioned' FROM documents WHERE doc_id % 2 = 0
""",
    "memory_tags": """
SELECT 'doc-' || lpad(CAST(doc_id AS STRING), 8, '0') AS memory_id, 'lang:' || lang AS tag FROM documents
UNION ALL SELECT 'doc-' || lpad(CAST(doc_id AS STRING), 8, '0'), 'source:' || source FROM documents WHERE doc_id % 2 = 1
""",
    "contexts": """
SELECT 'region-' || CAST(r_regionkey AS STRING) AS id, '' AS parent_id, '/' || r_name AS path, 0 AS depth FROM region
UNION ALL SELECT 'nation-' || CAST(n_nationkey AS STRING), 'region-' || CAST(n_regionkey AS STRING), '/' || r_name || '/' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'customer-' || CAST(c_custkey AS STRING), 'nation-' || CAST(n_nationkey AS STRING), '/' || r_name || '/' || n_name || '/' || c_name, 2
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    "memory_derivations": """
SELECT 'doc-' || lpad(CAST(doc_id AS STRING), 8, '0') AS source_id, 'doc-' || lpad(CAST(doc_id + 1 AS STRING), 8, '0') AS target_id
FROM documents WHERE doc_id % 12 <> 11 AND doc_id + 1 < (SELECT count(*) FROM documents)
""",
    "entity_candidates": """
SELECT event_type || '_' || CAST(user_id AS STRING) AS name, 'global' AS scope, count(*) AS hit_count, min(ts) AS first_seen FROM events GROUP BY event_type, user_id
""",
    "access_log": """
SELECT event_id, ts, 'doc-' || lpad(CAST(event_id % (SELECT count(*) FROM documents) AS STRING), 8, '0') AS memory_id, user_id FROM events WHERE event_type IN ('view', 'click')
""",
    "memory_postings_input": """
SELECT 'doc-' || lpad(CAST(doc_id AS STRING), 8, '0') AS id, lower(text) AS content FROM documents WHERE doc_id % 23 <> 0
""",
}


def with_views(names: str, sql: str) -> str:
    """sql after a WITH clause that defines the named views."""
    parts = [f"{name} AS ({VIEWS[name]})" for name in names.split()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


class Views:
    """Tables and derived views of one folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in VIEWS:
            sql = VIEWS[name]
            used = [t for t in TABLES if f" {t}" in sql]
            found = self.spark.sql(_bound(sql, used), **{t: getattr(self, t) for t in used})
        else:
            raise AttributeError(name)
        setattr(self, name, found)
        return found


def _bound(sql: str, used: list[str]) -> str:
    """sql with braces around the tables it reads from, for DataFrame arguments."""
    import re

    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b(?= [a-z]\b)", rf"\1 {{{t}}}", sql)
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}} AS {t}", sql)
    return sql
