"""Registered scalar functions and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.operators import vectorsearch
from tidemark.operators.fulltext import STOP_WORDS
from tidemark.registry import query
from tidemark.sources.views import NOW

_NORM = "regexp_replace(trim(lower(content)), '\\s+', ' ', 'g')"
_CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}]"
_OVERLAP = r"trim(regexp_replace(lower(content), '[^\p{L}\p{N}]+', ' ', 'g'))"
_HOURS = f"date_diff('microsecond', last_accessed_at, TIMESTAMP '{NOW}') / 3600000000.0"
STRENGTH = f"(CASE WHEN retention_tier = 'permanent' OR last_accessed_at IS NULL THEN strength ELSE strength * exp(-decay_rate * greatest({_HOURS}, 0)) * least(3.0, 1 + 0.15 * log2(access_count + 1.0)) END)"


def _cases(column, weights, default="1.0"):
    return f"(CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {default} END)"


_CORE = "(CASE WHEN starts_with(scope, 'user/') AND memory_class = 'core' THEN 1.15 ELSE 1.0 END)"
KINDS = f"{_cases('kind', s.KIND)} * {_cases('sub_kind', s.SUB_KIND)} * {_cases('memory_class', s.CLASS)}"
STRUCTURAL = f"least({KINDS} * {_cases(chr(34) + 'prefix' + chr(34), s.SCOPE)} * {_CORE} * greatest({STRENGTH}, 0.05), 2.0)".replace('"prefix"', "split_part(scope, '/', 1)")
DIRECT = f"least({_cases('kind', s.DIRECT_KIND)} * {_cases('sub_kind', s.DIRECT_SUB_KIND)} * {_cases('memory_class', s.DIRECT_CLASS)}, 2.0) * (CASE WHEN contains(scope, '/') THEN {_cases('PREFIX', s.DIRECT_SCOPE)} ELSE 1.0 END) * {_CORE}".replace("PREFIX", "split_part(scope, '/', 1)")

query("fn_hash_norm", "memories", f"SELECT id, {_NORM} AS normalized FROM memories")(lambda v: v.memories.select("id", s.normalized(F.col("content")).alias("normalized")))
query("fn_hash", "memories", f"SELECT id, sha256({_NORM}) AS content_hash FROM memories")(lambda v: v.memories.select("id", s.content_hash(F.col("content")).alias("content_hash")))
query("fn_tokens", "memories", f"SELECT id, CAST(len(regexp_extract_all(content, '{_CJK}')) + (length(content) - len(regexp_extract_all(content, '{_CJK}')) + 3) // 4 AS BIGINT) AS tokens FROM memories")(lambda v: v.memories.select("id", s.estimated_tokens(F.col("content")).alias("tokens")))
query("fn_tok_simple", "memories", r"SELECT id, array_to_string(regexp_extract_all(content, '[\p{L}\p{Nd}]+'), ' ') AS tokens FROM memories")(lambda v: v.memories.select("id", F.array_join(s.simple_tokens(F.col("content")), " ").alias("tokens")))
_STOPPED = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
query("fn_stop", "memories", rf"SELECT id, array_to_string(list_filter(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+'), lambda x: x NOT IN ({_STOPPED})), ' ') AS kept FROM memories")(lambda v: v.memories.select("id", F.array_join(F.filter(s.indexed_terms(F.col("content")), lambda x: ~x.isin(*sorted(STOP_WORDS))), " ").alias("kept")))
# each document against the words of a question, the one whose number its own number gives
_OWN = r"SELECT d.doc_id, lower(d.text) AS low, list_distinct(list_filter(string_split_regex(lower(b.text), '\s+'), lambda w: w <> '')) AS w FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)"
query("fn_coverage", "", f"SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: contains(low, x))) / len(w) END, 6) AS coverage FROM ({_OWN})")(lambda v: _covered(v))
query("fn_overlap_norm", "memories", f"SELECT id, {_OVERLAP} AS normalized FROM memories")(lambda v: v.memories.select("id", s.overlap_text(F.col("content")).alias("normalized")))
query("fn_overlap_terms", "", r"SELECT item_id, array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '))), ' ') AS terms FROM benchmark")(lambda v: v.benchmark.select("item_id", F.array_join(F.array_sort(F.array_distinct(F.split(s.overlap_text(F.col("text")), " "))), " ").alias("terms")))
query("fn_overlap", "memories", f"SELECT id, round(CASE WHEN doc = '' THEN 0 ELSE 0.35 * CAST(contains(doc, 'of the') AS INT) + 0.65 * (CAST(contains(doc, 'of') AS INT) + CAST(contains(doc, 'the') AS INT)) / 2 END, 6) AS score FROM (SELECT id, {_OVERLAP} AS doc FROM memories)")(lambda v: v.memories.select("id", F.round(s.overlap_score(F.lit("of the"), F.array(F.lit("of"), F.lit("the")), s.overlap_text(F.col("content"))), 6).alias("score")))
query("fn_cosine", "memory_embeddings", "SELECT a.memory_id, b.memory_id AS other_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM memory_embeddings a JOIN memory_embeddings b ON CAST(substr(b.memory_id, 5) AS BIGINT) % 50 = 0")(lambda v: _cosines(v))
query("fn_blend_vec", "memory_embeddings", "SELECT memory_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: 0.7 * x + 0.3 * 0.5)), 6) AS total FROM memory_embeddings")(lambda v: v.memory_embeddings.select("memory_id", F.round(F.aggregate(s.blended(F.col("embedding"), F.transform("embedding", lambda x: F.lit(0.5)), 0.3), F.lit(0.0), lambda a, b: a + b), 6).alias("total")))
query("fn_strength", "memories", f"SELECT id, round({STRENGTH}, 6) AS strength FROM memories")(lambda v: v.memories.select("id", F.round(s.effective_strength(NOW), 6).alias("strength")))
query("fn_age_decay", "memories", f"SELECT id, round(exp(-0.01 * greatest(date_diff('microsecond', created_at, TIMESTAMP '{NOW}') / 86400000000.0, 0)), 6) AS decay FROM memories")(lambda v: v.memories.select("id", F.round(s.age_decay(F.col("created_at"), NOW, 0.01), 6).alias("decay")))
query("fn_structural", "memories", f"SELECT id, round({STRUCTURAL}, 6) AS weight FROM memories")(lambda v: v.memories.select("id", F.round(s.structural_weight(NOW), 6).alias("weight")))
query("fn_structural_legacy", "memories", f"SELECT id, round(CAST({DIRECT} AS DOUBLE), 6) AS weight FROM memories")(lambda v: v.memories.select("id", F.round(s.direct_weight(), 6).alias("weight")))
query("fn_temporal_score", "memories", "SELECT id, round(CASE WHEN days <= 10 THEN 1.0 ELSE 1 / (1 + days / 10) END, 6) AS score FROM (SELECT id, abs(date_diff('microsecond', coalesce(happened_at, created_at), TIMESTAMP '2024-01-15 00:00:00') / 86400000000.0) AS days FROM memories)")(lambda v: v.memories.select("id", F.round(s.temporal_score(F.coalesce("happened_at", "created_at"), "2024-01-15 00:00:00", 10), 6).alias("score")))
query("fn_event_time", "memories", "SELECT id, CAST(epoch_us(coalesce(happened_at, created_at)) AS BIGINT) AS event_us FROM memories")(lambda v: v.memories.select("id", F.unix_micros(F.coalesce("happened_at", "created_at")).alias("event_us")))
query("fn_tier", "memories", "SELECT id, CASE retention_tier WHEN 'ephemeral' THEN 'short_term' WHEN 'short_term' THEN 'standard' WHEN 'standard' THEN 'long_term' ELSE 'permanent' END AS next_tier, CASE memory_class WHEN 'episodic' THEN 'short_term' WHEN 'procedural' THEN 'long_term' WHEN 'core' THEN 'permanent' ELSE 'standard' END AS least_tier, decay_rate AS decay FROM memories")(lambda v: v.memories.select("id", s.next_tier(F.col("retention_tier")).alias("next_tier"), s.least_tier(F.col("memory_class")).alias("least_tier"), s.decay_of(F.col("retention_tier")).alias("decay")))
query("fn_cjk_ratio", "memories", f"SELECT id, round(CASE WHEN length(content) = 0 THEN 0 ELSE len(regexp_extract_all(content, '{_CJK}')) / length(content) END, 6) AS ratio FROM memories")(lambda v: v.memories.select("id", F.round(s.cjk_ratio(F.col("content")), 6).alias("ratio")))
query("fn_fuzzy_hit", "", "SELECT doc_id, (SELECT count(*) FROM (VALUES ('the'), ('eau'), ('keit'), ('que')) w(word) WHERE contains(lower(text), word)) >= 2 AS hit FROM documents")(lambda v: v.documents.select("doc_id", (F.size(F.filter(F.array(*map(F.lit, ("the", "eau", "keit", "que"))), lambda w: F.contains(F.lower("text"), w))) >= 2).alias("hit")))
query("fn_check_hit", "memory_embeddings", "SELECT label, min(nth) AS first_rank FROM (SELECT label, memory_id, row_number() OVER (PARTITION BY label ORDER BY memory_id) AS nth FROM memory_embeddings) WHERE contains(memory_id, '3') GROUP BY label")(lambda v: _first_ranks(v))
query("fn_proper_nouns", "conversation_memories", r"SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b'))), '|') AS names FROM conversation_memories WHERE regexp_full_match(content, '[\x00-\x7f]*')")(lambda v: v.conversation_memories.filter(F.octet_length("content") == F.char_length("content")).select("id", F.array_join(F.array_sort(s.proper_nouns(F.col("content"))), "|").alias("names")))
query("fn_json", "entity_candidates", "SELECT name, '[\"' || name || '\",\"' || scope || '\"]' AS ids FROM entity_candidates")(lambda v: v.entity_candidates.select("name", F.to_json(F.array_append(F.array("name"), F.col("scope"))).alias("ids")))
query("fn_excerpt", "memories", "SELECT id, CASE WHEN length(content) <= 50 THEN content ELSE substr(content, 1, 100) END AS short FROM memories")(lambda v: v.memories.select("id", s.excerpt(F.col("content")).alias("short")))
# pages' addresses as remotes, every other one in the form of a secure shell
_REMOTES = "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'git@' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/', ':') || '.git' END AS url FROM pages"
_NORMAL = rf"SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(trim(url), '^(ssh|https?|git)://', ''), '^[\w.-]+@([\w.-]+):', '\1/'), '\.git$', '')) AS normalized FROM ({_REMOTES})"
query("fn_git_norm", "", _NORMAL)(lambda v: _remotes(v).select("page_id", s.remote_url(F.col("url")).alias("normalized")))
query("fn_project_id", "", f"SELECT page_id, 'p_' || substr(sha256(normalized), 1, 12) AS project_id FROM ({_NORMAL})")(lambda v: _remotes(v).select("page_id", s.project_id(F.col("url")).alias("project_id")))
query("fn_observation", "", "SELECT event_id, CASE WHEN event_type = 'view' THEN '[Read] /data/' || CAST(user_id AS STRING) ELSE '[Bash] $ run ' || CAST(user_id AS STRING) || ' -> ' || event_type END AS line FROM events")(lambda v: _observations(v))

# projections
query("prj_detail", "memories", "SELECT id, '' AS content, excerpt, '' AS summary FROM memories")(lambda v: detail(v.memories, "excerpt_only").select("id", "content", "excerpt", "summary"))
query("prj_scan", "memories memory_tags", f"SELECT m.id, m.excerpt AS title, coalesce(t.tags, '') AS tags, CAST(len(regexp_extract_all(content, '{_CJK}')) + (length(content) - len(regexp_extract_all(content, '{_CJK}')) + 3) // 4 AS BIGINT) AS tokens FROM memories m LEFT JOIN (SELECT memory_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM memory_tags GROUP BY memory_id) t ON t.memory_id = m.id")(lambda v: scan(v.memories, v.memory_tags))
query("prj_builder", "memories", "SELECT id, kind FROM memories WHERE kind = 'rule' AND strength > 0.5 ORDER BY id LIMIT 10")(lambda v: v.memories.filter((F.col("kind") == "rule") & (F.col("strength") > 0.5)).orderBy("id").limit(10).select("id", "kind"))


def _cosines(v):
    """Every row against those whose number is divisible by 50."""
    asked = v.memory_embeddings.filter(F.substring("memory_id", 5, 99).cast("long") % 50 == 0).select(F.col("memory_id").alias("query_id"), F.col("embedding").alias("query"))
    found = vectorsearch.search(v.memory_embeddings.select(F.col("memory_id").alias("id"), "embedding"), asked, None)
    return found.select(F.col("id").alias("memory_id"), F.col("query_id").alias("other_id"), F.round("score", 6).alias("cosine"))


def _covered(v):
    n = v.benchmark.agg(F.count("*")).scalar()
    asked = v.benchmark.select("item_id", F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("words"))
    own = v.documents.select("doc_id", "text", (F.col("doc_id") % n).alias("item_id")).join(asked, "item_id")
    return own.select("doc_id", F.round(s.coverage(F.col("words"), F.col("text")), 6).alias("coverage"))


def _first_ranks(v):
    from pyspark.sql import Window

    ranked = v.memory_embeddings.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("memory_id")))
    return ranked.filter(F.contains(F.col("memory_id"), F.lit("3"))).groupBy("label").agg(F.min("nth").cast("long").alias("first_rank"))


def _observations(v):
    user = F.col("user_id").cast("string")
    read = F.col("event_type") == "view"
    given = F.when(read, F.concat(F.lit('{"file_path": "/data/'), user, F.lit('"}'))).otherwise(F.concat(F.lit('{"command": "run '), user, F.lit('"}')))
    return v.events.select("event_id", s.observation(F.when(read, "Read").otherwise("Bash"), given, F.col("event_type")).alias("line"))


def detail(rows, level: str):
    """Rows as far as a detail level shows them: all, "summary" without content, "excerpt_only" without summary too."""
    hidden = {"summary": ("content",), "excerpt_only": ("content", "summary")}.get(level, ())
    return rows.withColumns({c: F.lit("") for c in hidden}) if hidden else rows


def scan(rows, tags):
    """Compact rows: id, title, tags and estimated tokens."""
    named = tags.groupBy(F.col("memory_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags"))
    return rows.join(named, "id", "left").select("id", F.col("excerpt").alias("title"), F.coalesce("tags", F.lit("")).alias("tags"), s.estimated_tokens(F.col("content")).alias("tokens"))


def _remotes(v):
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    shell = F.concat(F.lit("git@"), F.regexp_replace(bare, "^([^/]*)/", "$1:"), F.lit(".git"))
    return v.pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(shell).alias("url"))
