"""Registered operators that SQL can't say: chunks, batches, clusters and hooks. Tests hold them against plain Python."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog.retrieval import asked, store
from tidemark.functions import scalars as s
from tidemark.operators import bulk, chunking, extraction, hooks, selection, snapshots
from tidemark.operators.predicates import live
from tidemark.plans import pipelines as pl
from tidemark.registry import query
from tidemark.session import shared_dir
from tidemark.sources.files import json_cases
from tidemark.sources.views import NOW

query("udtf_text")(lambda v: chunking.chunks(v.documents, "doc_id", "text").select("doc_id", "at", "chunk"))
query("udtf_markdown")(lambda v: chunking.chunks(v.documents, "doc_id", "text", markdown=True))
query("udtf_document")(lambda v: chunking.chunks(chunking.page_texts(v.pages), "page_id", "text").select(F.concat_ws("-", F.lit("page"), F.col("page_id").cast("string"), F.col("at").cast("string")).alias("id"), F.col("chunk").alias("content"), F.col("heading").alias("summary")))
query("src_docfile")(lambda v: chunking.page_texts(v.pages))
query("src_json", "", "SELECT text AS query, 2 AS n, CAST(item_id AS VARCHAR) AS first FROM benchmark")(lambda v: _cases(v))
query("win_batches")(lambda v: selection.batched(v.documents.select(F.col("source"), F.col("doc_id").alias("id"), s.estimated_tokens(F.col("text")).alias("tokens")), "source", 4096))
query("win_overlap")(lambda v: chunking.chunks(v.documents, "doc_id", "text", most_tokens=128, overlap_tokens=16).select("doc_id", "at", "chunk"))
query("job_cluster")(lambda v: selection.clustered(v.memory_embeddings.select("label", F.col("memory_id").alias("id"), "embedding"), "label", threshold=0.3))
query("job_consolidate")(lambda v: _consolidated(v))
query("job_embed", "", "SELECT conv_id, turn, 64 AS dims, EXISTS (SELECT 1 FROM conversations o WHERE o.turn = 0 AND coalesce(o.text, '') = coalesce(c.text, '')) AS cached FROM conversations c")(lambda v: _embedded(v))
query("job_backfill_embed", "memories", "SELECT id, 64 AS dims FROM memories WHERE deleted_at IS NULL")(lambda v: _backfilled(v))
query("job_extract", "conversation_memories", r"SELECT id, name FROM (SELECT id, unnest(list_distinct(regexp_extract_all(content, '\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+)*'))) AS name FROM conversation_memories)")(lambda v: _extracted(v).select("id", "name"))
query("job_extract_resolve")(lambda v: extraction.resolved(_extracted(v), v.entities))
query("job_extract_batch")(lambda v: selection.batched(v.conversation_memories.select("context_id", "id", s.estimated_tokens(F.col("content")).alias("tokens")), "context_id", 1024))
query("job_reflect")(lambda v: _reflected(v))
query("fn_synonym")(lambda v: hooks.expanded(v.benchmark.select("item_id", F.split("text", r"\s+").alias("words")), hooks.Synonyms([("data", "records", "rows"), ("fast", "quick", "rapid")])).select("item_id", F.array_join("words", " ").alias("expanded")))
query("fn_tok_noop", "memories", "SELECT id, content AS tokens FROM memories")(lambda v: v.memories.select("id", F.col("content").alias("tokens")))


def _consolidated(v):
    vectors = v.memory_embeddings.select("label", F.col("memory_id").alias("id"), "embedding")
    found = selection.clustered(vectors.join(v.memories.filter(live()).select("id"), "id", "left_semi"), "label", threshold=0.3)
    after, _ = snapshots.consolidated(v.memories, found, NOW)
    return after.select("id", s.content_hash(F.col("content")).alias("content_hash"), "consolidated_into", F.col("deleted_at").isNotNull().alias("gone"), "retention_tier", "kind", "scope", F.round("strength", 6).alias("strength"))


def _embedded(v):
    """A run over the first turns, then one over all: what the first has made comes from the cache."""
    cache, rows = f"{shared_dir(v.spark)}/embeddings-{uuid.uuid4().hex}", v.conversations.select("conv_id", "turn", F.col("text").alias("content"))
    bulk.embedded_once(rows.filter("turn = 0"), cache, "hashed", hooks.hashed_vector)
    return bulk.embedded_once(rows, cache, "hashed", hooks.hashed_vector).select("conv_id", "turn", F.size("embedding").alias("dims"), "cached")


def _backfilled(v):
    """Vectors of all live memories in two runs, the first of which ends after three batches."""
    path = f"{shared_dir(v.spark)}/backfill-{uuid.uuid4().hex}"
    rows, work = v.memories.filter(live()).select("id", "content"), lambda part: hooks.embedded(part).select("id", F.size("embedding").alias("dims"))
    bulk.resumed(rows, path, work, most=3)
    return bulk.resumed(rows, path, work).select("id", "dims")


def _model(messages):
    """Stands in for a model: capitalised words are concepts; the answer is whole, fenced or in a sentence, by its length, or comes at the second call."""
    import json

    import regex

    names = list(dict.fromkeys(regex.findall(r"\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+)*", messages[0])))
    answer = json.dumps({"entities": [{"name": n, "entity_type": " Concept "} for n in names], "relations": []})
    if len(messages) == 1 and len(messages[0]) % 4 == 3:
        return "I can't say."
    return (answer, f"```json\n{answer}\n```", f"Here it is: {answer} {{}}", answer)[len(messages[0]) % 4]


def _extracted(v):
    """What the model finds in every text of conversations, in any script."""
    read = extraction.read_texts(v.conversation_memories.select("id", "content"), _model, most=0)
    return read.select("id", F.lit("global").alias("scope"), F.explode("entities").alias("e")).select("id", "scope", "e.name", "e.entity_type")


def _reflected(v):
    """All questions of benchmark; the reasoner stands in for a model."""

    def retrieve(texts, limit):
        found = pl.fts(store(v), pl.Queries(texts), limit)
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("nth", nth).join(v.memories.select("id", F.col("excerpt").alias("text")), "id").select("query_id", "text", "score", "nth")

    def reason(question, rows):
        return (f"{len(rows)} rows", None) if len(question) < 40 else (None, question[: len(question) // 2])

    return hooks.reflected(asked(v).text, retrieve, reason).select("query_id", "conclusion", F.array_join("asked", "\n").alias("asked"), F.size("asked").alias("rounds"))


def _cases(v):
    """Evaluation cases written as lines of JSON and read back."""
    path = f"{shared_dir(v.spark)}/cases-{uuid.uuid4().hex}"
    v.benchmark.select(F.col("text").alias("query"), F.array(F.col("item_id").cast("string"), F.col("text")).alias("expected")).write.json(path)
    return json_cases(v.spark, path).select("query", F.size("expected").alias("n"), F.element_at("expected", 1).alias("first"))
