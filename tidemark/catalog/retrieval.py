"""Registered full-text, vector and fusion operators, routing and pipelines."""

from __future__ import annotations

import dataclasses
import re
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.catalog.reads import _VISIBLE, WHO
from tidemark.catalog.scalars import DIRECT, STRENGTH, STRUCTURAL
from tidemark.functions import scalars as s
from tidemark.operators import fulltext, graphs, predicates, relations, segmentation, selection, vectorindex, vectorsearch
from tidemark.operators.segments import SegmentedIndex
from tidemark.plans import pipelines as pl
from tidemark.plans import routing
from tidemark.registry import query
from tidemark.session import fingerprint, shared_dir, small, written
from tidemark.sources.views import NOW, Views

_STOP = ", ".join(f"'{w}'" for w in sorted(fulltext.STOP_WORDS))
_READ = f"deleted_at IS NULL AND {_VISIBLE}"
# common table expressions that the oracles build on, each after those it uses
CTE = {
    "q": "SELECT item_id AS query_id, text FROM benchmark",
    "asked_words": r"""SELECT query_id, list_filter(string_split_regex(translate(text, '-+"*()^', '  '), '\s+'), lambda w: w <> '') AS w FROM q""",
    "asked_kept": f"SELECT query_id, w, list_filter(w, lambda x: lower(x) NOT IN ({_STOP}) AND NOT (length(x) = 1 AND ascii(x) < 128)) AS k FROM asked_words",
    "asked_parts": "SELECT query_id, len(k) = 0 AS every, unnest(CASE WHEN len(k) = 0 THEN w ELSE list_slice(list_concat(k, CASE WHEN len(k) > 2 THEN list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]) ELSE [] END), 1, 12) END) AS part FROM asked_kept",
    "asked_tokens": r"SELECT query_id, every, regexp_extract_all(lower(part), '[\p{L}\p{N}]+') AS t FROM asked_parts",
    "asked_phrases": "SELECT *, CASE WHEN every THEN count(*) OVER (PARTITION BY query_id) ELSE 1 END AS need FROM (SELECT query_id, array_to_string(t, ' ') AS phrase, len(t) AS size, count(*) AS times, bool_or(every) AS every FROM asked_tokens WHERE len(t) > 0 GROUP BY 1, 2, 3)",
    "wanted": "SELECT phrase, size, generate_subscripts(t, 1) AS i, unnest(t) AS term FROM (SELECT DISTINCT phrase, size, string_split(phrase, ' ') AS t FROM asked_phrases)",
    "words": r"SELECT id, col, w, generate_subscripts(t, 1) AS pos, unnest(t) AS term FROM (SELECT id, 'content' AS col, 10.0 AS w, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS t FROM memories UNION ALL SELECT id, 'excerpt', 5.0, regexp_extract_all(lower(excerpt), '[\p{L}\p{N}]+') FROM memories)",
    "lens": "SELECT m.id, CAST(coalesce(x.n, 0) AS DOUBLE) AS length FROM memories m LEFT JOIN (SELECT id, count(*) AS n FROM words GROUP BY id) x ON x.id = m.id",
    "hits": "SELECT phrase, id, w, pos - i AS at FROM words JOIN wanted USING (term) GROUP BY phrase, size, id, col, w, pos - i HAVING count(*) = size",
    "tfs": "SELECT phrase, id, CAST(sum(w) AS DOUBLE) AS tf FROM hits GROUP BY phrase, id",
    "dfs": "SELECT phrase, count(*) AS df FROM tfs GROUP BY phrase",
    "ranks": "SELECT query_id, t.id, round(sum(times * greatest(ln(((SELECT count(*) FROM lens) - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT avg(length) FROM lens)))), 9) AS bm25 FROM asked_phrases q JOIN tfs t ON t.phrase = q.phrase JOIN dfs d ON d.phrase = q.phrase JOIN lens l ON l.id = t.id GROUP BY query_id, t.id HAVING count(*) >= max(need)",
    "top": "SELECT query_id, id, bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS nth FROM ranks) WHERE nth <= 300",
    "fts": rf"SELECT query_id, id, bm25 * (0.7 + 0.3 * share) AS score, bm25, nth FROM (SELECT t.query_id, t.id, t.bm25, (SELECT count(*) FROM (SELECT DISTINCT unnest(string_split_regex(lower(q.text), '\s+')) AS w) WHERE w <> '' AND contains(lower(m.content || ' ' || m.excerpt), w)) / greatest((SELECT count(*) FROM (SELECT DISTINCT unnest(string_split_regex(lower(q.text), '\s+')) AS w) WHERE w <> ''), 1) AS share, row_number() OVER (PARTITION BY t.query_id ORDER BY t.bm25 DESC, t.id) AS nth FROM top t JOIN memories m ON m.id = t.id JOIN q ON q.query_id = t.query_id WHERE {_READ}) WHERE nth <= 30",
    "qv": "SELECT CAST(vec_id // 50 AS BIGINT) AS query_id, CAST(embedding AS DOUBLE[]) AS query FROM embeddings WHERE vec_id % 50 = 0",
    "vec": f"SELECT query_id, id, score, nth FROM (SELECT query_id, m.id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), query) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), query) DESC, m.id) AS nth FROM memory_embeddings e JOIN memories m ON m.id = e.memory_id CROSS JOIN qv WHERE {_READ} AND list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), query) >= 0.3) WHERE nth <= 30",
    "seeds": "SELECT query_id, 'nation-' || CAST(query_id AS STRING) AS entity_id FROM q",
    "edges": "SELECT source_id AS a, target_id AS b FROM entity_relations UNION SELECT target_id, source_id FROM entity_relations",
    "d1": "SELECT DISTINCT query_id, b AS entity_id FROM seeds JOIN edges ON a = entity_id",
    "d2": "SELECT DISTINCT query_id, b AS entity_id FROM d1 JOIN edges ON a = entity_id",
    "d3": "SELECT DISTINCT query_id, b AS entity_id FROM d2 JOIN edges ON a = entity_id",
    "visited": "SELECT query_id, entity_id, min(depth) AS depth FROM (SELECT query_id, entity_id, 0 AS depth FROM seeds UNION ALL SELECT query_id, entity_id, 1 FROM d1 UNION ALL SELECT query_id, entity_id, 2 FROM d2) GROUP BY 1, 2",
    "visited3": "SELECT query_id, entity_id, min(depth) AS depth FROM (SELECT query_id, entity_id, depth FROM visited UNION ALL SELECT query_id, entity_id, 3 FROM d3) GROUP BY 1, 2",
    "owned": f"SELECT entity_id, id FROM (SELECT l.entity_id, m.id, row_number() OVER (PARTITION BY l.entity_id ORDER BY m.updated_at DESC, m.id) AS nth FROM (SELECT DISTINCT entity_id, memory_id FROM memory_entities) l JOIN memories m ON m.id = l.memory_id WHERE {_READ}) WHERE nth <= 10",
}
for _name in ("words", "lens", "hits", "tfs", "dfs", "ranks"):  # of the rows that aren't deleted
    _live = re.sub(r"\b(FROM|JOIN) (words|lens|hits|tfs|dfs)\b", r"\1 \2_live", CTE[_name])
    CTE[f"{_name}_live"] = re.sub(r"\bFROM memories\b", "FROM (SELECT * FROM memories WHERE deleted_at IS NULL)", _live)
_AGED = f"exp(-0.01 * greatest(date_diff('microsecond', m.created_at, TIMESTAMP '{NOW}') / 86400000000.0, 0)) / (depth + 1)"
for _name, _from in (("graph", "visited"), ("graph3", "visited3"), ("graph1", "(SELECT * FROM visited WHERE depth <= 1)")):
    CTE[_name] = f"SELECT query_id, g.id, depth, {_AGED} AS score FROM (SELECT query_id, id, depth, row_number() OVER (PARTITION BY query_id ORDER BY depth, id) AS nth FROM (SELECT query_id, id, min(depth) AS depth FROM owned JOIN {_from} x USING (entity_id) GROUP BY 1, 2)) g JOIN memories m ON m.id = g.id WHERE nth <= 30"
CTE["times"] = "SELECT query_id, TIMESTAMP '2024-01-15 00:00:00' AS center, 7 AS range_days FROM q"
_TIME = "coalesce(happened_at, created_at)"
CTE["temporal"] = f"SELECT query_id, id, score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM (SELECT query_id, id, CASE WHEN days <= 7 THEN 1.0::DOUBLE ELSE 1 / (1 + days / 7) END AS score, nth FROM (SELECT query_id, id, abs(date_diff('microsecond', {_TIME}, center)) / 86400000000.0 AS days, row_number() OVER (PARTITION BY query_id ORDER BY {_TIME} DESC, id) AS nth FROM memories CROSS JOIN times WHERE {_READ} AND abs(date_diff('microsecond', {_TIME}, center)) <= 21 * 86400000000)) WHERE nth <= 60) WHERE place <= 30"
CTE["weights"] = f"SELECT id, {STRUCTURAL} AS weight FROM memories WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{NOW}'"
CTE["hops"] = "SELECT query_id, id, max(CASE depth WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END)::DOUBLE AS graph_score FROM (SELECT entity_id, memory_id AS id FROM memory_entities) l JOIN visited USING (entity_id) GROUP BY 1, 2"
_DOC = r"trim(regexp_replace(lower(concat_ws(' ', m.content, m.excerpt, m.summary)), '[^\p{L}\p{N}]+', ' ', 'g'))"
_ASK = r"trim(regexp_replace(lower(q.text), '[^\p{L}\p{N}]+', ' ', 'g'))"


def merge_sql(channels: list[str], aware: bool) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, id, score, '{c.rstrip('13')}' AS source FROM {c}" for c in channels)
    trust = "CASE WHEN bool_or(source = 'graph') AND count(DISTINCT source) > 1 THEN 1.5 WHEN bool_or(source IN ('graph', 'vec')) THEN 1.0 ELSE 0.8 END" if aware else "1.0"
    return f"SELECT query_id, id, sum(weight / (60 + nth)) * {trust} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS nth FROM ({union})) JOIN weights USING (id) GROUP BY 1, 2"


def ratio_sql(source: str, ratio: float) -> str:
    return f"SELECT query_id, id, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM ({source})) WHERE best <= 0 OR score >= best * {ratio}"


def overlap_sql(source: str) -> str:
    words = f"list_distinct(string_split({_ASK}, ' '))"
    external = f"CASE WHEN {_DOC} = '' THEN 0 ELSE CASE WHEN contains({_DOC}, {_ASK}) THEN 0.35 ELSE 0 END + 0.65 * len(list_filter({words}, lambda w: contains({_DOC}, w))) / len({words}) END"
    placed = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM ({source})"
    head = f"SELECT c.query_id, c.id, c.score, {external} AS ext FROM ({placed}) c JOIN memories m ON m.id = c.id JOIN q ON q.query_id = c.query_id WHERE place <= 20"
    return f"SELECT query_id, id, 0.3 * score / CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN max(score) OVER (PARTITION BY query_id) ELSE 1 END + 0.7 * ext AS score FROM ({head}) UNION ALL SELECT query_id, id, score FROM ({placed}) WHERE place > 20"


def nearness_sql(source: str) -> str:
    return f"SELECT query_id, id, 0.4 * score / CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN max(score) OVER (PARTITION BY query_id) ELSE 1 END + 0.6 * graph_score AS score FROM ({source}) JOIN hops USING (query_id, id) WHERE graph_score >= 0.2"


def _oracle(sql: str) -> str:
    """The views and the CTEs that sql needs, put in front of it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTE.items():
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(body)
                if name not in need:
                    need.append(name)

    visit(sql)
    from tidemark.sources.views import VIEWS

    every = " ".join([sql, *(CTE[n] for n in need)])
    views = [v for v in VIEWS if re.search(rf"\b{v}\b", every)]
    parts = [f"{v} AS ({VIEWS[v]})" for v in views] + [f"{n} AS ({CTE[n]})" for n in need]
    return "WITH " + ", ".join(parts) + " " + sql


def register(key: str, sql: str | None = None):
    return query(key, "", _oracle(sql) if sql else None)


def store(v: Views) -> pl.Store:
    vectors = v.memory_embeddings.select(F.col("memory_id").alias("id"), "embedding")
    return pl.Store(v.memories, vectors, v.memory_entities.select("memory_id", "entity_id"), v.entity_relations.select("source_id", "target_id"), NOW, WHO, index=lambda: text_index(v))


_indexes: dict[tuple[str, str], tuple[tuple, SegmentedIndex]] = {}


def text_index(v: Views) -> fulltext.Index:
    """The written full-text index of the folder's memories: made once for an application, as a store keeps one, and again when the table's files have changed."""
    key, now = (v.spark.sparkContext.applicationId, v.sf_dir), fingerprint(v.documents)
    if key not in _indexes or _indexes[key][0] != now:
        index = SegmentedIndex(v.spark, f"{shared_dir(v.spark)}/fulltext-{uuid.uuid4().hex}")
        index.add(v.memories)
        _indexes[key] = now, index
    return _indexes[key][1].index()


def _changed_index(v: Views, restored: bool = False, merged: bool = False) -> SegmentedIndex:
    """An index of memories made in two batches, from which those that are marked as deleted are taken, and put back if restored."""
    index = SegmentedIndex(v.spark, f"{shared_dir(v.spark)}/fulltext-{uuid.uuid4().hex}")
    late = F.col("created_at") >= "2023-09-01"
    index.add(v.memories.filter(~late))
    index.add(v.memories.filter(late))
    index.delete(v.memories.filter("deleted_at IS NOT NULL"))
    if restored:
        index.add(v.memories.filter("deleted_at IS NOT NULL"))
    if merged:
        index.merge()
    return index


def _index_ranks(v: Views, index: SegmentedIndex) -> DataFrame:
    return fulltext.bm25(v.memories, fulltext.query_parts(asked(v).text), index=index.index()).select("query_id", "id", F.round("bm25", 3).alias("bm25"))


def _indexed_words(v: Views) -> DataFrame:
    found = _changed_index(v, merged=True).index().postings.filter("column = 'content'")
    return found.groupBy("id").agg(F.count("*").alias("n")).join(v.memories.select("id", "kind"), "id").groupBy("kind").agg(F.sum("n").alias("words"))


def asked(v: Views, times: bool = False) -> pl.Queries:
    """All texts of benchmark, and the vectors whose id is divisible by 50, the k-th of them as that of text k."""
    text = v.benchmark.select(F.col("item_id").alias("query_id"), "text")
    vectors = v.embeddings.filter("vec_id % 50 = 0").select(F.expr("vec_id div 50").alias("query_id"), F.col("embedding").alias("query"))
    seeds = text.select("query_id", F.concat(F.lit("nation-"), F.col("query_id").cast("string")).alias("entity_id"))
    when = text.select("query_id", F.lit("2024-01-15 00:00:00").cast("timestamp").alias("center"), F.lit(7).alias("range_days")) if times else None
    return pl.Queries(text, vectors, seeds, when)


def _shown(df: DataFrame) -> DataFrame:
    """Scores in thousandths to seven digits: short decimals, as weights make them, then end on neither side of a rounding. From 1 on, to four."""
    return df.select("query_id", "id", F.when(F.col("score") >= 1, F.round(F.col("score") * 1000, 4)).otherwise(F.round(F.col("score") * 1000, 7)).alias("score"))


_SHOW = "SELECT query_id, id, CASE WHEN score >= 1 THEN round(score * 1000, 4) ELSE round(score * 1000, 7) END AS score FROM "

# full text
register("fts_postings", "SELECT term, count(DISTINCT id) AS docs, count(*) AS hits FROM words GROUP BY term")(lambda v: fulltext.postings(v.memories, {"content": 10.0, "excerpt": 5.0}).groupBy("term").agg(F.count_distinct("id").alias("docs"), F.count("*").alias("hits")))
register("fts_bm25", "SELECT query_id, id, round(bm25, 6) AS bm25 FROM ranks")(lambda v: fulltext.bm25(v.memories, fulltext.query_parts(asked(v).text), index=text_index(v)).select("query_id", "id", F.round("bm25", 6).alias("bm25")))
register("fts_phrase", "SELECT phrase, count(*) AS hits FROM (SELECT term || ' ' || lead(term) OVER (PARTITION BY id, col ORDER BY pos) AS phrase FROM words WHERE col = 'content') WHERE phrase IN ('of the', 'de la', 'in the') GROUP BY phrase")(lambda v: fulltext.phrases(fulltext.postings(v.memories, {"content": 10.0})).filter(F.col("term").isin("of the", "de la", "in the")).groupBy(F.col("term").alias("phrase")).agg(F.count("*").alias("hits")))
register("fts_hybrid", f"{_SHOW} fts")(lambda v: _shown(fulltext.search(v.memories, asked(v).text, 30, store(v).readable(), index=text_index(v))))
register("src_fts", "SELECT query_id, id, nth FROM fts")(lambda v: fulltext.search(v.memories, asked(v).text, 30, store(v).readable(), index=text_index(v)).select("query_id", "id", F.col("nth").cast("long").alias("nth")))
register("src_fts_filtered", f"SELECT query_id, id FROM (SELECT t.query_id, t.id, row_number() OVER (PARTITION BY t.query_id ORDER BY t.bm25 DESC, t.id) AS nth FROM top t JOIN memories m ON m.id = t.id WHERE {_READ} AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}') AND strength >= 0.2) WHERE nth <= 30")(lambda v: fulltext.search(v.memories, asked(v).text, 30, store(v).readable() & predicates.search_filters(NOW, min_strength=0.2), index=text_index(v)).select("query_id", "id"))
register("jn_fts_row", "SELECT t.query_id, t.id, m.kind FROM top t JOIN memories m ON m.id = t.id WHERE deleted_at IS NULL")(lambda v: _fts_rows(v))
register("fn_fts_query", "SELECT query_id, phrase, times, CAST(need AS BIGINT) AS need FROM asked_phrases")(lambda v: fulltext.query_parts(asked(v).text).withColumn("need", F.col("need").cast("long")))
query("snk_fts_rebuild", "memories", r"SELECT kind, count(*) AS words FROM (SELECT kind, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) FROM memories WHERE deleted_at IS NULL) GROUP BY kind")(_indexed_words)
register("snk_fts_delete", "SELECT query_id, id, round(bm25, 3) AS bm25 FROM ranks_live")(lambda v: _index_ranks(v, _changed_index(v)))
register("snk_fts_restore", "SELECT query_id, id, round(bm25, 3) AS bm25 FROM ranks")(lambda v: _index_ranks(v, _changed_index(v, restored=True)))
query("fn_tok_gse")(lambda v: _segmented(v))

# vectors
register("src_vec", f"{_SHOW} vec")(lambda v: _shown(pl.vector(store(v), asked(v))))
register("src_vec_filtered", f"SELECT query_id, id FROM (SELECT query_id, m.id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), query) DESC, m.id) AS nth FROM memory_embeddings e JOIN memories m ON m.id = e.memory_id CROSS JOIN qv WHERE {_READ} AND scope = 'project/p1') WHERE nth <= 10")(lambda v: vectorsearch.search(store(v).vectors.join(v.memories.filter(store(v).readable() & (F.col("scope") == "project/p1")).select("id"), "id", "left_semi"), asked(v).vectors, 10).select("query_id", "id"))
register("top_vec", "SELECT query_id, id, nth FROM (SELECT query_id, memory_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), query) DESC, memory_id) AS nth FROM memory_embeddings CROSS JOIN qv) WHERE nth <= 10")(lambda v: vectorsearch.search(store(v).vectors, asked(v).vectors, 10).select("query_id", "id", F.col("nth").cast("long").alias("nth")))
register("top_vec_probed", "SELECT query_id, id, nth FROM (SELECT query_id, memory_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), query) DESC, memory_id) AS nth FROM memory_embeddings CROSS JOIN qv) WHERE nth <= 10")(lambda v: _vector_index(v).search(asked(v).vectors, 10).select("query_id", "id", F.col("nth").cast("long").alias("nth")))
query("top_vec_approx")(lambda v: _vector_index(v).search(asked(v).vectors, 10, _probes(v)).select("query_id", "id", F.col("nth").cast("long").alias("nth")))
query("top_vec_compared")(lambda v: _vector_index(v).compared(asked(v).vectors, _probes(v)))
register("flt_min_score", "SELECT query_id, id FROM vec")(lambda v: pl.vector(store(v), asked(v)).select("query_id", "id"))
register("snk_centroid", "SELECT entity_id, n, round(list_sum(centroid), 5) AS total FROM (SELECT entity_id, max(n) AS n, list(value) AS centroid FROM (SELECT l.entity_id, i, avg(CAST(e.embedding[i] AS DOUBLE)) AS value, count(*) AS n FROM memory_entities l JOIN memory_embeddings e ON e.memory_id = l.memory_id CROSS JOIN range(1, 65) r(i) WHERE l.role = 'mentioned' GROUP BY 1, 2) GROUP BY 1)")(lambda v: vectorsearch.centroids(v.memory_embeddings.select("memory_id", "embedding"), v.memory_entities.filter("role = 'mentioned'").select("memory_id", "entity_id")).select("entity_id", "n", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, b: a + b), 5).alias("total")))
register("src_centroid", "SELECT query_id, entity_id FROM (SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, entity_id) AS nth FROM (SELECT query_id, entity_id, list_cosine_similarity(centroid, query) AS cos FROM (SELECT entity_id, list(value ORDER BY i) AS centroid FROM (SELECT l.entity_id, i, avg(CAST(e.embedding[i] AS DOUBLE)) AS value FROM memory_entities l JOIN memory_embeddings e ON e.memory_id = l.memory_id CROSS JOIN range(1, 65) r(i) WHERE l.role = 'mentioned' GROUP BY 1, 2) GROUP BY 1) CROSS JOIN qv) WHERE cos >= 0.2) WHERE nth <= 10")(lambda v: vectorsearch.search(vectorsearch.centroids(v.memory_embeddings.select("memory_id", "embedding"), v.memory_entities.filter("role = 'mentioned'").select("memory_id", "entity_id")).select(F.col("entity_id").alias("id"), F.col("centroid").alias("embedding")), asked(v).vectors, 10, 0.2).select("query_id", F.col("id").alias("entity_id")))

# stages
register("stg_fts", f"{_SHOW} fts")(lambda v: _shown(pl.fts(store(v), asked(v))))
register("stg_vector", f"{_SHOW} vec")(lambda v: _shown(pl.vector(store(v), asked(v))))
register("stg_graph", f"{_SHOW} graph")(lambda v: _shown(pl.graph(store(v), asked(v))))
register("stg_temporal", f"{_SHOW} temporal")(lambda v: _shown(pl.temporal(store(v), asked(v, times=True))))
_EXHAUSTIVE = f"SELECT query_id, id, 1.0::DOUBLE AS score FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY t, id) AS nth FROM (SELECT DISTINCT s.query_id, m.id, {_TIME} AS t FROM seeds s JOIN memory_entities l ON l.entity_id = s.entity_id JOIN memories m ON m.id = l.memory_id WHERE {_READ} AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}'))) WHERE nth <= 200"
_BARE = f"SELECT query_id, id, 1.0::DOUBLE AS score FROM (SELECT id FROM memories WHERE {_READ} AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}') ORDER BY {_TIME} DESC, id LIMIT 200) CROSS JOIN (SELECT query_id FROM q WHERE query_id NOT IN (SELECT query_id FROM ({_EXHAUSTIVE})))"
register("stg_exhaustive", f"{_SHOW} ({_EXHAUSTIVE} UNION ALL {_BARE})")(lambda v: _shown(pl.exhaustive(store(v), asked(v))))
_CORE = f"SELECT query_id, id, 2.0::DOUBLE AS score FROM (SELECT id, row_number() OVER (PARTITION BY scope ORDER BY reinforced_count DESC, created_at DESC, id) AS nth FROM memories WHERE {_READ} AND memory_class = 'core' AND scope IN ('project/p1', 'user/user_1')) CROSS JOIN q WHERE nth <= 5 AND (query_id, id) NOT IN (SELECT (query_id, id) FROM fts)"
register("stg_core", f"{_SHOW} ({_CORE} UNION ALL SELECT query_id, id, score FROM fts)")(lambda v: _shown(pl.with_core(store(v), asked(v), pl.fts(store(v), asked(v)), ("project/p1", "user/user_1"))))
register("stg_merge_rrf", f"{_SHOW} ({merge_sql(['vec', 'fts'], False)})")(lambda v: _shown(pl.merged(store(v), [pl.vector(store(v), asked(v)), pl.fts(store(v), asked(v))])))
register("stg_merge_graph", f"{_SHOW} ({merge_sql(['graph', 'fts', 'vec'], True)})")(lambda v: _shown(pl.merged(store(v), [pl.graph(store(v), asked(v)), pl.fts(store(v), asked(v)), pl.vector(store(v), asked(v))], graph_aware=True)))
register("stg_filter", f"{_SHOW} ({ratio_sql('SELECT query_id, id, score FROM fts', 0.5)})")(lambda v: _shown(pl.above(pl.fts(store(v), asked(v)), 0.5)))
register("flt_ratio", f"{_SHOW} ({ratio_sql('SELECT query_id, id, score FROM vec', 0.6)})")(lambda v: _shown(pl.above(pl.vector(store(v), asked(v)), 0.6)))
register("stg_rerank_overlap", f"{_SHOW} ({overlap_sql('SELECT query_id, id, score FROM fts')})")(lambda v: _shown(pl.by_overlap(store(v), asked(v), pl.fts(store(v), asked(v)))))
register("stg_rerank_graph", f"{_SHOW} ({nearness_sql('SELECT query_id, id, score FROM graph')})")(lambda v: _shown(pl.by_graph(store(v), asked(v), pl.graph(store(v), asked(v)))))
_LLM = "SELECT query_id, id, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN 0.3 * score / max(score) OVER (PARTITION BY query_id) ELSE 0.3 * score END + 0.7 * ext AS score FROM (SELECT f.query_id, f.id, f.score, m.strength AS ext FROM fts f JOIN memories m ON m.id = f.id WHERE m.strength >= 0.3)"
register("stg_rerank_llm", f"{_SHOW} ({_LLM})")(lambda v: _shown(pl.by_scorer(pl.fts(store(v), asked(v)), _strengths(v))))
register("stg_rerank_remote", f"{_SHOW} ({_LLM.replace(' WHERE m.strength >= 0.3', '')})")(lambda v: _shown(pl.by_scorer(pl.fts(store(v), asked(v)), _strengths(v), least=None)))
query("stg_mmr")(lambda v: selection.diverse(pl.vector(store(v), asked(v)), store(v).vectors))
register("stg_trim", f"SELECT query_id, id FROM (SELECT query_id, id, sum(tokens) OVER w AS total, row_number() OVER w AS nth FROM (SELECT f.query_id, f.id, f.score, (length(m.content) + 3) // 4 AS tokens FROM fts f JOIN memories m ON m.id = f.id) WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)) WHERE total <= 4096 OR nth = 1")(lambda v: pl.trimmed(store(v), pl.fts(store(v), asked(v))).select("query_id", "id"))
query("stg_disclosure")(lambda v: selection.disclosed(_sized(v)))
query("stg_breaker")(lambda v: _breaker(v))
register("agg_rrf", "SELECT query_id, id, round(sum(1.0 / (60 + nth)) * 1000, 7) AS score FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM fts UNION ALL SELECT query_id, id, nth FROM vec) GROUP BY 1, 2")(lambda v: _shown(relations.fused(pl.fts(store(v), asked(v)).unionByName(pl.vector(store(v), asked(v))), "query_id")))
register("leg_rrf", "SELECT query_id, id, round(sum(w / (60 + nth)) * 1000, 7) AS score FROM (SELECT query_id, id, 1.0 AS w, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM fts UNION ALL SELECT query_id, id, 0.8, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM graph) GROUP BY 1, 2")(lambda v: _shown(relations.fused(pl.fts(store(v), asked(v)).unionByName(pl.graph(store(v), asked(v))), "query_id", weight=F.when(F.col("source") == "fts", 1.0).otherwise(0.8))))
register("agg_trust", "SELECT query_id, id, CASE WHEN bool_or(source = 'graph') AND count(DISTINCT source) > 1 THEN 1.5 WHEN bool_or(source IN ('graph', 'vector')) THEN 1.0 ELSE 0.8 END::DOUBLE AS trust FROM (SELECT query_id, id, 'fts' AS source FROM fts UNION ALL SELECT query_id, id, 'graph' FROM graph UNION ALL SELECT query_id, id, 'vector' FROM vec) GROUP BY 1, 2")(lambda v: pl.fts(store(v), asked(v)).unionByName(pl.graph(store(v), asked(v))).unionByName(pl.vector(store(v), asked(v))).groupBy("query_id", "id").agg(relations.trust(F.collect_set("source")).alias("trust")))
register("agg_max_graph", "SELECT query_id, id, graph_score FROM hops JOIN (SELECT query_id, id FROM graph) USING (query_id, id)")(lambda v: graphs.hop_scores(store(v).links, store(v).relations, asked(v).seeds, pl.graph(store(v), asked(v))).filter("graph_score > 0"))
register("agg_neighbor_votes", "SELECT query_id, entity_id, count(*) AS votes FROM vec v JOIN memory_entities l ON l.memory_id = v.id WHERE nth <= 10 GROUP BY 1, 2 HAVING count(*) >= 2")(lambda v: relations.votes(vectorsearch.search(store(v).vectors.join(v.memories.filter(store(v).readable()).select("id"), "id", "left_semi"), asked(v).vectors, 10, 0.3).select("query_id", F.col("id").alias("memory_id")), v.memory_entities.select("memory_id", "entity_id")))
register("flt_evidence", "SELECT query_id, id FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM vec) WHERE score >= 0.35 OR nth = 1")(lambda v: pl.vector(store(v), asked(v)).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter("score >= 0.35 OR nth = 1").select("query_id", "id"))
register("prj_backfill", "SELECT query_id, id, kind FROM (SELECT v.query_id, m.id, m.kind FROM vec v JOIN memories m ON m.id = v.id)")(lambda v: pl.vector(store(v), asked(v)).join(v.memories.select("id", "kind"), "id").select("query_id", "id", "kind"))

# pipelines
register("pipe_fast", f"{_SHOW} ({ratio_sql('SELECT query_id, id, score FROM fts WHERE nth <= 10', 0.05)})")(lambda v: _shown(pl.PIPELINES["fast"].run(store(v), asked(v))))
register("pipe_semantic", f"{_SHOW} ({overlap_sql(ratio_sql(merge_sql(['vec', 'fts'], False), 0.3))})")(lambda v: _shown(pl.PIPELINES["semantic"].run(store(v), asked(v))))
register("pipe_exploration", f"{_SHOW} ({overlap_sql(ratio_sql(merge_sql(['graph', 'fts', 'temporal'], False), 0.05))})")(lambda v: _shown(pl.PIPELINES["exploration"].run(store(v), asked(v, times=True))))
register("pipe_precision", f"{_SHOW} ({nearness_sql(ratio_sql(merge_sql(['graph', 'fts'], True), 0.3))})")(lambda v: _shown(pl.PIPELINES["precision"].run(store(v), asked(v))))
register("pipe_association", f"{_SHOW} ({ratio_sql(nearness_sql('SELECT query_id, id, score FROM graph3'), 0.2)})")(lambda v: _shown(pl.PIPELINES["association"].run(store(v), asked(v))))
register("pipe_full", f"{_SHOW} ({overlap_sql(ratio_sql(merge_sql(['graph', 'fts', 'vec'], True), 0.3))})")(lambda v: _shown(pl.PIPELINES["full"].run(store(v), asked(v))))
register("pipe_aggregation", f"{_SHOW} ({_EXHAUSTIVE} UNION ALL {_BARE})")(lambda v: _shown(pl.PIPELINES["aggregation"].run(store(v), asked(v))))
query("pipe_exec")(lambda v: _shown(pl.execute(store(v), asked(v), "precision").found))
query("post_default")(lambda v: _shown(pl.post_processed(store(v), asked(v), pl.PIPELINES["semantic"].run(store(v), asked(v)), ("project/p1", "user/user_1"))))
_LEGACY = f"SELECT query_id, id, score * weight AS score FROM (SELECT query_id, id, sum(w / (60 + nth)) AS score FROM (SELECT query_id, id, 1.0 AS w, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM fts UNION ALL SELECT query_id, id, 1.0, nth FROM vec UNION ALL SELECT query_id, id, 0.8, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM graph1) GROUP BY 1, 2) JOIN (SELECT id, CAST({DIRECT} AS DOUBLE) * greatest({STRENGTH}, 0.05) AS weight FROM memories WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{NOW}') USING (id)"
register("leg_retrieve", f"{_SHOW} (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM ({_LEGACY})) WHERE nth <= 10")(lambda v: _shown(pl.direct(store(v), asked(v))))
query("leg_mmr")(lambda v: selection.diverse(pl.direct(store(v), asked(v), limit=30), store(v).vectors, 0.5, 5))
register("leg_experience", f"SELECT query_id, id, excerpt FROM (SELECT query_id, m.id, m.excerpt, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, m.id) AS nth FROM ({_LEGACY}) x JOIN memories m ON m.id = x.id WHERE memory_class = 'procedural') WHERE nth <= 3")(lambda v: pl.direct(store(v), asked(v), limit=3, memory_class="procedural").join(v.memories.select("id", "excerpt"), "id").select("query_id", "id", "excerpt"))
# a search with filters, and once more without the time range and with 0.6 of the strength
_STRICT, _WIDE = "happened_at >= TIMESTAMP '2024-01-10 00:00:00' AND strength >= 0.5", "strength >= 0.3"
for _kind, _condition in (("strict", _STRICT), ("wide", _WIDE)):
    for _name in ("fts", "vec", "owned"):
        CTE[f"{_name}_{_kind}"] = CTE[_name].replace(_READ, f"{_READ} AND {_condition}")
    CTE[f"graph1_{_kind}"] = CTE["graph1"].replace("FROM owned JOIN", f"FROM owned_{_kind} JOIN")
    _one = _LEGACY
    for _name in ("fts", "vec", "graph1"):
        _one = _one.replace(f"FROM {_name} ", f"FROM {_name}_{_kind} ").replace(f"FROM {_name})", f"FROM {_name}_{_kind})")
    CTE[_kind] = f"SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM ({_one})) WHERE nth <= 10"
CTE["better"] = "SELECT query_id FROM (SELECT query_id, max(score) AS one FROM strict GROUP BY 1) JOIN (SELECT query_id, max(score) AS two FROM wide GROUP BY 1) USING (query_id) WHERE one < 0.3 AND two > one"
register("leg_retry", f"{_SHOW} (SELECT query_id, id, score FROM strict WHERE query_id NOT IN (SELECT query_id FROM better) UNION ALL SELECT query_id, id, score FROM wide WHERE query_id IN (SELECT query_id FROM better))")(lambda v: _shown(pl.retried(*(pl.direct(dataclasses.replace(store(v), filters=F.expr(c)), asked(v)) for c in (_STRICT, _WIDE)))))
_DIRECT = f"SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM ({_LEGACY})) WHERE nth <= 10"
register("leg_rerank", f"{_SHOW} ({overlap_sql(_DIRECT)})")(lambda v: _shown(pl.reranked(store(v), asked(v))))

# routing
_QUESTIONS = "SELECT 'b-' || CAST(item_id AS STRING) AS question_id, text AS query FROM benchmark UNION ALL SELECT 'c-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING), text FROM conversations"
_INTENT = rf"CASE WHEN regexp_matches(query, '{routing.TEMPORAL}') THEN 'temporal' WHEN regexp_matches(query, '{routing.RELATIONAL}') THEN 'relational' WHEN length(query) > 0 AND length(query) <= CASE WHEN cjk > 0.5 THEN 8 ELSE 20 END AND NOT regexp_matches(query, '{routing.EXPLORATORY}') THEN 'keyword' WHEN length(query) > CASE WHEN cjk > 0.5 THEN 25 ELSE 35 END OR regexp_matches(query, '{routing.EXPLORATORY}') THEN 'semantic' ELSE 'general' END"
_CJKR = r"CASE WHEN length(query) = 0 THEN 0 ELSE len(regexp_extract_all(query, '[\x{4E00}-\x{9FFF}]')) / length(query) END"
_TOLD = f"SELECT question_id, query, {_INTENT} AS intent FROM (SELECT question_id, query, {_CJKR} AS cjk FROM ({_QUESTIONS}))"
_BY = " ".join(f"WHEN '{k}' THEN '{p}'" for k, p in routing.BY_INTENT.items())
_W = " ".join(f"WHEN '{k}' THEN '{w[0] * 1.0:.2f}/{w[1] * 1.0:.2f}/{w[2] * 0.8:.2f}'" for k, w in routing.CHANNELS.items())
query("rt_intent", "", f"SELECT question_id, intent FROM ({_TOLD})")(lambda v: _questions(v).select("question_id", routing.intent(F.col("query")).alias("intent")))
_RULES = f"CASE WHEN intent = 'general' AND length(query) > 0 AND length(query) < 5 THEN 'fast' WHEN regexp_matches(query, '{routing.HISTORY}') THEN 'aggregation' WHEN regexp_matches(query, '{routing.TEMPORAL}') THEN 'exploration' WHEN regexp_matches(query, '{routing.AGGREGATION}') THEN 'aggregation' WHEN regexp_matches(query, '{routing.RELATIONAL}') THEN 'association' WHEN intent <> 'general' THEN CASE intent {_BY} END WHEN length(query) > 0 AND length(query) < 5 THEN 'fast' ELSE 'exploration' END"
query("rt_rules", "", f"SELECT question_id, {_RULES} AS pipeline FROM ({_TOLD})")(lambda v: _questions(v).select("question_id", routing.route(F.col("query"), routing.intent(F.col("query"))).alias("pipeline")))
query("rt_weights", "", f"SELECT question_id, CASE intent {_W} END AS weights FROM ({_TOLD})")(lambda v: _questions(v).select("question_id", _weights_text(routing.channel_weights(routing.intent(F.col("query")))).alias("weights")))
# a model's answers stand in: the six names, one that it may not choose, one that is none, no object at all
_NAMES = ("precision", "exploration", "semantic", "association", "fast", "full", "aggregation", "other")
_ANSWERS = f"SELECT item_id, text AS query, CASE WHEN item_id % 9 = 8 THEN '' ELSE list_extract([{', '.join(repr(n) for n in _NAMES)}], CAST(item_id % 9 + 1 AS INT)) END AS named, {_CJKR} AS cjk FROM (SELECT *, text AS query FROM benchmark)"
query("rt_agent", "", f"SELECT item_id, CASE WHEN named IN ({', '.join(repr(n) for n in routing.SELECTABLE)}) THEN named ELSE {_RULES} END AS pipeline FROM (SELECT *, {_INTENT} AS intent FROM ({_ANSWERS}))")(lambda v: _routed(v))
_WIN = " ".join(f"WHEN regexp_matches(query, '{p}') THEN {d * 1000 + o}" for p, d, o in routing.WINDOWS)
query("fn_time_window", "", f"SELECT question_id, CAST(CASE {_WIN} ELSE 30000 END AS INT) AS packed FROM ({_QUESTIONS})")(lambda v: _questions(v).select("question_id", (routing.window_days(F.col("query"))["days"] * 1000 + routing.window_days(F.col("query"))["offset"]).cast("int").alias("packed")))
_KEYWORDS = rf"SELECT question_id, intent, query, list_filter(regexp_extract_all(query, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w) NOT IN ({_STOP})) AS k FROM ({_TOLD})"
_NAMED = "SELECT question_id, list(id ORDER BY place, id) AS found FROM (SELECT question_id, id, min(place) AS place FROM (SELECT question_id, generate_subscripts(k, 1) AS place, lower(unnest(k)) AS word FROM asked_now) a JOIN (SELECT id, lower(name) AS name, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS nth FROM entities WHERE scope = 'global') e ON e.name = a.word WHERE nth <= 5 GROUP BY 1, 2) GROUP BY 1"
_PLAN = f"SELECT question_id, intent, {_RULES} AS pipeline, array_to_string(k, ' ') AS keywords, coalesce(array_to_string(found, ' '), '') AS entities, CASE WHEN intent = 'temporal' THEN CAST(CASE {_WIN} ELSE 30000 END AS INT) END AS packed, CASE intent {_W} END AS weights FROM asked_now LEFT JOIN named_now USING (question_id)"
CTE |= {"asked_now": _KEYWORDS, "named_now": _NAMED}
register("rt_preprocess", _PLAN)(lambda v: _planned(v))

# evaluation: a hit is a neighbour with the query's label, itself left out
_RANKS = "SELECT query_id, label, min(nth) FILTER (WHERE hit) AS rank FROM (SELECT a.vec_id AS query_id, a.label, b.label = a.label AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) DESC, b.vec_id) AS nth FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE nth <= 10 GROUP BY 1, 2"
_IR = "count(*) AS total, round(avg(CASE WHEN rank IS NOT NULL THEN 100.0 ELSE 0 END), 6) AS hit_rate, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 / rank ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_5, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_10, " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END), 6) AS recall_{k}" for k in (1, 3, 5, 10))
query("agg_ir", "", f"SELECT label, {_IR} FROM ({_RANKS}) GROUP BY label")(lambda v: _rounded(relations.quality(_hits(v), "label")))
query("job_eval", "", f"SELECT 'all' AS run, {_IR} FROM ({_RANKS})")(lambda v: _rounded(relations.quality(_hits(v).withColumn("run", F.lit("all")), "run")))
# the baseline is the saved report of the exact search; the run held against it searches codes of a bit an element
_CODES = "(SELECT vec_id, label, CAST(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 WHEN x <= 0 THEN -1 END) AS DOUBLE[]) AS embedding FROM embeddings)"
_CODED_RANKS = re.sub(r"\b(FROM|JOIN) embeddings\b", rf"\1 {_CODES}", _RANKS)
_REPORT = "SELECT label, avg(CASE WHEN rank IS NOT NULL THEN 100.0 ELSE 0 END) AS hit_rate, avg(CASE WHEN rank IS NOT NULL THEN 1.0 / rank ELSE 0 END) AS mrr, avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS ndcg_10 FROM (SELECT unnest(['all', CAST(label AS VARCHAR)]) AS label, rank FROM ({})) GROUP BY label"
_FALLS = " UNION ALL ".join(f"SELECT n.label, '{m}' AS metric, b.{m} AS baseline, n.{m} AS current, {a} AS allowed FROM now_report n JOIN before_report b ON n.label IS NOT DISTINCT FROM b.label" for m, a in relations.ALLOWED.items())
_GATE = f"WITH before_report AS ({_REPORT.format(_RANKS)}), now_report AS ({_REPORT.format(_CODED_RANKS)}) SELECT label, metric, round(baseline, 6) AS baseline, round(current, 6) AS current, round(baseline - current, 6) AS drop FROM ({_FALLS}) WHERE round(baseline - current, 9) > allowed"
query("agg_regression", "", _GATE)(lambda v: _rounded(relations.regressions(_report(v, s.signs), written(_report(v), "baseline"), "label")))


def _vector_index(v: Views) -> vectorindex.VectorIndex:
    return vectorindex.VectorIndex.build(v.memory_embeddings.select(F.col("memory_id").alias("id"), "embedding"))


def _probes(v: Views) -> int:
    """Two thirds of the lists: these tables' vectors are hardly clustered, so that their neighbours lie in many."""
    return max(1, min(vectorindex.LISTS, int(v.memory_embeddings.count() ** 0.5)) * 2 // 3)


def _segmented(v: Views) -> DataFrame:
    """Every text of conversations in words that benchmark's texts use: run-together ones are cut by its words and their counts."""
    known = v.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-öø-ÿ]{2,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    return segmentation.segmenter(known, "a-zà-öø-ÿ")(v.conversations.select("conv_id", "turn", "text"), "text", "words").select("conv_id", "turn", F.array_join("words", " ").alias("words"))


def _hits(v: Views, coded=lambda vector: vector) -> DataFrame:
    """The queries' labels and the ranks of their first hits, by vectors as coded gives them."""
    vectors = v.embeddings.select("vec_id", coded(F.col("embedding")).alias("embedding"))
    few = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = vectorsearch.search(vectors.select(F.col("vec_id").alias("id"), "embedding"), few, 11).filter("id <> query_id")
    place = near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("nth"))).filter("place <= 10")
    labels = v.embeddings.select(F.col("vec_id").alias("id"), "label")
    own = labels.withColumnsRenamed({"id": "query_id", "label": "own"})
    return place.join(labels, "id").join(own, "query_id").groupBy("query_id", F.col("own").alias("label")).agg(F.min(F.when(F.col("label") == F.col("own"), F.col("place"))).alias("rank"))


def _report(v: Views, coded=lambda vector: vector) -> DataFrame:
    """The measures of all cases and of each label's."""
    cases = _hits(v, coded).select(F.explode(F.array(F.lit("all"), F.col("label").cast("string"))).alias("label"), "rank")
    return relations.quality(cases, "label")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _questions(v: Views) -> DataFrame:
    """All texts of benchmark and conversations as questions."""
    one = v.benchmark.select(F.concat(F.lit("b-"), F.col("item_id").cast("string")).alias("question_id"), F.col("text").alias("query"))
    return one.union(v.conversations.select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")), "text"))


def _planned(v: Views) -> DataFrame:
    plan = routing.planned(_questions(v).withColumnRenamed("query", "text"), v.entities, "global")
    packed = (F.col("days") * 1000 + F.col("offset")).cast("int").alias("packed")
    return plan.select("question_id", "intent", "pipeline", F.array_join("keywords", " ").alias("keywords"), F.array_join("entities", " ").alias("entities"), packed, _weights_text(F.col("weights")).alias("weights"))


def _routed(v: Views) -> DataFrame:
    named = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("item_id") % 9 + 1).cast("int"))
    answer = F.when(F.col("item_id") % 9 == 8, "no object").otherwise(F.to_json(F.struct(F.when(F.col("item_id") % 9 < 8, named).alias("pipeline"))))
    return v.benchmark.select("item_id", routing.chosen(answer, F.col("text"), routing.intent(F.col("text"))).alias("pipeline"))


def _weights_text(w):
    return F.format_string("%.2f/%.2f/%.2f", w["fts"], w["vector"], w["graph"])


def _strengths(v: Views):
    return lambda found: found.select("query_id", "id").join(v.memories.select("id", F.col("strength").alias("external")), "id")


def _fts_rows(v: Views) -> DataFrame:
    ranks = fulltext.bm25(v.memories, fulltext.query_parts(asked(v).text), index=text_index(v), most=300)
    return ranks.join(v.memories.filter("deleted_at IS NULL").select("id", "kind"), "id").select("query_id", "id", "kind")


def _sized(v: Views) -> DataFrame:
    size = lambda c: s.estimated_tokens(F.col(c)).cast("long")
    found = pl.graph(store(v), asked(v)).unionByName(pl.fts(store(v), asked(v))).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    found = small(found, "found")
    few = v.memories.join(found.select("id").distinct(), "id", "left_semi")  # sizes of their texts only
    sizes = few.select("id", size("content").alias("full"), size("summary").alias("summary"), size("excerpt").alias("excerpt"))
    return found.join(sizes, "id").select("query_id", "id", "score", "full", "summary", "excerpt")


def _breaker(v: Views) -> DataFrame:
    breaker, rows = pl.Breaker(clock=lambda: 0.0), []
    for step, ok in enumerate((False, False, False, True, True)):
        rows.append((step, breaker.allows()))
        breaker.told(ok)
    return v.spark.createDataFrame(rows, "step int, allowed boolean")
