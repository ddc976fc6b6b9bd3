"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard import similarity_classes

    return similarity_classes(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substrings import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import replace

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace(docs, "key of the registered query", count_col="n_replaced")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.merkle import verified_documents

    return verified_documents(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.trie import prefix_trie, rebuilt

    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_packing, op3_embedding_dedup, op4_nearest, op5_jaccard_join, op6_warc, op7_token_counts, op8_substrings, op9_pii, op10_toxicity, op11_merkle, op12_prefix_trie, op13_bpe)
}

#: Links by brute force within a label, components by the closure of links.
_OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 fine AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
 reached AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other),
 least AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
 degrees AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN least USING (vec_id) LEFT JOIN degrees USING (vec_id)
"""

#: Shingles of five words, or of all words of a shorter text; every pair that shares one is counted.
_OP5 = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 shingles AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[s : s + 4], ' ')) AS h FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(s) WHERE len(w) > 0),
 sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
 shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE shared.n / (x.n + y.n - shared.n) >= 0.8),
 reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other),
 least AS (SELECT doc_id, min(other) AS class_id FROM reached GROUP BY doc_id),
 degrees AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM documents JOIN least USING (doc_id) LEFT JOIN degrees USING (doc_id)
"""

#: Base 32 by pieces of 20 bits, four letters each.
_OP6 = """
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
 hashed AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS last FROM payloads)
SELECT page_id, payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM hashed
"""

#: Every window of 50 words, its first document, and the words that later ones cover.
_OP8 = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 windows AS (SELECT doc_id, s, md5_number(array_to_string(w[s : s + 49], ' ')) AS h FROM words, unnest(range(1, len(w) - 48)) AS t(s) WHERE len(w) >= 50),
 firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
 gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM windows JOIN firsts USING (h) WHERE first < doc_id),
 each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
 kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
"""



def _crc32(text: str) -> str:
    """CRC-32 of a text of ASCII letters: each letter's code, then eight shifts (-1), from a start of ones."""
    codes = f"flatten(list_transform(string_split({text}, ''), lambda c: list_prepend(CAST(ascii(c) AS BIGINT), list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))"
    step = "CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, x: {step}), CAST(4294967295 AS BIGINT))"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


#: Each language's tree and the one above, level by level; then every leaf walks up through both.
_OP11 = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered FROM documents),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
 tree AS (SELECT lang, 0 AS level, pos, n, leaf AS digest FROM ranked
  UNION ALL SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, level, pos // 8, n),
 runs AS (SELECT lang, level, pos // 8 AS run, list(digest ORDER BY pos) AS d FROM tree WHERE n > 1 GROUP BY ALL),
 tops AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
 above AS (SELECT 0 AS level, pos, n, subroot AS digest FROM tops
  UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY level, pos // 8, n),
 upper_runs AS (SELECT level, pos // 8 AS run, list(digest ORDER BY pos) AS d FROM above WHERE n > 1 GROUP BY ALL),
 walk AS (SELECT doc_id, lang, leaf, 0 AS level, pos, n, coalesce(tampered, leaf) AS node, '' AS sib FROM ranked
  UNION ALL SELECT doc_id, w.lang, leaf, w.level + 1, pos // 8, (n + 7) // 8,
   sha256(array_to_string(list_slice(d, 1, pos % 8), '') || node || array_to_string(list_slice(d, pos % 8 + 2, 8), '')),
   sib || array_to_string(list_slice(d, 1, pos % 8), '') || array_to_string(list_slice(d, pos % 8 + 2, 8), '')
   FROM walk w JOIN runs r ON r.lang IS NOT DISTINCT FROM w.lang AND r.level = w.level AND r.run = pos // 8 WHERE n > 1),
 climb AS (SELECT doc_id, leaf, subroot, 0 AS level, tops.pos, tops.n, node, sib FROM walk JOIN tops ON tops.lang IS NOT DISTINCT FROM walk.lang WHERE walk.n = 1
  UNION ALL SELECT doc_id, leaf, subroot, c.level + 1, pos // 8, (n + 7) // 8,
   sha256(array_to_string(list_slice(d, 1, pos % 8), '') || node || array_to_string(list_slice(d, pos % 8 + 2, 8), '')),
   sib || array_to_string(list_slice(d, 1, pos % 8), '') || array_to_string(list_slice(d, pos % 8 + 2, 8), '')
   FROM climb c JOIN upper_runs r ON r.level = c.level AND r.run = pos // 8 WHERE n > 1)
SELECT doc_id, leaf, subroot, a.digest AS root, sha256(sib) AS proof_sha256, node AS folded_root, node = a.digest AS verified FROM climb c JOIN above a ON a.n = 1 WHERE c.n = 1
"""

#: Prefixes by their texts, each with its members; subtrees by the prefixes of each node's smallest member.
_OP12 = f"""
WITH keyed AS (SELECT conv_id, turn, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS part, octet_length(encode(coalesce(text, ''))) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
 t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(part)) AS pos FROM keyed),
 c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS head, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM t GROUP BY conv_id),
 b AS (SELECT c.*, least(c.h, coalesce(o.n, 0)) AS base FROM c LEFT JOIN c o ON o.conv_id = c.head),
 turns AS (SELECT b.conv_id, pos AS d, part, bytes FROM b JOIN t ON t.conv_id = b.head AND pos <= h UNION ALL SELECT conv_id, base + pos - h, part, bytes FROM b JOIN t USING (conv_id) WHERE pos > h),
 paths AS (SELECT conv_id, 0 AS d, '' AS path, 0 AS bytes FROM c UNION ALL SELECT conv_id, d, string_agg(md5(part), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d), bytes FROM turns),
 lens AS (SELECT conv_id, max(d) AS len FROM paths GROUP BY conv_id),
 nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = len), '') AS ends FROM paths JOIN lens USING (conv_id) GROUP BY path, d),
 up AS (SELECT n.*, p.path AS parent FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
 kids AS (SELECT parent AS path, count(*) AS n_children FROM up WHERE d > 0 GROUP BY parent),
 full_nodes AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (path)),
 sums AS (SELECT p.path, sum((n_convs - 1) * n.bytes) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM full_nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.path)
SELECT f.conv_id, f.d AS depth, o.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN sums USING (path) LEFT JOIN nodes o ON o.path = f.parent
"""

ORACLES: dict[str, str] = {"op3_embedding_dedup": _OP3, "op5_jaccard_join": _OP5, "op6_warc": _OP6, "op8_substrings": _OP8, "op11_merkle": _OP11, "op12_prefix_trie": _OP12}
