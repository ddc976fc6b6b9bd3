"""Full-text search: postings, weighted BM25 over words and phrases, and the share of query words found."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import indexed_terms
from tidemark.operators import packed
from tidemark.operators.segmentation import Tokenizer, runs
from tidemark.session import shared_dir, small, written

#: Weights of the indexed columns, the least weight of a word, and how coverage counts.
WEIGHTS = {"content": 10.0, "excerpt": 5.0, "summary": 3.0}
LEAST_IDF = 1e-6
RANK_SHARE, COVERAGE_SHARE = 0.7, 0.3
MOST_PARTS = 12
#: Queries that are matched at once at most, on the average of a hash.
QUERIES = 2048
#: Words that a query leaves out.
STOP_WORDS = frozenset(
    "a an the is are was were be been being have has had do does did will would could should may might shall can "
    "i me my we our you your he she it its they them their this that these those "
    "in on at to for of with by from as into about after what which who whom how when where if then so no not but or and".split()
)


def match_parts(query: str) -> list[str]:
    """The words, and from three words on the phrases of two, that a query asks for; all words if only stop words are left."""
    plain = query.translate(str.maketrans({**dict.fromkeys('"*()^', ""), "-": " ", "+": " "}))
    words = [w for w in plain.split() if w.lower() not in STOP_WORDS and not (len(w) == 1 and w.isascii())]
    if not words:
        return plain.split()
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])] if len(words) > 2 else []
    return (words + pairs)[:MOST_PARTS]


def query_parts(queries: DataFrame, text: str = "text", tokenizer: Tokenizer = runs) -> DataFrame:
    """(query_id, phrase, times, need): what match_parts() says of each query, each part as the index's words with a space between.

    times: how often the part is asked for; need: how many parts a row must have, all where only stop words are left.
    With a tokenizer of its own the index's words are the query's words.
    """
    if tokenizer is not runs:
        queries = tokenizer(queries.select("query_id", text), text, "_words").select("query_id", F.array_join("_words", " ").alias(text))
    words = F.filter(F.split(F.translate(F.col(text), '-+"*()^', "  "), r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*sorted(STOP_WORDS)) & ~w.rlike(r"^[\x00-\x7F]$"))
    split = queries.select("query_id", words.alias("words"), kept.alias("kept"))
    fewer = F.greatest(F.size("kept") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("kept", 1, fewer), F.slice("kept", 2, fewer), lambda a, b: F.concat_ws(" ", a, b))
    wanted = F.when(F.size("kept") > 2, F.slice(F.concat("kept", pairs), 1, MOST_PARTS)).otherwise(F.slice("kept", 1, MOST_PARTS))
    parts = split.select("query_id", (F.size("kept") == 0).alias("every"), F.explode(F.when(F.size("kept") > 0, wanted).otherwise(F.col("words"))).alias("part"))
    parts = parts.select("query_id", "every", F.array_join(indexed_terms(F.col("part")), " ").alias("phrase")).filter("phrase <> ''")
    counted = parts.groupBy("query_id", "phrase").agg(F.count("*").alias("times"), F.max("every").alias("every"))
    own = Window.partitionBy("query_id")
    return counted.select("query_id", "phrase", "times", F.when(F.col("every"), F.count("*").over(own)).otherwise(1).alias("need"))


def _tokenized(rows: DataFrame, columns: dict[str, float], tokenizer: Tokenizer) -> DataFrame:
    """(id, column, terms) of each indexed text."""
    parts = rows.select("id", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in columns))).alias("part"))
    return tokenizer(parts.select("id", F.col("part.column").alias("column"), F.col("part.text").alias("text")), "text", "terms").select("id", "column", "terms")


def postings(rows: DataFrame, columns: dict[str, float] = WEIGHTS, tokenizer: Tokenizer = runs) -> DataFrame:
    """(id, column, term, position) of every indexed word."""
    return _tokenized(rows, columns, tokenizer).select("id", "column", F.posexplode("terms").alias("position", "term"))


def phrases(found: DataFrame) -> DataFrame:
    """The postings' pairs of neighbouring words, as terms of two words."""
    follows = F.lead("term").over(Window.partitionBy("id", "column").orderBy("position"))
    return found.withColumn("next", follows).filter("next IS NOT NULL").select("id", "column", F.concat_ws(" ", "term", "next").alias("term"), "position")


@dataclass
class Index:
    """blocks: the words of chunks, as packed.pack() gives them; lengths: id, chunk, at, length of what is alive; n and mean: its number and
    mean length. within narrows blocks to those of some terms (a column of them) before anything else is read."""

    blocks: DataFrame
    lengths: DataFrame
    n: int
    mean: float | None
    within: Callable[[DataFrame, DataFrame], DataFrame] | None = None

    @property
    def packed(self) -> DataFrame:
        """A row for each word, column and chunk."""
        return packed.listed(self.blocks)

    @property
    def postings(self) -> DataFrame:
        """A row for each position."""
        return _positions(packed.unpacked(self.packed, self.lengths))

    def blocks_of(self, asked: DataFrame) -> DataFrame:
        return self.blocks if self.within is None else self.within(self.blocks, asked)

    def lists_of(self, asked: DataFrame) -> DataFrame:
        return packed.unpacked(packed.listed(self.blocks_of(asked)).join(asked.select("term").distinct(), "term", "left_semi"), self.lengths)

    def of_terms(self, asked: DataFrame) -> DataFrame:
        return _positions(self.lists_of(asked))


def _positions(listed: DataFrame) -> DataFrame:
    return listed.select(*(c for c in listed.columns if c != "positions"), F.explode("positions").alias("position"))


def passing_index(rows: DataFrame, columns: dict[str, float] = WEIGHTS, tokenizer: Tokenizer = runs) -> Index:
    """The index of rows, made anew for each use."""
    from tidemark.operators.segments import SegmentedIndex

    made = SegmentedIndex(rows.sparkSession, f"{shared_dir(rows.sparkSession)}/passing-{uuid.uuid4().hex}", columns, tokenizer)
    made.add(rows)
    return made.index()


def bm25(rows: DataFrame, parts: DataFrame, columns: dict[str, float] = WEIGHTS, index: Index | None = None, most: int | None = None) -> DataFrame:
    """(query_id, id, bm25) for the parts of queries, words and phrases, as query_parts() gives them; with most, the most best of each query, ties to the smaller id.

    The lists of the distinct words asked for, in the index or that of the rows without one, meet once, by chunk, with the
    phrases of QUERIES queries at most; a phrase is met where all its words stand in a row. What each row has of them is
    written; its numbers give the weights, and a task keeps no more than most rows a query.
    Ranks are rounded, so that equal texts are ties whatever the order of their sums.
    """
    index = index or passing_index(rows, columns)
    parts = written(parts, "parts")
    packs = max(1, -(-parts.select("query_id").distinct().count() // QUERIES))
    found = None
    for n in range(packs):
        one = _ranks(parts.filter(F.pmod(F.xxhash64("query_id"), F.lit(packs)) == n), columns, index, most)
        found = one if found is None else found.unionByName(one)
    if most is None:
        return found
    best = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "id")
    return found.withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= most).drop("_nth")


def _ranks(parts: DataFrame, columns: dict[str, float], index: Index, most: int | None) -> DataFrame:
    asked = parts.select("query_id", "phrase", "times", "need").toArrow()  # of QUERIES queries
    phrases = sorted(set(asked["phrase"].to_pylist()))
    words = parts.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
    hits = written(packed.matched(index.blocks_of(words), index.lengths, phrases, columns), "hits")
    df = {r[0]: r[1] for r in hits.select(F.explode("phrases").alias("p")).groupBy("p").count().collect()}  # a number for each phrase
    idf = np.array([max(math.log((index.n - df.get(p, 0) + 0.5) / (df.get(p, 0) + 0.5)), LEAST_IDF) for p in range(len(phrases))])
    return packed.ranked(hits, asked, phrases, idf, index.mean or 1.0, most)


def search(rows: DataFrame, queries: DataFrame, limit: int = 30, condition=None, overfetch: int | None = 10, index: Index | None = None, tokenizer: Tokenizer = runs) -> DataFrame:
    """For each query (query_id, text) at most limit rows: query_id, id, score, nth by rank.

    condition filters after the cut to limit * overfetch best, as an index that knows nothing of it would;
    with overfetch None it comes first, so no match is lost, and index, that of all rows, isn't used.
    """
    early = overfetch is None and condition is not None
    if index is None or early:
        index = passing_index(rows.filter(condition) if early else rows, tokenizer=tokenizer)
    ranks = bm25(rows, query_parts(queries, tokenizer=tokenizer), index=index, most=limit * overfetch if overfetch else None)
    best = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "id")
    allowed = (rows if condition is None else rows.filter(condition)).select("id")
    # the best are written, so that rows and texts meet few ids where they lie, and what reads the result often doesn't rank again
    ranks = small(ranks, "ranks") if overfetch else ranks
    best_rows = small(ranks.join(allowed, "id").withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= limit), "best")
    # the texts of what is left only; in lower case before the join, as a word's test would do it again for each word
    texts = rows.join(best_rows.select("id").distinct(), "id", "left_semi").select("id", F.lower(F.concat_ws(" ", "content", "excerpt")).alias("_document"))
    asked = queries.select("query_id", F.filter(F.array_distinct(F.split(F.lower("text"), r"\s+")), lambda w: w != "").alias("_words"))
    joined = best_rows.join(texts, "id").join(asked, "query_id")
    share = F.size(F.filter("_words", lambda w: F.contains(F.col("_document"), w))) / F.greatest(F.size("_words"), F.lit(1))
    # written too: what reads the result often doesn't read the texts again
    return small(joined.select("query_id", "id", (RANK_SHARE * F.col("bm25") + COVERAGE_SHARE * share * F.col("bm25")).alias("score"), "bm25", "nth"), "searched")
