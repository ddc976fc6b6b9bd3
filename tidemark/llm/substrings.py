"""Substring deduplication by relative Lempel-Ziv factors (operator 8).

A word is removed if a window of so many words that covers it also starts in a document with a smaller
id. Every document is parsed greedily into factors, copies of text of earlier documents, against an index
of the reference blocks of all documents; only factors of a window's length or more matter here.

1. Each window's anchor is its smallest hash of a few words (the leftmost, if several). Equal windows
   have equal anchors at equal offsets. The windows in a row with one anchor make a phrase, and the
   phrases, keyed by the hash of all their words, are the reference blocks, each with the place where it
   stands first. Blocks are spread by hash, and a document meets, by a join, just those that have
   something of it; visiting every block with every document would cost their product.
2. The parse walks a document's phrases. A phrase found in an earlier document starts a factor, which
   is extended while the next one stands next in the same document too.
3. At a factor's boundary the phrase agrees with another only in part. Then its anchor has several
   blocks; only for those, and only in the document that holds the block first, windows are checked
   word by word against an index of windows, and what is found extends the factor or is one of its own.

Each step is a minimum by key, combined on the map side, and a join of written tables, which may be split
where a key is hot; a copy costs a row for each phrase, whatever it holds. Word sequences are compared by
128-bit hashes in the index (64 bits of the block or window and 64 of its anchor).

Words are the runs of characters other than space and \\t to \\r, unchanged. A null or empty text has no
words. A row with a null id is no reference and loses nothing. Rows that repeat an id take nothing from
each other. Other columns are not read. An empty table gives an empty one. A very long text is one row of
a task, which holds its words and their hashes, some 30 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, drop, release, scratch, staged, text_key

_ANCHOR = 8
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hashes(dict):
    """64-bit hashes of words as bytes; bounded."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 250_000 and len(word) <= 64:
            self[word] = h
        return h


_hashes = Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()  # bytes split at exactly space and \t to \r
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _Q
    return h ^ (h >> np.uint64(29))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


class Rolling:
    """Hashes of runs of one document's words, by prefix sums modulo 2**64 of a polynomial with an odd base."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.power = _powers(self.n + 1, _P)
        self.inverse = _powers(self.n + 1, np.uint64(pow(int(_P), -1, 1 << 64)))
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_mixed(words) * self.power[:-1], out=self.sums[1:])

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The hash of words[start:stop], the same wherever the run stands."""
        raw = (self.sums[stop] - self.sums[start]) * self.inverse[start]
        return _mixed(raw + (stop - start).astype(np.uint64) * _Q)


def window_anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of span hashes, the position of its smallest one, the leftmost of equals."""
    n = len(grams) - span + 1
    best, reach = np.arange(len(grams)), 1
    while reach < span:  # minima of runs of twice the length, the last step overlapping
        step = min(reach, span - reach)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(grams[b] < grams[a], b, a)
        reach += step
    return best[:n]


def phrases(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Rolling] | None:
    """Block hash, anchor hash, first window and number of windows of each phrase."""
    if len(words) < window:
        return None
    roll = Rolling(words)
    at = np.arange(len(words) - _ANCHOR + 1)
    grams = roll.runs(at, at + _ANCHOR)
    anchors = window_anchors(grams, window - _ANCHOR + 1)
    first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    count = np.diff(np.r_[first, len(anchors)])
    # the block: all words of the phrase's windows, and where the anchor stands in them
    blocks = _mixed(roll.runs(first, first + count + window - 1) + (anchors[first] - first).astype(np.uint64) * _P)
    return blocks, grams[anchors[first]], first, count, roll


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def _covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    for start, stop in spans:
        edges[start] += 1
        edges[min(stop, n)] -= 1
    return np.cumsum(edges[:-1]) > 0


def greedy_factors(items: list[tuple[int, int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """Factors (start, stop, source, source_start) of a document from parts that were found, given alike.

    From left to right, a factor is extended by a part that goes on in the same place of the same source,
    with no window between them.
    """
    out: list[tuple[int, int, int, int]] = []
    last: dict[tuple[int, int], int] = {}  # open factors by source and shift
    for start, stop, source, place in sorted(items):
        at = last.get((source, place - start))
        if at is not None and start <= out[at][1] - window + 1:
            out[at] = (out[at][0], max(stop, out[at][1]), *out[at][2:])
        else:
            last[source, place - start] = len(out)
            out.append((start, stop, source, place))
    return out


_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])


def factors(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document with a factor of a window or more: its id, key (of id and text), factors.

    factors: array of (start, stop, source, source_start), in words; source is the smallest id that has the factor's first part.
    """
    with scratch(docs.sparkSession) as kept:
        kept.append(staged(_factors(docs, window, id_col, text_col), "factors"))
    return kept[0]


def _factors(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    rows = rows.withColumn("key", text_key(F.col("id"), F.col("text")))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "key", "block", "anchor", "first", "count"]
        for batch in arrow_rows(batches, 500):
            parts: list[list[np.ndarray]] = []
            for i, text, key in zip(*(c.to_pylist() for c in batch.columns)):
                found = phrases(word_hashes(text), window)
                if found:
                    blocks, anchors, first, count, _ = found
                    parts.append([np.full(len(blocks), i), np.full(len(blocks), key), blocks, anchors, first, count])
            if parts:
                ids, keys, blocks, anchors, first, count = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), _signed(blocks), _signed(anchors), pa.array(first.astype("i4")), pa.array(count.astype("i4"))], names)

    found = staged(rows.mapInArrow(parsed, "id long, key long, block long, anchor long, first int, count int"), "phrases")
    index = staged(found.groupBy("block", "anchor").agg(F.min(F.struct("id", "first")).alias("source"), F.max("id").alias("last")), "blocks")
    release(spark)
    shared = index.filter("source.id < last").select("block", "anchor", "source")
    whole = found.join(shared, ["block", "anchor"]).filter("source.id < id")
    whole = staged(whole.select("id", "key", F.col("first").alias("start"), (F.col("first") + F.col("count") + window - 1).alias("stop"), F.col("source.id").alias("source"), F.col("source.first").alias("place")), "whole")
    several = index.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    partly = staged(index.join(several, "anchor", "left_semi").select("block", "anchor", F.col("source.id").alias("owner")), "partly")
    drop(index)
    checks = staged(found.join(partly, ["block", "anchor"]).filter("owner = id").groupBy("id", "key").agg(F.collect_list(F.struct("first", "count")).alias("runs")), "checks")
    drop(found, partly)
    release(spark)
    asked = rows.join(checks, ["id", "key"]).select("id", "key", "text", "runs")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "key", "window", "anchor", "start"]
        for batch in arrow_rows(batches, 200):
            parts = []
            for i, key, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                words = word_hashes(text)
                roll = Rolling(words)
                start = np.unique(np.concatenate([np.arange(r["first"], r["first"] + r["count"]) for r in runs]))
                half = window // 2
                parts.append([np.full(len(start), i), np.full(len(start), key), roll.runs(start, start + window), roll.runs(start, start + half), start])
            if parts:
                ids, keys, hashed, halves, start = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), _signed(hashed), _signed(halves), pa.array(start.astype("i4"))], names)

    single = staged(asked.mapInArrow(windows, "id long, key long, window long, anchor long, start int"), "windows")
    drop(checks)
    release(spark)
    owners = single.groupBy("window", "anchor").agg(F.min(F.struct("id", "start")).alias("source"), F.max("id").alias("last")).filter("source.id < last")
    owners = staged(owners.drop("last"), "owners")
    edge = single.join(owners, ["window", "anchor"]).filter("source.id < id")
    edge = edge.select("id", "key", "start", (F.col("start") + window).alias("stop"), F.col("source.id").alias("source"), F.col("source.start").alias("place"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 500):
            made = [[dict(zip(("start", "stop", "source", "source_start"), f)) for f in greedy_factors([tuple(p.values()) for p in parts], window)] for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(_SPAN))], ["id", "key", "factors"])

    parts = whole.union(edge).groupBy("id", "key").agg(F.collect_list(F.struct("start", "stop", "source", "place")).alias("parts"))
    return parts.mapInArrow(joined, "id long, key long, factors array<struct<start:int,stop:int,source:long,source_start:int>>")


def deduplicated(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """A row for each row of docs: its id, n_words, n_removed, kept_sha256; with_text: also the factors and the kept text."""
    found = factors(docs, window, id_col, text_col).withColumnRenamed("id", "_id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", text_key(F.col("id").cast("long"), F.col("text")))
    joined = rows.join(found, (F.col("id").cast("long") == F.col("_id")) & (rows["key"] == found["key"]), "left").select("id", "text", "factors")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_words", "n_removed", "kept_sha256", *["factors", "text"] * with_text]
        for batch in arrow_rows(batches, 500):
            totals, removed, digests, texts = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or "").encode().split()
                total = len(words)
                if spans:
                    cover = _covered(total, [(s["start"], s["stop"]) for s in spans])
                    words = [w for w, g in zip(words, cover.tolist()) if not g]
                totals.append(total)
                removed.append(total - len(words))
                whole = b" ".join(words)
                digests.append(hashlib.sha256(whole).hexdigest())
                if with_text:
                    texts.append(whole.decode())
            arrays = [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [batch.column(2), pa.array(texts, pa.string())] * with_text, names)

    kind = dict(rows.dtypes)["id"]
    more = ", factors array<struct<start:int,stop:int,source:long,source_start:int>>, text string" * with_text
    return joined.mapInArrow(kept, f"id {kind}, n_words long, n_removed long, kept_sha256 string{more}").withColumnRenamed("id", id_col)
