"""Token counts of whole texts through a two-tier lookup (operator 7).

A byte-level BPE splits a text before merging, and a single space between two characters that are
not white space always starts a new pre-token. So a text is cut there into units whose lengths add up
exactly, whatever their neighbours are. The first tier is a compact table of the most frequent units'
lengths, counted over all texts in bounded summaries on the map side and broadcast; the second is a
bounded cache in each Python worker, filled by the tokenizer itself. No pre-token is ever shuffled:
only each task's summary of its frequent units is.

Null and empty texts have no tokens. Rows are kept as they are, repeated ones too; other columns are
not read, whatever their names. A very long text is counted whole, unit by unit; an empty table gives no rows. A text with a special token's string is cut there, as the library does by default.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows

#: White space by any definition that the library, Unicode or Python may use.
_SPACE = r"\s\x1c-\x1f\x85᠎​﻿"
_CUT = re.compile(rf"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")
_ODD = re.compile(rf"[{_SPACE}] | [{_SPACE}]|^ | $".replace("$", r"\Z"))
_LONGEST = 128


def units(text: str) -> list[str]:
    """The text's units without the space before each but the first."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class Counts(dict):
    """Length of ' ' + unit; what is missing is encoded, and kept while there is room."""

    def __init__(self, known: dict[str, int], encode: Callable[[str], int], room: int):
        super().__init__(known)
        self.known, self.encode, self.room = known, encode, room

    def __missing__(self, unit: str) -> int:
        n = self.encode(" " + unit)
        if len(unit) <= _LONGEST:
            if len(self) > self.room:
                self.clear()
                self.update(self.known)
            self[unit] = n
        return n


class Counter7:
    """Counts tokens of texts with one tokenizer file, in one process."""

    def __init__(self, path: str, known: dict[str, int], room: int = 300_000):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole, self.cuts = (lambda text: len(model.encode(text))), False
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.whole = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.cuts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        self.lengths, self.first = Counts(known, self.whole, room), {}

    def part(self, text: str) -> int:
        if not text:
            return 0
        head, *rest = units(text)
        n = self.first.get(head)
        if n is None:
            n = self.whole(head)
            if len(head) <= _LONGEST and len(self.first) < 50_000:
                self.first[head] = n
        return n + sum(map(self.lengths.__getitem__, rest))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.cuts:
            return self.whole(text)
        if self.special is None or not self.special.search(text):
            return self.part(text)
        parts = self.special.split(text)
        return sum(map(self.part, parts)) + len(parts) - 1


_workers: dict[tuple, Counter7] = {}


def frequent_units(texts: DataFrame, size: int, room: int = 200_000) -> list[str]:
    """The at most size most frequent units over all texts of the one column.

    Each task keeps a lossy count of at most room units and gives out those that make up at least one
    in 50,000 of its own, at most 50,000 by that bound; these summaries are added up.
    """

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Counter(), 0
        for batch in arrow_rows(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    got = units(text)[1:]
                    total += len(got)
                    seen.update(got)
            while len(seen) > room:  # lossy counting: the rarest go, as no frequent one can be among them for long
                least = sorted(seen.values())[len(seen) // 2]
                seen = Counter({u: n - least for u, n in seen.items() if n > least})
        kept = [(u, n) for u, n in seen.items() if n * 50_000 >= total and n > 1 and len(u) <= _LONGEST]
        yield pa.RecordBatch.from_pydict({"unit": pa.array([u for u, _ in kept], pa.string()), "n": pa.array([n for _, n in kept], pa.int64())})

    counted = texts.mapInArrow(summaries, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return [r.unit for r in counted.orderBy(F.desc("n"), "unit").limit(size).collect()]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, table_size: int = 65_536) -> DataFrame:
    """A row for each row of docs: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    tokenizer: path of a .json (tokenizers) or .model (sentencepiece) file that every worker has.
    table_size bounds the broadcast table; it changes speed only.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    encoder = Counter7(tokenizer, {})
    known = spark.sparkContext.broadcast({u: encoder.whole(" " + u) for u in frequent_units(texts, table_size)} if encoder.cuts else {})
    key = (tokenizer, known.id if hasattr(known, "id") else id(known), docs.sparkSession.sparkContext.applicationId)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _workers.get(key)
        if count is None:
            _workers.clear()
            count = _workers[key] = Counter7(tokenizer, known.value)
        for batch in arrow_rows(batches):
            n = pa.array([count(text) for text in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(counts, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
