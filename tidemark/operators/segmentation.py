"""Words of texts without spaces: the likeliest path through a dictionary, and tokenizers for the full-text index."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import indexed_terms

#: Adds the array column target with the words of the text column source.
Tokenizer = Callable[[DataFrame, str, str], DataFrame]
#: Runs that a dictionary segments: Chinese and Japanese letters, which are written without spaces.
HAN = "぀-ヿ㐀-䶿一-鿿豈-﫿𠀀-𯨟"
MOST_WORDS = 2_000_000


def runs(rows: DataFrame, source: str, target: str) -> DataFrame:
    """The index's usual words: runs of letters and numbers in lower case."""
    return rows.withColumn(target, indexed_terms(F.coalesce(source, F.lit(""))))


class Dictionary:
    """Words with their frequencies, and the prefixes of words, to see early that no word goes on.

    A letter that is no word counts as a word of frequency one, so every text has a path. Of equally likely
    paths the one whose first word is longest is taken, and so on.
    """

    def __init__(self, words: dict[str, float]):
        self.total = math.log(sum(words.values()) + 1 or 1)
        self.words: dict[str, float | None] = {}
        for word, count in words.items():
            self.words[word] = math.log(count) - self.total
            for end in range(1, len(word)):
                self.words.setdefault(word[:end], None)

    def cut(self, run: str) -> list[str]:
        """The words of the likeliest path; from the end back, the best path from each letter on."""
        best: list[tuple[float, int]] = [(0.0, 0)] * (len(run) + 1)
        for start in range(len(run) - 1, -1, -1):
            chosen = (-self.total + best[start + 1][0], start + 1)
            end = start + 1
            while end <= len(run) and (word := run[start:end]) in self.words:
                likely = self.words[word]
                if likely is not None:
                    value = likely + best[end][0]
                    if value > chosen[0] + 1e-12 or value >= chosen[0] - 1e-12 and end > chosen[1] or end == start + 1:
                        chosen = (value, end)
                end += 1
            best[start] = chosen
        words, at = [], 0
        while at < len(run):
            words.append(run[at : best[at][1]])
            at = best[at][1]
        return words


def segmenter(dictionary: DataFrame, letters: str = HAN, stop_words: frozenset[str] = frozenset()) -> Tokenizer:
    """A tokenizer that cuts runs of letters (a class of characters) by dictionary (word, count); other runs of letters and numbers stay whole.

    Words are in lower case, as the index has them; stop words are left out. The dictionary goes to every
    worker, so its size is checked: more than MOST_WORDS words are refused. Words that are null, empty or hold a
    count below one are passed over; of a repeated word counts add up.
    """
    words = dictionary.select(F.lower("word").alias("word"), F.col("count").cast("double").alias("count")).filter("word <> '' AND count >= 1").groupBy("word").agg(F.sum("count").alias("count"))
    found = words.limit(MOST_WORDS + 1).collect()
    if len(found) > MOST_WORDS:
        raise ValueError(f"the dictionary has more than {MOST_WORDS} words")
    sent = dictionary.sparkSession.sparkContext.broadcast({r.word: r["count"] for r in found})
    pieces = re.compile(rf"[{letters}]+|(?:(?![{letters}_])\w)+")
    inside = re.compile(rf"[{letters}]")

    def tokenizer(rows: DataFrame, source: str, target: str) -> DataFrame:
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Dictionary(sent.value)
            for batch in batches:
                words = []
                for text in batch.column(batch.num_columns - 1).to_pylist():
                    own = []
                    for piece in pieces.findall((text or "").lower()):
                        own += known.cut(piece) if inside.match(piece) else [piece]
                    words.append([w for w in own if w not in stop_words])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words, pa.list_(pa.string()))], [*names, target])

        names = [c for c in rows.columns if c != target]
        schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
        given = rows.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{source}`").cast("string").alias("_text"))
        return given.mapInArrow(cut, f"{schema}, `{target}` array<string>")

    return tokenizer
