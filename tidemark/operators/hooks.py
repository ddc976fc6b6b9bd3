"""What a deployment plugs in: tokenizer, synonyms, embedder, extractor, reasoner. The defaults are deterministic."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written


class Synonyms:
    """A dictionary read both ways."""

    def __init__(self, groups: list[tuple[str, ...]]):
        self.known: dict[str, list[str]] = {}
        for group in groups:
            low = [w.lower() for w in group]
            for w in low:
                self.known.setdefault(w, []).extend(x for x in low if x != w)

    def expand(self, words: list[str], most: int = 30) -> list[str]:
        """The words without repeats, then their synonyms, at most most in all."""
        out, seen = [], set()
        for w in words:
            if w.lower() not in seen:
                seen.add(w.lower())
                out.append(w)
        for w in words:
            for other in self.known.get(w.lower(), []):
                if other not in seen and len(out) < most:
                    seen.add(other)
                    out.append(other)
        return out


def expanded(rows: DataFrame, synonyms: Synonyms, words: str = "words", most: int = 30) -> DataFrame:
    """rows with their words and the words' synonyms in place of words; none for none."""

    @F.pandas_udf("array<string>")
    def run(found: pd.Series) -> pd.Series:
        return found.map(lambda w: None if w is None else synonyms.expand(list(w), most))

    return rows.withColumn(words, run(words))


def hashed_vector(text: str, dims: int = 64) -> list[float]:
    """A unit vector from hashes of the text's words: what stands in for a model."""
    out = np.zeros(dims)
    for word in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        out[h % dims] += 1 if h >> 63 else -1
    n = float(np.linalg.norm(out))
    return (out / n if n else out).tolist()


def embedded(rows: DataFrame, text: str = "content", embed: Callable[[str], list[float]] = hashed_vector) -> DataFrame:
    """rows with embedding; each distinct text is embedded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [embed(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], ["_text", "embedding"])

    distinct = rows.select(F.col(text).alias("_text")).distinct()
    made = distinct.mapInArrow(run, "_text string, embedding array<double>")
    return rows.join(made, rows[text].eqNullSafe(made["_text"])).drop("_text")


def next_k(at: int, rounds: int, used: int = 0, budget: int = 0, best: float | None = None) -> int:
    """How many rows round at, from 1, asks for; used and budget are tokens, best the round before's best score.

    Fixed values: 15 rows, 8 from the second round on and 5 in the last one; two thirds where less than 30 % of the
    budget is left, half of that below 10 %; then three quarters after good evidence (0.8), five quarters after
    poor (0.3); from 3 to 20.
    """
    k = 15 if at <= 1 else 8
    if budget > 0 and used > 0:
        left = (budget - used) / budget
        k = k * 2 // 3 if left < 0.3 else k
        k = k // 2 if left < 0.1 else k
    if at > 1 and best is not None:
        k = k * 3 // 4 if best >= 0.8 else k * 5 // 4 if best < 0.3 else k
    return max(3, min(20, 5 if at == rounds else k))


def reflect(question: str, retrieve: Callable[[str, int], list[tuple[str, float]]], reason: Callable[[str, list[str]], tuple[str | None, str | None]], rounds: int = 3, budget: int = 4096) -> tuple[str | None, list[str]]:
    """Retrieve and reason in turn: (conclusion, queries).

    retrieve gives (text, score), best first; reason (conclusion, next query). A conclusion, no next query, a
    repeated one or a spent budget ends it.
    """
    asked, following, spent, best = [], question, 0, None
    for at in range(1, rounds + 1):
        if following in asked:
            break
        asked.append(following)
        rows = retrieve(following, next_k(at, rounds, spent, budget, best))
        best = rows[0][1] if rows else 0.0
        spent += sum((len(text) + 3) // 4 for text, _ in rows)
        conclusion, following = reason(following, [text for text, _ in rows])
        if conclusion or not following or spent > budget:
            return conclusion, asked
    return None, asked


def reflected(questions: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], reason: Callable[[str, list[str]], tuple[str | None, str | None]], rounds: int = 3, budget: int = 4096) -> DataFrame:
    """reflect() for every question (query_id, text) at once: query_id, conclusion, asked.

    A round is one retrieval for all questions that are open: retrieve takes (query_id, text) and a limit and gives
    (query_id, text, score, nth). What a question has come to is a row; a question's evidence is at most 20 texts.
    """
    kind = questions.schema["query_id"].dataType.simpleString()
    fields = f"query_id {kind}, asked array<string>, following string, spent long, best double, conclusion string, open boolean, k int"

    def steps(at: int):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    asked = [*row["asked"], row["following"]]
                    rows = [(r["text"], r["score"]) for r in row["evidence"] or ()]
                    best, spent = rows[0][1] if rows else 0.0, row["spent"] + sum((len(text) + 3) // 4 for text, _ in rows)
                    conclusion, following = reason(row["following"], [text for text, _ in rows])
                    ends = bool(conclusion or not following or spent > budget)
                    out.append({"query_id": row["query_id"], "asked": asked, "following": following, "spent": spent, "best": best, "conclusion": conclusion if ends else None, "open": not ends and following not in asked, "k": next_k(at + 1, rounds, spent, budget, best)})
                names = ["asked", "following", "spent", "best", "conclusion", "open", "k"]
                types = [pa.list_(pa.string()), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.bool_(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), *(pa.array([o[n] for o in out], t) for n, t in zip(names, types))], ["query_id", *names])

        return step

    nothing = F.lit(None)
    state = questions.select("query_id", F.array().cast("array<string>").alias("asked"), F.col("text").alias("following"), F.lit(0).cast("long").alias("spent"), nothing.cast("double").alias("best"), nothing.cast("string").alias("conclusion"), F.lit(True).alias("open"), F.lit(next_k(1, rounds)).alias("k"))
    for at in range(1, rounds + 1):
        state = written(state, "reflection")
        still = state.filter("open")
        if not still.limit(1).count():
            break
        found = retrieve(still.select("query_id", F.col("following").alias("text")), 20)
        evidence = found.join(still.select("query_id", "k"), "query_id").filter(F.col("nth") <= F.col("k")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("nth", "text", "score"))).alias("evidence"))
        stepped = still.join(evidence, "query_id", "left").mapInArrow(steps(at), fields)
        state = state.filter("NOT open").unionByName(stepped)
    return state.select("query_id", "conclusion", "asked")
