"""Toxicity scores by weak supervision (operator 10).

Voters are mined from a bounded sample of labelled rows: words, word stems (3 to 8 letters), each also in
a form that asks for several occurrences, and fixed patterns of shouting. A generative label model takes
the voters, and the given label as one more voter that may err, and estimates by expectation
maximisation how often each votes on toxic and on clean texts; voters that go together more than the
classes explain form groups whose votes are scaled down to their effective number. A linear classifier
is then trained on the posterior labels and scores every whole text.

Only rows whose crc32(id as text) mod 3 is not 1 teach; max_labelled of them at most, those with the
smallest hashes of their ids. Labels, language, source and id are never inputs of a score.

A null text is scored as an empty one, from the classifier's intercept. Without labelled rows of both
kinds every score is the share of toxic ones (0 without any). Conflicting labels of an id are averaged.
Repeated rows are scored each and teach once; other columns are not read, whatever their names. A very long text
votes with all its words. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, drop, shielded, staged, unshielded
from tidemark.llm.components import roots_of

_WORDS = re.compile(r"[^\W\d_]+")
_STEMS = range(3, 9)
_TIMES = (2, 4)
_PATTERNS = (("shout", re.compile(r"!{2,}")), ("upper", re.compile(r"\b[A-Z]{4,}\b(?:\W+[A-Z]{4,}\b){2}")), ("stars", re.compile(r"\w\*{2,}\w")))
MAX_LABELLED = 20_000
MAX_VOTERS = 400
MAX_CANDIDATES = 50_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def stems(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in _STEMS if len(word) >= k)]


def features(text: str | None) -> set[str]:
    """Every voter that could vote on the text."""
    seen: Counter = Counter()
    for word, n in Counter(_WORDS.findall((text or "").lower())).items():
        for stem in stems(word):
            seen[stem] += n
    found = set(seen)
    for times in _TIMES:
        found |= {f"{s}#{times}" for s, n in seen.items() if n >= times}
    return found | {f"~{name}" for name, pattern in _PATTERNS if pattern.search(text or "")}


class Votes:
    """Which of the chosen voters vote on a text, through a bounded cache of words."""

    def __init__(self, voters: list[str]):
        self.at = {v: i for i, v in enumerate(voters)}
        self.stem_at: dict[str, list[tuple[int, int]]] = {}
        for v, i in self.at.items():
            if v[0] != "~":
                stem, _, times = v.partition("#")
                self.stem_at.setdefault(stem, []).append((int(times or 1), i))
        self.patterns = [(self.at[f"~{name}"], pattern) for name, pattern in _PATTERNS if f"~{name}" in self.at]
        self.known: dict[str, tuple[str, ...]] = {}

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, hits = self.known, None
        for word, n in Counter(_WORDS.findall(text.lower())).items():
            got = known.get(word)
            if got is None:
                got = tuple(s for s in stems(word) if s in self.stem_at)
                if len(known) > 500_000:
                    known.clear()
                known[word] = got
            if got:
                hits = hits if hits is not None else Counter()
                for s in got:
                    hits[s] += n
        out = [i for s, n in (hits or {}).items() for times, i in self.stem_at[s] if n >= times]
        return out + [i for i, pattern in self.patterns if pattern.search(text)]


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row; and of each voter, the given label last, its rates on toxic and on clean, and its scale."""
    v = np.column_stack([votes, given]).astype(float)
    p = np.where(given > 0.5, 0.95, 0.05)
    scale, both = np.ones(v.shape[1]), v.T @ v
    for step in range(rounds):
        on, off = ((p @ v) + 0.5) / (p.sum() + 1), (((1 - p) @ v) + 0.5) / ((1 - p).sum() + 1)
        prior = p.mean()
        if step in (0, 5):  # what voters share beyond the classes, as correlations of what the classes leave
            classes, rates = np.column_stack([p, 1 - p]), np.vstack([on, off])
            cross = (classes.T @ v).T @ rates
            shared = (both - cross - cross.T + rates.T @ (classes.T @ classes) @ rates) / len(v)  # without a table of what is left
            sd = np.sqrt(np.maximum(0, np.diag(shared) - (v.mean(axis=0) - classes.mean(axis=0) @ rates) ** 2)) + 1e-9
            shared = shared / np.outer(sd, sd)
            a, b = np.nonzero(np.triu(shared[:-1, :-1] > 0.3, 1))
            group = np.append(roots_of(a, b, v.shape[1] - 1), v.shape[1] - 1)
            for g in np.unique(group):
                own = np.flatnonzero(group == g)
                mean = (shared[np.ix_(own, own)].sum() - len(own)) / max(1, len(own) * (len(own) - 1))
                scale[own] = 1 / (1 + (len(own) - 1) * min(1, max(0, mean)))
        logit = np.log(prior / (1 - prior)) + v @ (scale * np.log(on / off) - (against := scale * np.log((1 - on) / (1 - off)))) + against.sum()
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p, on, off, scale


def linear(x: np.ndarray, p: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the intercept last, of a logistic classifier for soft labels, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = q * (1 - q) + 1e-6
        curve = sum((x[at : at + 1024] * bend[at : at + 1024, None]).T @ x[at : at + 1024] for at in range(0, len(x), 1024))
        step = np.linalg.solve(curve + ridge, x.T @ (p - q) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """rows (_id, text, toxic), each that repeats once, at most most of them: those with the smallest hashes of id and text."""
    keys = (F.xxhash64("_id").alias("_h"), F.col("_id"), F.xxhash64("text").alias("_t"))
    once = staged(rows.groupBy(*keys, "toxic").agg(F.first("text").alias("text")), "once")
    if once.count() <= most:
        return once
    small = once.select(F.struct("_h", "_id", "_t").alias("key")).orderBy("key").limit(most)
    last = small.agg(F.max("key").alias("key")).first().key
    return once.filter(F.struct("_h", "_id", "_t") <= F.struct(*(F.lit(last[c]).cast(once.schema[c].dataType).alias(c) for c in ("_h", "_id", "_t"))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, max_voters: int = MAX_VOTERS, max_candidates: int = MAX_CANDIDATES) -> tuple[list[str], np.ndarray]:
    """The voters and the classifier's weights, the intercept last.

    The model's size is bounded whatever the corpus: at most max_labelled labelled rows, those with the smallest
    id hashes, teach, of repeated ids and rows too no more; of the voters that at least 3 toxic rows (a 200th of them, if more) cast, the max_candidates
    most frequent are weighed, and the max_voters that tell most vote. Scores read every text whole.
    """
    teaching = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    teaching = teaching.groupBy(F.col("doc_id").alias("_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    teaching = teaching.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)  # the bound that allows the broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    labelled = staged(_bounded(texts.join(F.broadcast(teaching), "_id"), max_labelled).select("text", "toxic"), "labelled")
    totals = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        share = min(1 - 1e-9, max(1e-9, n_toxic / max(1, n_toxic + n_clean)))
        return [], np.array([np.log(share / (1 - share))])

    def counted(only: frozenset[str] | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in arrow_rows(batches, 500):
                seen: Counter = Counter()
                for text in batch.column(0).to_pylist():
                    seen.update(features(text) if only is None else features(text) & only)
                yield pa.RecordBatch.from_pydict({"voter": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

        return count

    least = max(3, n_toxic // 200)
    on_toxic = labelled.filter("toxic = 1").select("text").mapInArrow(counted(None), "voter string, n long").groupBy("voter").agg(F.sum("n").alias("n"))
    candidates = {r.voter: r.n for r in on_toxic.filter(F.col("n") >= least).orderBy(F.desc("n"), "voter").limit(max_candidates).collect()}
    on_clean = labelled.filter("toxic = 0").select("text").mapInArrow(counted(frozenset(candidates)), "voter string, n long").groupBy("voter").agg(F.sum("n").alias("n"))
    clean = {r.voter: r.n for r in on_clean.collect()}
    # voters that tell most: log likelihood ratio of toxic against clean, for voters of the toxic class
    def worth(v: str) -> float:
        a, b = (candidates[v] + 0.5) / (n_toxic + 1), (clean.get(v, 0) + 0.5) / (n_clean + 1)
        return candidates[v] * np.log(a / b) if a > 4 * b else 0.0

    ranked = sorted(((worth(v), v) for v in candidates), key=lambda x: (-x[0], x[1]))
    voters = [v for w, v in ranked[:max_voters] if w > 0]
    voters += [f"~{name}" for name, _ in _PATTERNS if f"~{name}" not in voters]

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = Votes(voters)
        for batch in arrow_rows(batches, 500):
            yield pa.RecordBatch.from_arrays([pa.array([vote(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], ["votes", "toxic"])

    rows = labelled.mapInArrow(cast, "votes array<int>, toxic int").toPandas().sort_values("toxic", kind="stable")
    drop(labelled)
    votes, given = np.zeros((len(rows), len(voters)), np.float32), rows.toxic.to_numpy()
    for i, got in enumerate(rows.votes):
        votes[i, np.asarray(got, int)] = 1
    del rows
    posterior = label_model(votes, given)[0]
    return voters, linear(votes, posterior)


def score(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs' rows and columns with score and predicted, in place of columns of these names."""
    voters, weights = model
    plain, names = shielded(docs, drop=("score", "predicted"))
    kept = list(names.values())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = Votes(voters)
        for batch in arrow_rows(batches):
            logits = [float(weights[-1] + weights[vote(text)].sum()) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(1 / (1 + np.exp(-np.clip(logits, -30, 30))), pa.float64())], [*kept, "score"])

    rows = plain.select(F.col(names[text_col]).cast("string").alias("text"), *kept)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    made = rows.mapInArrow(scored, f"{fields}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return unshielded(made, names, "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each row of docs: its id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, **options)
    rows = score(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), model, id_col, "text")
    return rows.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")
