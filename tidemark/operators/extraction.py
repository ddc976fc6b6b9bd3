"""Entities and relations that a model reads out of texts: calls, lenient answers, the whitelist, and who is known already."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an entity may be, and what a model is told whose answer was no JSON.
ENTITY_TYPES = ("person", "org", "concept", "tool", "location")
AGAIN = "Your previous response was not valid JSON. Please respond with ONLY a valid JSON object containing 'entities' and 'relations' arrays."
ANSWER = "entities array<struct<name:string,entity_type:string>>, relations array<struct<source:string,target:string,relation_type:string>>, level string, error string"


def _object(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) and (found.get("entities") or found.get("relations")) else None


def balanced(text: str) -> Iterator[str]:
    """The parts from a brace to the one that closes it, outermost first in their order; braces in strings don't count."""
    starts: list[int] = []
    inside = escaped = False
    for at, c in enumerate(text):
        if inside:
            inside, escaped = escaped or c not in '"', not escaped and c == "\\"
        elif c == '"' and starts:
            inside = True
        elif c == "{":
            starts.append(at)
        elif c == "}" and starts:
            begin = starts.pop()
            if not starts:
                yield text[begin : at + 1]


def parsed(answer: str) -> tuple[dict | None, str]:
    """The answer's object and how it was found: whole (json), in a fence or anywhere inside (extract), or not (none)."""
    whole = _object(answer)
    if whole is not None:
        return whole, "json"
    for part in (*(p.partition("\n")[2] for p in answer.split("```")[1::2]), *balanced(answer)):
        found = _object(part.strip())
        if found is not None:
            return found, "extract"
    return None, "none"


def _texts(items, names: tuple[str, ...], kind: str, allowed: frozenset[str] | None, most: int) -> list[dict]:
    out = []
    for item in items if isinstance(items, list) else ():
        if isinstance(item, dict) and all(isinstance(item.get(n), str) and item[n].strip() for n in (*names, kind)):
            told = item[kind].strip().lower()
            if allowed is None or told in allowed:
                out.append({n: item[n].strip() for n in names} | {kind: told})
    return out[:most] if most else out


def read_texts(rows: DataFrame, ask: Callable[[list[str]], str], content: str = "content", entity_types: tuple[str, ...] = ENTITY_TYPES, relation_types: tuple[str, ...] | None = None, most: int = 20, at_once: int = 4, tries: int = 3) -> DataFrame:
    """rows with what a model says of content: entities, relations, level (json, extract, retry, none) and error.

    ask takes the messages so far and gives the answer; a worker makes at_once calls at a time. A call that raises is
    made again, tries in all, and then leaves its row with the error. An answer that can't be read is sent back once.
    Types are in lower case and of the whitelist (relation_types None: any), at most most of each. Null and empty texts
    are not asked about.
    """
    names = rows.columns
    allowed, related = frozenset(entity_types), None if relation_types is None else frozenset(relation_types)
    where = names.index(content)

    def called(messages: list[str]) -> str:
        for n in range(tries):
            try:
                return ask(messages)
            except Exception as failed:  # whatever a model's client raises is the row's, not the job's
                if n == tries - 1:
                    raise RuntimeError(f"{type(failed).__name__}: {failed}") from failed
        raise AssertionError

    def one(text: str | None) -> tuple[list, list, str, str | None]:
        if not text:
            return [], [], "none", None
        try:
            answer = called([text])
            found, level = parsed(answer)
            if found is None:
                found, level = parsed(called([text, answer, AGAIN]))
                level = "retry" if found is not None else "none"
        except RuntimeError as failed:
            return [], [], "none", str(failed)
        if found is None:
            return [], [], "none", "no answer could be read"
        return _texts(found.get("entities"), ("name",), "entity_type", allowed, most), _texts(found.get("relations"), ("source", "target"), "relation_type", related, most), level, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, relation = (pa.list_(pa.struct([(f, pa.string()) for f in fields])) for fields in (("name", "entity_type"), ("source", "target", "relation_type")))
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                got = list(zip(*pool.map(one, batch.column(where).to_pylist()))) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(g, t) for g, t in zip(got, (entity, relation, pa.string(), pa.string())))], [*names, "entities", "relations", "level", "error"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{schema}, {ANSWER}")


def alike(name: Column) -> Column:
    """A name without case, signs and spaces: names that agree in this are the same entity."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def resolved(found: DataFrame, entities: DataFrame) -> DataFrame:
    """found (id, scope, name, entity_type) with entity_id and reused: exact (the name in any case), alike (see alike(), of the same type), or none.

    entities: id, name, entity_type, scope. Of several the smallest id counts.
    """
    known = entities.select(F.col("id").alias("entity_id"), F.lower("name").alias("low"), alike(F.col("name")).alias("like"), "entity_type", "scope")
    exact = known.groupBy("scope", "low").agg(F.min("entity_id").alias("by_name"))
    near = known.filter("like <> ''").groupBy("scope", "entity_type", "like").agg(F.min("entity_id").alias("by_like"))
    rows = found.withColumn("low", F.lower("name")).withColumn("like", alike(F.col("name"))).join(exact, ["scope", "low"], "left").join(near, ["scope", "entity_type", "like"], "left")
    told = F.when(F.col("by_name").isNotNull(), "exact").when(F.col("by_like").isNotNull(), "alike").otherwise("none")
    return rows.select("id", "scope", "name", "entity_type", F.coalesce("by_name", "by_like").alias("entity_id"), told.alias("reused"))


def new_candidates(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (name, scope, hit_count, ids) after the resolved rows that are nobody's: each counts once for an id that hasn't told of it."""
    own = rows.filter("reused = 'none'").groupBy(F.lower("name").alias("name"), "scope").agg(F.collect_set("id").alias("ids"))
    both = candidates.select("name", "scope", "ids").union(own.select("name", "scope", "ids"))
    told = both.select("name", "scope", F.explode("ids").alias("id")).distinct().groupBy("name", "scope")
    return told.agg(F.count("*").alias("hit_count"), F.array_sort(F.collect_set("id")).alias("ids"))
