"""The postings of some rows as a chunk: packed by word, matched against phrases and ranked, each chunk by itself.

A chunk's words and lengths meet by its name, so no row of a table is ever dealt out by word and id; a task holds
one chunk, a bounded number of rows and words, besides the phrases of a bounded number of queries.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import overlap_text
from tidemark.operators.segmentation import Tokenizer, runs

#: Rows and words (but for a row that has more) of a chunk at most; scores that are held at once; the constants of BM25.
CHUNK_ROWS, CHUNK_WORDS, HELD = 1024, 1 << 20, 1 << 21
K1, B = 1.2, 0.75
LISTED = "chunk string, term string, column string, at array<int>, ends array<int>, positions array<int>"
#: A block's words: their terms, of how many places each is, and their places, ends and positions, one word after the other, as
#: 32-bit numbers in one value each, as millions of them are dealt out and read.
BLOCK = "chunk string, column string, terms array<string>, sizes binary, at binary, ends binary, positions binary"


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _bytes(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """Lists of numbers as a value of 32-bit numbers each."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype("<i4")), pa.py_buffer(np.ascontiguousarray(values, "<i4"))])


def _numbers(values: pa.Array) -> np.ndarray:
    """What _bytes() has put in all of values, one after the other."""
    begin, end = (np.frombuffer(values.buffers()[1], "<i4")[[values.offset, values.offset + len(values)]]) if len(values) else (0, 0)
    return np.frombuffer(values.buffers()[2], "<i4", (end - begin) // 4, begin).astype(np.int64) if end > begin else np.zeros(0, np.int64)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def part_of(term, parts: int) -> Column:
    """The part of parts that a term falls in, as _packed() deals them out."""
    return F.pmod(F.crc32(F.col(term).cast("binary")), F.lit(parts)).cast("int")


def pack(rows: DataFrame, columns: list[str], tokenizer: Tokenizer, name: str, parts: int) -> DataFrame:
    """A row, a block, for each part of terms, column and chunk, so that what is dealt out and sorted is few rows; listed() gives one for each word.

    Of each word a block has at, the places of the chunk's rows that have it, ends, how many positions are theirs up to each, and
    positions. A row without words for each chunk has the ids and lengths in words of the rows at its places. name begins the chunks' names.
    """
    kind = rows.schema["id"].dataType.simpleString()
    words = rows.select("id", *columns)
    for n, column in enumerate(columns):
        if tokenizer is runs:  # the same words as one text, which is told apart by Arrow
            words = words.withColumn(f"_words{n}", F.nullif(overlap_text(F.coalesce(column, F.lit(""))), F.lit("")))
        else:
            words = tokenizer(words, column, f"_words{n}")
    words = words.select("id", *(f"_words{n}" for n in range(len(columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            if tokenizer is runs:
                batch = pa.RecordBatch.from_arrays([batch.column(0), *(pc.split_pattern(c, " ") for c in batch.columns[1:])], batch.schema.names)
            totals = sum(_sizes(batch.column(k + 1)) for k in range(len(columns)))
            start = 0
            while start < batch.num_rows:
                held = np.searchsorted(np.cumsum(totals[start : start + CHUNK_ROWS]), CHUNK_WORDS, side="right")
                size = max(1, int(held))
                yield _packed(batch.slice(start, size), columns, f"{name}-{task}-{made}", parts)
                start, made = start + size, made + 1

    return words.mapInArrow(run, f"{BLOCK}, part int, places array<int>, ids array<{kind}>, lengths array<double>")


def _packed(batch: pa.RecordBatch, columns: list[str], chunk: str, parts: int) -> pa.RecordBatch:
    n, total, found = batch.num_rows, np.zeros(batch.num_rows), []
    for k in range(len(columns)):
        lists = batch.column(k + 1)
        size = _sizes(lists)
        total += size
        row = np.repeat(np.arange(n), size)
        found.append((lists.flatten().cast(pa.string()), row, np.full(len(row), k), np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)))
    known = pa.concat_arrays([p[0] for p in found]).dictionary_encode()
    row, column, position = (np.concatenate([p[i] for p in found]) for i in (1, 2, 3))
    part = np.fromiter(map(zlib.crc32, known.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(known.dictionary)) % parts
    code, terms = known.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(part))
    listed = (part[code] * len(columns) + column) * terms + code
    order = np.argsort(listed * n + row, kind="stable")
    listed, row, position = listed[order], row[order], position[order]
    first = np.flatnonzero(np.diff(listed * n + row, prepend=-1))  # of each word, column and row
    heads = np.flatnonzero(np.diff(listed[first], prepend=-1))  # of each word and column
    begin = np.append(first[heads], len(row))
    ends = np.append(first[1:], len(row))[: len(first)] - np.repeat(begin[:-1], np.diff(np.append(heads, len(first))))
    own, places = listed[first[heads]], np.append(heads, len(first))
    block = own // terms
    starts = np.flatnonzero(np.diff(block, prepend=-1))  # of each part and column
    block, none, bounds = block[starts], len(starts), np.append(starts, len(own))
    last = lambda values: pa.ListArray.from_arrays(pa.array([0] * (none + 1) + [n], pa.int32()), values, mask=pa.array([True] * none + [False]))
    number = lambda offsets, values: pa.concat_arrays([_bytes(offsets, values), pa.nulls(1, pa.binary())])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([chunk] * (none + 1)),
            pa.array([*(columns[k] for k in (block % len(columns)).tolist()), None], pa.string()),
            pa.ListArray.from_arrays(pa.array(np.append(bounds, len(own)), pa.int32()), known.dictionary.take(pa.array(own % terms)), mask=pa.array([False] * none + [True])),
            number(bounds, np.diff(places)),
            number(places[bounds], row[first]),
            number(places[bounds], ends),
            number(begin[bounds], position),
            pa.array([*(block // len(columns)).tolist(), None], pa.int32()),
            last(pa.array(np.arange(n), pa.int32())),
            last(batch.column(0)),
            last(pa.array(total)),
        ],
        ["chunk", "column", "terms", "sizes", "at", "ends", "positions", "part", "places", "ids", "lengths"],
    )


def listed(blocks: DataFrame) -> DataFrame:
    """A row for each word, column and chunk, as LISTED says, with what else blocks has."""
    own = ("chunk", "column", "terms", "sizes", "at", "ends", "positions")
    more = {c: k for c, k in blocks.dtypes if c not in own}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, size, at, counts, positions = _flat(batch, "ends")
            places, words = np.append(0, np.cumsum(size)), np.repeat(np.arange(len(size)), size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("chunk").take(pa.array(row)),
                    batch.column("terms").flatten(),
                    batch.column("column").take(pa.array(row)),
                    _lists(places, at),
                    _lists(places, _numbers(batch.column("ends"))),
                    _lists(np.append(0, np.cumsum(np.bincount(words, counts, len(size)))), positions),
                    *(batch.column(c).take(pa.array(row)) for c in more),
                ],
                ["chunk", "term", "column", "at", "ends", "positions", *more],
            )

    return blocks.select(*own, *more).mapInArrow(run, ", ".join([LISTED, *(f"`{c}` {k}" for c, k in more.items())]))


def _flat(batch: pa.RecordBatch | pa.Table, last: str) -> tuple[np.ndarray, ...]:
    """Of each word its row and number of places, of each place the place and number of positions, and the positions; last: ends, or counts."""
    lists = {c: batch[c].combine_chunks() if isinstance(batch, pa.Table) else batch[c] for c in ("sizes", "at", last, "positions")}
    size, at, counts, positions = map(_numbers, lists.values())
    if last == "ends":
        head = np.diff(np.repeat(np.arange(len(size)), size), prepend=-1) != 0
        counts = np.where(head, counts, counts - np.concatenate([[0], counts[:-1]])) if len(counts) else counts
    return np.repeat(np.arange(batch.num_rows), pc.binary_length(lists["sizes"]).to_numpy(zero_copy_only=False) // 4), size, at, counts, positions


def blocks(listed: DataFrame, parts: int) -> DataFrame:
    """What listed() gives as blocks again, with their parts."""
    made = listed.groupBy("chunk", part_of("term", parts).alias("part"), "column").agg(F.collect_list(F.struct("term", "at", "ends", "positions")).alias("_words"))
    made = made.select("chunk", "column", F.col("_words.term").alias("terms"), F.transform("_words", lambda w: F.size(w["at"])).alias("sizes"), *(F.flatten(f"_words.{c}").alias(c) for c in ("at", "ends", "positions")), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packs = [_bytes(np.append(0, np.cumsum(_sizes(c))), c.flatten().to_numpy(zero_copy_only=False)) for c in batch.columns[3:7]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *packs, batch.column("part")], batch.schema.names)

    return made.mapInArrow(run, f"{BLOCK}, part int")


def _chosen(blocks: DataFrame, terms: pa.Array) -> DataFrame:
    """Of blocks the words that are among terms, as their places there, with the number of positions of each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, size, at, counts, positions = _flat(batch, "ends")
            word = pc.fill_null(pc.index_in(batch.column("terms").flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
            keep = word >= 0
            kept = np.repeat(keep, size)
            words = np.bincount(row[keep], minlength=batch.num_rows)
            places, own = np.bincount(row, np.where(keep, size, 0), batch.num_rows), np.repeat(row, size)[kept]
            found = np.bincount(own, counts[kept], batch.num_rows)
            offsets = lambda sizes: np.append(0, np.cumsum(sizes)).astype(np.int64)
            out = [batch.column("chunk"), batch.column("column"), _bytes(offsets(words), word[keep]), _bytes(offsets(words), size[keep]), _bytes(offsets(places), at[kept]), _bytes(offsets(places), counts[kept]), _bytes(offsets(found), positions[np.repeat(kept, counts)])]
            yield pa.RecordBatch.from_arrays(out, ["chunk", "column", "words", "sizes", "at", "counts", "positions"]).filter(pa.array(words > 0))

    schema = "chunk string, column string, words binary, sizes binary, at binary, counts binary, positions binary"
    return blocks.select("chunk", "column", "terms", "sizes", "at", "ends", "positions").mapInArrow(run, schema)


def unpacked(packed: DataFrame, lengths: DataFrame) -> DataFrame:
    """packed with a row for each word, column and id of lengths (id, chunk, at): id and positions for at, ends and positions."""
    one = packed.select("*", F.posexplode("at").alias("_nth", "_at"))
    start = F.when(F.col("_nth") > 0, F.get("ends", F.col("_nth") - 1)).otherwise(0)
    one = one.withColumn("positions", F.slice("positions", start + 1, F.get("ends", "_nth") - start))
    one = one.drop("at", "ends", "_nth").withColumnRenamed("_at", "at")
    return one.join(lengths.select("id", "chunk", "at"), ["chunk", "at"]).drop("chunk", "at")


def without(packed: DataFrame, lengths: DataFrame) -> DataFrame:
    """packed without the places that lengths (chunk, at) doesn't hold; what is then empty goes."""
    alive = lengths.groupBy("chunk").agg(F.collect_set("at").alias("_alive"))
    names = packed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, held = _sizes(batch.column("at")), _sizes(batch.column("_alive"))
            at, ends, positions, alive = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "ends", "positions", "_alive"))
            row = np.repeat(np.arange(batch.num_rows), size)
            width = int(max(at.max(initial=0), alive.max(initial=0))) + 1
            keep = np.isin(row * width + at, np.repeat(np.arange(batch.num_rows), held) * width + alive)
            first = np.diff(row, prepend=-1) != 0
            count = np.where(first, ends, ends - np.concatenate([[0], ends[:-1]])) if len(ends) else ends
            left, words = np.bincount(row[keep], minlength=batch.num_rows), np.bincount(row, np.where(keep, count, 0), batch.num_rows).astype(np.int64)
            starts = np.cumsum(words) - words
            new = {"at": _lists(np.append(0, np.cumsum(left)), at[keep]), "ends": _lists(np.append(0, np.cumsum(left)), np.cumsum(count[keep]) - starts[row[keep]]), "positions": _lists(np.append(0, np.cumsum(words)), positions[np.repeat(keep, count)])}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names).filter(pa.array(left > 0))

    schema = ", ".join(f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in names)
    return packed.join(alive, "chunk").select(*names, "_alive").mapInArrow(run, schema)


class Phrases:
    """Phrases, words with a space between, as steps from word to word; each prefix of a phrase is a node."""

    def __init__(self, phrases: list[str]):
        split = [p.split(" ") for p in phrases]
        self.terms = pa.array(sorted({t for words in split for t in words}), pa.string())
        code = {t: n for n, t in enumerate(self.terms.to_pylist())}
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for n, words in enumerate(split):
            node = -1
            for word in words:
                node = nodes.setdefault((node, code[word]), len(nodes))
            ends[node] = n
        self.number, self.size, self.longest = len(phrases), max(1, len(code)), max(map(len, split), default=0)
        steps = sorted(((node + 1) * self.size + word, to) for (node, word), to in nodes.items())
        self.steps, self.to = (np.array([s[i] for s in steps], np.int64) for i in (0, 1))
        self.phrase = np.array([ends.get(node, -1) for node in range(len(nodes))], np.int64)

    def follow(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The nodes that a word leads to, -1 where none; node -1 is the beginning."""
        if not len(self.steps):
            return np.full(len(word), -1)
        step = (node + 1) * self.size + word
        at = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
        return np.where(self.steps[at] == step, self.to[at], -1)


def matched(blocks: DataFrame, lengths: DataFrame, phrases: list[str], weights: dict[str, float]) -> DataFrame:
    """(id, length, phrases, tfs): for each of lengths (id, chunk, at, length) that has any, the places in phrases of those it has, and the weights of their columns, summed."""
    known = Phrases(phrases)
    columns = list(weights)
    worth, names = np.array([*weights.values(), 0.0]), pa.array(columns, pa.string())
    kind = lengths.schema["id"].dataType.simpleString()
    asked = _chosen(blocks, known.terms)

    def run(found: pa.Table, rows: pa.Table) -> pa.Table:
        ids = rows["id"].combine_chunks()
        hits = _hits(found, rows["at"].to_numpy(), known, names, worth) if found.num_rows and rows.num_rows else (np.zeros(0, np.int64),) * 3
        own, first = np.unique(hits[0], return_index=True)
        offsets = pa.array(np.append(first, len(hits[0])), pa.int32())
        lists = (pa.ListArray.from_arrays(offsets, pa.array(values, t)) for values, t in ((hits[1], pa.int32()), (hits[2], pa.float64())))
        return pa.Table.from_arrays([ids.take(pa.array(own)), rows["length"].combine_chunks().take(pa.array(own)), *lists], ["id", "length", "phrases", "tfs"])

    return asked.groupBy("chunk").cogroup(lengths.select("chunk", "id", "at", "length").groupBy("chunk")).applyInArrow(run, f"id {kind}, length double, phrases array<int>, tfs array<double>")


def _hits(found: pa.Table, places: np.ndarray, known: Phrases, names: pa.Array, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, phrase, tf), in order of row and phrase."""
    block, size, at, count, position = _flat(found, "counts")
    row = np.full(max(at.max(initial=0), places.max(initial=0)) + 1, -1)
    row[places] = np.arange(len(places))
    column = pc.fill_null(pc.index_in(found["column"], value_set=names), len(names)).to_numpy().astype(np.int64)[block]
    word = _numbers(found["words"].combine_chunks())
    column, word = np.repeat(column, size), np.repeat(word, size)
    row, column, word = (np.repeat(v, count) for v in (row[at], column, word))
    group = row * (len(names) + 1) + column
    alive = np.flatnonzero(row >= 0)
    order = alive[np.argsort(group[alive] * (position.max(initial=0) + 1) + position[alive], kind="stable")]
    group, position, word, row, weight = group[order], position[order], word[order], row[order], worth[column[order]]
    start, node, out = np.arange(len(order)), np.full(len(order), -1), []
    for n in range(known.longest):
        if n:
            fits = start + n < len(order)
            start, node = start[fits], node[fits]
            fits = (group[start + n] == group[start]) & (position[start + n] == position[start] + n)
            start, node = start[fits], node[fits]
        node = known.follow(node, word[start + n])
        start, node = start[node >= 0], node[node >= 0]
        whole = known.phrase[node] >= 0
        out.append((row[start[whole]] * known.number + known.phrase[node[whole]], weight[start[whole]]))
    key, inverse = np.unique(np.concatenate([o[0] for o in out]), return_inverse=True)
    return key // known.number, key % known.number, np.bincount(inverse, np.concatenate([o[1] for o in out]), len(key))


def ranked(hits: DataFrame, asked: pa.Table, phrases: list[str], idf: np.ndarray, mean: float, most: int | None) -> DataFrame:
    """(query_id, id, bm25) of what matched() gives for asked (query_id, phrase, times, need); with most, of each task the most best of a query, ties to the smaller id.

    A rank is a sum in the order of phrases, rounded to nine digits.
    """
    kinds = {c: k for c, k in hits.dtypes}
    who = asked["query_id"].combine_chunks().dictionary_encode()
    query, phrase = who.indices.to_numpy().astype(np.int64), pc.index_in(asked["phrase"], value_set=pa.array(phrases, pa.string())).to_numpy().astype(np.int64)
    times, n = asked["times"].to_numpy().astype(float), len(who.dictionary)
    need = np.zeros(n)
    np.maximum.at(need, query, asked["need"].to_numpy().astype(float))
    order = np.argsort(phrase, kind="stable")
    query, times, begin = query[order], times[order], np.searchsorted(phrase[order], np.arange(len(phrases) + 1))
    names = who.dictionary

    def scores(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = _sizes(batch.column("phrases"))
        row, code = np.repeat(np.arange(batch.num_rows), size), batch.column("phrases").flatten().to_numpy(zero_copy_only=False)
        tf, length = batch.column("tfs").flatten().to_numpy(zero_copy_only=False), batch.column("length").to_numpy(zero_copy_only=False)[row]
        part = idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        wide = np.diff(begin)[code]
        at = np.repeat(begin[code] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
        key, share = np.repeat(row, wide) * n + query[at], np.repeat(part, wide) * times[at]
        total, met = np.bincount(key, share, batch.num_rows * n), np.bincount(key, minlength=batch.num_rows * n)
        good = np.flatnonzero((met > 0) & (met >= np.tile(need, batch.num_rows)))
        return good % n, good // n, np.floor(total[good] * 1e9 + 0.5) / 1e9

    def best(q: np.ndarray, ids: pa.Array, score: np.ndarray) -> np.ndarray:
        place = np.empty(len(q), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(q))
        order = np.lexsort((place, -score, q))
        return order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < most]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda q, ids, score: pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids, pa.array(score)], ["query_id", "id", "bm25"])
        bound, held, number = np.full(n, -np.inf), [], 0
        step = max(1, HELD // max(1, n))
        for batch in (whole.slice(start, step) for whole in batches for start in range(0, whole.num_rows, step)):
            q, row, score = scores(batch)
            if most is None:
                yield out(q, batch.column("id").take(pa.array(row)), score)
                continue
            fine = score >= bound[q]
            held.append((q[fine], batch.column("id").take(pa.array(row[fine])), score[fine]))
            number += int(fine.sum())
            if number > 2 * n * most:
                held = [_kept(held, best)]
                q, _, score = held[0]
                number, last = len(q), np.flatnonzero(np.bincount(q, minlength=n) >= most)
                bound[last] = score[np.searchsorted(q, last) + most - 1]
        if held:
            yield out(*_kept(held, best))

    return hits.mapInArrow(run, f"query_id {_type_of(names.type)}, id {kinds['id']}, bm25 double")


def _kept(held: list[tuple], best: Callable) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    q, score = (np.concatenate([h[i] for h in held]) for i in (0, 2))
    ids = pa.concat_arrays([h[1] for h in held])
    keep = best(q, ids, score)
    return q[keep], ids.take(pa.array(keep)), score[keep]


def _type_of(kind: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()
