"""Packing tokenised documents into fixed windows by non-negative least squares (operator 2).

Whole windows are cut from long documents first. What remains of each document is a piece shorter than
a window. Lengths, in steps of a 64th of the window, make a histogram; the shallow combinations (at
most three lengths) that fill a window are its columns, non-negative least squares solves how often to
repeat each against the histogram, the counts are rounded down, and what they leave is packed greedily,
cutting pieces where that closes a gap. What stands last in a shard is cut at powers of two, which need
no padding, so a shard pads nothing.

Each task packs its own shards of bounded size, so no token is shuffled and no group can grow: a shard
is solved against its own histogram. Reruns agree as long as the input is split alike.

A null text is empty, and an empty one has only the end id. Repeated rows are packed each; other columns
are not read, whatever their names. A very long text is tokenized whole and cut into as many pieces as its sequences
need. An empty table gives no sequences.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows

STEPS = 64
#: White space that libraries disagree on, or that normalisation may change, and letters whose lower case they take differently.
_ODD = re.compile(r"[\u0130\u03a3\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by the active sets of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tiny = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[passive] = -np.inf
        if passive.all() or slope.max() <= tiny:
            break
        passive[int(slope.argmax())] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (z[passive] > 0).all():
                break
            low = passive & (z <= 0)
            x += float((x[low] / (x[low] - z[low] + 1e-300)).min()) * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = z
    return x


def combinations(steps: int = STEPS, depth: int = 3) -> list[tuple[int, ...]]:
    """Every multiset of at most depth lengths that add up to steps."""
    found = []
    for k in range(1, depth + 1):
        for head in itertools.combinations_with_replacement(range(1, steps + 1), k - 1):
            last = steps - sum(head)
            if last >= (head[-1] if head else 1):
                found.append((*head, last))
    return found


_columns: dict[int, tuple[list[tuple[int, ...]], np.ndarray]] = {}


def _strategies(steps: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    if steps not in _columns:
        found = combinations(steps)
        matrix = np.zeros((steps, len(found)))
        for j, lengths in enumerate(found):
            for length in lengths:
                matrix[length - 1, j] += 1
        _columns[steps] = found, matrix
    return _columns[steps]


def pack(lengths: list[int], window: int, steps: int = STEPS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in it, length) that hold each item's every token once. lengths: below window."""
    steps = min(steps, window)
    size = -(-window // steps)
    waiting: dict[int, list[int]] = defaultdict(list)
    for i, length in enumerate(lengths):
        if length:
            waiting[min(steps, -(-length // size))].append(i)
    histogram = np.array([len(waiting[k]) for k in range(1, steps + 1)], float)
    found, matrix = _strategies(steps)
    filled: list[list[tuple[int, int, int]]] = []
    if histogram.any():
        repeats = nnls(matrix, histogram)
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] < 1:
                break
            need = {k: found[j].count(k) for k in set(found[j])}
            for _ in range(min(int(repeats[j]), *(len(waiting[k]) // n for k, n in need.items()))):
                whole = [waiting[k].pop() for k in found[j]]
                if sum(lengths[i] for i in whole) > window:  # only where steps don't divide the window
                    for i, k in zip(whole, found[j]):
                        waiting[k].append(i)
                    break
                filled.append([(i, 0, lengths[i]) for i in whole])
    left = sorted((i for items in waiting.values() for i in items), key=lambda i: (-lengths[i], i))
    by_room: dict[int, list[int]] = defaultdict(list)  # best fit: sequences by the steps they have left
    room: list[int] = []
    opened: list[list[tuple[int, int, int]]] = []
    for i in left:
        need = -(-lengths[i] // size)
        for k in range(need, steps + 1):
            while by_room[k] and room[by_room[k][-1]] // size != k:
                by_room[k].pop()
            if by_room[k]:
                s = by_room[k].pop()
                break
        else:
            s = len(opened)
            opened.append([])
            room.append(window)
        opened[s].append((i, 0, lengths[i]))
        room[s] -= lengths[i]
        if room[s] >= size:
            by_room[room[s] // size].append(s)
    out = sorted(filled + opened, key=lambda s: -sum(p[2] for p in s))
    fill, last = 0, len(out) - 1  # the emptiest sequence gives its pieces, cut as need be, to the fullest with a gap
    while fill < last:
        gap = window - sum(p[2] for p in out[fill])
        while gap and fill < last:
            i, start, length = out[last].pop()
            taken = min(gap, length)
            out[fill].append((i, start, taken))
            gap -= taken
            if taken < length:
                out[last].append((i, start + taken, length - taken))
            if not out[last]:
                out.pop()
                last -= 1
        fill += 1
    if out:
        rest = out.pop()
        for seq in _at_powers(rest, window):
            out.append(seq)
    return out


def _at_powers(pieces: list[tuple[int, int, int]], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces in sequences whose lengths are the window or powers of two."""
    total, pieces = sum(p[2] for p in pieces), pieces[::-1]
    sizes = [window] * (total // window)
    sizes += [1 << b for b in reversed(range(total.bit_length() + 1)) if (total % window) >> b & 1]
    for size in sizes:
        seq = []
        while size:
            i, start, length = pieces.pop()
            taken = min(size, length)
            seq.append((i, start, taken))
            size -= taken
            if taken < length:
                pieces.append((i, start + taken, length - taken))
        yield seq


#: Between an ASCII letter or digit and a mark the tokenizer always splits; not so before an apostrophe.
_BEFORE, _MARK = (np.isin(np.arange(256), np.frombuffer(c, np.uint8)) for c in (b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b'.,;:!?$%&*#|)"]}'))


def _apart(texts: pa.Array) -> pa.Array:
    """texts, large strings, with a space where the tokenizer splits anyway, so that fewer units differ."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    marks = np.flatnonzero(_MARK[held])
    marks = marks[marks > 1]
    before, lead = held[marks - 1], held[marks - 2]
    # U+00C0 to U+017F, two bytes, are letters but for the signs of multiplication and division
    cuts = marks[_BEFORE[before] | (before > 127) & ((lead == 0xC3) & (before != 0x97) & (before != 0xB7) | (lead == 0xC4) | (lead == 0xC5))]
    new = at - at[0]
    cuts = np.setdiff1d(cuts, new, assume_unique=False)
    spaced = np.insert(held, cuts, 32)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(new + np.searchsorted(cuts, new)), pa.py_buffer(spaced))


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models have for each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in prints)}


_BYTES = _byte_letters()


class Ids(dict):
    """Little-endian unsigned 32-bit ids of a unit between white space.

    Texts are put in lower case and split before marks first, as the tokenizer does itself, so few
    different units remain. Bounded: when a generation is full it becomes the old one, from which what is
    used again is taken over.
    """

    def __init__(self, path: str, room: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.room, self.old = Tokenizer.from_file(path), room, {}
        self.model = self.tokenizer.model
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split, normal = json.dumps(spec.get("pre_tokenizer")), json.dumps(spec.get("normalizer"))
        self.cuts = '"Removed"' in split and '"invert": true' in split and '"add_prefix_space": true' not in split
        self.lowers = self.cuts and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and '"ByteLevel"' in split and '"Lowercase"' in normal and '"NFC"' in normal and r"[\\p{L}]+" in split and r"[^\\s\\p{L}\\p{N}]+" in split
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens") or []) or r"(?!)")

    def encode(self, text: str) -> bytes:
        # letters alone are one pre-token as they stand, so the model can have them at once
        if self.lowers and text.isalpha() and max(text) < "\u0250" and text.islower():
            return array("I", [t.id for t in self.model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(_BYTES))]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = self.encode(unit)
        if len(unit) <= 64:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[unit] = ids
        return ids

    def of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. Units are told apart by Arrow, so each is looked up once for all texts."""
        out, at, plain = [b""] * len(texts), [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.cuts or self.special.search(text) or _ODD.search(text) or self.lowers and not (text.isascii() or unicodedata.is_normalized("NFC", text)):
                out[i] = self.encode(text)
            else:
                at.append(i)
                plain.append(text.lower() if self.lowers else text)
        if not plain:
            return out
        split = pc.ascii_split_whitespace(_apart(pa.array(plain, pa.large_string())) if self.lowers else pa.array(plain, pa.large_string()))
        coded = split.values.dictionary_encode()
        units = [self[u] for u in coded.dictionary.to_pylist()]
        known = np.frombuffer(b"".join(units), "<u4")
        length = np.fromiter(map(len, units), np.int64, len(units)) // 4
        code = coded.indices.to_numpy()
        counts = length[code]
        ends = np.r_[0, np.cumsum(counts)]
        ids = known[np.repeat((np.cumsum(length) - length)[code] - ends[:-1], counts) + np.arange(ends[-1])].tobytes()
        cut = (4 * ends[split.offsets.to_numpy()]).tolist()
        for i, start, stop in zip(at, cut, cut[1:]):
            out[i] = ids[start:stop]
        return out


def _in_parts(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batches in parts of about size bytes of text, with the texts."""
    for batch in arrow_rows(batches, 2000):
        texts = batch.column(1).to_pylist()
        start = held = 0
        for i, text in enumerate(texts):
            held += len(text or "")
            if held >= size:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


_encoders: dict[str, Ids] = {}


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 4_000_000, with_ids: bool = False) -> DataFrame:
    """A row for each piece: its document's id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: also ids.

    A document's ids are the tokenizer's and end_id. Sequences have at most window ids, padded up to it
    except at a power of two. shard_tokens bounds what a task packs and holds at once.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer)
        if encoder is None:
            encoder = _encoders[tokenizer] = Ids(tokenizer)
        ending = np.array([end_id], "<u4").tobytes()
        sequence = (TaskContext.get().partitionId() << 32) - 1
        rows: list[tuple] = []
        shard: list[tuple] = []
        held = 0

        def given() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 8
            kinds = (id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(b, "<u4").astype("i4") for b in columns[7]], pa.list_(pa.int32())))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        def flush() -> None:
            nonlocal sequence
            for seq in pack([len(ids) // 4 for _, _, ids, _ in shard], window):
                sequence += 1
                offset = 0
                for i, start, length in seq:
                    doc, before, ids, total = shard[i]
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, before + start, length, zlib.crc32(part), total, sequence, offset, part if with_ids else None))
                    offset += length
            shard.clear()

        id_type = None
        for batch, texts in _in_parts(batches):
            id_type = batch.column(0).type
            for doc, found in zip(batch.column(0).to_pylist(), encoder.of(texts)):
                ids = found + ending
                total = len(ids) // 4
                whole = total // window
                for k in range(whole):
                    sequence += 1
                    part = ids[4 * window * k : 4 * window * (k + 1)]
                    rows.append((doc, window * k, window, zlib.crc32(part), total, sequence, 0, part if with_ids else None))
                    if with_ids and len(rows) >= 500:
                        yield given()
                if total % window:
                    shard.append((doc, whole * window, ids[4 * window * whole :], total))
                    held += total % window
                if held >= shard_tokens:
                    flush()
                    held = 0
            if len(rows) >= 20_000:
                yield given()
        if id_type is not None:
            flush()
            yield given()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(packed, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)
