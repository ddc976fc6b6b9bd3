"""Byte-level BPE encoding and decoding by a dynamic program over prefixes (operator 13).

Every prefix of a piece of text has one encoding, so it has one last token, and that is the only token ending
there that may stand behind the last token of the prefix before it. So a table of each prefix's last token
holds the encodings of all prefixes: the ids are read backwards from its end, more bytes only extend it, and
an edit leaves the pieces before and behind it alone. Whether two tokens may stand side by side is told by
the tokens at their seam, merge by merge.

A text is split into pieces by the caller's pattern. As a single space between two characters that are not
white space starts a piece of the public pattern, texts are cut there first, and units of frequent words are
kept in a bounded cache of each worker. Rows are independent, so nothing is shuffled; a batch holds a bounded
number of rows, and a text is cut, encoded and given out as one row.

Null and empty texts have no tokens; very long texts are encoded whole, a very long piece in time that grows
with its length. Rows are kept as they are, null or repeated ids too; an empty table gives an empty table. Columns
that are not named are not read, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows
from tidemark.llm.tokens import units

_NEVER = 1 << 40
_LONGEST = 64
_SHORT = 128
_PAIRS = 1 << 20
_BETWEEN = "\u0100"


def ranks_of(path: str) -> dict[bytes, int]:
    """Tokens and their ranks of a rank file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Vocabulary:
    """Encodes single pieces; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.spines: dict[int, tuple[tuple[int, ...], tuple[int, ...]] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.known, self.told = np.full(_PAIRS, -1, np.int64), np.zeros(_PAIRS, bool)
        self.letters = np.array([ranks[bytes([b])] for b in range(256)] + [0] * 512, np.int64)
        self.unmade = {token for token, rank in ranks.items() if not self.spine(rank)}
        self.back = max(map(len, ranks))
        self.endings = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1 and token not in self.unmade:
                self.endings.add_word(token.decode("latin-1"), len(token) << 32 | rank)
        self.endings.make_automaton()

    def spine(self, token: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """The tokens at the left and at the right edge while token is merged from its bytes, and token; None if merging never makes it."""
        if token not in self.spines:
            text, made = self.tokens[token], None
            if len(text) == 1:
                made = (token,), (token,)
            for cut in range(1, len(text)):
                left, right = self.ranks.get(text[:cut], _NEVER), self.ranks.get(text[cut:], _NEVER)
                if max(left, right) < _NEVER and self.spine(left) and self.spine(right) and self.seam(left, right, token):
                    made = (*self.spine(left)[0], token), (*self.spine(right)[1], token)
                    break
            self.spines[token] = made
        return self.spines[token]

    def seam(self, left: int, right: int, limit: int = _NEVER) -> bool:
        """Whether no merge of a rank below limit joins the two, while both are merged from their bytes."""
        ends, starts = self.spine(left)[1], self.spine(right)[0]
        i = j = 0
        while True:
            end_goes = ends[i + 1] if i + 1 < len(ends) else _NEVER
            start_goes = starts[j + 1] if j + 1 < len(starts) else _NEVER
            joined = self.ranks.get(self.tokens[ends[i]] + self.tokens[starts[j]], _NEVER)
            if joined < min(limit, end_goes) and joined <= start_goes:  # of equal merges the leftmost comes first
                return False
            if end_goes == start_goes == _NEVER:
                return True
            i, j = (i + 1, j) if end_goes <= start_goes else (i, j + 1)

    def fits(self, left: int, right: int) -> bool:
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        found = self.pairs[left << 32 | right] = self.seam(left, right)
        return found

    def tables(self, text: str, last: list[int], begin: int) -> None:
        """Fills last, whose place i is for the last token of the prefix of i bytes, from place begin + 1 on, where it holds
        the single bytes so far. text: the bytes as letters. Place 0 holds -1."""
        pairs, fits, done = self.pairs, self.fits, begin
        for end, found in self.endings.iter(text, max(0, begin + 1 - self.back)):
            if end >= done:  # the longest come first; once one fits, the others don't
                before, token = last[end + 1 - (found >> 32)], found & 0xFFFFFFFF
                if before < 0 or (fits(before, token) if (known := pairs.get(before << 32 | token)) is None else known):
                    last[end + 1] = token
                    done = end + 1

    def table(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of each prefix of piece, from one byte on. known: the same of a part from piece's start, which is extended."""
        known = known or []
        last = [-1, *known, *self.letters[list(piece[len(known) :])].tolist()]
        self.tables(piece.decode("latin-1"), last, len(known))
        return last[1:]

    def _fit(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each token may stand behind the one before it. What was told last is kept, one pair a slot."""
        pairs = before << 32 | tokens
        slots = (before * 0x9E3779B1 ^ tokens * 0x85EBCA77) >> 7 & _PAIRS - 1
        good = self.told[slots]
        missing = np.flatnonzero(self.known[slots] != pairs)
        if len(missing):
            new, where = np.unique(pairs[missing], return_inverse=True)
            fresh = np.array([self.seam(p >> 32, p & 0xFFFFFFFF) for p in new.tolist()], bool)[where]
            good[missing] = fresh
            self.known[slots[missing]], self.told[slots[missing]] = pairs[missing], fresh
        return good

    def encode_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece. One table over all short ones is filled a place of every piece at a time."""
        if len(pieces) < 32:
            return [tuple(self.encode(p)) for p in pieces]
        short = [p for p in pieces if len(p) <= _SHORT and p not in self.unmade]
        found = dict(zip(short, self._encode_short(short)))
        return [found[p] if p in found else tuple(self.encode(p)) for p in pieces]

    def _encode_short(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        if not pieces:
            return []
        text = _BETWEEN.join(p.decode("latin-1") for p in pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes + 1) - sizes - 1
        met = np.fromiter(chain.from_iterable(self.endings.iter(text)), np.int64)
        end, token = met[::2] + 1, met[1::2] & 0xFFFFFFFF
        begin = end - (met[1::2] >> 32)
        place = end - np.repeat(starts, sizes + 1)[end - 1]
        order = np.argsort(place.astype(np.int16), kind="stable")
        last = np.empty(len(text) + 1, np.int64)
        last[1:] = self.letters[np.frombuffer(text.encode("utf-16-le"), np.uint16)]  # single bytes stand where no longer token does
        last[starts] = -1
        for at in np.split(order, np.cumsum(np.bincount(place))[:-1])[1:]:
            before, own = last[begin[at]], token[at]
            good = before == -1
            open_pairs = np.flatnonzero(before >= 0)
            good[open_pairs] = self._fit(before[open_pairs], own[open_pairs])
            last[end[at[good]]] = own[good]
        # the ids, from each piece's end back
        now, piece, steps = starts + sizes, np.arange(len(pieces)), []
        while len(piece):
            ids = last[now[piece]]
            steps.append((piece, ids))
            now[piece] -= self.spelled[1][ids]
            piece = piece[now[piece] > starts[piece]]
        piece, ids = (np.concatenate(x) for x in zip(*steps))
        turn = np.repeat(np.arange(len(steps)), [len(x) for x, _ in steps])
        flat = ids[np.lexsort((-turn, piece))].tolist()
        ends = np.cumsum(np.bincount(piece)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def traced(self, table: list[int]) -> list[int]:
        """The ids of the text whose table it is."""
        ids, end = [], len(table)
        while end:
            ids.append(table[end - 1])
            end -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return self.traced(self.table(piece)) if whole is None else [whole]

    @functools.cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each id's place and length in the bytes of all tokens, and these."""
        order = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        sizes = np.array(list(map(len, order)), np.int64)
        return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(order), np.uint8)

    @functools.cached_property
    def names(self) -> list[str]:
        """Each id in decimals."""
        return list(map(str, range(max(self.tokens) + 1)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@dataclass(frozen=True)
class Pattern:
    r"""A pattern for regex. Of the characters odd, whose class in \s or \p{..} differs from tiktoken's, whose Unicode
    may be another version, plain says other things than tiktoken does; exact, which is slower, says the same."""

    plain: str
    exact: str
    odd: str


@functools.cache
def pattern_of(pattern: str) -> Pattern:
    import tiktoken

    bytes_only = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    odd: set[str] = set()

    def chosen(found: re.Match) -> str:
        name = found.group()
        theirs = set(bytes(tiktoken.Encoding("one class", pat_str=name, mergeable_ranks=bytes_only, special_tokens={}).encode_ordinary(every)).decode())
        ours = set(regex.findall(name, every))
        odd.update(theirs ^ ours)
        more, less = (regex.escape("".join(sorted(s))) for s in (theirs - ours, ours - theirs))
        name = f"[{name}||[{more}]]" if more else name
        return f"[{name}--[{less}]]" if less else name

    exact = "(?V1)" + re.sub(r"\\s|\\p\{\w+\}", chosen, pattern)
    return Pattern(pattern, exact, "".join(sorted(odd)))


class Encoder:
    """Encodes whole texts in one process."""

    def __init__(self, ranks: dict[bytes, int], pattern: Pattern, by_units: bool, room: int = 500_000):
        self.vocabulary, self.by_units, self.room = Vocabulary(ranks), by_units, room
        self.pattern, self._exact, self.odd = regex.compile(pattern.plain), pattern.exact, frozenset(pattern.odd)
        self.units, self.old, self.pieces = {}, {}, {}

    def splitter(self, text: str) -> regex.Pattern:
        return self.pattern if self.odd.isdisjoint(text) else self.exact

    @functools.cached_property
    def exact(self) -> regex.Pattern:
        return regex.compile(self._exact)

    def plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.vocabulary.encode_all([p.encode() for p in self.splitter(text).findall(text)])))

    def learn(self, new: set[str]) -> None:
        """Puts the ids of units, each behind a space, into the cache.

        A full cache becomes the old one, from which what is asked for again comes back without work.
        """
        if len(self.units) > self.room:
            self.old, self.units = self.units, {}
        if len(self.pieces) > self.room:
            self.pieces.clear()
        again = self.old.keys() & new
        self.units.update((u, self.old[u]) for u in again)
        new = list(new - again)
        splits = [[p] if u.isascii() and u.isalpha() else self.splitter(u).findall(p) for u, p in zip(new, map(" ".__add__, new))]
        missing = [p for p in set(chain.from_iterable(splits)) if p not in self.pieces]
        self.pieces.update(zip(missing, self.vocabulary.encode_all([p.encode() for p in missing])))
        get = self.pieces.__getitem__
        self.units.update((u, get(split[0]) if len(split) == 1 else tuple(chain.from_iterable(map(get, split)))) for u, split in zip(new, splits))
        for p in missing:
            if len(p) > _LONGEST:
                del self.pieces[p]

    def many(self, texts: list[str | None]) -> list[list[int]]:
        if not self.by_units:
            return [list(self.plain(t)) if t else [] for t in texts]
        cut = [units(t) if t else [""] for t in texts]
        asked = set(chain.from_iterable(cut))
        room, self.room = self.room, min(self.room, max(0, self.room - len(asked)))
        known = self.units if len(self.units) <= self.room else ()
        self.learn({u for u in asked if u not in known})
        self.room = room
        get = self.units.__getitem__
        out = [list(chain(self.plain(head), chain.from_iterable(map(get, rest)))) for head, *rest in cut]
        for u in asked:
            if len(u) > _LONGEST:
                del self.units[u]
        return out

    def __call__(self, text: str | None) -> list[int]:
        return self.many([text])[0]

    def state(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """(ids, each piece's number of ids, the last piece's table)."""
        pieces = [p.encode() for p in self.splitter(text or "").findall(text or "")]
        each = [self.vocabulary.encode(p) for p in pieces]
        return list(chain.from_iterable(each)), list(map(len, each)), self.vocabulary.table(pieces[-1]) if pieces else []

    def edited(self, text: str, ids: list[int], pieces: list[int], tail: list[int], start: int, stop: int, new: str) -> tuple[str, list[int], list[int], list[int]]:
        """Text and state after new has taken the place of text[start:stop]; only pieces near it are split and encoded again.

        A piece of the public pattern depends on two characters behind it at most, so those that end so
        far before start stay; behind the edit, pieces stay from the first boundary that the old text had too.
        """
        old, raw = np.asarray(ids, np.int64), text.encode()
        lengths = np.fromiter((len(self.vocabulary.tokens[i]) for i in ids), np.int64, len(ids))
        token_ends = np.cumsum(pieces, dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(lengths)))[token_ends] if len(pieces) else token_ends  # in bytes
        safe = len(text[: max(0, start - 2)].encode())
        keep = int(np.searchsorted(ends, safe, "right"))  # pieces before the edit that stay
        at = int(ends[keep - 1]) if keep else 0
        begin = len(raw[:at].decode())
        changed = text[:start] + new + text[stop:]
        shift = len(new.encode()) - len(text[start:stop].encode())
        fresh, resume, end, last = [], len(pieces), at, b""
        behind = len(text[:start].encode()) + len(new.encode())
        for found in self.splitter(changed).finditer(changed, begin):
            last = found.group().encode()
            known = None
            if end == (int(ends[-2]) if len(ends) > 1 else 0) and len(ends) and raw[end:] and last.startswith(raw[end:]):
                known = list(tail)  # the old last piece has only grown
            end += len(last)
            whole = self.vocabulary.ranks.get(last)
            tail_now = self.vocabulary.table(last, known)
            fresh.append([whole] if whole is not None else self.vocabulary.traced(tail_now))
            same = int(np.searchsorted(ends, end - shift))
            if end >= behind and same < len(ends) and ends[same] == end - shift:
                resume = same + 1
                break
        else:
            resume = len(pieces)
        first = int(token_ends[keep - 1]) if keep else 0
        rest = int(token_ends[resume - 1]) if resume else 0
        ids_now = old[:first].tolist() + list(chain.from_iterable(fresh)) + old[rest:].tolist()
        pieces_now = [*pieces[:keep], *map(len, fresh), *pieces[resume:]]
        if resume < len(pieces) or not changed:
            return changed, ids_now, pieces_now, list(tail) if changed else []
        if fresh:
            return changed, ids_now, pieces_now, tail_now
        kept_last = raw[int(ends[keep - 2]) if keep > 1 else 0 : at] if keep else b""
        return changed, ids_now, pieces_now, self.vocabulary.table(kept_last)


_workers: dict[tuple, Encoder] = {}


def _factory(path: str, pattern: str):
    """A function that gives a worker's encoder, made once there."""
    import public_tokenizers

    found, by_units = pattern_of(pattern), pattern == public_tokenizers.PATTERN

    def encoder() -> Encoder:
        key = path, pattern
        if key not in _workers:
            _workers.clear()
            _workers[key] = Encoder(ranks_of(path), found, by_units)
        return _workers[key]

    return encoder


def _mapped(rows: DataFrame, function, schema: str) -> DataFrame:
    """Each row's Arrow columns through function, a list of columns for a list of columns."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 500):
            made = function(*batch.columns)
            yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

    return rows.mapInArrow(each, schema)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", state: bool = False) -> DataFrame:
    """A row for each row of docs: its id and ids, by the ranks of the file path, which every worker has.

    With state also pieces (the number of ids of each piece) and tail (the last piece's table), which
    edited() takes, and the text.
    """
    encoder = _factory(path, pattern)

    def plain(keys, texts):
        ids = [np.array(i, np.int32) for i in encoder().many(texts.to_pylist())]
        ends = np.concatenate(([0], np.cumsum(list(map(len, ids))))).astype(np.int32)
        return {id_col: keys, "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))}

    def whole(keys, texts):
        ids, pieces, tails = zip(*map(encoder().state, texts.to_pylist()))
        kind = pa.list_(pa.int32())
        return {id_col: keys, text_col: texts, "ids": pa.array(ids, kind), "pieces": pa.array(pieces, kind), "tail": pa.array(tails, kind)}

    rows = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    if state:
        return _mapped(rows, whole, f"`{id_col}` {kind}, `{text_col}` string, ids array<int>, pieces array<int>, tail array<int>")
    return _mapped(rows, plain, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """A row for each row of encoded: its id and content, the bytes that its ids stand for (null ids: none)."""
    import public_tokenizers

    encoder = _factory(path, public_tokenizers.PATTERN)

    def contents(keys, lists):
        starts, sizes, letters = encoder().vocabulary.spelled
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes[ids], dtype=np.int64)
        place = np.repeat(starts[ids] - np.concatenate(([0], ends))[:-1], sizes[ids]) + np.arange(ends[-1] if len(ends) else 0)
        counts = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        bounds = np.concatenate(([0], np.concatenate(([0], ends))[counts])).astype(np.int32)
        return {id_col: keys, "content": pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(bounds), pa.py_buffer(letters[place])])}

    return _mapped(encoded.select(id_col, ids_col), contents, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, content binary")


def edited(encoded: DataFrame, start: Column, stop: Column, new: Column, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode(state=True)'s rows after new has taken the place of the text's characters from start (from 0) up to stop.

    Only the pieces near the edit are encoded again. A row whose start, stop or new is null stays; places
    outside the text count as its ends; an append has both behind the text. pattern: the public one.
    """
    encoder = _factory(path, pattern)

    def changed(keys, texts, ids, pieces, tails, starts, stops, news):
        call, out = encoder(), []
        for text, i, p, t, a, b, n in zip(*(c.to_pylist() for c in (texts, ids, pieces, tails, starts, stops, news))):
            if None not in (a, b, n):
                size = len(text or "")
                a = min(max(a, 0), size)
                text, i, p, t = call.edited(text or "", i, p, t, a, min(max(a, b), size), n)
            out.append((text, i, p, t))
        text, i, p, t = zip(*out)
        kind = pa.list_(pa.int32())
        return {id_col: keys, text_col: pa.array(text, pa.string()), "ids": pa.array(i, kind), "pieces": pa.array(p, kind), "tail": pa.array(t, kind)}

    rows = encoded.select(id_col, text_col, "ids", "pieces", "tail", start.cast("long").alias("_a"), stop.cast("long").alias("_b"), new.cast("string").alias("_new"))
    return _mapped(rows, changed, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, `{text_col}` string, ids array<int>, pieces array<int>, tail array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """A row for each document: n_tokens, and digests of the ids that encode() gives and of the bytes that decode() makes of them, in one pass."""
    encoder = _factory(path, pattern)

    def digests(keys, texts):
        call, made = encoder(), texts.to_pylist()
        lists = call.many(made)
        names, get = call.vocabulary.names, call.vocabulary.tokens.__getitem__
        told = [hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest() for ids in lists]
        back = [hashlib.sha256(b"".join(map(get, ids))).hexdigest() for ids in lists]
        return {"doc_id": keys, "n_tokens": pa.array(map(len, lists), pa.int64()), "ids_sha256": told, "decoded_sha256": back}

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return _mapped(rows, digests, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
