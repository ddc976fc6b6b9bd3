"""Similarity join of documents on word shingles by chosen paths (operator 5).

Texts with equal sets of shingles are one representative with a count. Minimum hashes make each set a
vector of 128 tokens. In each run, and on each level of it, a position is drawn, another one for each
path; every set follows the path of its token there, so sets split into buckets that share the tokens
drawn so far. Buckets of moderate size are brute-forced, larger ones split again; what is still large on
the last level is brute-forced in tiles of bounded size. Runs repeat until a pair at the threshold is met
with the target probability even where it has to survive every level. (Drawing a random number of
positions, 1/similarity on average, costs more rows for the same recall while levels are few.)

Brute force compares the token vectors and gives out stars of local components, never all pairs. The
first runs show the components of what is alike; in the others a large component stands in a bucket
by its centre: Hamming distance of token vectors is a metric, so sets farther from the centre than the
component's reach allows are near none of it, and where all are that far the component leaves the bucket.
The components of these candidates then hold every pair that can be near; inside each one an exact check of
the whole shingle sets, again in tiles, counts links and yields the stars of exact links, whose
components are the classes. So a link between two texts is counted once, whichever buckets they met in.

Words are the runs of characters other than space and \\t to \\r, unchanged; shingles are of five words.
A text of one to four words is one shingle of them all. A null text, or one without words, links with
nothing. Rows with a null or repeated id are documents of their own; a class is named after its smallest
id that is not null. Other columns are not read, whatever their names. A very long text is compared by all its
shingles. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, drop, scratch, shielded, staged, text_key, unshielded
from tidemark.llm.components import components, roots_of
from tidemark.llm.substrings import Rolling, word_hashes

TOKENS, LEVELS, LIMIT, TILE = 128, 3, 128, 512
_rng = np.random.default_rng(20240201)
_A = (_rng.integers(0, 1 << 31, TOKENS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, TOKENS, dtype=np.uint32)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = word_hashes(text)
    if not len(words):
        return words
    roll, size = Rolling(words), min(size, len(words))
    at = np.arange(len(words) - size + 1)
    return np.unique(roll.runs(at, at + size))


def tokens(found: np.ndarray) -> np.ndarray:
    """The set's minimum hashes."""
    h = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(TOKENS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(h), 2048):
        np.minimum(out, (h[at : at + 2048, None] * _A + _B).min(axis=0), out=out)
    return out


def runs_needed(recall: float, levels: int, similarity: float = 0.8) -> int:
    """Runs until a pair at the threshold has survived all levels of one with this probability: each keeps it with probability similarity."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**levels)))


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _next_paths(level: int, runs: range) -> Callable:
    """node, run, path and tokens of sets to node, run and path on the next level; level 0 starts every run."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 20_000):
            if not batch.num_rows:
                continue
            node, run, path = (batch.column(i).to_numpy() for i in range(3))
            token = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, TOKENS).astype(np.uint64)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for r in runs if level == 0 else (None,):
                number = run if r is None else np.full(len(node), r, np.int32)
                seed = _scrambled(path.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (number * LEVELS + level + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                drawn = (seed >> np.uint64(7)) % np.uint64(TOKENS)
                h = _scrambled(seed + token[np.arange(len(node)), drawn.astype(np.int64)] * np.uint64(0xC2B2AE3D27D4EB4F))
                out.append((node, number, h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["node", "run", "path"])

    return follow


def _tiles(rows: DataFrame, sizes: DataFrame, key: str, tile: int) -> DataFrame:
    """rows with (one, two, own): every pair of a group's tiles, and the row's own tile in it. sizes: key, n."""
    tiled = rows.join(sizes.select(key, F.ceil(F.col("n") / tile).cast("int").alias("tiles")), key)
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return tiled.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")}).drop("other", "tiles")


def _bucket_tiles(paths: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, node, one, two, own) of buckets, sizes: path, n, their major component and its m members.

    A bucket of at most TILE sets is one tile. In a larger one the major component, whose sets are linked
    already, has tiles of its own, which meet the others' tiles but not each other; so it costs a row for
    each set and tile of the others, not for each pair of its own tiles.
    """
    rows = paths.join(sizes, "path")
    major, whole = F.col("component") == F.col("major"), F.col("n") <= TILE
    ours, others = F.ceil(F.col("m") / TILE).cast("int"), F.ceil((F.col("n") - F.col("m")) / TILE).cast("int")
    place = F.xxhash64("node")
    own = F.when(whole, 0).when(major, F.pmod(place, ours)).otherwise(ours + F.pmod(place, others)).cast("int")
    met = F.when(whole, F.array(F.lit(0))).when(major, F.sequence(ours, ours + others - 1)).otherwise(F.sequence(F.lit(0), ours + others - 1))
    tiled = rows.select("path", "node", own.alias("own"), F.explode(met).alias("other"))
    return tiled.select("path", "node", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own")


def _by_group(compare: Callable[[pa.Table, bool], Iterator[tuple]], names: list[str], kinds: list[pa.DataType]) -> Callable:
    """For partitions sorted by (key, one, two), the first three columns: compare() of each group's rows, own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.stack([table.column(i).to_numpy().astype(np.int64) for i in range(3)])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            out: list[tuple] = []
            for start, stop in zip(np.r_[0, cut].tolist(), np.r_[cut, table.num_rows].tolist()):
                if stop - start > 1:
                    out.append(compare(table.slice(start, stop - start), bool(keys[1, start] != keys[2, start])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            keys = np.stack([held.column(i).to_numpy().astype(np.int64) for i in range(3)])
            last = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            if len(last):  # all groups but the last are complete
                at = int(last[-1]) + 1
                yield from groups(held.slice(0, at))
                held = held.slice(at)
        if held is not None and held.num_rows:
            yield from groups(held)

    return run


def _stars(linked: Callable[[np.ndarray, np.ndarray], np.ndarray], node: np.ndarray, own: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """linked(i, j): a matrix for two ranges of rows. Nodes with links, the local root of each, and the matrix."""
    left = np.flatnonzero(own == own.min()) if split else np.arange(len(node))
    right = np.flatnonzero(own != own.min()) if split else left
    met = linked(left, right)
    if not split:
        np.fill_diagonal(met, False)
    i, j = np.nonzero(met)
    root = roots_of(left[i], right[j], len(node))
    return met, root, np.concatenate([left, right]) if split else left


def _alike(least: float) -> Callable:
    """Stars of the sets whose token vectors agree in the share least."""

    def compare(table: pa.Table, split: bool) -> tuple:
        node, own = table.column("node").to_numpy(), table.column("own").to_numpy()
        token = np.stack([np.frombuffer(t, np.uint8) for t in table.column("brief").to_pylist()])
        if len(node) == 2:
            near = (token[0] == token[1]).mean() >= least
            return (node[:1], node[1:]) if near else (node[:0], node[:0])

        def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            same = np.zeros((len(i), len(j)), np.int16)
            for p in range(TOKENS):
                same += token[i, p][:, None] == token[j, p]
            return same >= least * TOKENS

        if not split:
            root = _stars(linked, node, own, split)[1]
            far = np.flatnonzero(root != np.arange(len(node)))
            return node[far], node[root[far]]
        left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
        if not len(right):
            return node[:0], node[:0]
        # each tile's own stars come from its own group; between two tiles one edge for two of their components is enough
        one, two = (part[roots_of(*np.nonzero(linked(part, part)), len(part))] for part in (left, right))
        i, j = np.nonzero(linked(left, right))
        root = roots_of(one[i], two[j], len(node))
        met = np.unique(np.concatenate([one[i], two[j]]))
        far = met[root[met] != met]
        return node[far], node[root[far]]

    return _by_group(compare, ["a", "b"], [pa.int64(), pa.int64()])


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many hashes sets i and j share, from blocks of exact 0/1 products."""
    used = np.unique(np.concatenate([i, j]))
    found, at = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
    row = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(i), len(j)))
    place = np.zeros(int(used.max()) + 1, int)
    place[used] = np.arange(len(used))
    step = max(1024, (1 << 23) // len(used))
    for start in range(0, len(found), step):
        a, b = np.searchsorted(at, [start, start + step])
        block = np.zeros((len(used), min(step, len(found) - start)), np.float32)
        block[row[a:b], at[a:b] - start] = 1
        out += block[place[i]] @ block[place[j]].T
    return out


def _exact(similarity: float) -> Callable:
    """Nodes with exact links, a root of their local stars, and the number of documents they link with."""

    def compare(table: pa.Table, split: bool) -> tuple:
        node, own, n = (table.column(c).to_numpy() for c in ("node", "own", "n"))
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        nothing = node[:0], node[:0], node[:0]
        if split and own.min() == own.max():
            return nothing
        sizes = np.array([len(s) for s in sets])
        if len(node) == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            return (node, node[[0, 0]], n[::-1]) if both / (sizes.sum() - both) >= similarity else nothing

        def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            both = overlaps(sets, i, j)
            return both / (sizes[i][:, None] + sizes[j] - both) >= similarity

        met, root, order = _stars(linked, node, own, split)
        if split:
            left = (own == own.min()).sum()
            links = np.concatenate([met @ n[order[left:]], met.T @ n[order[:left]]])
        else:
            links = met @ n
        some = links > 0
        return node[order][some], node[root[order]][some], links[some].astype(np.int64)

    return _by_group(compare, ["node", "root", "links"], [pa.int64()] * 3)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "key", "high", "low", "tokens"]
    for batch in arrow_rows(batches, 500):
        high, low, made = [], [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text)
            if not len(found):
                high.append(None)
                low.append(None)
                made.append(None)
                continue
            h = xxhash.xxh3_128_intdigest(found.tobytes())
            high.append((h >> 64) - (1 << 63))
            low.append((h & ((1 << 64) - 1)) - (1 << 63))
            made.append(tokens(found).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(made, pa.binary())], names)


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_rows(batches, 200):
        made = [shingles(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], [*batch.schema.names[:-1], "shingles"])


def candidates(sets: DataFrame, similarity: float, recall: float, slack: float = 0.16) -> DataFrame:
    """Stars (a, b) of the nodes of sets (node, tokens, brief) that met in a bucket and look near.

    slack lets pass what 128 tokens can underestimate: over four and a half standard deviations. The first
    two runs join most of what is near; the others pass over buckets within one of the components known by
    then, compare a large bucket's largest component with none of its own, and only with sets that its
    centre can't rule out.
    """
    runs = runs_needed(recall, LEVELS, similarity)
    briefs = sets.select("node", "brief")
    found, known = None, None
    for part in (range(min(2, runs)), range(2, runs)):
        if not len(part):
            break
        if found is not None:
            groups = staged(components(found), "groups")
            centres = groups.filter("node = component").join(briefs, "node").select("component", F.col("brief").alias("centre"))
            placed = groups.join(briefs, "node").join(centres, "component").select("node", "component", "brief", "centre")
            known = staged(placed.mapInArrow(_distances, "node long, component long, far int"), "known")
            drop(groups)
        more = staged(_met(sets, similarity, slack, part, known), "candidates")
        found = more if found is None else found.union(more)
    return found


def _apart(brief: pa.Array, centre: pa.Array) -> np.ndarray:
    """In how many positions two columns of token vectors differ."""
    one, two = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, TOKENS) for c in (brief, centre))
    return (one != two).sum(axis=1).astype(np.int32)


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_rows(batches, 10_000):
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(_apart(*batch.columns[2:]))], ["node", "component", "far"])


def _in_reach(least: float) -> Callable:
    """Of sets with a centre and its component's reach, those that some set of the component may agree with in the share least."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 10_000):
            if batch.num_rows:
                apart = _apart(batch.column("brief"), batch.column("centre"))
                some = apart - batch.column("reach").to_numpy() <= (1 - least) * TOKENS
                yield batch.select(["node", "run", "path"]).filter(pa.array(some))

    return kept


def _bucketed(paths: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """paths with each set's component, and (path, n, major, m, reach) of buckets with sets of several components."""
    paths = paths.join(known, "node", "left").withColumns({"component": F.coalesce("component", "node"), "far": F.coalesce("far", F.lit(0))})
    parts = paths.groupBy("path", "component").agg(F.count("*").alias("n"), F.max("far").alias("reach"))
    sizes = parts.groupBy("path").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component", "reach")).alias("major"))
    return paths, sizes.filter(F.col("n") > F.col("major.n")).select("path", "n", F.col("major.component").alias("major"), F.col("major.n").alias("m"), F.col("major.reach").alias("reach"))


def _pruned(paths: DataFrame, known: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(node, run, path) of buckets in which something can be found, major components left out where their centre allows.

    The other sets of such a bucket make a bucket of their own, and those in reach meet the component.
    """
    paths, sizes = _bucketed(paths, known)
    sizes = staged(sizes, "parted")
    large = sizes.filter(F.col("m") > LIMIT)
    calm = paths.join(sizes.filter(F.col("m") <= LIMIT).select("path"), "path").select("node", "run", "path")
    centres = sets.select(F.col("node").alias("major"), F.col("brief").alias("centre"))
    others = paths.join(large.select("path", "major", "reach"), "path").filter("component != major").select("node", "run", "path", "major", "reach")
    asked = others.join(large.join(centres, "major").select("path", "centre"), "path").join(sets.select("node", "brief"), "node")
    near = staged(asked.select("node", "run", "path", "brief", "centre", "reach").mapInArrow(_in_reach(least), "node long, run int, path long"), "near")
    met = large.join(near.select("path").distinct(), "path").select("path", F.col("major").alias("component"))
    major = paths.join(met, ["path", "component"]).select("node", "run", "path")
    apart = others.select("node", "run", F.xxhash64("path", F.lit("others")).alias("path"))
    return calm.union(near).union(major).union(apart)


def _met(sets: DataFrame, similarity: float, slack: float, runs: range, known: DataFrame | None) -> DataFrame:
    """Stars of some runs. known: (node, component, far from its centre), buckets within one of which are passed over."""
    start = sets.select("node", F.lit(0).alias("run"), F.lit(0).cast("long").alias("path"), "tokens")
    leaves = None
    for level in range(LEVELS):
        paths = staged(start.mapInArrow(_next_paths(level, runs), "node long, run int, path long"), f"paths{level}")
        if known is not None:
            paths = staged(_pruned(paths, known, sets, similarity - slack), f"pruned{level}")
        paths, sizes = _bucketed(paths, known if known is not None else sets.select("node", F.col("node").alias("component"), F.lit(0).alias("far")).limit(0))
        sizes = staged(sizes.drop("reach"), f"buckets{level}")
        last = level == LEVELS - 1
        ready = sizes if last else sizes.filter(F.col("n") <= LIMIT)
        found = _bucket_tiles(paths, ready)
        leaves = found if leaves is None else leaves.unionByName(found)
        large = sizes.filter(F.col("n") > LIMIT)
        if last or not large.limit(1).count():
            break
        start = paths.join(large.select("path"), "path", "left_semi").join(sets.select("node", "tokens"), "node").select("node", "run", "path", "tokens")
    rows = leaves.join(sets.select("node", "brief"), "node").select("path", "one", "two", "own", "node", "brief")
    grouped = rows.repartition("path", "one", "two").sortWithinPartitions("path", "one", "two", "own", "node")
    return grouped.mapInArrow(_alike(similarity - slack), "a long, b long").distinct()


def classes(docs: DataFrame, similarity: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, key (of id and text), class_id, n_links (other documents linked with it), component.

    component tells classes apart; class_id is only a name, null or the same for two of them where ids are null or repeat.
    """
    with scratch(docs.sparkSession) as kept:
        kept.append(_classes(docs, similarity, recall, id_col, text_col))
    return kept[0]


def _classes(docs: DataFrame, similarity: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", text_key(F.col("id"), F.col("text")))
    read = staged(rows.select("id", "key", "text").mapInArrow(_read, "id long, key long, high long, low long, tokens binary"), "sets")
    sets = read.filter("high is not null").groupBy("high", "low").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.any_value("tokens").alias("tokens"), F.min("key").alias("any_key"), F.min_by("id", "key").alias("any_id"))
    sets = sets.withColumn("node", F.monotonically_increasing_id()).withColumn("brief", _brief(F.col("tokens")))
    sets = staged(sets, "representatives")
    near = candidates(sets, similarity, recall)
    groups = staged(components(near), "groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    members = groups.join(sets.select("node", "any_id", "any_key", F.col("n").alias("copies")), "node")
    members = _tiles(members, sizes, "component", TILE).select("component", "one", "two", "own", "node", "copies", "any_id", "any_key")
    texts = groups.join(sets.select("node", F.col("any_id").alias("id"), F.col("any_key").alias("key")), "node").select("node", "id", "key")
    same = rows["key"].eqNullSafe(texts["key"]) & rows["id"].eqNullSafe(texts["id"])
    texts = rows.join(texts, same).select("node", "text").dropDuplicates(["node"])
    whole = staged(texts.mapInArrow(_shingled, "node long, shingles binary"), "shingles")
    grouped = members.join(whole, "node").select("component", "one", "two", "own", "node", F.col("copies").alias("n"), "shingles").repartition("component", "one", "two").sortWithinPartitions("component", "one", "two", "own", "node")
    exact = staged(grouped.mapInArrow(_exact(similarity), "node long, root long, links long"), "exact")
    drop(whole)
    parts = components(exact.select(F.col("node").alias("a"), F.col("root").alias("b")))
    degrees = exact.groupBy("node").agg(F.sum("links").alias("links"))
    known = sets.select("node", "high", "low", "id", "n").join(degrees, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = staged(known, "linked")
    names = known.groupBy("component").agg(F.min("id").alias("class_id"))
    known = staged(known.join(names, "component").select("high", "low", "component", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "class-names")
    out = read.select("id", "key", "high", "low").join(known, ["high", "low"], "left")
    return out.select("id", "key", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component")


def _brief(tokens: Column) -> Column:
    """One byte of each token, as binary of TOKENS bytes: chance makes one in 256 agree."""
    hexed = F.hex(tokens)
    # of eight hexadecimal digits, the first two are the token's lowest byte
    return F.unhex(F.regexp_replace(hexed, "(..)......", "$1"))


def similarity_classes(docs: DataFrame, similarity: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: its id, class_id and n_links."""
    return classes(docs, similarity, recall, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "n_links")


def one_of_each(docs: DataFrame, similarity: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: its smallest id, or where ids are null or repeat, the smallest hash of id and text.

    Documents that link with nothing stay, those without words among them, and repeats of those too.
    """
    found = staged(classes(docs, similarity, recall, id_col, text_col), "classes")
    alone = found.filter("n_links = 0").select("id", "key", F.lit(False).alias("linked"))
    least = found.filter("n_links > 0").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))).alias("row"))
    stay = alone.distinct().union(least.select("row.id", "row.key", F.lit(True).alias("linked")))
    stay = staged(stay, "stay")
    plain, names = shielded(docs)
    own = plain.withColumn("own_key", text_key(F.col(names[id_col]).cast("long"), F.col(names[text_col]).cast("string")))
    same = (F.col("own_key") == F.col("key")) & F.col(names[id_col]).cast("long").eqNullSafe(F.col("id"))
    joined = own.join(stay, same)
    kept = joined.filter("not linked").union(joined.filter("linked").dropDuplicates(["id", "key"]))
    return unshielded(kept, names)
