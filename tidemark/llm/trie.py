"""The prefix trie of conversations, from their sorted order (operator 12).

Conversations are sorted by their sequences of turns; the trie's branching nodes are the intervals of the
array of longest common prefixes (LCP) of neighbours in that order, its Cartesian tree with nodes of equal
LCP merged. An interval reaches from the nearest smaller value on the left to that on the right; these are
found in blocks, and where a block has none, among the blocks' minima, level by level. Depths between an
interval and its parent are then expanded, and counts, least ids and sums of subtrees are taken from
running sums over the order, minima over blocks and the nodes' preorder.

Nothing gathers a conversation, a group of copies or the children of a node in one task: turns are numbered
by ranges, sequences are named by levels of SPAN symbols (blocks of turns, blocks of blocks), each name being
the block's rank, so that names sort as sequences do; equal conversations share one sequence, and their ids
are hashed from pieces of bounded size. The driver learns counts only.

Rows with a null conv_id belong to no conversation; null turns come first, turns that are equal in order stand
by their digest, repeated rows are turns of their own; null roles and texts are empty ones. Very long texts
count by their digest of 128 bits. An empty table has no trie and gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, staged
from tidemark.llm.order import cumulative, numbered

#: Symbols of one name, places of one block, ids of one piece.
SPAN, BLOCK, PIECE = 64, 1024, 4096
_RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, size, pos, n): the turn's digest, its text's bytes, its place from 0, and the conversation's turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    return staged(numbered(rows, ["conv_id"], ["turn", "key"]).drop("turn"), "turns")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, key, size) with d from 1, and (conv_id, len), a turnless one too: each conversation behind the first turns
    of the one whose id is the multiple of five below, as many as crc32 of its id says, instead of as many of its own."""
    turns = ordered_turns(conversations)
    each = turns.groupBy("conv_id").agg(F.max("n").alias("n"))
    cut = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9))
    each = each.withColumn("h", cut).withColumn("head", F.col("conv_id") - F.col("conv_id") % 5)
    heads = each.select(F.col("conv_id").alias("head"), F.col("n").alias("head_n"))
    base = F.least("h", F.coalesce("head_n", F.lit(0)))
    each = staged(each.join(heads, "head", "left").select("conv_id", "h", "head", base.alias("base"), (base + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "rebuilt")
    own = turns.join(each.select("conv_id", "h", "base"), "conv_id").filter("pos >= h").select("conv_id", (F.col("base") + F.col("pos") - F.col("h") + 1).alias("d"), "key", "size")
    taken = turns.filter("pos < 8").select(F.col("conv_id").alias("head"), "pos", "key", "size").join(each.filter("base > 0").select("conv_id", "head", "h"), "head")
    taken = taken.filter("pos < h").select("conv_id", (F.col("pos") + 1).alias("d"), "key", "size")
    return staged(own.union(taken), "rebuilt-turns"), each.select("conv_id", "len")


def sequence_ranks(turns: DataFrame, each: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id, len, r): equal sequences share a rank, ranks sort as sequences do; and the names (name, seq) of each level."""
    empty = each.filter("len = 0").select("conv_id", F.lit(0).cast("long").alias("j"), F.expr("CAST(array() AS array<string>)").alias("seq"))
    symbols, levels = turns.select("conv_id", (F.col("d") - 1).alias("j"), F.col("key").alias("symbol")), []
    blocks = -(-(each.agg(F.max("len")).first()[0] or 1) // SPAN)
    while True:
        part = F.transform(F.array_sort(F.collect_list(F.struct("j", "symbol"))), lambda x: x["symbol"])  # SPAN at most
        rows = symbols.groupBy("conv_id", F.floor(F.col("j") / SPAN).alias("_j")).agg(part.alias("seq")).withColumnRenamed("_j", "j")
        rows = rows if levels else rows.unionByName(empty)
        rows = staged(rows.withColumn("sig", F.md5(F.array_join(F.col("seq").cast("array<string>"), ","))), "blocks")
        names = staged(numbered(rows.groupBy("sig").agg(F.first("seq").alias("seq")), [], ["seq"]).select("sig", "seq", F.col("pos").alias("name")), "names")
        levels.append(names.select("name", "seq"))
        symbols = staged(rows.select("conv_id", "j", "sig").join(names.select("sig", "name"), "sig").select("conv_id", "j", F.col("name").alias("symbol")), "symbols")
        if blocks <= 1:
            return symbols.join(each, "conv_id").select("conv_id", "len", F.col("symbol").alias("r")), levels
        blocks = -(-blocks // SPAN)


def common_prefixes(levels: list[DataFrame]) -> DataFrame:
    """(r, lcp) for each rank r but the first: the turns that its sequence and the one before begin with."""
    open_pairs, done = levels[-1].select(F.col("name").alias("r"), (F.col("name") - 1).alias("x"), F.col("name").alias("y"), F.lit(0).cast("long").alias("lcp")).filter("r > 0"), None
    for height in reversed(range(len(levels))):
        left, right = (levels[height].select(F.col("name").alias(c), F.col("seq").alias(f"{c}_seq")) for c in "xy")
        pairs = open_pairs.join(left, "x").join(right, "y")
        both = F.least(F.size("x_seq"), F.size("y_seq"))
        same = F.zip_with(F.slice("x_seq", F.lit(1), both), F.slice("y_seq", F.lit(1), both), lambda a, b: a == b)
        pairs = pairs.withColumn("differ", F.array_position(same, False)).withColumn("i", F.when(F.col("differ") == 0, both).otherwise(F.col("differ") - 1))
        pairs = staged(pairs.withColumn("lcp", F.col("lcp") + F.col("i") * SPAN**height), "prefixes")
        ended = pairs.filter(F.lit(height == 0) | (F.col("differ") == 0)).select("r", "lcp")
        done = ended if done is None else done.union(ended)
        if height:
            open_pairs = pairs.filter("differ > 0").select("r", *(F.element_at(f"{c}_seq", F.col("differ").cast("int")).alias(c) for c in "xy"), "lcp")
    return staged(done, "lcp")


def _block(column: str) -> Column:
    return F.floor(F.col(column) / BLOCK)


def _nearest_in_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each place of a block the nearest smaller value before it; -1 where the block has none."""
    rows, stack, left, value = rows.sort_values("pos"), [], [], []
    for pos, v in zip(rows.pos.tolist(), rows.v.tolist()):
        while stack and stack[-1][1] >= v:
            stack.pop()
        left.append(stack[-1][0] if stack else -1)
        value.append(stack[-1][1] if stack else -1)
        stack.append((pos, v))
    return pd.DataFrame({"pos": rows.pos, "v": rows.v, "left": left, "left_v": value})


def _last_below(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """For each (at, v) the last place before at in the block with a value below v, and that; -1 where there is none."""
    block = block.sort_values("pos")
    places, values = block.pos.to_numpy(), block.v.to_numpy()
    found, value = [], []
    for at, v in zip(asked["at"].tolist(), asked.v.tolist()):
        below = np.flatnonzero(values[: np.searchsorted(places, at)] < v)
        found.append(places[below[-1]] if len(below) else -1)
        value.append(values[below[-1]] if len(below) else -1)
    return pd.DataFrame({"at": asked["at"], "v": asked.v, "found": found, "value": value})


def _searched(levels: list[DataFrame], k: int, asked: DataFrame, block: Column) -> DataFrame:
    answers = asked.groupBy(block.alias("block")).cogroup(levels[k].groupBy(_block("pos").alias("block")))
    return answers.applyInPandas(_last_below, "at long, v long, found long, value long")


def _before(levels: list[DataFrame], sizes: list[int], k: int, asked: DataFrame) -> DataFrame:
    """(at, v, found): of each asked (at, v) the last place before at, on level k, whose value is below v; -1 if none."""
    here = staged(_searched(levels, k, asked, _block("at")).select("at", "v", "found"), "within")
    if sizes[k] <= BLOCK:
        return here
    rest = here.filter(F.col("found") < 0).select("at", "v", _block("at").alias("up"))
    above = staged(_before(levels, sizes, k + 1, rest.select(F.col("up").alias("at"), "v").distinct()), "above")
    down = _into(levels, k, above)
    joined = rest.join(down.select(F.col("at").alias("up"), "v", "found"), ["up", "v"], "left").select("at", "v", F.coalesce("found", F.lit(-1)).alias("found"))
    return here.filter(F.col("found") >= 0).unionByName(joined)


def _into(levels: list[DataFrame], k: int, above: DataFrame) -> DataFrame:
    """above (at, v, found on level k + 1) with found and value on level k, of those that are found."""
    hits = above.filter(F.col("found") >= 0)
    inner = hits.select(((F.col("found") + 1) * BLOCK).alias("at"), "v").distinct()
    inner = _searched(levels, k, inner, F.floor((F.col("at") - 1) / BLOCK))
    return hits.select("at", "v", ((F.col("found") + 1) * BLOCK).alias("_end")).join(inner.withColumnRenamed("at", "_end"), ["_end", "v"]).drop("_end")


def nearest_smaller(values: DataFrame, n: int) -> DataFrame:
    """values (pos, v), numbered from 0 to n - 1, with left and left_v: the nearest place before whose value is smaller, and that; -1 if there is none."""
    levels, sizes = [values.select("pos", F.col("v").cast("long").alias("v"))], [n]
    while sizes[-1] > BLOCK:
        levels.append(staged(levels[-1].groupBy(_block("pos").alias("pos")).agg(F.min("v").alias("v")), "minima"))
        sizes.append(-(-sizes[-1] // BLOCK))
    local = staged(levels[0].groupBy(_block("pos")).applyInPandas(_nearest_in_block, "pos long, v long, left long, left_v long"), "nearest")
    if len(levels) == 1:
        return local
    rest = local.filter(F.col("left") < 0).select("pos", "v", _block("pos").alias("at"))
    down = _into(levels, 0, _before(levels, sizes, 1, rest.select("at", "v").distinct()))
    joined = rest.join(down, ["at", "v"], "left").select("pos", "v", F.coalesce("found", F.lit(-1)).alias("left"), F.coalesce("value", F.lit(-1)).alias("left_v"))
    return staged(local.filter(F.col("left") >= 0).unionByName(joined), "nearest-all")


def _least_in_block(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("pos")
    values, base = block.v.to_numpy(), block.pos.min()
    return pd.DataFrame({"lo": asked.lo, "hi": asked.hi, "least": [values[a - base : b - base].min() for a, b in zip(asked.lo, asked.hi)]}, dtype="int64")


def range_least(values: DataFrame, n: int, asked: DataFrame) -> DataFrame:
    """asked (lo, hi), distinct, with the least v of values (pos, v) at lo up to before hi."""
    inside = _block("lo") == F.floor((F.col("hi") - 1) / BLOCK)
    within = asked.filter(inside).groupBy(_block("lo").alias("block")).cogroup(values.groupBy(_block("pos").alias("block"))).applyInPandas(_least_in_block, "lo long, hi long, least long")
    if n <= BLOCK:
        return within
    whole = Window.partitionBy(_block("pos")).orderBy("pos")
    ends = staged(values.select("pos", F.min("v").over(whole.rowsBetween(0, Window.unboundedFollowing)).alias("to_end"), F.min("v").over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias("to_here")), "block-ends")
    wide = asked.filter(~inside).withColumn("_a", _block("lo") + 1).withColumn("_b", F.floor((F.col("hi") - 1) / BLOCK))
    minima = staged(values.groupBy(_block("pos").alias("pos")).agg(F.min("v").alias("v")), "block-minima")
    middle = range_least(minima, -(-n // BLOCK), wide.filter("_a < _b").select(F.col("_a").alias("lo"), F.col("_b").alias("hi")).distinct())
    joined = wide.join(ends.select(F.col("pos").alias("lo"), "to_end"), "lo").join(ends.select((F.col("pos") + 1).alias("hi"), "to_here"), "hi")
    joined = joined.join(middle.select(F.col("lo").alias("_a"), F.col("hi").alias("_b"), "least"), ["_a", "_b"], "left")
    return within.union(joined.select("lo", "hi", F.least("to_end", "to_here", "least")))  # least() passes over nulls


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each r's pieces, which come in order, with commas between."""
    now, state = None, hashlib.sha256()
    for batch in batches:
        ranks, digests = [], []
        for r, ids in zip(batch.column("r").to_pylist(), batch.column("ids").to_pylist()):
            if r != now:
                if now is not None:
                    ranks.append(now)
                    digests.append(state.hexdigest())
                now, state = r, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(digests, pa.string())], ["r", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["r", "ends"])


def member_digests(members: DataFrame) -> DataFrame:
    """(r, ends): SHA-256 of the ids of each rank's conversations, ascending and joined by commas. members: (r, conv_id, pos in that order over all)."""
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")  # PIECE at most
    pieces = members.groupBy("r", F.floor(F.col("pos") / PIECE).alias("piece")).agg(ids.alias("ids"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    reach = members.groupBy("r").agg((F.floor(F.max("pos") / PIECE) > F.floor(F.min("pos") / PIECE)).alias("many"))
    pieces = staged(pieces.join(reach, "r"), "pieces")
    parted = pieces.filter("many").repartition("r").sortWithinPartitions("r", "piece").select("r", "ids").mapInArrow(_hash_pieces, "r long, ends string")
    return pieces.filter("NOT many").select("r", F.sha2("ids", 256).alias("ends")).union(parted)


def prefix_trie(turns: DataFrame, each: DataFrame) -> DataFrame:
    """A row for each node. turns: (conv_id, d from 1, key, size); each: (conv_id, len), all conversations.

    conv_id is the node's smallest member; saved_tokens sums, over its subtree, each node's members but one
    times its size; ends_sha256 hashes the members that end there.
    """
    spark = turns.sparkSession
    with scratch(spark) as kept:
        ranked, levels = sequence_ranks(turns, each)
        members = staged(numbered(ranked, [], ["r", "conv_id"]).select("r", "conv_id", "len", "pos"), "members")
        sequences = staged(members.groupBy("r").agg(F.min("conv_id").alias("least"), F.max("len").alias("len"), F.min("pos").alias("first")), "sequences")
        n, n_convs = sequences.count(), members.count()
        if not n:
            return spark.createDataFrame([], _RESULT)
        ends = spark.range(2).select((F.col("id") * n).alias("pos"), F.lit(-1).cast("long").alias("v"))
        values = staged(common_prefixes(levels).select(F.col("r").alias("pos"), F.col("lcp").alias("v")).union(ends), "values")
        left = nearest_smaller(values, n + 1)
        right = nearest_smaller(values.select((n - F.col("pos")).alias("pos"), "v"), n + 1).select((n - F.col("pos")).alias("pos"), (n - F.col("left")).alias("right"), F.col("left_v").alias("right_v"))
        bounds = staged(left.filter((F.col("pos") > 0) & (F.col("pos") < n)).join(right, "pos").select("pos", "v", "left", "left_v", "right", "right_v"), "bounds")

        # places 0 to n of the order, with what stands before each
        after = values.select((F.col("pos") - 1).alias("pos"), F.col("v").alias("next_v"))
        places = sequences.select(F.col("r").alias("pos"), "least", "len", "first").join(values, "pos").join(after, "pos")
        places = places.select("*", (F.col("len") > F.col("next_v")).cast("long").alias("maximal"), (F.col("len") - F.col("v")).alias("fresh"))
        last = spark.range(1).select(F.lit(n).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(n_convs).cast("long"), *(F.lit(x).cast("long") for x in (-1, None, 0, 0)))
        places = staged(cumulative(places.union(last), "pos", ["maximal", "fresh"], n + 1), "places")

        # the Cartesian tree's nodes, those of equal depth merged, and the sequences' own ends
        up = F.when(F.col("left_v") >= F.col("right_v"), F.col("left")).otherwise(F.col("right"))
        merged = bounds.groupBy(F.col("left").alias("lo"), F.col("right").alias("hi"), F.col("v").alias("depth")).agg(F.count("*").alias("parts"), F.max(F.greatest("left_v", "right_v")).alias("over"), F.max(up).alias("up"))
        merged = staged(merged, "merged")
        least = staged(range_least(places.filter(F.col("pos") < n).select("pos", F.col("least").alias("v")), n, merged.select("lo", "hi").distinct()), "least")
        inner = merged.join(least, ["lo", "hi"])
        leaves = places.filter((F.col("pos") < n) & (F.col("len") > F.greatest("v", "next_v")))
        leaves = leaves.select(F.col("pos").alias("lo"), (F.col("pos") + 1).alias("hi"), F.col("len").alias("depth"), F.lit(None).cast("long").alias("parts"), F.greatest("v", "next_v").alias("over"), F.when(F.col("v") >= F.col("next_v"), F.col("pos")).otherwise(F.col("pos") + 1).alias("up"), "least")
        of_bound = bounds.select(F.col("pos").alias("up"), F.col("left").alias("lo"), F.col("right").alias("hi")).join(least, ["lo", "hi"]).select("up", F.col("least").alias("up_least"))
        tree = inner.unionByName(leaves).join(of_bound, "up", "left")
        starts = places.select(F.col("pos").alias("lo"), "v", "len", "first", "before_maximal", "before_fresh")
        stops = places.select(F.col("pos").alias("hi"), F.col("first").alias("hi_first"), F.col("before_maximal").alias("hi_maximal"), F.col("before_fresh").alias("hi_fresh"))
        tree = staged(tree.join(starts, "lo").join(stops, "hi"), "tree")

        # every depth between a node and its parent, each with its turn's size
        step = F.explode(F.sequence(F.lit(0), F.floor((F.col("depth") - F.col("over") - 1) / PIECE))).alias("step")
        begin = F.col("over") + 1 + F.col("step") * PIECE
        nodes = tree.select("*", step).select("*", F.explode(F.sequence(begin, F.least(F.col("depth"), begin + PIECE - 1))).alias("d"))
        sizes = turns.join(sequences.join(values.withColumnRenamed("pos", "r"), "r").select(F.col("least").alias("conv_id"), "r", "v"), "conv_id").filter("d > v").select(F.col("r").alias("lo"), "d", "size")
        nodes = nodes.join(sizes, ["lo", "d"], "left").withColumn("weight", (F.col("hi_first") - F.col("first") - 1) * F.coalesce("size", F.lit(0)))
        nodes = nodes.withColumn("place", F.col("before_fresh") + F.col("d") - F.col("v") - 1)
        total = places.agg(F.sum("fresh")).first()[0]
        weights = staged(nodes.select("place", "weight").union(spark.range(1).select(F.lit(total).cast("long"), F.lit(0).cast("long"))), "weights")
        weights = staged(cumulative(weights, "place", ["weight"], total + 1).select("place", "before_weight"), "saved")
        nodes = nodes.drop("weight", "size").join(weights, "place").join(weights.select(F.col("place").alias("hi_fresh"), F.col("before_weight").alias("hi_weight")), "hi_fresh")
        nodes = nodes.join(member_digests(members).withColumnRenamed("r", "lo"), "lo")
        at_end = F.col("d") == F.col("depth")
        children = F.when(~at_end, 1).when(F.col("parts").isNull(), 0).otherwise(F.col("parts") + (F.col("len") > F.col("depth")).cast("long"))
        out = nodes.select(
            F.col("least").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") > F.col("over") + 1, F.col("least")).otherwise(F.col("up_least")).alias("parent_conv_id"),
            (F.col("hi_first") - F.col("first")).alias("n_convs"), children.cast("long").alias("n_children"), (F.col("hi_maximal") - F.col("before_maximal")).alias("n_leaves"),
            (F.col("hi_weight") - F.col("before_weight")).alias("saved_tokens"), F.when(F.col("d") == F.col("len"), F.col("ends")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
        kept.append(staged(out, "trie"))
        return kept[0]
