"""Mixing sources to target weights by a low-discrepancy schedule (operator 1, DataFrame functions only).

Each slot of the schedule has a point of the golden-ratio sequence, which the cumulative targets map to
a source; a source's slots are ranked, and its k-th slot takes its k-th block of equal size. Blocks are
cut from the source's documents in shuffled order, pass after pass, so blocks and slots join one to one
on (source, rank), no join key has more than a block's words, and a source's words follow its target
at every point of the schedule.

Prefix sums run on two levels: within buckets of bounded size that a hash of the row assigns, then over
the buckets' sums; so a source with a third of all rows is never sorted in one task.

Sources are ordered by code point, null last. A null or empty text has size 0 and is never taken, and a
source without words has target 0. Repeated rows count each. Other columns are not read by mix(); and
mixed_documents() carries them along, whatever their names. A very long text is cut into blocks of words, which
are taken like others. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, shielded, staged, unshielded, wide_key

#: The golden ratio's fraction times 2**31, made odd: i * _GOLDEN mod 2**31 visits every point once.
_BITS, _GOLDEN = 31, 1327217885
#: The weights that sources get in turn.
WEIGHTS = (5, 2, 1)
#: How many rows a bucket of a prefix sum has on average, at most.
_BUCKET_ROWS = 2_048


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """sizes: (source, source_size). With number, weight, and target: all sizes shared by weight, at most most times its own.

    The excess over a bound is shared by weight among the rest until none is above. Taking sources by
    bound over weight, a source is bounded if its bound is at most its share of what those before leave,
    so one pass settles it. The table has a row for each source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("number", F.row_number().over(order).cast("long"))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    bounded = weighted.withColumn("bound", F.col("source_size") * most)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("bound") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    shares = bounded.withColumns({
        "left_words": F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    stops = shares.withColumn("stops", F.col("bound") * F.col("left_weight") <= F.col("weight") * F.col("left_words"))
    rest = F.sum("source_size").over(everything) - F.sum(F.when(F.col("stops"), F.col("bound")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("stops"), F.lit(0)).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("stops"), F.col("bound").cast("double")).otherwise((F.col("weight") * rest).cast("double") / open_weight)
    return stops.select("source", "source_size", "number", "weight", target.alias("target"))


def schedule(targets: DataFrame, n_slots: Column, n_words_all: int, slots: int) -> DataFrame:
    """(number, rank, slot): the source of each slot and the slot's rank among its source's, from 0.

    A slot's point falls into one cell of a grid over [0, total); each source lies in the cells its
    range of cumulative targets meets, so points and ranges meet in an equality join on cells.
    """
    spark = targets.sparkSession
    cells = 4096
    upto = F.sum("target").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("target").over(Window.partitionBy())
    low = F.coalesce(F.lag("high").over(Window.orderBy("number")), F.lit(0.0))
    last = F.max("number").over(Window.partitionBy())
    ranges = targets.filter("target > 0").withColumn("high", upto / total).withColumn("low", low)
    ranges = ranges.withColumn("high", F.when(F.col("number") == last, F.lit(1.0)).otherwise(F.least(F.col("high"), F.lit(1.0))))
    first_cell, last_cell = F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1))
    ranges = ranges.select("number", "low", "high", F.explode(F.sequence(first_cell, last_cell)).alias("cell"))
    # a point is (i * _GOLDEN mod 2**31 + 1/2) / 2**31, exact in a double
    step = F.pmod(F.pmod(F.col("id"), F.lit(1 << _BITS)) * _GOLDEN, F.lit(1 << _BITS))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((step + F.lit(0.5)) / float(1 << _BITS)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * cells))
    placed = points.join(ranges, "cell").filter("point >= low and point < high").select("number", "slot", F.floor(F.col("slot") / _BUCKET_ROWS).alias("bucket"))
    return _running(placed, ["number"], ["slot"], F.lit(1).cast("long"), "rank").select("number", "rank", "slot")


def _running(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the rows of the same keys that come before by (bucket, *order)."""
    rows = rows.withColumn("_value", value)
    sums = rows.groupBy(*keys, "bucket").agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select(*keys, "bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.sum("_value").over(Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    joined = rows.withColumn("_own", F.coalesce(own, F.lit(0))).join(bases, [*keys, "bucket"])
    return joined.withColumn(name, F.col("_base") + F.col("_own")).drop("_value", "_own", "_base")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 17) -> DataFrame:
    """A row for each row of docs: row_key, its id, source, size, source_size, target and taken (words the mix takes).

    Also text_key, the hash of id, text and source by which mixed_documents() joins back. The order within a
    source is by md5 of seed, id and text hash, so reruns take the same words.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), wide_key(F.col(id_col), F.col(text_col), F.col(source_col)).alias("text_key"))
    # the key of a row: of rows that agree in all of this, any may come first
    sized = staged(sized.withColumn("row_key", F.monotonically_increasing_id()), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    counts = sizes.agg(F.sum("source_size"), F.sum("n_rows")).first()
    total, n_rows = counts[0] or 0, counts[1] or 0
    targets = staged(source_targets(sizes.drop("n_rows"), weights, most), "mix-targets")
    kept = targets.withColumnRenamed("source", "_source")
    rows = sized.join(kept, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    block = max(1, min(4096, total // 65_536))
    slots = total // block
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("text_key").cast("string")))
    buckets = max(1, -(-n_rows // _BUCKET_ROWS))
    rows = rows.withColumn("_order", order).withColumn("bucket", F.pmod(F.xxhash64("_order"), F.lit(buckets)))
    placed = _running(rows, ["number"], ["_order", "row_key"], F.col("size"), "at")
    # of pass p over a source, a document's words stand at p * source_size + at; blocks past the target's aren't looked for
    passes = F.least(F.lit(most), F.ceil((F.col("target") + 8 * block) / F.greatest(F.col("source_size"), F.lit(1)))).cast("int")
    placed = placed.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.greatest(passes, F.lit(1)) - 1)))
    placed = placed.withColumn("start", F.col("_pass") * F.col("source_size") + F.col("at")).withColumn("stop", F.col("start") + F.col("size"))
    first, last = F.floor(F.col("start") / block), F.floor((F.greatest(F.col("stop") - 1, F.col("start"))) / block)
    pieces = placed.withColumn("rank", F.explode(F.sequence(first, last)))
    pieces = pieces.withColumn("words", F.least(F.col("stop"), (F.col("rank") + 1) * block) - F.greatest(F.col("start"), F.col("rank") * block))
    slotted = schedule(targets, F.lit(slots), total, slots).select("number", "rank", F.lit(True).alias("_met"))
    met = pieces.join(slotted, ["number", "rank"], "left")
    taken = F.coalesce(F.sum(F.when(F.col("_met"), F.col("words"))), F.lit(0)).cast("long")
    out = met.groupBy("row_key", "id", "text_key", "source", "size", "source_size", "target").agg(taken.alias("taken"))
    return out.withColumnRenamed("id", id_col)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix's documents, with the columns of docs: whole copies, and where words are left the first of them."""
    taken = mix(docs, id_col, text_col, source_col, **options)
    # rows that agree in id, text and source are interchangeable: the i-th of them gets the i-th count
    counts = taken.groupBy(F.col("text_key").alias("_key")).agg(F.sort_array(F.collect_list("taken"), asc=False).alias("_counts"), F.max("size").alias("_size"))
    counts = staged(counts.filter(F.element_at("_counts", 1) > 0), "mix-counts")
    plain, names = shielded(docs)
    content = F.col(names[text_col])
    keyed = plain.withColumn("_key", wide_key(F.col(names[id_col]), content, F.col(names[source_col])))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_size"))
    joined = keyed.join(counts, "_key").withColumn("_taken", F.element_at("_counts", nth)).filter("_taken > 0")
    copies = F.array_repeat(F.col("_size"), F.floor(F.col("_taken") / F.col("_size")).cast("int"))
    rest = F.pmod(F.col("_taken"), F.col("_size"))
    parts = F.when(rest > 0, F.concat(copies, F.array(rest))).otherwise(copies)
    joined = joined.withColumn("_words", F.explode(parts))
    part = F.array_join(F.slice(F.regexp_extract_all(content, F.lit(WORD), F.lit(0)), F.lit(1), F.col("_words").cast("int")), " ")
    text = F.when(F.col("_words") == F.col("_size"), content).otherwise(part)
    changed = {names[text_col]: text} | ({names["n_chars"]: F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return unshielded(joined.withColumns(changed), names)
