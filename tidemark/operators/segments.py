"""A written full-text index that stays in step with its rows: segments, deletions and merges.

A segment is a batch's postings, in blocks of the words of a hash, by chunk of rows and column, in a folder for each hash,
and its rows' lengths, in folders of their own by the hash of the chunk. Deleted and replaced ids are written beside it with the number of the last segment they
hold for; what they take from the number of rows and their total length is counted then, so neither is counted
again. A version is a file of the names of all that; it is written last, so a batch that breaks off leaves the
version before. One writer at a time. A search reads only the folders its terms fall in.
"""

from __future__ import annotations

import functools
import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import packed
from tidemark.operators.fulltext import WEIGHTS, Index
from tidemark.operators.segmentation import Tokenizer, runs

BUCKETS = 64
#: Bytes of a file's row groups: a block is a row of many words, and a reader holds a group's rows at once.
GROUP_BYTES = 16 << 20


@dataclass(frozen=True)
class Version:
    """segments: (number, rows) of the live ones; dead: (name, last segment) of the tables of ids that no longer hold."""

    number: int = 0
    segments: tuple[tuple[int, int], ...] = ()
    dead: tuple[tuple[str, int], ...] = ()
    rows: int = 0
    words: float = 0.0
    made: int = 0


def _bucket(term) -> Column:
    return packed.part_of(term, BUCKETS)


@dataclass
class SegmentedIndex:
    """The index under path; columns are the indexed texts of rows that also have an id."""

    spark: SparkSession
    path: str
    columns: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    tokenizer: Tokenizer = runs

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> Version:
        """The last version that was written whole."""
        system, path = self._files()
        names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
        whole = [n for n in names if n.isdigit() and system.exists(self._at(f"versions/{n}/_SUCCESS"))]
        if not whole:
            return Version()
        told = json.loads(self.spark.read.text(f"{self.path}/versions/{max(whole, key=int)}").first()[0])
        return Version(**told | {k: tuple(map(tuple, told[k])) for k in ("segments", "dead")})

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _commit(self, version: Version) -> Version:
        version = replace(version, number=version.number + 1)
        self.spark.createDataFrame([(json.dumps(asdict(version)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/versions/{version.number}")
        return version

    def _read(self, what: str, number: int) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{number}/words").withColumn("segment", F.lit(number))
        if what == "postings":
            return rows.filter(F.col("bucket") < BUCKETS).drop("places", "ids", "lengths")
        one = rows.filter(F.col("bucket") >= BUCKETS).select("segment", "chunk", F.explode(F.arrays_zip("ids", "places", "lengths")).alias("_one"))
        return one.select("segment", "chunk", F.col("_one.ids").alias("id"), F.col("_one.places").alias("at"), F.col("_one.lengths").alias("length"))

    def _write(self, rows: DataFrame, number: int) -> None:
        """rows, as packed.pack() gives them, as a segment."""
        bucket = F.when(F.col("part").isNull(), BUCKETS + _bucket("chunk")).otherwise(F.col("part"))
        rows.withColumn("bucket", bucket).drop("part").repartition("bucket").sortWithinPartitions("bucket", "chunk", "column").write.partitionBy("bucket").option("parquet.block.size", GROUP_BYTES).mode("overwrite").parquet(f"{self.path}/{number}/words")

    def _dead(self, version: Version) -> DataFrame | None:
        tables = [self.spark.read.parquet(f"{self.path}/dead/{name}").select("id", F.lit(last).alias("last")) for name, last in version.dead if any(n <= last for n, _ in version.segments)]
        return functools.reduce(DataFrame.union, tables).groupBy("id").agg(F.max("last").alias("last")) if tables else None

    def _alive(self, df: DataFrame, version: Version) -> DataFrame:
        dead = self._dead(version)
        return df if dead is None else df.join(dead, (df["id"] == dead["id"]) & (F.col("segment") <= F.col("last")), "left_anti")

    def _all(self, what: str, version: Version) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, (self._read(what, n) for n, _ in version.segments))

    def _without(self, ids: DataFrame, version: Version) -> Version:
        """version after what ids holds of its segments is dead."""
        if not version.segments:
            return version
        name = uuid.uuid4().hex
        ids.select("id").distinct().write.parquet(f"{self.path}/dead/{name}")
        gone = self._alive(self._all("lengths", version), version).join(self.spark.read.parquet(f"{self.path}/dead/{name}"), "id", "left_semi")
        count, words = gone.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0.0))).first()
        if not count:
            return version
        return replace(version, dead=(*version.dead, (name, version.segments[-1][0])), rows=version.rows - count, words=version.words - words)

    def add(self, rows: DataFrame) -> Version:
        """rows as a new segment; a row whose id is there replaces it, so a restored row is added again. A batch has an id once."""
        version, number = self.version(), self.version().made + 1
        rows = rows.select("id", *self.columns)
        if rows.rdd.getNumPartitions() < self.spark.sparkContext.defaultParallelism:  # a table of few files is dealt out first
            rows = rows.repartition(self.spark.sparkContext.defaultParallelism)
        self._write(packed.pack(rows, list(self.columns), self.tokenizer, str(number), BUCKETS), number)
        sizes = self._read("lengths", number)
        version = self._without(sizes, version)
        count, words = sizes.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0.0))).first()
        return self._commit(replace(version, segments=(*version.segments, (number, count)), rows=version.rows + count, words=version.words + words, made=number))

    def delete(self, ids: DataFrame) -> Version:
        """The rows of ids (a column id) are found no more; ids that aren't there are passed over."""
        version = self.version()
        return self._commit(self._without(ids, version))

    def merge(self, most_rows: int | None = None) -> Version:
        """The live rows of all segments of at most most_rows rows (None: of all) as one segment, the last."""
        version, number = self.version(), self.version().made + 1
        small = tuple(s for s in version.segments if most_rows is None or s[1] <= most_rows)
        if not small:
            return version
        part = replace(version, segments=small)
        live = self._alive(self._all("lengths", part), part)
        words = packed.without(packed.listed(self._all("postings", part).drop("segment", "bucket")), live)
        heads = live.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "id", "length"))).alias("_rows"))
        heads = heads.select("chunk", F.col("_rows.at").alias("places"), F.col("_rows.id").alias("ids"), F.col("_rows.length").alias("lengths"))
        self._write(packed.blocks(words, BUCKETS).unionByName(heads, allowMissingColumns=True), number)
        count = self._read("lengths", number).count()
        left = tuple(s for s in version.segments if s not in small)
        # ids that are dead in an earlier segment are so no more in the new one, whose number is above all of theirs
        dead = tuple(d for d in version.dead if any(n <= d[1] for n, _ in left))
        return self._commit(replace(version, segments=(*left, (number, count)), dead=dead, made=number))

    def index(self) -> Index:
        """What a search takes: the last version."""
        version = self.version()
        if not version.segments:
            return Index(self.spark.createDataFrame([], f"{packed.BLOCK}, bucket int, segment int"), self.spark.createDataFrame([], "id string, chunk string, at int, length double"), 0, None)
        sizes = self._alive(self._all("lengths", version), version).select("id", "chunk", "at", "length")
        return Index(self._all("postings", version), sizes, version.rows, version.words / version.rows if version.rows else None, self._asked)

    def _asked(self, found: DataFrame, asked: DataFrame) -> DataFrame:
        """found in the folders of asked's terms, of which the driver sees BUCKETS numbers at most."""
        buckets = [r[0] for r in asked.select(_bucket("term")).distinct().collect()]
        return found.filter(F.col("bucket").isin(buckets)) if len(buckets) < BUCKETS else found
