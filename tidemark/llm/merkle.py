"""A Merkle manifest of a dataset: persisted levels, a proof for each row, and its verification (operator 11).

Bottom up, every run of eight consecutive nodes of a group becomes a parent; each level is a written table
whose rows hold their children's digests, until a group has one node, its subroot. Subroots, in the order of
their groups, make the tree above in the same way. Top down, each level joins its parents: a child prepends
its siblings to the proof suffix that the parent inherited. Rows are numbered by ranges (order.numbered), so
a group that holds most rows spreads over all tasks, and levels are joined by (group, run), which no group
makes hot. The driver learns the largest group's size, the number of groups and the root.

Null fields count as '-'; a null group is a group of its own, the first. Empty texts and very long ones are
hashed whole. Rows with a null id come first in their group; those with equal ids stand in the order of their
leaves, so repeated rows get the same digests in every run. An empty table gives no rows and no root. Columns
that are not named are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.order import numbered

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_PROOF = "array<struct<left string, right string>>".replace(" string", ":string")


def digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, each '-' if null, else its UTF-8 bytes' count, ':', and itself."""
    parts = (F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (f.cast("string") for f in fields))
    return F.sha2(F.concat(*parts), 256)


@dataclass(frozen=True)
class Manifest:
    """leaves: the caller's columns with grp (the group as text that sorts like it, null first), pos and n in it, and digest.

    levels: (grp, pos, n, children, digest) from the leaves' parents upward; subroots: (grp, height, pos, n,
    digest) and above, the levels over them; root: None of an empty table.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    above: list[DataFrame]
    root: str | None


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The levels over nodes (grp, pos, n, digest), whose largest group has most."""
    levels = []
    while most > 1:
        run = F.floor(F.col("pos") / FANOUT)
        grouped = nodes.filter("n > 1").groupBy("grp", run.alias("pos"), F.floor((F.col("n") + FANOUT - 1) / FANOUT).alias("n"))
        children = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])  # FANOUT at most
        nodes = staged(grouped.agg(children.alias("children")).withColumn("digest", F.sha2(F.array_join("children", ""), 256)), "level")
        levels.append(nodes)
        most = -(-most // FANOUT)
    return levels


def build(leaves: DataFrame, group: Column, order: list[str]) -> Manifest:
    """leaves: columns of the caller, order's among them, and digest."""
    grp = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))  # null first, then bytewise
    leaves = staged(numbered(leaves.withColumn("grp", grp), ["grp"], [*order, "digest"]), "leaves")
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = _levels(leaves.select("grp", "pos", "n", "digest"), most)
    tops = leaves.filter("n = 1").select("grp", F.lit(0).alias("height"), "digest")
    for height, level in enumerate(levels, 1):
        tops = tops.union(level.filter("n = 1").select("grp", F.lit(height), "digest"))
    subroots = staged(numbered(staged(tops, "tops").withColumn("_all", F.lit("")), ["_all"], ["grp"]).drop("_all"), "subroots")
    groups = subroots.count()
    above = _levels(subroots.select(F.lit("").alias("grp"), "pos", "n", "digest"), groups)
    root = (above[-1] if above else subroots).select("digest").first() if groups else None
    return Manifest(leaves, levels, subroots, above, root and root[0])


def _inherited(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """nodes with the parents' proof, their own siblings before it."""
    above = parents.select("grp", F.col("pos").alias("_run"), F.col("children").alias("_run_children"), F.col("proof").alias("_suffix"))
    joined = nodes.withColumn("_run", F.floor(F.col("pos") / FANOUT)).join(above, ["grp", "_run"])
    at = F.pmod("pos", F.lit(FANOUT)).cast("int")
    left, right = F.array_join(F.slice("_run_children", 1, at), ""), F.array_join(F.slice("_run_children", at + 2, FANOUT), "")
    return joined.select(*nodes.columns, F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "_suffix").alias("proof"))


def _pushed(levels: list[DataFrame], nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """nodes (the lowest level) with proof. tops: (grp, height, proof) of each group's only node at the last of its levels."""
    below = None
    for height in range(len(levels), -1, -1):
        level = levels[height - 1] if height else nodes
        own = tops.filter(F.col("height") == height).select("grp", "proof")
        found = level.filter("n = 1").join(own, "grp").select(*level.columns, "proof")
        if below is not None:
            found = found.unionByName(_inherited(level.filter("n > 1"), below))
        below = staged(found, "proofs") if height else found
    return below


def proofs(manifest: Manifest) -> DataFrame:
    """manifest's leaves with subroot, root and proof: (left, right) for each level from the leaf's, the digests before and after it in its run."""
    nothing = F.expr(f"CAST(array() AS {_NO_PROOF})")
    top = manifest.subroots.select(F.lit("").alias("grp"), F.lit(len(manifest.above)).alias("height"), nothing.alias("proof")).limit(1)
    upper = manifest.subroots.select(F.lit("").alias("grp"), F.col("grp").alias("_grp"), F.col("height").alias("_height"), "pos", "n", F.col("digest").alias("subroot"))
    tops = staged(_pushed(manifest.above, upper, top).select(F.col("_grp").alias("grp"), F.col("_height").alias("height"), "subroot", "proof"), "subroot-proofs")
    done = _pushed(manifest.levels, manifest.leaves, tops)
    return done.join(tops.select("grp", "subroot"), "grp").withColumn("root", F.lit(manifest.root))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings' digests of a proof in one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), "")


def verified_documents(docs: DataFrame) -> DataFrame:
    """A row for each document: its leaf, subroot, root and proof's digest, and what verification says once every
    third document (by crc32 of its id) has lost its capitals."""
    text = F.col("text").cast("string")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    fields = [F.col(f) for f in FIELDS]
    tampered = F.when(chosen & (lowered != text), digest(*fields[:-1], lowered))
    leaves = docs.select("doc_id", F.col("lang").alias("_lang"), digest(*fields).alias("digest"), tampered.alias("tampered"))
    rows = proofs(build(staged(leaves, "hashed"), F.col("_lang"), ["doc_id"]))
    folded = fold(F.coalesce("tampered", "digest"), F.col("proof"))
    rows = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
