"""Changes as functions from one snapshot of a table to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.operators.predicates import live, visible


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def changed(rows: DataFrame, where: Column, **columns: Column) -> DataFrame:
    """rows with other values in columns where the condition holds."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumns({c: F.when(hit, value).otherwise(F.col(c)) for c, value in columns.items()})


def with_defaults(requests: DataFrame, now: str) -> DataFrame:
    """Requests as rows: class, then tier by kind and class, then decay and expiry, scope and visibility."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    cls = F.when(text("memory_class") == "", "episodic").otherwise(text("memory_class"))
    rows = requests.withColumn("memory_class", cls)
    tier = F.when(text("retention_tier") != "", text("retention_tier")).when(text("kind") == "conversation", "ephemeral").otherwise(s.least_tier(F.col("memory_class")))
    rows = rows.withColumn("retention_tier", tier).withColumn("decay_rate", s.decay_of(F.col("retention_tier")))
    project = text("scope").startswith("project/") & (text("kind") != "observation")
    return rows.withColumns({
        "scope": F.when(text("scope") == "", "default").otherwise(text("scope")),
        "visibility": F.when(text("visibility") != "", text("visibility")).when(project, "team").otherwise("private"),
        "strength": F.coalesce("strength", F.lit(1.0)),
        "expires_at": F.when(F.col("retention_tier") == "ephemeral", at(now) + F.expr("INTERVAL 24 HOURS")),
    })


def inserted(rows: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """rows and what of fresh has a new key."""
    return rows.unionByName(fresh.join(rows.select(key), key, "left_anti").select(*rows.columns))


def inserted_by_hash(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """rows and what of fresh has a new content; of equal contents in fresh the smallest id."""
    hashed = lambda df: df.withColumn("_hash", s.content_hash(F.col("content")))
    first = Window.partitionBy("_hash").orderBy("id")
    new = hashed(fresh).withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
    return rows.unionByName(new.join(hashed(rows.filter(live())).select("_hash"), "_hash", "left_anti").select(*rows.columns))


def patched(rows: DataFrame, patch: DataFrame, *columns: str, key: str = "id") -> DataFrame:
    """rows with the patch's values where they aren't null; a new tier brings its decay unless the patch has one."""
    given = patch.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = rows.join(given, key, "left")
    values = {c: F.coalesce(f"_{c}", c) for c in columns}
    if "retention_tier" in columns:
        own = F.col("_decay_rate") if "decay_rate" in columns else F.lit(None).cast("double")
        values["decay_rate"] = F.coalesce(own, F.when(F.col("_retention_tier").isNotNull(), s.decay_of(F.col("_retention_tier"))), F.col("decay_rate"))
    return joined.withColumns(values).select(*rows.columns)


def deleted(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return rows.join(keys.select(*on), list(on), "left_anti")


def soft_deleted(rows: DataFrame, where: Column, now: str) -> DataFrame:
    return changed(rows, where & live(), deleted_at=at(now), updated_at=at(now))


def restored(rows: DataFrame, where: Column, now: str) -> DataFrame:
    return changed(rows, where & F.col("deleted_at").isNotNull(), deleted_at=F.lit(None).cast("timestamp"), updated_at=at(now))


def purged(rows: DataFrame, before: str, *others: tuple[DataFrame, str]) -> list[DataFrame]:
    """rows, and each (table, column) that refers to them, without those deleted before the time."""
    gone = rows.filter(F.col("deleted_at") < at(before)).select("id")
    return [rows.join(gone, "id", "left_anti"), *(df.join(gone.withColumnRenamed("id", c), c, "left_anti") for df, c in others)]


def reinforced(rows: DataFrame, where: Column, now: str) -> DataFrame:
    return changed(rows, where & live(), strength=F.col("strength") + 0.1 * (1 - F.col("strength")), reinforced_count=F.col("reinforced_count") + 1, last_accessed_at=at(now), updated_at=at(now))


def accessed(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """counts: id, accesses. Adds them up; when a row was last accessed stays."""
    joined = rows.join(counts.select("id", "accesses"), "id", "left")
    return joined.withColumn("access_count", F.col("access_count") + F.coalesce("accesses", F.lit(0)).cast("int")).select(*rows.columns)


def latest(rows: DataFrame, *keys: str, order: str) -> DataFrame:
    """Of rows with equal keys the last by order; of those alike in it the first by a hash of the row."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order), F.xxhash64(*rows.columns))
    return rows.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")


def earliest(rows: DataFrame, *keys: str, order: str) -> DataFrame:
    """Of rows with equal keys the first by order, then by a hash of the row."""
    first = Window.partitionBy(*keys).orderBy(order, F.xxhash64(*rows.columns))
    return rows.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def relation_stats(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """Relations with further mentions (source_id, target_id, relation_type, last_seen_at); pairs of one entity are refused."""
    fresh = mentions.filter("source_id <> target_id").withColumn("mention_count", F.lit(1).cast("long"))
    keys = ("source_id", "target_id", "relation_type")
    return relations.unionByName(fresh.select(*relations.columns)).groupBy(*keys).agg(F.sum("mention_count").alias("mention_count"), F.max("last_seen_at").alias("last_seen_at"))


def candidate_hits(hits: DataFrame) -> DataFrame:
    """hits: name, scope, entity_type, memory_id. A row for each name: number, rows, and the first type that tells something."""
    told = F.when(~F.col("entity_type").isin("", "concept"), F.col("entity_type"))
    grouped = hits.groupBy("name", "scope").agg(F.count("*").alias("hit_count"), F.sort_array(F.collect_set("memory_id")).alias("memory_ids"), F.min_by(told, F.when(told.isNotNull(), F.col("memory_id"))).alias("entity_type"))
    return grouped.withColumn("entity_type", F.coalesce("entity_type", F.lit("concept")))


def moved(contexts: DataFrame, path: str, to: str) -> DataFrame:
    """The context at path, and all below it, under the context at to ('' is the top). Into itself it can't go."""
    if to == path or to.startswith(f"{path}/"):
        raise ValueError("a context can't move below itself")
    new = f"{to}/{path.rsplit('/', 1)[1]}"
    inside = (F.col("path") == path) | F.col("path").startswith(f"{path}/")
    depth = new.count("/") - path.count("/")
    return changed(contexts, inside, path=F.concat(F.lit(new), F.substring("path", len(path) + 1, 10_000)), depth=F.col("depth") + depth)


def counted(contexts: DataFrame, rows: DataFrame) -> DataFrame:
    """contexts with memory_count, counted anew."""
    n = rows.groupBy(F.col("context_id").alias("id")).agg(F.count("*").alias("memory_count"))
    return contexts.join(n, "id", "left").withColumn("memory_count", F.coalesce("memory_count", F.lit(0)))


def failed_tasks(tasks: DataFrame, where: Column, most: int = 3) -> DataFrame:
    """A failed task waits again until it has been retried most times."""
    tries = F.col("retries") + 1
    return changed(tasks, where, status=F.when(tries < most, "pending").otherwise("failed"), retries=tries)


def stale_tasks(tasks: DataFrame, now: str, minutes: int = 5) -> DataFrame:
    return changed(tasks, (F.col("status") == "processing") & (F.col("started_at") < at(now) - F.make_dt_interval(mins=F.lit(minutes))), status=F.lit("pending"))


# jobs


def decayed(rows: DataFrame, now: str, weak: float = 0.1, days: int = 90, limit: int = 200) -> DataFrame:
    """Ids of rows that decay lets go: weak, never reinforced, old, and weak also with their accesses."""
    weakest = rows.filter(live() & (F.col("strength") < weak)).orderBy("strength", "id").limit(limit)
    old = F.col("created_at") < at(now) - F.make_dt_interval(days=F.lit(days))
    return weakest.filter((F.col("reinforced_count") == 0) & old & (F.col("retention_tier") != "permanent") & (s.effective_strength(now) < weak)).select("id")


def crystallizes(now: str, count: int = 5, strength: float = 0.7, hours: int = 720) -> Column:
    lasting = F.col("created_at") <= at(now) - F.make_dt_interval(hours=F.lit(hours))
    return (F.col("retention_tier") != "permanent") & ~F.col("kind").isin("ephemeral", "conversation") & (F.col("reinforced_count") >= count) & (F.col("strength") >= strength) & lasting


def promoted_tiers(rows: DataFrame, now: str) -> DataFrame:
    """short_term rows that were reinforced and last a day become standard, standard ones that crystallise long_term."""
    aged = F.col("created_at") <= at(now) - F.expr("INTERVAL 24 HOURS")
    first = (F.col("retention_tier") == "short_term") & (F.col("kind") != "conversation") & (F.col("reinforced_count") >= 2) & aged
    second = (F.col("retention_tier") == "standard") & crystallizes(now)
    tier = F.when(first, "standard").when(second, "long_term").otherwise(F.col("retention_tier"))
    return changed(rows, live() & (first | second), retention_tier=tier, decay_rate=s.decay_of(tier))


def promoted_candidates(rows: DataFrame, now: str, count: int = 3, strength: float = 0.6, days: int = 1) -> DataFrame:
    """Candidates that are ready take the class they stand for, and at least its tier."""
    target = F.element_at(F.split("candidate_for", "_candidate"), 1)
    ready = live() & F.col("candidate_for").isin("semantic_candidate", "procedural_candidate", "core_candidate") & (F.col("reinforced_count") >= count) & (F.col("strength") >= strength) & (F.col("created_at") <= at(now) - F.make_dt_interval(days=F.lit(days)))
    tier = F.when(s.tier_rank(F.col("retention_tier")) < s.tier_rank(s.least_tier(target)), s.least_tier(target)).otherwise(F.col("retention_tier"))
    return changed(rows, ready, memory_class=target, retention_tier=tier, decay_rate=s.decay_of(tier), candidate_for=F.lit(""))


def readable_rows(rows: DataFrame, who) -> DataFrame:
    return rows.filter(live() & visible(who))


def finalized(sessions: DataFrame, requests: DataFrame, used: DataFrame) -> DataFrame:
    """sessions (session_id, state, version) after the requests (session_id, key) to finalise them.

    A key counts once: of its requests the one with the smallest session_id, none if used has it. Requests without
    a session or a key are refused; sessions that are final stay as they are.
    """
    told = requests.filter((F.col("key") != "") & (F.col("session_id") != "")).groupBy("key").agg(F.min("session_id").alias("session_id"))
    asked = told.join(used.select("key"), "key", "left_anti").select("session_id").distinct().withColumn("_asked", F.lit(True))
    joined = sessions.join(asked, "session_id", "left")
    return changed(joined, F.col("_asked") & (F.col("state") != "finalized"), state=F.lit("finalized"), version=F.lit(1)).select(*sessions.columns)


def repaired(sessions: DataFrame, now: str, failing: Column, most: int = 3, minutes: int = 30, batch: int | None = 10) -> DataFrame:
    """sessions (session_id, state, last_seen, attempts) after a sweep over those idle for minutes and not yet final.

    The sweep takes the batch that is idle longest, all of them if batch is None. Who has had most attempts is
    abandoned. The others have one more and are finalised, or wait for the next sweep where failing holds.
    """
    idle = F.col("state").isin("active", "pending_repair") & (F.col("last_seen") < at(now) - F.make_dt_interval(mins=F.lit(minutes)))
    joined = sessions.withColumn("_due", F.coalesce(idle, F.lit(False)))
    if batch is not None:
        taken = sessions.filter(idle).orderBy("last_seen", "session_id").limit(batch).select("session_id", F.lit(True).alias("_due"))
        joined = sessions.join(taken, "session_id", "left").withColumn("_due", F.coalesce("_due", F.lit(False)))
    tried = F.coalesce("attempts", F.lit(0))
    over = tried >= most
    state = F.when(over, "abandoned").when(F.coalesce(failing, F.lit(False)), "pending_repair").otherwise("finalized")
    return joined.withColumns({
        "state": F.when(F.col("_due"), state).otherwise(F.col("state")),
        "attempts": F.when(F.col("_due") & ~over, tried + 1).otherwise(F.col("attempts")),
        "last_seen": F.when(F.col("_due"), at(now)).otherwise(F.col("last_seen")),
    }).select(*sessions.columns)


def consolidated(rows: DataFrame, clusters: DataFrame, now: str, merge: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """rows with consolidated_into, and derivations (source_id, target_id), after each cluster's live rows became one.

    clusters: cluster_id, id, of live rows; cluster_id is one of them. merge makes one text of the numbered lines of a cluster, in the order of ids; without
    it they are the text. A cluster whose text is empty, or shorter in bytes than a tenth of its shortest row,
    stays as it is. The new row is permanent and semantic; it takes the first scope, kind and team that are not empty.
    """
    rows = rows if "consolidated_into" in rows.columns else rows.withColumn("consolidated_into", F.lit(None).cast("string"))
    text, kind = F.coalesce("content", F.lit("")), F.coalesce("kind", F.lit(""))
    found = clusters.select("cluster_id", "id").join(rows.filter(live()), "id")
    line = F.concat(F.when(kind != "", F.concat(F.lit("["), kind, F.lit("] "))).otherwise(""), text)
    first = lambda c, *no: F.coalesce(F.min_by(c, F.when(~F.col(c).isin("", *no), F.col("id"))), F.lit("")).alias(c)
    grouped = found.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("_lines"), F.min(F.octet_length(text)).alias("_least"),
        F.least(F.lit(1.0), F.max("strength") * 1.1).alias("strength"), first("scope"), first("kind", "consolidated"), first("team_id"),
    )
    numbered = F.array_join(F.transform("_lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n")
    size = F.octet_length("content")
    made = grouped.withColumn("content", F.trim(merge(numbered) if merge else numbered)).filter((F.size("_lines") > 1) & (size > 0) & (size >= F.floor(F.col("_least") / 10)))
    made = made.withColumns({"id": F.concat(F.lit("consolidated-"), "cluster_id"), "memory_class": F.lit("semantic"), "retention_tier": F.lit("permanent"), "visibility": F.lit(""), "source_type": F.lit("consolidation")})
    made = with_defaults(made, now).withColumns({"created_at": at(now), "updated_at": at(now), "access_count": F.lit(0), "reinforced_count": F.lit(0)})
    members = made.select(F.explode("_lines.id").alias("source_id"), F.col("id").alias("target_id"))
    kinds = dict(rows.dtypes)
    empty = {c: F.lit("" if t == "string" and c != "consolidated_into" else None).cast(t) for c, t in kinds.items() if c not in made.columns}
    fresh = made.withColumns(empty).select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()))
    joined = rows.join(members.withColumnRenamed("source_id", "id"), "id", "left")
    merged = F.col("target_id").isNotNull() & live()
    kept = changed(joined, merged, consolidated_into=F.col("target_id"), deleted_at=at(now), updated_at=at(now)).select(*rows.columns)
    return kept.unionByName(fresh), members
