"""Row predicates: visibility, search filters, write rules and the transitions of a session."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Identity:
    team: str = ""
    owner: str = ""


def visible(who: Identity | None) -> Column:
    """What a caller may read. Without a caller only public rows; without a team the team isn't compared."""
    public = F.col("visibility") == "public"
    if who is None:
        return public
    own = (F.col("visibility") == "private") & ((F.col("owner_id") == who.owner) | (F.col("owner_id") == ""))
    team = F.col("visibility") == "team"
    if who.team:
        same = F.col("team_id") == who.team
        return public | (same & team) | (same & own)
    return public | team | own


def vector_visible(who: Identity | None) -> Column:
    """The vector index's rule: an owner or a team counts only if it isn't empty."""
    public = F.col("visibility") == "public"
    if who is None:
        return public
    private = (F.col("visibility") == "private") & (F.col("owner_id") != "") & (F.col("owner_id") == who.owner)
    return public | private | ((F.col("visibility") == "team") & (F.col("team_id") != "") & (F.col("team_id") == who.team))


def live() -> Column:
    return F.col("deleted_at").isNull()


def event_time() -> Column:
    return F.coalesce("happened_at", "created_at")


def search_filters(now: str, *, scope: str = "", context_id: str = "", kind: str = "", source_type: str = "", source_ref: str = "", happened_after: str = "", happened_before: str = "", min_strength: float = 0.0, tier: str = "", role: str = "", include_expired: bool = False) -> Column:
    """All conditions that are set: equality, a prefix of source_ref without regard to case, ranges, and expiry."""
    found = [F.lit(True)]
    for name, value in (("scope", scope), ("context_id", context_id), ("kind", kind), ("source_type", source_type), ("retention_tier", tier), ("message_role", role)):
        if value:
            found.append(F.col(name) == value)
    if source_ref:
        found.append(F.lower("source_ref").startswith(source_ref.lower()))
    if happened_after:
        found.append(F.col("happened_at") >= F.lit(happened_after).cast("timestamp"))
    if happened_before:
        found.append(F.col("happened_at") <= F.lit(happened_before).cast("timestamp"))
    if min_strength:
        found.append(F.col("strength") >= min_strength)
    if not include_expired:
        found.append(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))
    return reduce(lambda a, b: a & b, found)


def not_expired(now: str) -> Column:
    """The merging stage's rule: a row that expires now is still there."""
    return F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now).cast("timestamp"))


def not_noise(least: int = 10, patterns: tuple[str, ...] = ()) -> Column:
    return (F.char_length("content") >= least) & ~F.coalesce(F.col("content").isin(*patterns), F.lit(False))


def clamp(value: int, default: int, most: int) -> int:
    """A limit as callers give it: the default where it isn't positive, and at most most."""
    return min(value, most) if value > 0 else default


#: Who may write protected classes, the classes, and how a scope may begin.
INTERNAL_SOURCES = ("reflect", "session_summary", "consolidation", "system")
PROTECTED_CLASSES = ("core", "procedural")
SCOPE_PREFIXES = ("user/", "project/", "session/", "agent/")
#: The blocks that a core row may be.
CORE_BLOCKS = ("user_profile", "user_preferences", "active_goals", "current_project_state", "operating_rules")


def may_write() -> Column:
    """Protected classes come from internal sources only."""
    return ~F.col("memory_class").isin(*PROTECTED_CLASSES) | F.col("source_type").isin(*INTERNAL_SOURCES)


def valid_scope() -> Column:
    return (F.col("scope") == "") | reduce(lambda a, b: a | b, [F.col("scope").startswith(p) for p in SCOPE_PREFIXES])


def core_write(blocks: tuple[str, ...] = CORE_BLOCKS, most: int = 500) -> Column:
    """A core row is of a known block, or of none, and short."""
    known = (F.col("sub_kind") == "") | F.col("sub_kind").isin(*blocks)
    return (F.col("memory_class") != "core") | (known & (F.char_length("content") <= most))


def writable_scope(rows: DataFrame, policies: DataFrame, writer: str = "owner_id") -> DataFrame:
    """rows with actual_scope and downgraded: a project whose policy lists other writers becomes the writer's own scope.

    policies: (scope, allowed_writers array). No policy, or an empty list, restricts nobody.
    """
    known = policies.select(F.col("scope").alias("_scope"), "allowed_writers")
    joined = rows.join(known, rows["scope"] == known["_scope"], "left")
    denied = F.col("scope").startswith("project/") & (F.size("allowed_writers") > 0) & ~F.array_contains("allowed_writers", F.col(writer))
    denied = F.coalesce(denied, F.lit(False))
    scope = F.when(denied, F.concat(F.lit("user/"), F.col(writer))).otherwise(F.col("scope"))
    return joined.withColumns({"actual_scope": scope, "downgraded": denied}).drop("_scope", "allowed_writers")


#: The edges of a session's states.
TRANSITIONS = (
    ("created", "bootstrapped"), ("bootstrapped", "active"), ("active", "finalizing"), ("active", "pending_repair"),
    ("finalizing", "finalized"), ("finalizing", "pending_repair"), ("pending_repair", "finalizing"), ("pending_repair", "abandoned"),
)


def allowed_transitions(requests: DataFrame, source: str = "from_state", target: str = "to_state") -> DataFrame:
    """The rows of requests whose two states make an edge."""
    edge = reduce(lambda a, b: a | b, [(F.col(source) == a) & (F.col(target) == b) for a, b in TRANSITIONS])
    return requests.filter(edge)
