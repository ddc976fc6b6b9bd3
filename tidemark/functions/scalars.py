"""Scalar functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Han with its first two extensions, Hangul, Hiragana and Katakana.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}"


def normalized(text: Column) -> Column:
    """Lower case, trimmed, white space collapsed: what content hashes are taken of."""
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def content_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def estimated_tokens(text: Column) -> Column:
    """One token for each CJK character, and for each four others, rounded up."""
    cjk = F.regexp_count(text, F.lit(f"[{CJK}]"))
    return (cjk + F.floor((F.char_length(text) - cjk + 3) / 4)).cast("long")


def cjk_ratio(text: Column) -> Column:
    return F.when(F.char_length(text) == 0, 0.0).otherwise(F.regexp_count(text, F.lit(f"[{CJK}]")) / F.char_length(text))


def simple_tokens(text: Column) -> Column:
    """CJK characters one by one, and runs of other letters and digits; case is kept."""
    return F.regexp_extract_all(text, F.lit(rf"[{CJK}]|[\p{{L}}\p{{Nd}}&&[^{CJK}]]+"), F.lit(0))


def indexed_terms(text: Column) -> Column:
    """What the full-text index holds of a text: runs of letters and numbers in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def overlap_text(text: Column) -> Column:
    """Lower case, with one space for whatever is no letter or number."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def overlap_score(query: Column, terms: Column, document: Column) -> Column:
    """query and document as overlap_text gives them: 0.35 for the whole phrase and 0.65 by the share of terms."""
    found = F.size(F.filter(terms, lambda t: F.contains(document, t)))
    score = F.when(F.contains(document, query), 0.35).otherwise(0.0) + F.lit(0.65) * found / F.size(terms)
    return F.when(document == "", 0.0).otherwise(score)


def coverage(words: Column, document: Column) -> Column:
    """The share of words that the document, in lower case, contains."""
    low = F.lower(document)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: F.contains(low, w))) / F.size(words))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def signs(a: Column) -> Column:
    """1 for each element above 0, else -1: what a code of a bit an element keeps of a vector. Nulls stay."""
    return F.transform(a, lambda x: F.when(x > 0, 1.0).when(x <= 0, -1.0).cast("float"))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for vectors of different lengths and for zero ones."""
    norms = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def cosine_with(vector: Column, query: list[float]) -> Column:
    """The cosine with one known query, as sums of products that code generation covers."""
    length = sum(x * x for x in query) ** 0.5
    parts = [F.get(vector, F.lit(i)).cast("double") for i in range(len(query))]
    dot = norm = F.lit(0.0)
    for x, p in zip(query, parts):
        dot, norm = dot + p * x, norm + p * p
    return F.when((F.size(vector) == len(query)) & (norm > 0) & F.lit(length > 0), dot / (F.sqrt(norm) * (length or 1.0))).otherwise(0.0)


def blended(query: Column, other: Column, weight: float) -> Column:
    return F.zip_with(query, other, lambda q, h: (1 - weight) * q.cast("double") + weight * h.cast("double"))


def hours_between(start: Column, now: str) -> Column:
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(start)) / 3_600_000_000


def effective_strength(now: str, alpha: float = 0.15) -> Column:
    """Decayed by the hours since the last access, raised by the number of accesses, at most threefold."""
    hours = F.greatest(hours_between(F.col("last_accessed_at"), now), F.lit(0.0))
    boost = F.least(F.lit(3.0), 1 + alpha * F.log2(F.col("access_count") + 1.0))
    lasting = (F.col("retention_tier") == "permanent") | F.col("last_accessed_at").isNull()
    return F.when(lasting, F.col("strength")).otherwise(F.col("strength") * F.exp(-F.col("decay_rate") * hours) * boost)


def age_decay(start: Column, now: str, rate: float) -> Column:
    """exp(-rate * days); 1 without a rate, and for what lies ahead."""
    days = F.greatest(hours_between(start, now) / 24, F.lit(0.0))
    return F.exp(-rate * days) if rate > 0 else F.lit(1.0)


#: Weights by kind, sub-kind, class and scope, and for the direct path.
KIND = {"skill": 1.5, "rule": 1.4, "mental_model": 1.3, "preference": 1.2, "goal": 1.2, "note": 1.0, "event": 0.9, "error": 0.8}
SUB_KIND = {"core_belief": 1.4, "working_memory": 0.7}
CLASS = {"procedural": 1.5, "semantic": 1.2, "core": 1.4, "episodic": 1.0}
SCOPE = {"session": 1.3, "project": 1.2, "user": 1.0, "agent": 1.0, "global": 0.9}
DIRECT_KIND = {"skill": 1.5, "profile": 1.2, "fact": 1.0, "note": 1.0}
DIRECT_SUB_KIND = {"pattern": 1.3, "case": 1.3}
DIRECT_CLASS = {"procedural": 1.5, "semantic": 1.2, "episodic": 1.0}
DIRECT_SCOPE = {"session": 1.3, "project": 1.2, "user": 1.1, "agent": 1.0}


def looked_up(key: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, weight in weights.items():
        out = F.when(key == name, F.lit(weight)).otherwise(out)
    return out


def _scope_boost(weights: dict[str, float], slash: bool) -> Column:
    prefix = F.substring_index(F.col("scope"), "/", 1)
    boost = looked_up(prefix, weights)
    boost = F.when(F.contains(F.col("scope"), F.lit("/")), boost).otherwise(1.0) if slash else boost
    return boost * F.when(F.col("scope").startswith("user/") & (F.col("memory_class") == "core"), 1.15).otherwise(1.0)


def structural_weight(now: str, alpha: float = 0.15, least: float = 0.05, most: float = 2.0) -> Column:
    """Kind, sub-kind, class, scope and effective strength multiplied, at most most."""
    kinds = looked_up(F.col("kind"), KIND) * looked_up(F.col("sub_kind"), SUB_KIND) * looked_up(F.col("memory_class"), CLASS)
    return F.least(kinds * _scope_boost(SCOPE, slash=False) * F.greatest(effective_strength(now, alpha), F.lit(least)), F.lit(most))


def direct_weight(most: float = 2.0) -> Column:
    """The direct path's: kind and class are bounded together, then the scope's boost."""
    kinds = looked_up(F.col("kind"), DIRECT_KIND) * looked_up(F.col("sub_kind"), DIRECT_SUB_KIND) * looked_up(F.col("memory_class"), DIRECT_CLASS)
    return F.least(kinds, F.lit(most)) * _scope_boost(DIRECT_SCOPE, slash=True)


def temporal_score(when: Column, center: str, range_days: float) -> Column:
    """1 within range_days (at least one) of center, then falling with the distance."""
    days, reach = F.abs(hours_between(when, center)) / 24, max(1.0, range_days)
    return F.when(days <= reach, 1.0).otherwise(1 / (1 + days / reach))


#: Tiers from the least to the most lasting with their decay rates, and the least tier of a class.
TIERS = {"ephemeral": 0.1, "short_term": 0.05, "standard": 0.01, "long_term": 0.001, "permanent": 0.0}
LEAST_TIER = {"episodic": "short_term", "semantic": "standard", "procedural": "long_term", "core": "permanent"}


def _case(key: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def decay_of(tier: Column) -> Column:
    return _case(tier, TIERS, TIERS["standard"])


def tier_rank(tier: Column) -> Column:
    return _case(tier, {t: i for i, t in enumerate(TIERS)}, 2)


def next_tier(tier: Column) -> Column:
    names = list(TIERS)
    return F.coalesce(_case(tier, dict(zip(names, names[1:])), None), tier)


def least_tier(memory_class: Column) -> Column:
    return _case(memory_class, LEAST_TIER, "standard")


def excerpt(text: Column) -> Column:
    """A short text is its own excerpt; of a longer one, without a summariser, the first hundred characters."""
    return F.when(F.char_length(text) <= 50, text).otherwise(F.substring(text, 1, 100))


def proper_nouns(text: Column) -> Column:
    """Phrases of capitalised words."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), F.lit(0)))


def remote_url(url: Column) -> Column:
    """A repository's remote in one form, host/path in lower case: without scheme, user, port and suffix."""
    plain = F.regexp_replace(F.trim(url), r"^(ssh|https?|git)://", "")
    short = F.trim(url).rlike(r"^[\w.-]+@[\w.-]+:.+$")
    path = F.regexp_replace(F.regexp_replace(plain, r"^[^@]*@", ""), r"^([^:]*):[^/]*/", "$1/")
    found = F.when(short, F.regexp_replace(F.trim(url), r"^[\w.-]+@([\w.-]+):", "$1/")).otherwise(path)
    return F.lower(F.regexp_replace(found, r"\.git$", ""))


def project_id(url: Column) -> Column:
    return F.concat(F.lit("p_"), F.substring(F.sha2(remote_url(url), 256), 1, 12))


def cut(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text) if most > 0 else text


def observation(tool: Column, given: Column, output: Column, most_given: int = 500, most_output: int = 500) -> Column:
    """One line of a captured tool call: a file's path, or a command with its output, or what was given, cut."""
    path, command = F.get_json_object(given, "$.file_path"), F.get_json_object(given, "$.command")
    told = cut(output, most_output)
    ran = F.concat(F.lit("$ "), cut(command, 200), F.when(told != "", F.concat(F.lit(" -> "), cut(told, 200))).otherwise(""))
    file = tool.isin("Write", "Edit", "Read") & (F.coalesce(path, F.lit("")) != "")
    shell = (tool == "Bash") & (F.coalesce(command, F.lit("")) != "")
    return F.concat(F.lit("["), tool, F.lit("] "), F.when(file, path).when(shell, ran).otherwise(cut(given, most_given)))
