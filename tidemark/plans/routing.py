"""Which pipeline a query takes: intent, route, time window and channel weights, as columns and as plain functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import cjk_ratio
from tidemark.operators.fulltext import STOP_WORDS
from tidemark.operators.segmentation import Tokenizer

#: The patterns that tell what a query is about.
TEMPORAL = r"(?i)\b(recent|latest|last\s+week|last\s+month|last\s+quarter|yesterday|today|this\s+week|this\s+month|past\s+few\s+days)\b|最近|上周|上月|前天|昨天|今天|本周|本月|这几天|之前"
RELATIONAL = r"(?i)\b(related\s+to|associated\s+with|connected\s+to|regarding|depends\s+on|dependencies\s+of)\b|相关|关于|有关|关联|之间|依赖"
EXPLORATORY = r"(?i)\b(how|why|what|when|where|which|explain|describe|summarize|overview)\b|怎么|为什么|什么|如何|谁|哪里|解释|描述|总结|概述|哪些"
AGGREGATION = r"(?i)\b(total|average|sum\s+of|in\s+total|altogether|across\s+all|how\s+much\s+total)\b|一共|总共|总计|多少(个|次|钱|天)|平均|合计|累计|所有.*加起来"
HISTORY = r"(之前|以前|历史上|过去).*(都|哪些|所有)"
#: Fixed values: (pattern, days of the window, days from now to its center), the first that matches.
WINDOWS = (
    (r"(?i)\b(today)\b|今天", 1, 0), (r"(?i)\b(yesterday)\b|昨天", 1, -1), (r"前天", 1, -2),
    (r"(?i)\b(this\s+week)\b|本周|这周|这几天|最近几天", 7, 0), (r"(?i)\b(last\s+week)\b|上周|上一周", 7, -7),
    (r"(?i)\b(this\s+month)\b|本月|这个月", 30, 0), (r"(?i)\b(last\s+month)\b|上月|上个月", 30, -30), (r"(?i)\b(last\s+quarter)\b|上季度", 90, -90),
    (r"(?i)\b(recent\s+months?|past\s+few\s+months?)\b|最近几个月", 90, 0), (r"(?i)\b(this\s+year)\b|今年", 365, 0), (r"(?i)\b(last\s+year)\b|去年", 365, -365),
)
#: Pipelines by intent, and (text, vector, graph) weights by intent over their bases.
BY_INTENT = {"keyword": "precision", "semantic": "semantic", "temporal": "exploration", "relational": "association", "aggregation": "aggregation"}
CHANNELS = {"keyword": (1.5, 0.6, 0.5), "semantic": (0.6, 1.5, 0.8), "temporal": (1.3, 0.8, 0.6), "relational": (0.4, 0.7, 1.8), "general": (1.0, 1.0, 1.0)}
BASES = (1.0, 1.0, 0.8)
SHORT = 5


def intent(query: Column) -> Column:
    """temporal, relational, keyword for short queries, semantic for long or exploring ones, else general."""
    length, cjk = F.char_length(query), cjk_ratio(query) > 0.5
    short, long = F.when(cjk, 8).otherwise(20), F.when(cjk, 25).otherwise(35)
    explores = query.rlike(EXPLORATORY)
    return (
        F.when(query.rlike(TEMPORAL), "temporal").when(query.rlike(RELATIONAL), "relational")
        .when((length > 0) & (length <= short) & ~explores, "keyword").when((length > long) | explores, "semantic").otherwise("general")
    )


def route(query: Column, asked: Column, fallback: str = "exploration") -> Column:
    """The pipeline of a query with an intent; '' and general are none."""
    length, told = F.char_length(query), ~asked.isin("", "general")
    by_intent = F.lit(None).cast("string")
    for name, pipeline in BY_INTENT.items():
        by_intent = F.when(asked == name, pipeline).otherwise(by_intent)
    short = (length > 0) & (length < SHORT)
    return (
        F.when(~told & short, "fast").when(query.rlike(HISTORY), "aggregation").when(query.rlike(TEMPORAL), "exploration")
        .when(query.rlike(AGGREGATION), "aggregation").when(query.rlike(RELATIONAL), "association").when(by_intent.isNotNull(), by_intent)
        .when(short, "fast").when(query.rlike(EXPLORATORY), "exploration").otherwise(fallback)
    )


#: The pipelines that a model may name.
SELECTABLE = ("precision", "exploration", "semantic", "association", "fast", "full")


def chosen(answer: Column, query: Column, asked: Column) -> Column:
    """The pipeline that a model's answer, a JSON object, names; that of the rules where it names none it may choose."""
    name = F.get_json_object(answer, "$.pipeline")
    return F.when(name.isin(*SELECTABLE), name).otherwise(route(query, asked))


def window_days(query: Column) -> Column:
    """A struct of the window's days and its center's offset in days; 30 days around now without a rule."""
    out = F.struct(F.lit(30).alias("days"), F.lit(0).alias("offset"))
    for pattern, days, offset in reversed(WINDOWS):
        out = F.when(query.rlike(pattern), F.struct(F.lit(days).alias("days"), F.lit(offset).alias("offset"))).otherwise(out)
    return out


def channel_weights(asked: Column, bases: tuple[float, float, float] = BASES) -> Column:
    """A struct of the weights of text, vector and graph."""
    names = ("fts", "vector", "graph")
    make = lambda ws: F.struct(*(F.lit(b * w).alias(n) for b, w, n in zip(bases, ws, names)))
    out = make(CHANNELS["general"])
    for name, weights in CHANNELS.items():
        out = F.when(asked == name, make(weights)).otherwise(out)
    return out


def planned(questions: DataFrame, entities: DataFrame, scope: str, synonyms: Callable[[DataFrame], DataFrame] | None = None, tokenizer: Tokenizer | None = None, most_entities: int = 5) -> DataFrame:
    """A row for each question (question_id, text) with what a search is told of it: intent, pipeline, keywords, entities, temporal, days, offset, weights.

    Keywords are its words that no search leaves out, by the tokenizer (None: runs of letters and numbers, case
    kept) and, with synonyms (a function of rows with an array words), expanded. Entities are those of the scope
    whose name is a keyword, in lower case, at most most_entities of each keyword by id, in the order of keywords.
    Days and offset tell the window of a temporal question only. An empty or null question has an intent and
    weights, and no words.
    """
    text = F.coalesce("text", F.lit(""))
    rows = questions.select("question_id", text.alias("text"))
    words = tokenizer(rows, "text", "words") if tokenizer else rows.withColumn("words", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    words = words.withColumn("words", F.filter("words", lambda w: ~F.lower(w).isin(*sorted(STOP_WORDS))))
    words = synonyms(words) if synonyms else words
    asked = words.select("question_id", F.posexplode("words").alias("at", "word")).select("question_id", "at", F.lower("word").alias("word"))
    # the names that are asked for are few; each has at most most_entities ids
    named = entities.filter(F.col("scope") == scope).select(F.lower("name").alias("word"), "id").join(asked.select("word").distinct(), "word", "left_semi")
    named = named.withColumn("nth", F.row_number().over(Window.partitionBy("word").orderBy("id"))).filter(F.col("nth") <= most_entities)
    first = asked.join(named, "word").groupBy("question_id", "id").agg(F.min(F.struct("at", "nth")).alias("place"))
    found = first.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("entities"))
    told = intent(F.col("text"))
    window = window_days(F.col("text"))
    temporal = told == "temporal"
    plan = words.join(found, "question_id", "left").select(
        "question_id", told.alias("intent"), route(F.col("text"), told).alias("pipeline"), F.col("words").alias("keywords"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"),
        temporal.alias("temporal"), F.when(temporal, window["days"]).alias("days"), F.when(temporal, window["offset"]).alias("offset"), channel_weights(told).alias("weights"),
    )
    return plan
