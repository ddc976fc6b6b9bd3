"""Numbers worked out by hand, and sequential operators against plain Python."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.operators import chunking, fulltext, graphs, hooks, relations, selection, snapshots, vectorsearch
from tidemark.plans import pipelines, routing
from tidemark.sources.files import json_cases
from tidemark.streaming import streams


def test_reciprocal_ranks_of_two_channels(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, "fts"), (1, "b", 0.8, "fts"), (1, "b", 0.7, "vector"), (1, "c", 0.1, "vector")], "query_id int, id string, score double, source string")
    got = {r.id: r.score for r in relations.fused(rows, "query_id").collect()}
    assert got["b"] == pytest.approx(1 / 62 + 1 / 61)
    assert max(got, key=got.get) == "b"


def test_trust(spark):
    df = spark.createDataFrame([(["graph", "fts"],), (["vector"],), (["fts"],), (["graph"],)], "sources array<string>")
    assert [r[0] for r in df.select(relations.trust(F.col("sources"))).collect()] == [1.5, 1.0, 0.8, 1.0]


def test_windows_of_time(spark):
    df = spark.createDataFrame([("what did I do today",), ("notes of last month",), ("昨天的会议",), ("plain",)], "q string")
    assert [tuple(r[0]) for r in df.select(routing.window_days(F.col("q"))).collect()] == [(1, 0), (30, -30), (1, -1), (30, 0)]


def test_match_parts():
    assert fulltext.match_parts("the state of the art") == ["state", "art"]
    assert fulltext.match_parts("graph-aware merge stage")[-1] == "merge stage"
    assert fulltext.match_parts("is it") == ["is", "it"]
    assert len(fulltext.match_parts(" ".join(f"w{i}" for i in range(40)))) == 12


def test_tokens(spark):
    df = spark.createDataFrame([("",), ("abcde",), ("你好ab",)], "t string")
    assert [r[0] for r in df.select(s.estimated_tokens(F.col("t"))).collect()] == [0, 2, 3]
    assert spark.createDataFrame([("你好World x1",)], "t string").select(s.simple_tokens(F.col("t"))).first()[0] == ["你", "好", "World", "x1"]


def test_remote_urls(spark):
    urls = ["git@Host.org:Team/Repo.git", "https://me@host.org/team/repo.git", "ssh://git@host.org:2222/team/repo"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r[0] for r in df.select(s.remote_url(F.col("u"))).collect()} == {"host.org/team/repo"}


def test_diverse_order_prefers_what_differs():
    same, other = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert selection.diverse_order(["a", "b", "c"], [1.0, 0.95, 0.9], [same, same, other], 0.5, 2) == [0, 2]
    assert selection.diverse_order([], [], [], 0.5, 2) == []


def test_disclosure():
    rows = [("a", 500, 100, 10), ("b", 800, 100, 10), ("c", 700, 0, 0), ("d", 5, 0, 0), ("e", 0, 0, 0), ("f", 5000, 0, 300), ("g", 150, 0, 0), ("h", 5000, 900, 800)]
    told = [("a", "core", "full", 500), ("b", "core", "summary", 100), ("c", "context", "full", 700), ("d", "context", "full", 5), ("e", "overflow", "pointer", 0), ("f", "entity", "excerpt", 300), ("g", "timeline", "full", 150), ("h", "overflow", "pointer", 0)]
    assert selection.disclose(rows, 2000) == told
    assert selection.disclose([("a", 1100, 0, 0)], 2000, "precision") == [("a", "core", "full", 1100)]
    assert selection.disclose([("a", 900, 0, 0)], 2000, "temporal") == [("a", "timeline", "full", 900)]


def test_a_retry_keeps_the_better(spark):
    first = spark.createDataFrame([(1, "a", 0.2), (2, "b", 0.5), (3, "c", 0.2)], "query_id long, id string, score double")
    again = spark.createDataFrame([(1, "x", 0.25), (1, "a", 0.1), (2, "y", 0.9), (3, "z", 0.1), (4, "w", 0.9)], "query_id long, id string, score double")
    got = sorted(map(tuple, pipelines.retried(first, again).collect()))
    assert got == [(1, "a", 0.1), (1, "x", 0.25), (2, "b", 0.5), (3, "c", 0.2)]


def test_phrases_and_stop_words_in_a_search(spark):
    rows = spark.createDataFrame([("a", "red green blue", "", ""), ("b", "green red blue", "", ""), ("c", "is it there", "", ""), ("d", "it was", "", ""), ("e", None, None, None)], "id string, content string, excerpt string, summary string")
    asked = spark.createDataFrame([(1, "red green blue"), (2, "is it"), (3, ""), (4, None)], "query_id long, text string")
    parts = {(r.query_id, r.phrase): (r.times, r.need) for r in fulltext.query_parts(asked).collect()}
    assert parts == {(1, p): (1, 1) for p in ("red", "green", "blue", "red green", "green blue")} | {(2, "is"): (1, 2), (2, "it"): (1, 2)}
    found = {(r.query_id, r.id): r.bm25 for r in fulltext.bm25(rows, fulltext.query_parts(asked)).collect()}
    assert set(found) == {(1, "a"), (1, "b"), (2, "c")} and found[1, "a"] > found[1, "b"]


def test_json_cases(spark, tmp_path):
    (tmp_path / "cases.json").write_text('{"query": "a", "expected": ["x", "y"], "category": "c"}\n{"query": "b"}\nno object\n')
    assert [tuple(r) for r in json_cases(spark, str(tmp_path / "cases.json")).orderBy("query").collect()] == [("a", ["x", "y"], "c", ""), ("b", [], "", "")]


def test_batches():
    assert selection.batches_of([5, 5, 5, 20, 1], 10) == [0, 0, 1, 2, 3]


def test_average_linkage():
    vectors = [np.array(v, float) for v in ([1, 0], [0.99, 0.1], [0, 1])] + [None]
    assert selection.average_linkage(vectors, 0.8) == [0, 0, 2, 3]


def test_average_linkage_is_that_of_all_pairs():
    rng = np.random.default_rng(4)
    for n, threshold in ((1, 0.3), (30, 0.3), (40, 0.5), (40, -0.2)):
        vectors = [rng.normal(size=4) for _ in range(n)]
        vectors[n // 2] = None
        vectors[3:6] = [np.zeros(4), vectors[2], vectors[2]] if n > 6 else vectors[3:6]
        unit = [np.zeros(4) if v is None or not v.any() else v / np.linalg.norm(v) for v in vectors]
        groups = {i: [i] for i in range(n)}
        while len(groups) > 1:
            far = {(a, b): np.mean([1 - unit[i] @ unit[j] for i in groups[a] for j in groups[b]]) for a in groups for b in groups if a < b}
            a, b = min(far, key=lambda k: (round(far[k], 12), k))
            if far[a, b] > 1 - threshold:
                break
            groups[a] += groups.pop(b)
        expected = {i: a for a, own in groups.items() for i in own}
        assert selection.average_linkage(vectors, threshold) == [expected[i] for i in range(n)]


def test_clusters_of_a_large_block(spark):
    angle = [k // 2 * 0.04 for k in range(300)]
    rows = [(1, f"v{k:03d}", [float(np.cos(x)), float(np.sin(x))]) for k, x in enumerate(angle)]
    got = selection.clustered(spark.createDataFrame(rows, "label int, id string, embedding array<double>"), "label", threshold=0.9999).collect()
    assert {(r.cluster_id, r.id) for r in got} == {(f"v{k // 2 * 2:03d}", f"v{k:03d}") for k in range(300)}


def test_no_limit_is_no_cut(spark):
    vectors = spark.createDataFrame([(f"m{i:02d}", [1.0, float(i)]) for i in range(40)], "id string, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 1.0])], "query_id int, query array<double>")
    assert vectorsearch.search(vectors, asked, None).count() == 40 and vectorsearch.search(vectors, asked, 3).count() == 3
    rows = spark.createDataFrame([(f"m{i:02d}", None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1)) for i in range(40)], "id string, deleted_at timestamp, created_at timestamp, updated_at timestamp")
    links = spark.createDataFrame([(f"e{i % 8}", f"m{i:02d}") for i in range(40)], "entity_id string, memory_id string")
    visited = spark.createDataFrame([(0, f"e{i}", i) for i in range(8)], "query_id int, entity_id string, depth int")
    assert graphs.collected(rows, links, visited, "2024-01-30 12:00:00", limit=None).count() == 40 and graphs.collected(rows, links, visited, "2024-01-30 12:00:00").count() == 30


def test_chunks_cover_the_text_and_overlap():
    text = "\n\n".join("word " * 100 for _ in range(10))
    plain = chunking.split_text(text, 100, 0)
    assert all(len(c) <= 300 for c in plain)
    assert "".join("".join(plain).split()) == "".join(text.split())
    with_tail = chunking.split_text(text, 100, 10)
    assert all(b.startswith(a[-30:]) for a, b in zip(with_tail, with_tail[1:]))
    assert chunking.split_text("") == []
    assert chunking.split_text("x" * 700, 100, 0) == ["x" * 300, "x" * 300, "x" * 100]


def test_markdown_keeps_tables_and_paths():
    got = chunking.split_markdown("# A\ntext\n## B\n| a | b |\n|---|---|\n", title="doc")
    assert [h for h, _ in got] == ["doc > A", "doc > A > B"]
    assert "| a | b |" in got[1][1]


def test_html():
    assert chunking.html_text("<title>t</title><script>x()</script><p>a &amp; b</p>") == "t\na & b"
    assert chunking.html_text(None) == ""


def test_move_refuses_cycles(spark):
    df = spark.createDataFrame([("/a", 0), ("/a/b", 1)], "path string, depth int")
    with pytest.raises(ValueError):
        snapshots.moved(df, "/a", "/a/b")
    assert {tuple(r) for r in snapshots.moved(df, "/a/b", "").collect()} == {("/a", 0), ("/b", 0)}


def test_breaker():
    now = [0.0]
    breaker = pipelines.Breaker(clock=lambda: now[0])
    for _ in range(3):
        assert breaker.allows()
        breaker.told(False)
    assert not breaker.allows()
    now[0] = 31
    assert breaker.allows()
    breaker.told(True)
    assert breaker.allows()


def test_hooks():
    assert hooks.Synonyms([("car", "auto")]).expand(["Car"]) == ["Car", "auto"]
    assert [hooks.next_k(1, 3), hooks.next_k(2, 3), hooks.next_k(3, 3), hooks.next_k(1, 1)] == [15, 8, 5, 5]
    assert [hooks.next_k(2, 4, 80, 100), hooks.next_k(2, 4, 95, 100), hooks.next_k(1, 4, 80, 100)] == [5, 3, 10]
    assert [hooks.next_k(2, 4, best=b) for b in (0.9, 0.5, 0.1)] == [6, 8, 10]
    assert hooks.reflect("q", lambda q, k: [("row", 0.5)], lambda q, rows: (None, "q"))[1] == ["q"]
    wanted = []
    hooks.reflect("q", lambda q, k: wanted.append(k) or [("row", 0.9)], lambda q, rows: (None, q + "!"), rounds=4)
    assert wanted == [15, 6, 6, 5]


def test_finalising_counts_a_key_once(spark):
    sessions = spark.createDataFrame([("a", "active", 0), ("b", "created", 0), ("c", "active", 0), ("d", "finalized", 1), ("e", "active", 0)], "session_id string, state string, version int")
    asked = spark.createDataFrame([("a", "k1"), ("a", "k1"), ("b", "k1"), ("c", "old"), ("d", "k2"), ("x", "k3"), ("e", ""), (None, "k4")], "session_id string, key string")
    used = spark.createDataFrame([("old",)], "key string")
    got = {r.session_id: (r.state, r.version) for r in snapshots.finalized(sessions, asked, used).collect()}
    assert got == {"a": ("finalized", 1), "b": ("created", 0), "c": ("active", 0), "d": ("finalized", 1), "e": ("active", 0)}


def test_repair(spark):
    hour = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("a", "active", hour(1), None), ("b", "pending_repair", hour(2), 3), ("c", "active", hour(3), 2), ("d", "active", dt.datetime(2024, 1, 1, 11, 31), 0), ("e", "created", hour(0), 0), ("f", "active", hour(4), 0), ("g", None, None, None)]
    sessions = spark.createDataFrame(rows, "session_id string, state string, last_seen timestamp, attempts int")
    after = lambda batch: {r.session_id: (r.state, r.attempts) for r in snapshots.repaired(sessions, "2024-01-01 12:00:00", F.col("session_id") == "c", batch=batch).collect()}
    told = {"a": ("finalized", 1), "b": ("abandoned", 3), "c": ("pending_repair", 3), "d": ("active", 0), "e": ("created", 0), "f": ("finalized", 1), "g": (None, None)}
    assert after(None) == told
    assert after(3) == told | {"f": ("active", 0)}


def test_consolidation(spark):
    kinds = "id string, content string, kind string, memory_class string, scope string, team_id string, visibility string, retention_tier string, decay_rate double, strength double, reinforced_count int, access_count int, source_type string, created_at timestamp, updated_at timestamp, expires_at timestamp, deleted_at timestamp"
    now = dt.datetime(2024, 1, 1)
    row = lambda key, content, kind="note", scope="", team="", strength=0.5, deleted=None: (key, content, kind, "episodic", scope, team, "private", "standard", 0.01, strength, 1, 2, "s", now, now, None, deleted)
    rows = spark.createDataFrame([row("a", "one", "", "", "", 0.95), row("b", "two", "consolidated", "s", "t"), row("c", "x" * 100), row("d", "y" * 100), row("e", "alone"), row("f", "gone", deleted=now), row("g", "left")], kinds)
    clusters = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c"), ("c", "d"), ("f", "f"), ("f", "g")], "cluster_id string, id string")
    after, links = snapshots.consolidated(rows, clusters, "2024-02-01 00:00:00", lambda c: F.when(c.contains("xx"), "short").otherwise(c))
    got = {r.id: r for r in after.collect()}
    assert set(got) == set("abcdefg") | {"consolidated-a"}
    new = got["consolidated-a"]
    assert (new.content, new.kind, new.scope, new.team_id, new.strength, new.retention_tier, new.memory_class, new.reinforced_count, new.decay_rate) == ("1. one\n2. [consolidated] two", "", "s", "t", 1.0, "permanent", "semantic", 0, 0.0)
    assert {k for k in got if got[k].consolidated_into} == {"a", "b"} and {k for k in got if got[k].deleted_at} == {"a", "b", "f"}
    assert sorted(map(tuple, links.collect())) == [("a", "consolidated-a"), ("b", "consolidated-a")]
    none = snapshots.consolidated(rows, clusters.limit(0), "2024-02-01 00:00:00")
    assert none[0].count() == 7 and none[1].count() == 0


def test_a_model_may_choose_six_pipelines(spark):
    asked = [('{"pipeline": "full"}', "q"), ('{"pipeline": "aggregation"}', "abcd"), ("no object", "abcd"), (None, "abcd"), ("", "what is related to this")]
    df = spark.createDataFrame(asked, "answer string, q string")
    assert [r[0] for r in df.select(routing.chosen(F.col("answer"), F.col("q"), routing.intent(F.col("q")))).collect()] == ["full", "precision", "precision", "precision", "association"]


def test_synonyms_of_rows(spark):
    df = spark.createDataFrame([(1, ["Car", "car", "x"]), (2, []), (3, None)], "id int, words array<string>")
    got = {r.id: r.words for r in hooks.expanded(df, hooks.Synonyms([("car", "auto")])).collect()}
    assert got == {1: ["Car", "x", "auto"], 2: [], 3: None}


def test_streams_of_sessions_and_requests(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=m), 1, "s", "k") for m in (0, 10, 20, 120)] + [(start + dt.timedelta(minutes=5), 2, "s", "other")]
    spark.createDataFrame(rows, "ts timestamp, user_id long, scope string, key string").write.parquet(str(tmp_path / "log"))
    read = lambda: spark.readStream.schema("ts timestamp, user_id long, scope string, key string").parquet(str(tmp_path / "log"))
    got = streams.drained(streams.idle_sessions(read()), "idle", "complete")
    assert sorted((r.user_id, r.events) for r in got.collect()) == [(1, 1), (1, 3), (2, 1)]
    got = streams.drained(streams.reservations(read()), "reserved")
    assert sorted((r.scope, r.key) for r in got.collect()) == [("s", "k"), ("s", "other")]


def test_work_of_a_ticker_sees_each_row_once(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(5)], "id long").write.parquet(str(tmp_path / "log"))
    seen = []
    run = streams.every(spark.readStream.schema("id long").parquet(str(tmp_path / "log")), "1 second", lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "at"))
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    assert sorted(seen) == [0, 1, 2, 3, 4]


def test_streams_drain(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=m), "a") for m in (0, 1, 7)] + [(start + dt.timedelta(hours=5), "b")]
    spark.createDataFrame(rows, "ts timestamp, memory_id string").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("ts timestamp, memory_id string").parquet(str(tmp_path / "log"))
    got = streams.drained(streams.access_counts(stream), "accesses", "complete")
    assert sorted((r.memory_id, r.accesses) for r in got.collect()) == [("a", 1), ("a", 2), ("b", 1)]
