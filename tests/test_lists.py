"""A search takes a word's lists of positions once, however many phrases and questions ask for the word."""

from tidemark.operators import fulltext
from tidemark.operators.segments import SegmentedIndex
from tidemark.session import shared_dir


def test_lists_and_phrases(spark):
    index = SegmentedIndex(spark, f"{shared_dir(spark)}/lists", {"content": 1.0})
    texts = {"a": "la la la sol", "b": "sol la", "c": "la sol sol's la", "d": ""}
    rows = spark.createDataFrame(list(texts.items()), "id string, content string")
    index.add(rows)
    held = index.index()
    words = spark.createDataFrame([("la",), ("sol",)], "term string")
    assert {(r.id, r.term): r.positions for r in held.lists_of(words).collect()} == {("a", "la"): [0, 1, 2], ("a", "sol"): [3], ("b", "sol"): [0], ("b", "la"): [1], ("c", "la"): [0, 4], ("c", "sol"): [1, 2]}
    asked = [(1, "la la", 1, 1), (2, "la sol", 1, 1), (3, "sol s la", 1, 1), (4, "la", 1, 1), (5, "sol la", 1, 1), (6, "la la la", 1, 1), (7, "la", 1, 2), (7, "sol la", 1, 2)]
    parts = spark.createDataFrame(asked, "query_id int, phrase string, times long, need int")
    for made in (held, None):
        got = {(r.query_id, r.id) for r in fulltext.bm25(rows, parts, {"content": 1.0}, made).collect()}
        assert got == {(1, "a"), (2, "a"), (2, "c"), (3, "c"), (4, "a"), (4, "b"), (4, "c"), (5, "b"), (6, "a"), (7, "b")}
