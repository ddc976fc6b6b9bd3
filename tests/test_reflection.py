"""Reflection over all questions at once against the loop of one question."""

from tidemark.operators import hooks

TEXTS = [(f"t{i:02d}", "x" * (i * 7 % 120)) for i in range(40)]


def one(question, k):
    return [(text, 1.0 / (1 + (len(question) + i) % 5)) for i, (_, text) in enumerate(TEXTS[: max(0, len(question) - 2)])][:k]


def test_all_questions_at_once(spark):
    def reason(question, rows):
        if question.startswith("same"):
            return None, question
        if question.startswith("stop"):
            return None, None
        if len(rows) < 4:
            return f"{len(rows)}", None
        return None, question[:-3] if not question.startswith("long") else question + "!"

    questions = [(i, q) for i, q in enumerate(["", "abc", "abcdefghij", "same question", "stop here", "long " * 6, "abcdefghijklmnopqrst", "abcdefghij", "abcdefg"])]

    def retrieve(rows, limit):
        made = [(r.query_id, text, score, nth) for r in rows.collect() for nth, (text, score) in enumerate(one(r.text, limit), 1)]
        return spark.createDataFrame(made, "query_id int, text string, score double, nth int")

    for budget in (4096, 60):
        got = {r.query_id: (r.conclusion, r.asked) for r in hooks.reflected(spark.createDataFrame(questions, "query_id int, text string"), retrieve, reason, budget=budget).collect()}
        assert got == {i: hooks.reflect(q, one, reason, budget=budget) for i, q in questions}
    assert hooks.reflected(spark.createDataFrame([], "query_id int, text string"), retrieve, reason).count() == 0
