"""Lenient answers, calls that fail, the whitelist, and who is known already."""

import pytest

from tidemark.operators import extraction

GOOD = '{"entities": [{"name": "Ann", "entity_type": "Person"}], "relations": [{"source": "Ann", "target": "B", "relation_type": "Knows"}]}'


@pytest.mark.parametrize(
    "answer, level",
    [
        (GOOD, "json"), (f"```json\n{GOOD}\n```", "extract"), (f"Sure! {GOOD} Anything else?", "extract"), (f'{{"note": "a }} in {{ a string"}} {GOOD}', "extract"), (f"{{broken {{}} }} then {GOOD}", "extract"),
        ("[1, 2]", "none"), ("", "none"), ("{", "none"), ('{"entities": []}', "none"), ("no", "none"), ('{"entities": "Ann"', "none"),
    ],
)
def test_answers(answer, level):
    found, how = extraction.parsed(answer)
    assert how == level and (found is None) == (level == "none")


def test_calls(spark):
    good = GOOD

    def ask(messages):
        text = messages[0]
        if text.startswith("down"):
            raise TimeoutError("too slow")
        if text.startswith("later"):
            return good if len(messages) == 3 else "what?"
        if text.startswith("never"):
            return "what?"
        if text.startswith("odd"):
            return '{"entities": [{"name": " Uni ", "entity_type": " ORG "}, {"name": "x", "entity_type": "planet"}, {"name": " ", "entity_type": "org"}, {"entity_type": "org"}, 7, {"name": 5, "entity_type": "org"}], "relations": {"a": 1}}'
        return '{"entities": [' + ", ".join(f'{{"name": "n{i}", "entity_type": "tool"}}' for i in range(30)) + "]}"

    rows = spark.createDataFrame([(1, "down"), (2, "later 数据"), (3, "never"), (4, "odd"), (5, "many"), (6, ""), (7, None)], "id int, content string")
    got = {r.id: r for r in extraction.read_texts(rows, ask, relation_types=("knows",)).collect()}
    assert got[1].error == "TimeoutError: too slow" and got[3].error == "no answer could be read" and got[2].level == "retry"
    assert [(e.name, e.entity_type) for e in got[2].entities] == [("Ann", "person")] and got[2].relations[0].relation_type == "knows"
    assert [(e.name, e.entity_type) for e in got[4].entities] == [("Uni", "org")] and got[4].relations == [] and len(got[5].entities) == 20
    assert all(got[i].entities == [] and got[i].error is None for i in (6, 7)) and len(got) == 7


def test_who_is_known(spark):
    entities = spark.createDataFrame([("e2", "New York", "location", "g"), ("e1", "NEW YORK", "location", "g"), ("e3", "Post-Gres", "tool", "g"), ("e4", "Ann", "person", "other")], "id string, name string, entity_type string, scope string")
    found = spark.createDataFrame([(1, "g", "new york", "concept"), (2, "g", "PostGres", "tool"), (3, "g", "postgres!", "org"), (4, "g", "Ann", "person"), (5, "g", "ann", "person"), (5, "g", "Ann", "person"), (6, "g", "--", "tool")], "id int, scope string, name string, entity_type string")
    rows = extraction.resolved(found, entities)
    assert sorted((r.id, r.entity_id or "", r.reused) for r in rows.collect()) == [(1, "e1", "exact"), (2, "e3", "alike"), (3, "", "none"), (4, "", "none"), (5, "", "none"), (5, "", "none"), (6, "", "none")]
    before = spark.createDataFrame([("ann", "g", 2, [4, 9]), ("old", "g", 1, [1])], "name string, scope string, hit_count int, ids array<int>")
    after = {r.name: (r.hit_count, r.ids) for r in extraction.new_candidates(rows, before).collect()}
    assert after == {"ann": (3, [4, 5, 9]), "old": (1, [1]), "postgres!": (1, [3]), "--": (1, [6])}
