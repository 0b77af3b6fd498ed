"""Salvage of models' JSON, checks of its shape, and the path from question to answer."""

import pytest

from codeloom.operators import answers
from codeloom.operators.answers import salvaged


@pytest.mark.parametrize(("said", "want"), [
    ("{a: 1,}", '{"a": 1}'), ('```json\n{"a": 1,}\n```', '{"a": 1}'), ('x {"a": [1, 2', '{"a": [1, 2]}'), ("no", None), ('{"t": "a, ]", b: [1,],}', '{"t": "a, ]", "b": [1]}'),
    ('{"a": "b, }', '{"a": "b, }"}'), (None, None), ('{"a": 1, "b":', '{"a": 1, "b": null}'), ("", None), ("[1, 2] and [3]", "[1, 2]"), ("}{", "{}"),
    ("{'a': 1, 'b': 'it\\'s \"x\"'}", '{"a": 1, "b": "it\'s \\"x\\""}'), ('{"a": "it\'s"}', '{"a": "it\'s"}'), ("code ```js\nlet x = 1;\n``` then ```json\n{a: 2}\n```", '{"a": 2}'), ("```\nno\n``` [1,]", "[1]"),
])
def test_salvage(said, want):
    assert salvaged(said) == want


def test_schema_errors(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": [2]}',), ('{"a": "1"}',), ('{"a": null, "b": {}}',), ("x",), (None,)], "j string")
    got = [list(r.e) for r in rows.select(answers.schema_errors("j", {"a": "number", "b": "array"}).alias("e")).collect()]
    assert got == [[], ["a not number", "b missing"], ["a not number", "b not array"], ["no JSON"], ["no JSON"]]


def test_questions_are_answered_from_the_nearest_chunks(spark):
    chunks = spark.createDataFrame([(1, "a.js", "JavaScript", "alpha beta", [1.0, 0.0]), (2, "b.js", "JavaScript", "gamma", [0.9, 0.1]), (3, "c.js", "JavaScript", "delta", [0.0, 1.0])], "id long, file_path string, language string, content string, vector array<double>")
    asked = spark.createDataFrame([(7, "what is alpha?", [1.0, 0.0]), (8, "nothing near?", [-1.0, -1.0])], "query_id long, question string, query_vector array<double>")
    got = {r.query_id: r for r in answers.ask(asked, chunks).collect()}
    assert got[7].sources == [1, 2] and got[7].answer == "alpha beta" and "### a.js (100%)" in got[7].prompt and got[7].prompt.endswith("what is alpha?")
    assert got[8].sources is None and got[8].answer is None and "nothing near?" in got[8].prompt
