import pytest
from pyspark.sql import functions as F

from deskspark.functions import responses as rs

FIELDS = {
    "label": ("$.label", "string"),
    "score": ("$.scores.tone", "int"),
    "sure": ("$.sure", "double"),
    "first": ("$.tags[0]", "string"),
}
CASES = [
    ('{"label": "a", "scores": {"tone": 4}, "sure": 0.5, "tags": ["x", "y"]}', ("a", 4, 0.5, "x", [], [], None)),
    ('<think>{"label": "b"}</think> {"label": "c", "sure": "0.25"}', ("c", None, 0.25, None, ["score", "first"], [], None)),
    ('ok:\n```json\n{"label": null, "scores": {"tone": "high"}}\n```', (None, None, None, None, ["label", "sure", "first"], ["score"], None)),
    ('I say {"label": "d", "scores": [1], "tags": []} or so', ("d", None, None, None, ["score", "sure", "first"], [], None)),
    ('{"label": 7, "sure": true, "tags": [null]}', ("7", None, 1.0, None, ["score", "first"], [], None)),
    ("[1, 2]", (None, None, None, None, [], [], "json_parse_failed")),
    ('{"label": "cut', (None, None, None, None, [], [], "json_parse_failed")),
    ("", (None, None, None, None, [], [], "json_parse_failed")),
    (None, (None, None, None, None, [], [], "json_parse_failed")),
]


@pytest.fixture(scope="module")
def answers(spark):
    rows = [(i, raw, "old") for i, (raw, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "id int, raw string, label string")


def test_typed_and_nested_fields(answers):
    parsed = rs.parse_typed(answers, "raw", FIELDS)
    assert parsed.columns == ["id", "raw", "label", "score", "sure", "first", "missing", "mistyped", "error"]
    got = {r["id"]: tuple(r)[2:] for r in parsed.collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_drift_counts_every_answer_once_per_field(answers):
    got = {(r["field"], r["kind"]): r["n"] for r in rs.answer_drift(answers, "raw", {"s": "$.scores", "l": "$.label"}).collect()}
    assert got == {
        ("s", "object"): 2, ("s", "array"): 1, ("s", "missing"): 2, ("s", "unreadable"): 4,
        ("l", "string"): 3, ("l", "null"): 1, ("l", "number"): 1, ("l", "unreadable"): 4,
    }


def test_schema_of_all_answers(answers):
    row = rs.answer_schema(answers, "raw").first()
    assert (row["answers"], row["unreadable"]) == (5, 4)
    assert "label: VARIANT" in row["schema"] and row["schema"].startswith("OBJECT<")
    none = rs.answer_schema(answers.where("id > 99"), "raw").first()
    assert (none["answers"], none["unreadable"]) == (0, 0)
    assert rs.parse_typed(answers.where(F.lit(False)), "raw", FIELDS).count() == 0
