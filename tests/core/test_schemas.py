import json

import pytest

from ledgerlark.operators.schemas import Schema, checked, checked_answers, compiled, detail, named

ENVELOPE = {
    "type": "object", "additionalProperties": False, "required": ["event"],
    "properties": {"event": {"type": "object", "additionalProperties": False, "required": ["application", "eventName", "when"], "properties": {
        "application": {"type": "integer"}, "eventName": {"type": "string", "const": "Unauthorized"}, "when": {"type": "string", "format": "date-time"}}}},
}


def broken(spark, schema, *payloads):
    """(path, keyword) of each payload's breaches."""
    rows = [(k, p if isinstance(p, str) or p is None else json.dumps(p)) for k, p in enumerate(payloads)]
    found = checked(spark.createDataFrame(rows, "k int, payload string"), schema).orderBy("k").collect()
    return [[(b.path, b.keyword) for b in r.breaches] for r in found]


def test_seven_kinds_of_drift(spark):
    good = {"event": {"application": 1, "eventName": "Unauthorized", "when": "2026-01-01T00:00:00Z"}}
    event = good["event"]
    cases = [good, {"event": event | {"more": 1}}, {"event": {k: v for k, v in event.items() if k != "when"}}, {"event": event | {"application": "1"}}, {"event": event | {"eventName": "Other"}}, {"event": event | {"when": "yesterday"}}, {"event": event, "x": None}, {}, [], "no json", None, {"event": event | {"application": 1.0, "when": "2026-02-30T00:00:00Z"}}]
    assert broken(spark, ENVELOPE, *cases) == [
        [], [("/event", "additionalProperties")], [("/event", "required")], [("/event/application", "type")], [("/event/eventName", "const")], [("/event/when", "format")], [("", "additionalProperties")],
        [("", "required")], [("", "type")], [("", "json")], [("", "json")], [("/event/when", "format")],
    ]


def test_detail_of_breaches(spark):
    df = spark.createDataFrame([('{"event": {"application": "1", "more": 2}}',), ("[]",)], "payload string")
    text, root = (r[0] for r in checked(df, ENVELOPE).select(detail("breaches")).collect())
    assert text.split("\n") == [
        "  - /event must NOT have additional properties {\"additionalProperty\":\"more\"}", "  - /event must have required property 'eventName' {\"missingProperty\":\"eventName\"}",
        "  - /event must have required property 'when' {\"missingProperty\":\"when\"}", '  - /event/application must be integer {"type":"integer"}',
    ]
    assert root == '  - (root) must be object {"type":"object"}'


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"type": ["string", "null"]}, ["a", None], [1, True, [], {}]),
        ({"type": "number"}, [1, 1.5, -2e3], ["1", None]),
        ({"type": "integer"}, [1, 1.0, 10**15], [1.5, True]),
        ({"type": "boolean"}, [True, False], [0, "true"]),
        ({"enum": [1, "a", None, {"x": [1, 2], "y": 0}]}, [1, 1.0, "a", None, {"y": 0, "x": [1, 2]}], [2, "b", {"x": [2, 1], "y": 0}, []]),
        ({"const": 3}, [3, 3.0], ["3", 4]),
        ({"pattern": "^a.c"}, ["abcd", 1], ["xabc"]),
        ({"minLength": 2, "maxLength": 3}, ["é𝄞", "abc", 1], ["a", "abcd"]),
        ({"minimum": 1, "exclusiveMaximum": 3}, [1, 2.9, "x"], [0.9, 3]),
        ({"exclusiveMinimum": 1, "maximum": 3}, [1.1, 3], [1, 3.1]),
        ({"multipleOf": 2.5}, [0, 5, -2.5], [1, 2]),
        ({"items": {"type": "integer"}}, [[], [1, 2], {}], [[1, "a"]]),
        ({"items": [{"type": "integer"}, {"type": "string"}], "additionalItems": False}, [[1], [1, "a"], []], [["a"], [1, "a", 2]]),
        ({"items": [{}], "additionalItems": {"type": "string"}}, [[1, "a"]], [[1, "a", 2]]),
        ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, [[1], [1, 2], "x"], [[], [1, 2, 3], [1, 1]]),
        ({"contains": {"const": 1}}, [[2, 1], 5], [[], [2]]),
        ({"minProperties": 1, "maxProperties": 1}, [{"a": 1}], [{}, {"a": 1, "b": 2}]),
        ({"patternProperties": {"^n_": {"type": "integer"}}, "additionalProperties": {"type": "string"}}, [{"n_a": 1, "b": "x"}], [{"n_a": "x"}, {"b": 1}]),
        ({"propertyNames": {"maxLength": 2}}, [{"ab": 1}, {}], [{"abc": 1}]),
        ({"allOf": [{"type": "integer"}, {"minimum": 3}]}, [3], [2, "a"]),
        ({"anyOf": [{"type": "integer"}, {"const": "x"}]}, [3, "x"], ["y"]),
        ({"oneOf": [{"type": "integer"}, {"minimum": 3}]}, [2, 3.5], [3, 2.5]),
        ({"not": {"type": "string"}}, [1], ["a"]),
        ({"if": {"minimum": 10}, "then": {"multipleOf": 10}, "else": {"multipleOf": 3}}, [20, 9], [21, 8]),
        ({"$ref": "#/definitions/a~1b", "definitions": {"a/b": {"type": "integer"}}}, [1], ["a"]),
        ({"properties": {"a/b~": {"type": "integer"}}}, [{"a/b~": 1}, {}], [{"a/b~": "x"}]),
        (False, [], [1, None]),
        (True, [1, None, {}], []),
        ({"format": "date"}, ["2024-02-29", 1], ["2023-02-29", "2024-2-9"]),
        ({"format": "ipv4"}, ["10.0.255.1"], ["10.0.256.1", "1.2.3", "1.2.3.4."]),
        ({"format": "uuid"}, ["123e4567-e89b-12d3-a456-426614174000"], ["123e4567"]),
        ({"format": "email"}, ["a.b@c.de"], ["a@b", "a b@c.de"]),
        ({"format": "uri"}, ["https://x/y"], ["x/y"]),
        ({"format": "time"}, ["23:59:59Z"], ["24:00:00Z"]),
        ({"format": "of-no-kind", "unheard": 1}, ["x"], []),
    ],
)
def test_keywords(spark, schema, good, bad):
    found = broken(spark, schema, *map(json.dumps, [*good, *bad]))
    assert all(not b for b in found[: len(good)]) and all(found[len(good) :]), found


def test_paths_into_arrays_and_odd_keys(spark):
    schema = {"properties": {"rows": {"items": {"properties": {"a/b": {"type": "integer"}}, "additionalProperties": {"items": {"minimum": 2}}}}}}
    assert broken(spark, schema, {"rows": [{"a/b": 1}, {"a/b": "x", "c~": [2, 1]}]}) == [[("/rows/1/a~1b", "type"), ("/rows/1/c~0/1", "minimum")]]


def test_schemas_by_name_are_read_once(spark, tmp_path):
    (tmp_path / "login.schema.json").write_text(json.dumps(ENVELOPE))
    first = named(spark, str(tmp_path), "login")
    (tmp_path / "login.schema.json").unlink()
    assert named(spark, f"{tmp_path}", "login") is first and first is compiled(json.dumps(ENVELOPE))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        named(spark, str(tmp_path), "other")


def test_references_that_lead_nowhere_or_back(spark):
    from pyspark.sql import functions as F

    for schema in ({"$ref": "#/definitions/a", "definitions": {"a": {"items": {"$ref": "#/definitions/a"}}}}, {"$ref": "other.json#/a"}):
        with pytest.raises(ValueError):
            Schema(schema).breaches(F.parse_json(F.lit("1")))


def test_answers_of_endpoints(spark):
    rows = [("a", 401, '{"k": 1}'), ("b", 200, '{"k": 1}'), ("c", 401, "{}"), ("d", None, None)]
    answers = spark.createDataFrame(rows, "url string, status int, body string")
    ok = lambda df: [r.ok for r in df.orderBy("url").collect()]
    assert ok(checked_answers(answers, {"required": ["k"]}, 401)) == [True, False, False, False]
    assert ok(checked_answers(answers, {"required": ["k"]})) == [False, True, False, False]
    assert checked_answers(answers.limit(0), {"required": ["k"]}).count() == 0


def test_problems_of_browser_events(spark):
    from ledgerlark.operators.contracts import browser_problems, page_health

    events = [{"kind": "pageerror", "message": "x is undefined"}, {"kind": "requestfailed", "method": "GET", "url": "/a.js"}, {"kind": "requestfailed", "method": "GET", "url": "/api/login/refresh", "error": "reset"},
              {"kind": "response", "status": 404, "method": "GET", "url": "/b"}, {"kind": "response", "status": 399, "method": "GET", "url": "/c"}, {"kind": "response", "status": 401, "method": "POST", "url": "/api/login/refresh?x"}, {"kind": "console"}]
    log = spark.createDataFrame([("p", json.dumps(e)) for e in events] + [("q", "no json"), ("q", None)], "page string, event string")
    found = browser_problems(log, r"/api/login/refresh\b")
    assert sorted((r.page, r.what, r.text) for r in found.collect()) == [("p", "error", "Uncaught: x is undefined"), ("p", "failure", "404 GET /b"), ("p", "failure", "GET /a.js — failed")]
    health = page_health(log.select("page").distinct(), found.filter("what = 'error'"), found.filter("what = 'failure'"))
    assert {r.page: (r.errors, r.failures, r.healthy) for r in health.collect()} == {"p": (1, 2, False), "q": (0, 0, True)}
