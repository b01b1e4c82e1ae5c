"""Dotted paths over JSON of many layouts, against a plain walk."""

import json

import pytest

from ledgerloom.functions import paths


def walk(text, dotted):
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return None
    for key in dotted.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return None if value is None or isinstance(value, (dict, list)) else value


TEXTS = ['{"a": {"b": "x"}, "c": 1}', '{"a": "flat"}', '{"a": {"b": {"c": "deep"}}}', '{"a": [1, 2]}', '{"a": null, "c": "z"}', '{"a": ""}',
         "[1]", '"a"', "7", "{}", "", None, "{broken", '{"a": {"b": ""}, "c": "last"}', '{"it\'s here": {"b c": "q"}}', '{"a": {"b": true}}']


def test_paths_are_walked_key_by_key(spark):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for dotted in ("a", "a.b", "a.b.c", "c", "it's here.b c", "no.such"):
        got = {r.i: r.v for r in table.select("i", *paths.fields("t", {"v": ([dotted], "string")})).collect()}
        for i, text in enumerate(TEXTS):
            value = walk(text, dotted)
            wanted = None if value is None or value == "" else str(value).lower() if isinstance(value, bool) else str(value)
            assert got[i] == wanted, (text, dotted)


def test_first_path_with_a_value_wins(spark):
    table = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r.v for r in table.select(*paths.fields("t", {"v": (["a.b", "a", "c"], "string")})).collect()]
    assert got == ["x", "flat", None, None, "z", None, None, None, None, None, None, None, None, "last", None, "true"]


def test_a_number_is_asked_for_as_a_number(spark):
    table = spark.createDataFrame([('{"a": {"n": 2.5}}',), ('{"n": "3"}',), ('{"n": "x"}',)], "t string")
    assert [r.v for r in table.select(*paths.fields("t", {"v": (["a.n", "n"], "double")})).collect()] == [2.5, 3.0, None]


def test_an_empty_key_is_refused():
    with pytest.raises(ValueError):
        paths.variant_path("a..b")
