"""Layers of fields merged by their schema; against a plain recursion over Python values."""

import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docketry.operators import intake

KIND = "a string, n int, ok boolean, tags array<string>, deep struct<x:string,more:struct<y:bigint,rows:array<struct<k:string,v:int>>>>, notes map<string,string>"
text = st.sampled_from(["", "p", "q"])
layer = st.fixed_dictionaries({
    "a": st.none() | text, "n": st.none() | st.integers(0, 2), "ok": st.none() | st.booleans(), "tags": st.none() | st.lists(st.none() | text, max_size=2),
    "deep": st.none() | st.fixed_dictionaries({"x": st.none() | text, "more": st.none() | st.fixed_dictionaries({
        "y": st.none() | st.integers(0, 1), "rows": st.none() | st.lists(st.fixed_dictionaries({"k": st.none() | text, "v": st.none() | st.integers(0, 1)}), max_size=2)})}),
    "notes": st.none() | st.dictionaries(st.sampled_from("gh"), text, max_size=2)})


def clean(value):
    """None for what says nothing."""
    if isinstance(value, dict):
        return {k: clean(v) for k, v in value.items()}
    if isinstance(value, list):
        return [x for x in map(clean, value) if not nothing(x)] or None
    return value if isinstance(value, bool) else value or None


def nothing(value):
    return all(map(nothing, value.values())) if isinstance(value, dict) else value is None


def plain(first, second):
    a, b = clean(first), clean(second)
    def both(x, y):
        if isinstance(x, dict) or isinstance(y, dict):
            return {k: both((x or {}).get(k), (y or {}).get(k)) for k in {**(x or {}), **(y or {})}}
        return y if x is None else x
    return both(a, b)


def told(value):
    """Without what says nothing, so that a null struct and one of nulls are the same."""
    if isinstance(value, dict):
        return {k: told(v) for k, v in value.items() if not nothing(clean(v))}
    return [told(x) for x in value] if isinstance(value, list) else value


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(layer, layer), min_size=150, max_size=150))
def _compare(spark, pairs):
    def table(side):
        rows = [(i, json.dumps(pair[side], ensure_ascii=False)) for i, pair in enumerate(pairs)]
        return spark.createDataFrame(rows, "id int, j string").select("id", F.from_json("j", KIND).alias("j")).select("id", "j.*")

    got = {r["id"]: json.loads(r["j"]) for r in intake.merge_extracted_fields(table(0), table(1), "id").select(
        "id", F.to_json(F.struct("a", "n", "ok", "tags", "deep", "notes")).alias("j")).collect()}
    for i, (first, second) in enumerate(pairs):
        assert told(got[i]) == told(plain(first, second)), (first, second)


def test_merge_equals_recursion(spark):
    _compare(spark)


def test_fields_of_one_layer_clashes_and_empty_tables(spark):
    left = spark.sql("SELECT 1 AS id, named_struct('x', '', 'only', 'l') AS s UNION ALL SELECT 2, NULL")
    right = spark.sql("SELECT 1 AS id, named_struct('x', 'r', 'other', 0) AS s, array('', 'e') AS more")
    rows = {r["id"]: r.asDict(recursive=True) for r in intake.merge_extracted_fields(left, right, "id").collect()}
    assert rows[1] == {"id": 1, "s": {"x": "r", "only": "l", "other": None}, "more": ["e"]}
    assert rows[2] == {"id": 2, "s": {"x": None, "only": None, "other": None}, "more": None}
    assert intake.merge_extracted_fields(left.limit(0), right, "id").count() == 0
    with pytest.raises(TypeError):
        intake.merge_extracted_fields(left, right.select("id", F.lit("text").alias("s")), "id")


def test_claims_of_a_reply(spark):
    replies = ['{"claims": [{"id": "", "summary": "a"}, "b", {"id": "X", "quote": "q"}, null, 5], "requests": "none"}', "no json", None, "{}", '```json\n{"claims": []}\n```']
    rows = spark.createDataFrame(list(enumerate(replies)), "id int, reply string")
    got = {r["id"]: r["claims"] for r in intake.model_fields(rows).collect()}
    assert [tuple(c) for c in got[0]] == [("C1", "a", ""), ("C2", "b", ""), ("X", "", "q"), ("C4", "", ""), ("C5", "5", "")]
    assert (got[1], got[2], got[3], got[4]) == (None, None, None, [])
