"""Problem 3: links of nested rows at any depth, and the odd forms."""

import json

import pytest

from tessera.operators import nested


def rows(body):
    ok, value = nested.parse(body)
    return list(nested.visit(value)) if ok else []


def test_deep_subsets_keep_their_keys():
    inner = {"Name": "C"}
    for name in ("B", "A"):
        inner = {"Name": name, "Subsets": [inner]}
    found = [(x[2], x[3], x[4], x[5]["Name"]) for x in rows(json.dumps({"metadata": {"Subsets": [inner]}})) if x[1] == "subset"]
    assert found == [(-1, 0, "0", "A"), (0, 0, "0.0", "B"), (0, 0, "0.0.0", "C")]


def test_depth_300():
    subset = {"Name": "x"}
    for _ in range(299):
        subset = {"Name": "x", "Subsets": [subset]}
    assert sum(x[1] == "subset" for x in nested.visit({"metadata": {"Subsets": [subset]}})) == 300


@pytest.mark.parametrize("body", [None, "", "  ", "{", "null", "[]", "{}", "NaN"])
def test_no_rows(body):
    assert rows(body) == []


def test_forms():
    body = {"runs": [None, {"metadata": json.dumps({"Authors": "A. B", "Affiliations": [None, " ", "X"], "Subsets": {"a": {"Name": "s"}, "b": None}}), "cost": {}}]}
    got = [x[:5] for x in rows(json.dumps(body))]
    assert got == [(1, "run", -1, 0, "0"), (1, "metadata", -1, 0, "0"), (1, "author", -1, 0, "0"), (1, "affiliation", -1, 2, "2"), (1, "subset", -1, 0, "0")]


def test_tables(spark):
    run = {"metadata": {"Subsets": [{"Name": "A", "Subsets": [{"Name": "B", "Subsets": [{"Name": "C"}]}]}]}}
    df = spark.createDataFrame([(1, json.dumps(run), "x"), (1, json.dumps(run), "x"), (2, None, "y"), (None, json.dumps(run), "z")], "file_id long, body string, entity string")
    assert sorted((r.path, r.Name) for r in nested.typed(nested.emit(df), "subset").collect()) == [("0", "A"), ("0.0", "B"), ("0.0.0", "C")]
    assert nested.flatten(df.limit(0)).count() == 0
