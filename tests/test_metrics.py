"""Comparison metrics: the rules of each type, the groups and the edge cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import metrics

ATTRS = [
    ("ar", 0, "Name", "str", 0, 5, None, None), ("ar", 1, "Subsets", "List[Dict]", 0, None, None, "DIVERSITY"), ("ar", 2, "License", "str", 0, None, ["a", "b"], "ACCESSABILITY"),
    ("ar", 3, "Volume", "float", 0, None, None, "CONTENT"), ("ar", 4, "Tokenized", "bool", 0, None, None, "CONTENT"), ("ar", 5, "Tasks", "List[str]", 0, None, ["x", "y", "z"], "EVALUATION"),
    ("ar", 6, "Authors", "List[str]", 1, None, None, None), ("ar", 7, "Language", "str", 0, None, ["ar"], "DIVERSITY"),
    ("multi", 0, "Language", "List[str]", 2, 25, ["ar", "en"], "DIVERSITY"), ("multi", 1, "Volume", "float", 0, None, None, "CONTENT"),
]
ATTR_DDL = "schema_name string, ordinal int, attribute string, answer_type string, answer_min int, answer_max int, options array<string>, validation_group string"
RUN_DDL = f"result_id long, paper_id string, schema_name string, result_set string, shot int, model string, is_browsing boolean, metadata {schemas.RECORD_DDL}"
GOLD_DDL = f"record_id long, paper_id string, metadata {schemas.RECORD_DDL}, annotations_from_paper map<string,int>"


def record(**values):
    full = dict.fromkeys(schemas.RECORD_FIELDS)
    full.update({k.replace("_", " "): v for k, v in values.items()})
    return tuple(full.values())


GOLD = dict(Name="A", Subsets=[("s", 1.0, "u", None, None), ("t", 2.0, "u", None, None)], License="a", Volume=10.0, Tokenized=True, Tasks=["x", "y"], Language="ar")


def score(spark, runs, gold, annotated=False):
    attrs = spark.createDataFrame(ATTRS, ATTR_DDL)
    results = spark.createDataFrame([(i, p, s, "set", 0, "m", False, m) for i, p, s, m in runs], RUN_DDL)
    got = metrics.score(results, spark.createDataFrame(gold, GOLD_DDL), attrs, annotated)
    return {r.result_id: r for r in got.collect()}


def test_groups(spark):
    gold = [(1, "p", record(**GOLD), {"Volume": 0}), (2, "p", record(Name="other"), None), (3, "q", record(Languages=["ar", "en"], Volume=1.0), None)]
    runs = [
        (1, "p", "ar", record(**GOLD)),
        (1, "p", "ar", record(**GOLD)),  # repeated
        (2, "p", "ar", record(**{**GOLD, "Volume": 9.0})),
        (3, "p", "ar", record(**{**GOLD, "Subsets": GOLD["Subsets"][::-1], "Tasks": ["X ", "y", "z"], "License": "A"})),
        (4, "p", "ar", None),
        (5, "none", "ar", record(**GOLD)),
        (6, "q", "multi", record(Languages=["EN", "ar"], Volume=1.0)),
        (7, None, "ar", record()),
    ]
    got = score(spark, runs, gold)
    assert len(got) == 7
    assert [got[1][g] for g in (*schemas.GROUPS, "AVERAGE")] == [1, 1, 1, 1, 1]
    assert (got[2].CONTENT, got[2].AVERAGE) == (1 - 1 / 2, 1 - 1 / 6)
    assert (got[3].DIVERSITY, got[3].EVALUATION, got[3].ACCESSABILITY) == (1, 1, 0)
    assert got[4].AVERAGE == 0 and got[5].AVERAGE == 0 and got[7].AVERAGE == 0
    assert (got[6].AVERAGE, got[6].ACCESSABILITY) == (1, None)
    starred = score(spark, runs, gold, annotated=True)
    # a flagged attribute takes no part in the average; its group still divides by its full size
    assert (starred[2].AVERAGE, starred[2].CONTENT) == (1, 1 / 2)


def test_empty_tables(spark):
    assert score(spark, [], []) == {}


def _common(a, b, most=1):
    x, y = {v.lower().strip() for v in a if v is not None}, {v.lower().strip() for v in b if v is not None}
    return (not x and not y) or (bool(x & y) and len(x ^ y) <= most)


def test_list_overlap_against_python(spark):
    rng = random.Random(3)
    words = ["a", "A ", " b", "b", "\tc", "d\u00a0", "", None]
    pairs = [([rng.choice(words) for _ in range(rng.randrange(4))], [rng.choice(words) for _ in range(rng.randrange(4))]) for _ in range(300)]
    pairs += [(None, None), (None, ["a"]), ([], [])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r.i: r.m for r in df.select("i", metrics.list_overlap(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {i: _common(a or [], b or []) for i, (a, b) in enumerate(pairs)}


def test_records_match(spark):
    lists = [None, [], [("a", 1.0)], [("a", 1.0), ("a", 1.0)], [("a", 1.0), ("b", None)], [("b", None), ("a", 1.0)]]
    pairs = list(itertools.product(lists, lists))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<struct<n:string,v:double>>, b array<struct<n:string,v:double>>")
    got = {r.i: r.m for r in df.select("i", metrics.records_match(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {i: len(a or []) == len(b or []) and all(x in (b or []) for x in a or []) for i, (a, b) in enumerate(pairs)}


@pytest.mark.parametrize(("a", "b", "same"), [("x, y", "Y,x,z", True), ("x,x", "x", False), ("", "", True), (None, "a", False)])
def test_csv(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(metrics.csv_set_match(F.col("a"), F.col("b"))).first()[0] is same


def test_lengths_and_fill(spark):
    attrs = spark.createDataFrame(ATTRS, ATTR_DDL)
    side = schemas.profile(attrs)
    rows = spark.createDataFrame([(1, "ar", record(Name="one two three four five six", Authors=["x"])), (2, "ar", record(Name="", Authors=[], License="a"))], f"id int, schema_name string, metadata {schemas.RECORD_DDL}").join(side, "schema_name")
    got = {r.id: r for r in rows.select("id", metrics.lengths(rows, "metadata").alias("n"), metrics.fill_ratio(rows, "metadata").alias("f"), metrics.key_ratio(rows, "metadata").alias("k")).collect()}
    assert got[1].n == pytest.approx(7 / 8) and got[2].n == pytest.approx(7 / 8)
    assert got[1].f == pytest.approx(2 / 8) and got[2].f == pytest.approx(1 / 8) and got[1].k == 1


def test_profile_and_derive(spark):
    attrs = spark.createDataFrame(ATTRS, ATTR_DDL)
    got = {r.schema_name: r for r in schemas.profile(attrs).collect()}
    assert got["ar"].validation_columns == ["Subsets", "Language", "License", "Volume", "Tokenized", "Tasks"]
    assert got["ar"].list_columns == ["Tasks", "Authors"] and got["ar"].lengths["Name"] == [0, 5] and got["ar"].lengths["Authors"] == [1, -1]
    jp = {r.attribute: r for r in schemas.derive(attrs, "jp").collect()}
    assert "Subsets" not in jp and jp["Language"].options == ["jp"] and jp["Language"].ordinal == 6
    multi = {r.attribute: r for r in schemas.derive(attrs, "multi").collect()}
    assert multi["Language"].answer_type == "List[str]" and len(multi["Language"].options) == 25 and "Subsets" in multi
