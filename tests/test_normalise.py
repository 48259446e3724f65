"""Normalisation: defaults, casts, options, JSON repair."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import repair
from tessera.functions.similarity import closest, ratio
from tessera.operators import normalise

DDL = "schema_name string, ordinal int, attribute string, answer_type string, answer_min int, answer_max int, options array<string>, validation_group string"
ATTRS = [
    ("ar", 0, "Name", "str", 0, 5, None, None), ("ar", 1, "Subsets", "List[Dict[Name, Volume]]", 0, None, None, None), ("ar", 2, "Year", "date[year]", 0, None, None, None), ("ar", 3, "Count", "int", 0, None, None, None),
    ("ar", 4, "Volume", "float", 0, None, None, None), ("ar", 5, "Tokenized", "bool", 0, None, None, None), ("ar", 6, "Dialect", "str", 0, None, ["Modern Standard Arabic", "Gulf", "mixed"], None),
    ("ar", 7, "Collection Style", "List[str]", 0, None, ["crawling", "manual curation", "other"], None),
]


def run(spark, raws, method="last"):
    attrs = spark.createDataFrame(ATTRS, DDL)
    records = spark.createDataFrame([(i, "ar", r) for i, r in enumerate(raws)], "id int, schema_name string, raw map<string,string>")
    rows = normalise.postprocess(records, attrs, ["id"], 2025, method).collect()
    pick = lambda r: next((v for v in (r.text, r["number"], r.flag, r["items"]) if v is not None), None)
    return [{r.attribute: pick(r) for r in rows if r.id == i} for i in range(len(raws))]


def test_postprocess(spark):
    raws = [
        {},
        {"Name": None, "Year": " 2021 ", "Count": "12.0", "Volume": "1e3", "Tokenized": "TRUE", "Dialect": "Modern Stadard Arabic", "Collection Style": '["crwling", "manual curation", "crwling"]', "Extra": "x"},
        {"Year": "soon", "Volume": "many", "Tokenized": "maybe", "Dialect": "", "Collection Style": "crawling", "Subsets": '[{"Name": "a", "Volume": 3}]', "Count": "-7"},
        {"Dialect": "###", "Collection Style": "[null]"},
    ]
    empty, fixed, odd, none = run(spark, raws)
    assert empty == {"Name": "", "Subsets": [], "Year": 2025, "Count": 0, "Volume": 0, "Tokenized": False, "Dialect": "mixed", "Collection Style": ["other"]}
    assert (fixed["Year"], fixed["Count"], fixed["Volume"], fixed["Tokenized"], fixed["Dialect"]) == (2021, 0, 1000, True, "Modern Standard Arabic")
    assert fixed["Collection Style"] == ["crawling", "manual curation", "crawling"] and "Extra" not in fixed
    assert (odd["Year"], odd["Volume"], odd["Tokenized"], odd["Dialect"], odd["Collection Style"], odd["Count"]) == (2025, 0, None, "mixed", ["other"], -7)
    assert json.loads(odd["Subsets"][0]) == {"Name": "a", "Volume": 3}
    assert none["Dialect"] is None  # no character in common
    assert run(spark, [{}], "first")[0]["Dialect"] == "Modern Standard Arabic"
    assert run(spark, [{}], "random") == run(spark, [{}], "random")


def test_widen(spark):
    attrs = spark.createDataFrame(ATTRS, DDL)
    records = spark.createDataFrame([(1, "ar", {"Subsets": '[{"Name": "a", "Volume": 3}]', "Year": "2020"})], "id int, schema_name string, raw map<string,string>")
    got = normalise.widen(normalise.postprocess(records, attrs, ["id"], 2025), ["id"]).first().metadata
    assert got.Subsets[0].Name == "a" and got.Subsets[0].Volume == 3.0 and got.Year == 2020 and got.Link is None


def test_closest():
    assert closest("crwling", ["other", "crawling"]) == "crawling"
    assert closest("xyz", ["ab", "cd"]) is None
    assert closest("ab", ["ba", "ab", "AB"]) == "ab"  # the first best wins
    assert ratio("a", None) == 0 and ratio("abc", "abc") == 1


def _double(text):
    out, inside = [], False
    for c in text:
        inside ^= c == '"'
        out.append('"' if c == "'" and not inside else c)
    return "".join(out)


@pytest.mark.parametrize("text", ["{'a': 'b'}", """{'name': "Hell's Gate", 'x': 'y'}""", "it's", '"', "''\"'\"'", "", "{}"])
def test_quotes(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(repair.double_quotes(F.col("t"))).first()[0] == _double(text)


def test_read_json(spark):
    texts = ["```json\n{'a': 1}\n```", '"{\\"a\\": 1}"', "no json", None, '"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.j, r.e) for r in df.select("i", repair.read_json(F.col("t")).alias("j"), repair.json_error(F.col("t")).alias("e")).collect()}
    assert json.loads(got[0][0]) == {"a": 1} and json.loads(got[1][0]) == {"a": 1}
    assert got[2] == (None, "Expecting value: line") and got[3] == (None, None) and got[4][0] is None
