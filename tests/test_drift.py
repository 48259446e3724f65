"""Problem 2: changes between files, and the unified table that loses nothing."""

import datetime
import json

import pytest

from tessera.operators import drift

DDL = "file_id long, feed string, written_at timestamp, body string"


def table(spark, *bodies, repeat=1):
    rows = [(10 - i, "f", datetime.datetime(2024, 1, 1 + i), b) for i, b in enumerate(bodies)] * repeat
    return spark.createDataFrame(rows, DDL)


def lines(*records):
    return "\n".join(json.dumps(r) for r in records)


def test_changes(spark):
    paper = lambda i: f"https://x/{i}"
    a = lines(*({"Paper Link": paper(i), "Dialect": f"d{i}", "Year": str(2000 + i), "Old": i, "Subsets": [{"Name": f"n{i}", "Size": i}]} for i in range(5)))
    b = lines(*({"Paper Link": paper(i), "Variety": f"d{i}", "Year": 2000 + i, "New": True, "Subsets": [{"Name": f"n{i}", "Volume": i, "Script": f"s{i}"}]} for i in range(5))) + "\n{broken"
    got = {tuple(r) for r in drift.changes(table(spark, a, b, repeat=2)).collect()}
    assert got == {(9, "Dialect", "renamed"), (9, "Year", "retyped"), (9, "Old", "removed"), (9, "New", "added"), (9, "Subsets.Size", "renamed"), (9, "Subsets.Script", "added")}


def test_unify(spark):
    one = {"Paper Link": "l", "Name": "A", "Volume": "1,200", "Year": "soon", "Script": ["x", "y"], "Unit": ["a", "b"], "Dialect": {"code": "ar", "label": "Arabic"}, "Odd": {"k": [1]}, "Subsets": [{"Name": "n", "Volume": 3, "Script": "s"}, 7]}
    row = drift.unify(table(spark, lines(one), None, "", "[]")).first()
    assert (row.Name, row.Volume, row.Year, row.Script, row.Unit, row.Dialect) == ("A", 1200.0, None, ["x", "y"], "a", ["Arabic"])
    other = {k: json.loads(v) for k, v in row.other.items()}
    assert other == {"Year": "soon", "Unit": ["a", "b"], "Dialect": one["Dialect"], "Odd": {"k": [1]}, "Subsets": one["Subsets"]}
    assert row.Subsets[0].Volume == 3.0 and row.Subsets[0].other == {"Script": '"s"'}


@pytest.mark.parametrize("bodies", [(), (None,), ("", "{", "[]")])
def test_nothing(spark, bodies):
    df = table(spark, *bodies) if bodies else spark.createDataFrame([], DDL)
    assert drift.changes(df).count() == 0 and drift.unify(df).count() == 0


def test_assign_against_all_matchings():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(50):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        w = [[rng.choice([0, 0, rng.random()]) for _ in range(m)] for _ in range(n)]
        got = sum(w[i][j] for i, j in enumerate(drift.assign(w)) if j >= 0)
        cols = [*range(m), *[-1] * n]
        best = max(sum(w[i][j] for i, j in enumerate(p) if j >= 0) for p in itertools.permutations(cols, n))
        assert got == pytest.approx(best)
