"""Problem 4: the join finds what brute force finds; names are learned from other records; the rest is reported."""

import random

from tessera.llm import canonical

GOLD = "record_id long, paper_id string, metadata struct<License:string,Host:string,`Venue Title`:string,Tasks:array<string>>"
REF = "canonical_id int, field string, canonical string, short_form string"


def resolve(spark, rows, ref, **more):
    gold = spark.createDataFrame(rows, GOLD)
    return {(r.record_id, r.field, r.pos): r.canonical_id for r in canonical.resolve(gold, spark.createDataFrame(ref, REF), **more).collect()}


LISTED = [(1, "License", "CC BY 4.0", None), (2, "License", "CC BY 3.0", None), (3, "Tasks", "sentiment analysis", None), (4, "Tasks", "machine translation", "MT"), (5, "Host", "OpenShelf", None)]


def test_forms(spark):
    rows = [
        (1, "p", ("cc-by 4.0", "https://openshelf.example/x", None, ["mt", None, " ", "sentimnet analysis", "gardening"])),
        (1, "p", ("cc-by 4.0", "https://openshelf.example/x", None, ["mt", None, " ", "sentimnet analysis", "gardening"])),
        (2, "q", ("CC BY 4.0", "", None, [])),
        (3, None, ("Creative Commons Attribution 3.0", None, None, None)),
        (4, "q", ("CC BY 2.0", None, "x" * 5000, None)),
        (5, "q", None),
    ]
    got = resolve(spark, rows, LISTED)
    assert got == {(1, "License", 0): 1, (1, "Host", 0): 5, (1, "Tasks", 0): 4, (1, "Tasks", 3): 3, (1, "Tasks", 4): 0, (3, "License", 0): 2, (4, "License", 0): 0, (4, "Venue Title", 0): 0}
    assert resolve(spark, [], LISTED) == {} and set(resolve(spark, rows, LISTED[:0] or [(9, "Host", "Nothing", None)]).values()) == {0}


def test_learned_names(spark):
    rows = [(i, f"p{i % 4}", (None, None, None, ["opinion mining" if i < 4 else "sentiment analysis", "machine translation"])) for i in range(8)]
    rows += [(20 + i, f"z{i}", (None, None, None, ["gardening"])) for i in range(4)] + [(30, "y", (None, None, None, ["opinon mining"]))]
    got = resolve(spark, rows, LISTED)
    assert {got[i, "Tasks", 0] for i in range(4)} == {3} and got[30, "Tasks", 0] == 3 and got[20, "Tasks", 0] == 0
    one = [r for r in rows if r[0] in (0, 4)]  # a single witness is too few
    assert resolve(spark, one, LISTED)[0, "Tasks", 0] == 0


def test_given_names(spark):
    rows = [(1, "p", (None, None, None, ["opinion mining"]))]
    assert resolve(spark, rows, LISTED, aliases={"sentiment analysis": ["opinion mining"]}) == {(1, "Tasks", 0): 3}


def test_pigeonhole_against_all_pairs(spark):
    rng = random.Random(7)
    names = ["".join(rng.choices("abcdef", k=rng.randrange(9, 20))) for _ in range(25)]

    def slip(s):
        for _ in range(rng.randrange(1, 4)):
            i, kind = rng.randrange(len(s)), rng.randrange(3)
            s = s[:i] + ("" if kind == 0 else rng.choice("abcdef")) + s[i + (kind != 1) :]
        return s

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    typed = sorted({slip(rng.choice(names)) for _ in range(120)} - set(names))
    allowed = lambda n: next((k for least, k in canonical.EDITS["Tasks"] if n >= least), 0)
    rows = [(i, None, (None, None, None, [t])) for i, t in enumerate(typed)]
    got = resolve(spark, rows, [(i + 1, "Tasks", n, None) for i, n in enumerate(names)])
    for i, t in enumerate(typed):
        near = sorted((edits(t, n), k + 1) for k, n in enumerate(names) if edits(t, n) <= allowed(len(n)))
        best = [k for e, k in near if e == near[0][0]]
        assert got[i, "Tasks", 0] == (best[0] if len(best) == 1 else 0), t
