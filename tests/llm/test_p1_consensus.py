"""Problem 1: weights fall as errors rise, labels are those of the careful, odd rows do no harm."""

import random

import pytest
from tessera.llm import consensus

ATTRS = "attribute string, options array<string>"
DDL = "result_id long, paper_id string, model string, error string, config struct<model_name:string>, metadata struct<Form:string,Unit:string,`Ethical Risks`:string,Access:string,`Venue Type`:string>"


def tables(spark, rows):
    attrs = spark.createDataFrame([("Form", ["text", "spoken", "images"]), ("Unit", ["tokens", "hours"]), ("Ethical Risks", ["Low", "High"]), ("Access", ["Free", "With-Fee"]), ("Venue Type", None)], ATTRS)
    return spark.createDataFrame(rows, DDL), attrs


def test_truth_and_weights(spark):
    rng = random.Random(1)
    options, rows, truth = ["text", "spoken", "images"], [], {}
    for p in range(200):
        truth[f"p{p}"] = rng.choice(options)
        for m, right in (("good", 0.95), ("fair", 0.8), ("bad", 0.4)):
            said = truth[f"p{p}"] if rng.random() < right else rng.choice(options)
            rows.append((len(rows), f"p{p}", m, None, None, (said.upper(), None, None, None, None)))
    results, attrs = tables(spark, rows)
    labels = {r.paper_id: r.label for r in consensus.labels(results, attrs).where("attribute = 'Form'").collect()}
    assert sum(labels[p] == t for p, t in truth.items()) >= 185
    weight = {r.annotator: (r.error, r.weight) for r in consensus.reliability(results, attrs).where("attribute = 'Form'").collect()}
    by_error = sorted(weight.values())
    assert [w for _, w in by_error] == sorted((w for _, w in by_error), reverse=True) and weight["good"][1] > weight["bad"][1]


def test_edge_cases(spark):
    rows = [
        (1, "p", "m", None, None, ("text", None, None, None, None)), (1, "p", "m", None, None, ("text", None, None, None, None)), (2, "p", "n", None, None, ("odd", None, None, None, None)),
        (3, "q", "m", None, None, None), (4, "r", "m", "Timeout", None, ("images", None, None, None, None)), (5, None, "m", None, None, ("images", None, None, None, None)), (6, "s", None, None, (None,), ("spoken", "hours", "Low", "Free", None)),
    ]
    results, attrs = tables(spark, rows)
    got = {(r.paper_id, r.attribute): (r.label, r.n_claims) for r in consensus.consensus(results, attrs).collect()}
    assert got["p", "Form"] == ("text", 1) and got["q", "Unit"] == ("hours", 0)
    assert {p for p, _ in got} == {"p", "q", "s"} and {a for _, a in got} == {"Form", "Unit", "Ethical Risks", "Access"}
    assert consensus.labels(results.limit(0), attrs).count() == 0
    assert consensus.agreement(results, attrs).count() >= 0


@pytest.mark.parametrize(("n", "low"), [(10, 3.247), (100, 74.222)])
def test_chi2(spark, n, low):
    from pyspark.sql import functions as F

    assert spark.range(1).select(consensus.chi2_low(F.lit(n))).first()[0] == pytest.approx(low, rel=0.01)
