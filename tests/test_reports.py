"""Reports, joins and ensembles on small tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import ensembles, matching, reports


def test_coverage_and_languages(spark):
    ids = spark.createDataFrame([("ar", "1"), ("ar", "2"), ("en", "3")], "schema_name string, paper_id string")
    scored = spark.createDataFrame([("m", "ar", "1", 1.0), ("m", "ar", "2", 0.5), ("m", "en", "3", 0.2), ("n", "ar", "1", 1.0)], "model string, schema_name string, paper_id string, AVERAGE double")
    got = {r.model: r for r in reports.by_language(scored, ids, ("ar", "en")).collect()}
    assert set(got) == {"m"} and got["m"].ar == 75 and got["m"].Average == pytest.approx(47.5) and got["m"].Weighted_Average == pytest.approx(170 / 3)
    loose = {r.model: r for r in reports.by_language(scored, ids, ("ar", "en"), complete_only=False).collect()}
    assert loose["n"].ar == 100 and loose["n"].en == 0 and loose["n"].Average == 50
    assert {r.model for r in reports.gate(scored, ids).collect()} == {"m"}


def test_exact_median(spark):
    rng = random.Random(1)
    values = [("a", rng.gauss(0, 1)) for _ in range(5001)] + [("b", float(i % 7)) for i in range(4000)] + [("c", 3.0)]
    df = spark.createDataFrame(values, "m string, v double")
    got = {r.m: r["median"] for r in reports.exact_median(df, "m", "v").collect()}
    for m in "abc":
        held = sorted(v for k, v in values if k == m)
        n = len(held)
        assert got[m] == pytest.approx((held[(n - 1) // 2] + held[n // 2]) / 2)


def test_highlights_and_render(spark):
    table = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 2.0), ("c", 3.0, 1.0)], "model string, x double, y double")
    marks = {(r.model, r.column): r.mark for r in reports.highlights(table, "model", ("x", "y")).collect()}
    assert marks == {("a", "x"): "", ("b", "x"): "max", ("c", "x"): "max", ("a", "y"): "max", ("b", "y"): "max", ("c", "y"): ""}
    lines = reports.render(table, "model", ("x", "y")).splitlines()
    assert [line.split()[0] for line in lines] == ["model", "c", "a", "b"] and "**3.00**" in lines[1]
    assert reports.chart([("a", 1.0), ("bb", 2.0)], 10).splitlines()[1] == "bb ########## 2.00"


def test_errors(spark):
    rows = [(1, "m", None), (1, "m", None), (2, "m-browsing", "Expecting value: line 1"), (3, "m", "Timeout"), (4, "human", "x"), (5, "m", "")]
    runs = spark.createDataFrame(rows, "result_id long, model string, error string")
    assert [tuple(r) for r in reports.errors(runs).collect()] == [("m", 4, 2)]
    assert {r.error: r.n for r in reports.error_histogram(runs, True).collect()}["JSON Reading Error"] == 1


def test_match_record(spark):
    data = spark.createDataFrame([(0, "A b c", "https://x/pdf/1v1"), (1, "A b c", "https://x/pdf/2"), (2, "Building a corpus of dialects", "u")], "ordinal int, title string, link string")
    asked = [(1, "A b c", "", None), (2, "", "https://arxiv.org/abs/1", None), (3, "", "", "Building a corpus of dialect"), (4, "none", "", None), (5, "", "", None)]
    queries = spark.createDataFrame(asked, "query_id int, title string, link string, record_title string")
    got = {r.query_id: (r.ordinal, r.how) for r in matching.match_record(queries, data).collect()}
    assert got == {1: (1, "title"), 2: (0, "link"), 3: (2, "similar")}
    assert {r.query_id: r.ordinal for r in matching.match_record(queries, data, last=False).collect()}[1] == 0


def test_similar_candidates_against_all_pairs(spark):
    from tessera.functions.similarity import ratio

    rng = random.Random(5)
    words = ["news", "corpus", "arabic", "dialect", "speech", "a", "of", "for", "the", "treebank", "large", "noisy"]
    left = [" ".join(rng.choices(words, k=6)) for _ in range(60)]
    right = [" ".join(rng.choices(words, k=6)) for _ in range(40)] + [x[:-1] + "x" for x in left[:20]]
    x, y = spark.createDataFrame([(t,) for t in set(left)], "a string"), spark.createDataFrame([(t,) for t in set(right)], "b string")
    found = {(r.a, r.b) for r in matching.similar_candidates(x, y, "a", "b").collect()}
    want = {(a, b) for a in left for b in right if ratio(a, b) > 0.8}
    assert len(want & found) >= 0.9 * len(want) and len(want) >= 20


def test_similar_titles_without_a_common_word(spark):
    data = spark.createDataFrame([(0, "Arabicdialectcorpora", ""), (1, "Building Mirivox", ""), (2, "", ""), (3, None, "")], "ordinal int, title string, link string")
    queries = spark.createDataFrame([(1, "", "", "Arabicdialectcorpus"), (2, "", "", "BuildingMirivox"), (3, "", "", ""), (4, "", "", "none"), (5, "", "", None)], "query_id int, title string, link string, record_title string")
    for last in (True, False):
        assert {r.query_id: r.ordinal for r in matching.match_record(queries, data, last=last).collect()} == {1: 0, 2: 1, 3: 2}


def test_similar_titles_against_all_pairs(spark, monkeypatch):
    from tessera.functions.similarity import ratio

    monkeypatch.setattr(matching, "TIER", 30)
    monkeypatch.setattr(matching, "GROWTH", 2)
    monkeypatch.setattr(matching, "TEXTS", 40)
    monkeypatch.setattr(matching, "OPTIONS", 25)
    rng, words = random.Random(6), ["news", "corpus", "arabic", "dialect", "speech", "treebank", "noisy"]
    made = lambda n: sorted({"".join(rng.choices(words, k=rng.randrange(1, 7))) + "".join(rng.choices("xyz", k=3)) for _ in range(n)})
    asked, titles = made(120), made(150)
    rng.shuffle(titles)
    data = spark.createDataFrame([(i, t, "") for i, t in enumerate(titles)], "ordinal int, title string, link string")
    queries = spark.createDataFrame([(t, "", "", t) for t in asked], "query_id string, title string, link string, record_title string")
    for last in (True, False):
        want = {a: (max if last else min)(k) for a in asked if (k := [i for i, t in enumerate(titles) if ratio(a, t) > 0.8])}
        assert {r.query_id: r.ordinal for r in matching.match_record(queries, data, last=last).collect()} == want and 20 < len(want) < len(asked)


def test_first_alike_compares_few_pairs(monkeypatch):
    from tessera.functions import similarity

    rng, ran = random.Random(7), []
    titles = [f"{''.join(rng.choices('aeioulmnrst', k=8))}: A {rng.choice(['noisy', 'parallel', 'diachronic'])} {rng.choice(['speech', 'dialect', 'topic'])} dataset" for _ in range(300)]

    class Counted(similarity.SequenceMatcher):
        def ratio(self):
            ran.append(1)
            return super().ratio()

    monkeypatch.setattr(similarity, "SequenceMatcher", Counted)
    found = similarity.first_alike(titles, titles[::-1], 0.8)
    # of 90,000 pairs, few are compared by blocks
    assert (found >= 0).all() and len(ran) < 3000


def test_link_contains(spark):
    ids = spark.createDataFrame([("2401.1",), ("2401.12",)], "paper_id string")
    links = spark.createDataFrame([("https://x/2401.12v1",), (None,), ("none",)], "link string")
    assert [(r.paper_id, r.link) for r in matching.link_contains(ids, links).collect()] == [("2401.12", "https://x/2401.12v1")]


def test_resolve_model(spark):
    names = spark.createDataFrame([("GPT",), ("DeepSeek-V3",), ("none",)], "name string")
    listed = spark.createDataFrame([(0, "x/gpt-4o"), (1, "x/gpt-4o-mini")], "ordinal int, model string")
    got = {r.name: r.model for r in matching.resolve_model(names, listed).collect()}
    assert got == {"GPT": "x/gpt-4o", "DeepSeek-V3": "deepseek/deepseek-chat:free", "none": None}


def test_skip_existing(spark):
    work = spark.createDataFrame([("1", "m", 0), ("2", "m", 0), ("1", "jury", 0)], "paper_id string, model string, shot int")
    done = spark.createDataFrame([("1", "m", 0, "Timeout"), ("2", "m", 0, None), ("1", "jury", 0, None)], "paper_id string, model string, shot int, error string")
    left = lambda **k: sorted((r.paper_id, r.model) for r in matching.skip_existing(work, done, **k).collect())
    assert left() == [("1", "jury")] and left(repeat_on_error=True) == [("1", "jury"), ("1", "m")] and len(left(overwrite=True)) == 3


def test_choose_source(spark):
    docs = spark.createDataFrame([("p", "pdf_text", 1, "pdf"), ("p", "latex", 2, ""), ("p", "latex", 3, "tex"), ("q", "abstract", 4, "a"), (None, "latex", 5, "x")], "paper_id string, source string, doc_id long, text string")
    got = {r.paper_id: (r.source, r.text) for r in matching.choose_source(docs, ("latex", "pdf_text")).collect()}
    assert got == {"p": ("latex", "tex"), "q": (None, "")}


def test_majority_against_python(spark):
    rng = random.Random(2)
    rows = [(f"p{rng.randrange(6)}", "A", rng.choice("wxyz"), i) for i in range(200)]
    cast = spark.createDataFrame([(p, f"m{i}", a, v, i) for p, a, v, i in rows], "paper_id string, model string, attribute string, value string, seq int")
    got = {r.paper_id: r.winners for r in ensembles.majority(cast, ["paper_id"]).collect()}
    for p in {r[0] for r in rows}:
        top = Counter(v for q, _, v, _ in rows if q == p).most_common(3)
        assert got[p] == [v for v, n in top if n == top[0][1]]


def test_routing(spark):
    df = spark.createDataFrame([("a-browsing", "ACCESSABILITY"), ("a-pro", "ACCESSABILITY"), ("a-Pro", "CONTENT"), ("b", None)], "m string, g string")
    assert [r[0] for r in df.select(ensembles.may_vote(F.col("m"), F.col("g"))).collect()] == [True, False, True, False]
    assert ensembles.order_judges(["jury", "a", "composer"], []) == ["a", "composer", "jury"] and ensembles.order_judges(["all"], ["composer", "a"]) == ["a", "composer"]


def test_siblings(spark):
    rows = [("p", "m", "base", 0.5), ("p", "m", "half", 0.4), ("q", "m", "base", 0.7), ("r", "m", "half", 0.1)]
    scored = spark.createDataFrame(rows, "paper_id string, model string, s string, AVERAGE double")
    got = {r.paper_id: (r.base, r.half) for r in matching.siblings(scored, F.expr("s = 'base'"), {"half": F.expr("s = 'half'")}).collect()}
    assert got == {"p": (0.5, 0.4), "q": (0.7, None)}
