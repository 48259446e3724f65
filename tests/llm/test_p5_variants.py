"""Problem 5: the query exists and links the spellings of one name."""


def test_query(spark, tmp_path):
    import __spark_entry__

    schema = "paper_id string, metadata struct<Authors: array<string>, Affiliations: array<string>, Provider: array<string>>"
    rows = [("p1", (["Maria Velasquez", None, " "], ["University of Tolbar"], [])), ("p2", (["Velasquez, Maria", "Yusuf Korander"], ["Univ. of Tolbar"], None))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "gold.parquet"))
    found = {tuple(r) for r in __spark_entry__.queries()["p5_found"](spark, str(tmp_path)).collect()}
    assert found == {("person", "Maria Velasquez", "Velasquez, Maria"), ("organisation", "Univ. of Tolbar", "University of Tolbar")}


def test_spellings_beside_a_richer_name(spark):
    from tessera.llm import variants

    schema = "paper_id string, metadata struct<Authors: array<string>, Affiliations: array<string>, Provider: array<string>>"
    a, b, rich = "University of Kashemilor", "University of Kashimalar", "University of Tolbunds"
    rows = [("p1", ([], [a, b, rich], []))] + [(f"q{i}", ([], [rich], [])) for i in range(5)]
    found = {tuple(r) for r in variants.links(spark.createDataFrame(rows, schema)).collect()}
    assert found == {("organisation", a, b)}


def test_long_names_within_two_edits_share_a_block(spark):
    import random

    from pyspark.sql import functions as F
    from tessera.llm import variants

    rng, rows = random.Random(1), []
    for i in range(400):
        a = b = "".join(rng.choices("abcdefghij", k=rng.randrange(20, 45)))
        for _ in range(2):
            at, kind = rng.randrange(len(b)), rng.randrange(3)
            b = b[:at] + ("" if kind == 0 else rng.choice("abcdefghij")) + b[at + (kind != 1) :]
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    assert df.where(F.arrays_overlap(variants.block_keys(F.col("a")), variants.block_keys(F.col("b")))).count() == len(rows)


def test_block_keys_are_not_broadcast(spark):
    from tessera.llm import variants

    wanted = spark.createDataFrame([(1, "m", "velaskues"), (2, "k", "velaskues")], "f long, initial string, sk string")
    records = spark.createDataFrame([("m", "velaskuez", 7), ("m", "korander", 8)], "initial string, sk string, c long")
    found = variants.candidates(wanted, records)
    assert [tuple(r) for r in found.collect()] == [(1, "velaskues", "velaskuez", 7)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_empty(spark):
    from tessera.llm import variants

    schema = "paper_id string, metadata struct<Authors: array<string>, Affiliations: array<string>, Provider: array<string>>"
    assert variants.links(spark.createDataFrame([(None, None), ("p", ([], None, [None, " "]))], schema)).count() == 0
