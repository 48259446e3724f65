"""Problem 3: typed tables keep numbers written as strings, list fields and unknown fields."""

import json


def test_typed(spark, tmp_path):
    import __spark_entry__

    run = {
        "metadata": {"Name": "A", "Tasks": ["x", "y"], "Domain": "web", "Odd": 7},
        "cost": {"cost": "0.5", "input_tokens": "30647", "output_tokens": 12.0},
        "validation": {"AVERAGE": "0.75"},
    }
    spark.createDataFrame([(1, json.dumps(run))], "file_id long, body string").write.parquet(str(tmp_path / "raw_results.parquet"))
    queries = __spark_entry__.queries()
    one = lambda name: queries[name](spark, str(tmp_path)).collect()[0]
    runs, metadata, cost = one("p3_runs"), one("p3_metadata"), one("p3_cost")
    assert (runs.input_tokens, runs.output_tokens, runs.AVERAGE) == (30647, 12, 0.75)
    assert (cost.cost, cost.input_tokens) == (0.5, 30647)
    assert (metadata.Tasks, metadata.Domain) == (["x", "y"], ["web"])
    assert json.loads(metadata.payload)["Odd"] == 7
