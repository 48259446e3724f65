"""Queries of the general operators: drifting schemas and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import drift, nested
from tessera.plans.registry import Query
from tessera.session import written
from tessera.sources.tables import scan


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a field between a file and the one before it in its feed."""
    return drift.changes(scan(spark, sf_dir, "metadata_files"))


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all files in one consistent table."""
    return drift.unify(scan(spark, sf_dir, "metadata_files"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each field changed in each way, and in how many feeds."""
    files = scan(spark, sf_dir, "metadata_files")
    feeds = files.select("file_id", "feed").distinct()
    return (
        drift.changes(files).join(feeds, "file_id")
        .groupBy("field", "change").agg(F.count("*").alias("n_changes"), F.countDistinct("feed").alias("n_feeds"))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of every flat row of every result file."""
    return nested.flatten(scan(spark, sf_dir, "raw_results"))


def p3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run table with the model, score and cost of its children, joined by their keys."""
    rows = written(nested.emit(scan(spark, sf_dir, "raw_results")), "entity")
    child = lambda tag, *cols: nested.typed(rows, tag).select("file_id", "run_pos", *cols)
    return (
        nested.typed(rows, "run").select("file_id", "run_pos", "length_forcing", "ratio_filling", "error")
        .join(child("config", "model_name", "few_shot"), ["file_id", "run_pos"], "left")
        .join(child("validation", "AVERAGE"), ["file_id", "run_pos"], "left")
        .join(child("cost", "input_tokens", "output_tokens"), ["file_id", "run_pos"], "left")
    )


def p3_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subset table with its typed columns."""
    return nested.typed(nested.emit(scan(spark, sf_dir, "raw_results")), "subset")


def _table(tag: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.typed(nested.emit(scan(spark, sf_dir, "raw_results")), tag)

    query.__doc__ = f"The {tag} table with its typed columns."
    return query


#: The other flat tables, one for each tag.
TABLES = {f"p3_{tag}": _table(tag) for tag in ("metadata", "validation", "cost", "config", "author", "affiliation", "keyword")}

QUERIES = {"p2_found": p2_found, "p2_unified": p2_unified, "p2_report": p2_report, "p3_found": p3_found, "p3_runs": p3_runs, "p3_subsets": p3_subsets, **TABLES}
ORACLES: dict[str, str] = {}
