"""One record from several models' records, by majority or by routing.

Votes are counted by group, attribute and value before any ranking, and ranking
asks for the first three only, which Spark takes from each task before it
shuffles (window group limit); so a paper with a third of all votes is no hot task.

Defined results of the edge cases: null values and null list elements are votes
like others only if given as text; here they are left out; an attribute without
votes gives no row (an empty value); ties go to the value that appears first in the
order of ``seq``; records inside lists are not voted on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tessera import schemas

#: Who may vote in a composed record, by parts of the model's name (fixed values).
LINK_VOTERS, OTHER_VOTERS = ("browsing",), ("pro", "deepseek", "jury")


def _cast(values: Column, name: str) -> Column:
    return F.transform(values, lambda v, i: F.struct(F.lit(name).alias("attribute"), v.alias("value"), i.alias("place")))


def votes(runs: DataFrame, by: list[str], attributes: tuple[str, ...], record: str = "metadata", seq: Column | None = None) -> DataFrame:
    """``(by, model, attribute, value, seq)``: every value, lists flattened. ``seq`` orders the models; the place in the list follows."""
    fields = {f.name: f.dataType for f in schemas.record_fields(runs, record)}
    items = []
    for name in attributes:
        value, kind = schemas.field(record, name), fields[name]
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            continue
        values = F.coalesce(value, F.array()).cast("array<string>") if isinstance(kind, ArrayType) else F.array(value.cast("string"))
        items.append(_cast(values, name))
    order = F.struct(*([seq] if seq is not None else []), F.col("model"), F.col("result_id"))
    rows = runs.select(*by, "model", order.alias("o"), F.explode(F.flatten(F.array(*items))).alias("v"))
    return rows.where("v.value IS NOT NULL").select(*by, "model", "v.attribute", "v.value", F.struct("o", "v.place").alias("seq"))


def tally(cast: DataFrame, by: list[str], top: int = 3) -> DataFrame:
    """The ``top`` values of each group and attribute: ``(by, attribute, value, n, rank)``; ties by first appearance."""
    counted = cast.groupBy(*by, "attribute", "value").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "attribute").orderBy(F.desc("n"), "first")))
    return ranked.where(F.col("rank") <= top).drop("first")


def majority(cast: DataFrame, by: list[str]) -> DataFrame:
    """``(by, attribute, winners)``: the values among the top three that have as many votes as the best, best first. A scalar is the first."""
    best = tally(cast, by).withColumn("most", F.max("n").over(Window.partitionBy(*by, "attribute")))
    return best.where("n = most").groupBy(*by, "attribute").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("winners"))


def may_vote(model: Column, group: Column) -> Column:
    """Whether a model votes on an attribute of a composed record: browsing models on access, strong readers on the rest."""
    has = lambda parts: F.lower(model).rlike("|".join(parts))
    access = F.coalesce(group == "ACCESSABILITY", F.lit(False))
    return F.when(access, has(LINK_VOTERS)).otherwise(has(OTHER_VOTERS))


def compose(cast: DataFrame, by: list[str], groups: DataFrame) -> DataFrame:
    """The majority of those who may vote; ``groups`` gives ``(attribute, validation_group)``."""
    routed = cast.join(groups.select("attribute", "validation_group"), "attribute", "left").where(may_vote(F.col("model"), F.col("validation_group")))
    return majority(routed.drop("validation_group"), by)


def judge_input(results: DataFrame, by: list[str]) -> DataFrame:
    """The runs a judge reads: successful ones of real models, of repeated runs of a model the last (greatest ``result_id``)."""
    real = results.where(F.col("error").isNull() & F.col("metadata").isNotNull() & ~F.col("model").isin(*schemas.BASELINES))
    return real.groupBy(*by, "model").agg(F.max_by(F.struct("result_id", "metadata"), "result_id").alias("r")).select(*by, "model", "r.*")


def order_judges(models: list[str], every: list[str]) -> list[str]:
    """The models in the order of running: ``all`` stands for every one; the jury, else the composer, comes last."""
    chosen = list(every) if "all" in models else list(models)
    for judge in ("jury", "composer"):
        if judge in chosen:
            chosen.remove(judge)
            return [*chosen, judge]
    return chosen
