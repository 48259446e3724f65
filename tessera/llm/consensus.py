"""A consensus label from several annotators who disagree, by confidence-aware truth discovery.

Two steps alternate until the labels are stable. Given labels, every annotator gets, for
each attribute, a weight from the chi-squared upper bound of the variance of
their errors: ``N`` claims whose distances to the labels sum up to ``E`` bound it by
``E / chi2(alpha / 2, N)`` with confidence ``1 - alpha / 2``. The weight is the inverse of the bound's root, the
error's upper standard deviation, over the mean of all annotators: a careless annotator weighs less than
a careful one, and one of the long tail, whose few claims prove little, less than one as good with many.
Given weights, each item gets the label with the least weighted distance to its claims; how
common a label is stands in for one more annotator of mean weight.

The distance of a claim to a label is not 0 or 1: annotators err in ways of their
own (one falls back on the last option, one confuses neighbours), so it is the
negative log of the share of their claims that read so where the label holds,
estimated from the same labels and smoothed.

Claims are counted by item, annotator and option before anything else, so an item
with a third of all runs is a few rows. They are then laid out once by item and
checkpointed; a round reads them where they lie. All that is shuffled in a round is
counts by annotator, option and label. These counts and what follows from them are broadcast only
while they have at most ``BROADCAST_ROWS`` rows, and joined by shuffling beyond it.

Labels are stable when a round changes none. Should the alternation return to
labels it has had before, it would go on for ever, and ends there; there is no
other limit of rounds.

Defined results of the edge cases: rows with an error or without a paper take no
part; repeated rows count once; a null, unknown or unlisted answer is no claim;
an item without any claim gets the commonest label of its attribute; ties go to the
option listed first; an annotator without a name is one annotator; empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

ATTRIBUTES = ("Form", "Unit", "Ethical Risks", "Access", "Venue Type")
#: The 2.5 % point of the normal distribution, for alpha = 0.05 (a fixed value).
Z = -1.959963984540054
SMOOTHING, BROADCAST_ROWS = 1.0, 100_000
ITEM = ["paper_id", "attribute"]


def _letters(c):
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def chi2_low(n):
    """The lower ``alpha / 2`` point of chi-squared with ``n`` degrees of freedom (Wilson and Hilferty)."""
    part = F.lit(2.0) / (9.0 * n)
    return n * F.pow(F.greatest(F.lit(0.0), 1 - part + Z * F.sqrt(part)), 3)


def options(attr_schema: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """``(attribute, option, place, key, k)`` of the closed attributes, from all schemata; ``k`` numbers the options of each."""
    return (
        attr_schema.where(F.col("attribute").isin(*attributes) & F.col("options").isNotNull())
        .select("attribute", F.posexplode("options").alias("place", "option"))
        .groupBy("attribute", "option").agg(F.min("place").alias("place"))
        .withColumn("key", _letters(F.col("option")))
        .withColumn("k", F.row_number().over(Window.partitionBy("attribute").orderBy("place", "option")) - 1)
    )


def claims(results: DataFrame, opts: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> tuple[DataFrame, DataFrame]:
    """``(paper_id, attribute, annotator, option, n)``, and all ``(paper_id, attribute)`` that need a label."""
    ok = results.where(F.col("error").isNull() & F.col("paper_id").isNotNull())
    answers = F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(f"metadata.`{a}`").alias("answer")) for a in attributes))
    annotator = F.translate(F.coalesce("config.model_name", "model", F.lit("")), "/", "_")
    rows = ok.select("result_id", "paper_id", annotator.alias("annotator"), F.explode(answers).alias("_a")).select("result_id", "paper_id", "annotator", "_a.*")
    made = (
        rows.withColumn("key", _letters(F.col("answer")))
        .join(opts.select("attribute", "key", "option"), ["attribute", "key"])
        .groupBy("result_id", "paper_id", "attribute", "annotator", "option").agg(F.lit(1).alias("one"))
        .groupBy("paper_id", "attribute", "annotator", "option").agg(F.count("*").alias("n"))
    )
    needed = ok.select("paper_id").distinct().select("paper_id", F.explode(F.array(*map(F.lit, attributes))).alias("attribute"))
    return made, needed


def weights(seen: DataFrame, opts: DataFrame) -> DataFrame:
    """``(attribute, annotator, option, label, k, n, distance, n_claims, spread, weight)``: the table of one round.

    ``seen`` counts claims by ``(attribute, annotator, option, label)``; ``spread`` is the sum of distances.
    """
    by = ["attribute", "annotator"]
    who = seen.groupBy(by).agg(F.sum("n").alias("n_claims"))
    sides = F.broadcast(opts.select("attribute", "option").join(F.broadcast(opts.select("attribute", F.col("option").alias("label"), "k")), "attribute"))  # options by options
    full = who.join(sides, "attribute").join(seen, [*by, "option", "label"], "left").fillna(0, ["n"])
    size = F.count("*").over(Window.partitionBy(*by, "option"))  # labels of the attribute
    share = (F.sum("n").over(Window.partitionBy(*by, "option")) + 1) / (F.col("n_claims") + size)
    likely = (F.col("n") + SMOOTHING * share) / (F.sum("n").over(Window.partitionBy(*by, "label")) + SMOOTHING)
    far = full.withColumn("distance", -F.log(likely)).withColumn("spread", F.sum(F.col("n") * F.col("distance")).over(Window.partitionBy(*by)))
    raw = far.withColumn("raw", F.sqrt(chi2_low(F.col("n_claims")) / F.greatest("spread", F.lit(0.5))))
    # every annotator has as many rows as any other; the last mean is over one row for each of them
    mean = raw.groupBy("attribute", "annotator").agg(F.max("raw").alias("raw")).groupBy("attribute").agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean), "attribute").withColumn("weight", F.coalesce(F.col("raw") / F.nullif("mean", F.lit(0.0)), F.lit(0.0))).drop("raw", "mean")


def _least(sums: list) -> Column:
    """The number of the least sum, the first of equals; nulls (a label the attribute doesn't have) are never the least."""
    pairs = F.array(*(F.when(c.isNotNull(), F.struct(F.round(c, 9).alias("s"), F.lit(i).alias("k"))) for i, c in enumerate(sums)))
    return F.array_min(F.array_compact(pairs))["k"]


def discover(results: DataFrame, attr_schema: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(labels of all items, labels of items with claims, claims, weights)`` at the end of the alternation."""
    spark = results.sparkSession
    opts = cut_lineage(options(attr_schema, attributes))
    width = (opts.agg(F.max("k")).first()[0] or 0) + 1  # the most options of any attribute
    made, needed = claims(results, opts, attributes)
    made = made.join(opts.select("attribute", "option", "k"), ["attribute", "option"])
    made = cut_lineage(made.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *ITEM))
    names = opts.select("attribute", F.col("k").alias("label_k"), F.col("option").alias("label"))

    combos = made.select("attribute", "annotator", "option").distinct().count()
    small = combos * width <= BROADCAST_ROWS
    spread = (lambda df: F.broadcast(df)) if small else (lambda df: df)

    def labelled(scored: DataFrame, prior: Column | None = None) -> DataFrame:
        sums = scored.groupBy(*ITEM).agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(width)))
        total = [F.col(f"s{i}") + (F.lit(0.0) if prior is None else prior[i]) for i in range(width)]
        return cut_lineage(sums.select(*ITEM, _least(total).alias("label_k")))

    def state(truth: DataFrame) -> tuple:
        """How often each label is held, and a fingerprint of who holds it: one row for each attribute and option."""
        rows = truth.groupBy("attribute", "label_k").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*ITEM)).alias("h")).collect()
        return tuple(sorted((r["attribute"], r["label_k"], r["n"], r["h"]) for r in rows))

    kinds = opts.groupBy("attribute").agg(F.count("*").alias("kinds"))  # one row for each attribute
    sizes = dict(kinds.collect())
    first = made.join(F.broadcast(kinds), "attribute")
    truth = labelled(first.select(*ITEM, *(F.when(F.col("kinds") > i, F.when(F.col("k") == i, -F.col("n")).otherwise(0)).cast("double").alias(f"s{i}") for i in range(width))))
    met = [state(truth)]
    while True:
        seen = made.join(truth, ITEM).groupBy("attribute", "annotator", "option", "label_k").agg(F.sum("n").alias("n"))
        seen = seen.join(F.broadcast(names), ["attribute", "label_k"]).drop("label_k")
        table = cut_lineage(weights(cut_lineage(seen.coalesce(1) if small else seen), opts))
        if met[-1] in met[:-1]:
            break  # stable, or back where it has been
        prior = F.lit(None).cast("array<double>")
        for attribute, k in sizes.items():
            held = {label: n for name, label, n, _ in met[-1] if name == attribute}
            total = sum(held.values()) + k
            prior = F.when(F.col("attribute") == attribute, F.array(*(F.lit(-math.log((held.get(i, 0) + 1) / total)) for i in range(k)), *[F.lit(0.0)] * (width - k))).otherwise(prior)
        far = table.groupBy("attribute", "annotator", "option").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", (F.col("weight") * F.col("distance")).alias("d")))), lambda x: x["d"]).alias("far"))
        scored = made.join(spread(far), ["attribute", "annotator", "option"])
        truth = labelled(scored.select(*ITEM, *((F.col("n") * F.try_element_at("far", F.lit(i + 1))).alias(f"s{i}") for i in range(width))), prior)
        met.append(state(truth))
    truth = truth.join(F.broadcast(names), ["attribute", "label_k"]).select(*ITEM, "label")
    common = truth.groupBy("attribute", "label").agg(F.count("*").alias("held")).join(opts.select("attribute", F.col("option").alias("label"), "k"), ["attribute", "label"], "right")
    common = common.groupBy("attribute").agg(F.min_by("label", F.struct(-F.coalesce("held", F.lit(0)), "k")).alias("common"))
    every = needed.join(truth, ITEM, "left").join(F.broadcast(common), "attribute").select(*ITEM, F.coalesce("label", "common").alias("label"))
    return every, truth, made, table


def consensus(results: DataFrame, attr_schema: DataFrame) -> DataFrame:
    """``(paper_id, attribute, label, n_claims, agreement)``: the label and the share of claims that say it."""
    every, truth, made, _ = discover(results, attr_schema)
    votes = made.join(truth, ITEM).groupBy(*ITEM).agg(F.sum("n").alias("n_claims"), (F.sum(F.when(F.col("option") == F.col("label"), F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"))
    return every.join(votes, ITEM, "left").fillna(0, ["n_claims"])


def labels(results: DataFrame, attr_schema: DataFrame) -> DataFrame:
    """``(paper_id, attribute, label)`` only."""
    return discover(results, attr_schema)[0]


def reliability(results: DataFrame, attr_schema: DataFrame) -> DataFrame:
    """``(annotator, attribute, n_claims, error, error_bound, weight)``: the share of wrong claims, the upper bound of the error variance, and the weight."""
    table = discover(results, attr_schema)[3]
    return table.groupBy("annotator", "attribute").agg(
        F.max("n_claims").alias("n_claims"),
        (F.sum(F.when(F.col("option") != F.col("label"), F.col("n")).otherwise(0)) / F.sum("n")).alias("error"),
        F.max(F.col("spread") / F.nullif(chi2_low(F.col("n_claims")), F.lit(0.0))).alias("error_bound"),
        F.max("weight").alias("weight"),
    )


def agreement(results: DataFrame, attr_schema: DataFrame) -> DataFrame:
    """Nominal Krippendorff alpha of each attribute: 1 is full agreement, 0 what chance gives."""
    made, _ = claims(results, options(attr_schema))
    by_label = cut_lineage(made.groupBy("paper_id", "attribute", "option").agg(F.sum("n").alias("n")))
    units = by_label.withColumn("m", F.sum("n").over(Window.partitionBy("paper_id", "attribute"))).where("m > 1")
    observed = units.groupBy("attribute").agg(F.sum(F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1)).alias("off"), F.sum("n").alias("total"), F.countDistinct("paper_id").alias("n_items"))
    expected = units.groupBy("attribute", "option").agg(F.sum("n").alias("c")).groupBy("attribute").agg(F.sum(F.col("c") * F.col("c")).alias("same"))
    alpha = 1 - (F.col("total") - 1) * F.col("off") / (F.col("total") * F.col("total") - F.col("same"))
    return observed.join(expected, "attribute").select("attribute", "n_items", F.col("total").alias("n_claims"), alpha.alias("alpha"))
