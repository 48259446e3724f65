"""Leaderboards, cost, error, timing and ablation reports over scored runs.

Every report is a grouped aggregate whose groups are models, languages or
attributes, so its result is small whatever the data; only results are pivoted.

Defined results of the edge cases: null scores count in no mean; an unknown price
gives a null cost; an empty table gives an empty report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as T
from tessera.operators.matching import list_cost, with_prices

EPSILON = 1e-10
LENGTH_ATTRIBUTES = ("Name", "Description", "Provider", "Derived From", "Tasks")
JSON_ERROR = "Expecting value: line"


def no_baselines(runs: DataFrame, model: str = "model") -> DataFrame:
    return runs.where(~F.col(model).isin(*schemas.BASELINES) & ~F.lower(F.col(model)).contains("human"))


def browsing(runs: DataFrame, only: bool = False, none: bool = False) -> DataFrame:
    """With ``only`` the browsing runs, with ``none`` the others, else all."""
    flag = F.col("model").contains(T.BROWSING)
    return runs.where(flag) if only else runs.where(~flag) if none else runs


def coverage(runs: DataFrame, ids: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """``(by, n_runs, n_ids, complete)``: a model is complete if it has exactly as many runs as there are ids (a count, not a set)."""
    share = [c for c in by if c in ids.columns]
    wanted = ids.groupBy(*share).agg(F.count("*").alias("n_ids")) if share else ids.agg(F.count("*").alias("n_ids"))
    counted = runs.groupBy(*by).agg(F.count("*").alias("n_runs"))
    joined = counted.join(wanted, share, "left") if share else counted.crossJoin(wanted)  # one row
    return joined.select(*by, "n_runs", F.coalesce("n_ids", F.lit(0)).alias("n_ids"), (F.col("n_runs") == F.col("n_ids")).alias("complete"))


def gate(runs: DataFrame, ids: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """The runs of complete models only."""
    return runs.join(coverage(runs, ids, by).where("complete").select(*by), list(by), "left_semi")


def leaderboard(scored: DataFrame, values: tuple[str, ...] = (*schemas.GROUPS, "AVERAGE"), by: tuple[str, ...] = ("model",), times: float = 100.0) -> DataFrame:
    """``(by, n_runs, values)``: the mean of each value, in percent. Sort by ``AVERAGE`` to print it."""
    return scored.groupBy(*by).agg(F.count("*").alias("n_runs"), *((F.avg(v) * times).alias(v) for v in values))


def by_attribute(long: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """``(by, attribute, n, accuracy)`` in percent, on the long form."""
    return long.groupBy(*by, "attribute").agg(F.count("*").alias("n"), (F.avg(F.col("hit").cast("double")) * 100).alias("accuracy"))


def pivot_attributes(long: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """One column for each attribute, one row for each model; null where it was never scored."""
    share = F.avg(F.col("hit").cast("double")) * 100
    return long.groupBy("model").pivot("attribute", list(attributes)).agg(share)


def subset_detail(long: DataFrame, group: str) -> DataFrame:
    """Means of the attributes of one group, and their unweighted mean: ``(model, attribute, accuracy, row_mean)``."""
    rows = by_attribute(long.where(F.col("validation_group") == group))
    return rows.select("model", "attribute", "accuracy", F.avg("accuracy").over(Window.partitionBy("model")).alias("row_mean"))


def by_language(scored: DataFrame, ids: DataFrame, langs: tuple[str, ...] = schemas.SCHEMATA, complete_only: bool = True) -> DataFrame:
    """A column for each language, ``Average`` over all of them (a missing one counts 0) and ``Weighted_Average`` over runs of those present.

    With ``complete_only`` a model has a language only if it has as many runs there as there are ids.
    """
    runs = scored.select("model", F.col("schema_name").alias("lang"), "AVERAGE")
    sums = runs.groupBy("model", "lang").agg(F.sum("AVERAGE").alias("s"), F.count("*").alias("n"))
    if complete_only:
        sums = sums.join(ids.groupBy(F.col("schema_name").alias("lang")).agg(F.count("*").alias("n_ids")), "lang").where("n = n_ids")
    of = lambda c, lang: F.sum(F.when(F.col("lang") == lang, F.col(c)))
    wide = sums.groupBy("model").agg(*(F.coalesce(100 * of("s", x) / of("n", x), F.lit(0.0)).alias(x) for x in langs), (100 * F.sum("s") / F.sum("n")).alias("Weighted_Average"))
    total = F.lit(0.0)
    for x in langs:
        total = total + F.col(x)
    return wide.withColumn("Average", total / len(langs))


def costs(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """``(model, n_runs, input_tokens, output_tokens, total_tokens, stored_cost, list_cost)`` summed by model.

    ``runs`` has ``result_id, model, cost``; repeated rows count once. Prices meet the sums, not the runs.
    """
    once = runs.select("result_id", "model", "cost.cost", "cost.input_tokens", "cost.output_tokens").dropDuplicates(["result_id"])
    sums = once.groupBy("model").agg(
        F.count("*").alias("n_runs"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("stored_cost"),
    )
    priced = with_prices(sums, prices)
    return priced.select("model", "n_runs", "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), "stored_cost", list_cost(F.col("input_tokens"), F.col("output_tokens")).alias("list_cost"))


def error_class(error: Column) -> Column:
    """The class of a stored error: reading errors under one name, others as they are."""
    return F.when(error.contains(JSON_ERROR), "JSON Reading Error").otherwise(error)


def errors(runs: DataFrame) -> DataFrame:
    """``(model, n_runs, n_errors)``, browsing runs under their base model."""
    once = no_baselines(runs.select("result_id", T.base_model(F.col("model")).alias("model"), "error").dropDuplicates(["result_id"]))
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return once.groupBy("model").agg(F.count("*").alias("n_runs"), F.count_if(failed).alias("n_errors"))


def error_histogram(runs: DataFrame, classes: bool = False) -> DataFrame:
    """How often each message (or class) was stored; null is success."""
    once = no_baselines(runs.select("result_id", T.base_model(F.col("model")).alias("model"), "error").dropDuplicates(["result_id"]))
    return once.groupBy((error_class(F.col("error")) if classes else F.col("error")).alias("error")).agg(F.count("*").alias("n"))


def by_year(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """``(model, year, n_runs, AVERAGE)`` by the year of the gold record, in percent."""
    from tessera.operators.metrics import first_gold

    years = first_gold(gold).select("paper_id", schemas.field("gold", "Year").alias("year"))
    return scored.join(years, "paper_id").groupBy("model", "year").agg(F.count("*").alias("n_runs"), (F.avg("AVERAGE") * 100).alias("AVERAGE"))


def ablation(wide: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """The mean of each level by model, in percent; a level without runs is 0."""
    return wide.groupBy("model").agg(F.count("*").alias("n_base"), *(F.coalesce(F.avg(x) * 100, F.lit(0.0)).alias(x) for x in levels))


def melt_timings(papers: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``(paper_id, method, seconds)`` from one column for each method; missing timings are left out."""
    items = F.array(*(F.struct(F.lit(m).alias("method"), F.col(c).alias("seconds")) for m, c in columns.items()))
    return papers.select("paper_id", F.explode(items).alias("t")).select("paper_id", "t.method", "t.seconds").where("seconds IS NOT NULL AND NOT isnan(seconds)")


def exact_median(rows: DataFrame, by: str, value: str, accuracy: int = 1000) -> DataFrame:
    """``(by, median)``, exact, without a sort of all rows or all values of a group in one task.

    An approximate quantile with a known error of rank brackets the middle; one more pass counts what lies below the bracket, and
    only the values inside it, at most a share of ``4 / accuracy`` of the rows, are ranked.
    """
    gap = 2.0 / accuracy
    low = F.percentile_approx(value, F.lit(0.5 - gap), F.lit(accuracy)).alias("lo")
    high = F.percentile_approx(value, F.lit(0.5 + gap), F.lit(accuracy)).alias("hi")
    bracket = rows.groupBy(by).agg(low, high, F.count(value).alias("n"))
    placed = rows.join(bracket, by)
    below = placed.groupBy(by).agg(F.count_if(F.col(value) < F.col("lo")).alias("below"), F.first("n").alias("n"))
    inside = placed.where(F.col(value).between(F.col("lo"), F.col("hi"))).groupBy(by, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(value))
    ranked = inside.withColumn("upto", upto).join(below, by)
    first, last = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    at = lambda k: F.min(F.when(F.col("below") + F.col("upto") >= k, F.col(value)))
    return ranked.groupBy(by).agg(((at(first) + at(last)) / 2).alias("median"))


def timing_stats(timings: DataFrame) -> DataFrame:
    """``(method, n, mean, median, min, max, std)`` of seconds, the deviation being that of a sample."""
    s = "seconds"
    base = timings.groupBy("method").agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max"), F.stddev_samp(s).alias("std"))
    return base.join(exact_median(timings, "method", s), "method")


def timing_pivot(timings: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """A column for each method; 0 where a paper has none."""
    return timings.groupBy("paper_id").pivot("method", list(methods)).agg(F.max("seconds")).fillna(0.0, list(methods))


def highlights(table: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """``(key, column, value, mark)``: ``max`` or ``second`` for the largest and the second-largest entry of each column, else empty.

    ``table`` is a report, one row for each model. Entries tied with the largest are all ``max``, and then there is no second.
    """
    items = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    long = table.select(key, F.explode(items).alias("x")).select(key, "x.*")
    per = Window.partitionBy("column").orderBy(F.desc("value"), key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top, second = F.first("value").over(per), F.coalesce(F.nth_value("value", 2).over(per), F.first("value").over(per))
    mark = F.when(F.abs(F.col("value") - F.col("top")) < EPSILON, "max").when(F.abs(F.col("value") - F.col("second")) < EPSILON, "second").otherwise("")
    return long.withColumns({"top": top, "second": second}).select(key, "column", "value", mark.alias("mark"))


def render(table: DataFrame, key: str, columns: tuple[str, ...], decimals: int = 2) -> str:
    """A report as text, ascending by its last column; the largest entry in ``**``, the second in ``__``. Reports are small."""
    marks = {(r[key], r["column"]): (r["value"], r["mark"]) for r in highlights(table, key, columns).collect()}
    names = sorted({k for k, _ in marks}, key=lambda k: (marks[k, columns[-1]][0] is None, marks[k, columns[-1]][0], k))
    sign = {"max": "**", "second": "__", "": ""}
    cell = lambda v, m: f"{sign[m]}{'' if v is None else format(v, f'.{decimals}f')}{sign[m]}"
    rows = [[key, *columns], *([str(n), *(cell(*marks[n, c]) for c in columns)] for n in names)]
    wide = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    return "\n".join(" | ".join(x.ljust(w) for x, w in zip(r, wide)) for r in rows)


def chart(points: list[tuple[str, float]], width: int = 50) -> str:
    """Bars of a small report as text."""
    most = max((abs(v) for _, v in points), default=0.0) or 1.0
    label = max((len(n) for n, _ in points), default=0)
    return "\n".join(f"{n.ljust(label)} {'#' * round(width * abs(v) / most)} {v:.2f}" for n, v in points)


def compare_models(votes: DataFrame, by: list[str], models: tuple[str, ...], show_diff: bool = False) -> DataFrame:
    """Attributes by models: the value each gave; with ``show_diff`` only attributes on which they don't all agree."""
    wide = votes.groupBy(*by, "attribute").pivot("model", list(models)).agg(F.min("value"))
    if not show_diff:
        return wide
    cells = F.array(*(F.coalesce(F.col(f"`{m}`"), F.lit("\0")) for m in models))
    return wide.where(F.size(F.array_distinct(cells)) > 1)


def length_report(runs: DataFrame, attr_schema: DataFrame, columns: tuple[str, ...] = LENGTH_ATTRIBUTES) -> DataFrame:
    """``(model, n_runs, LENGTH)``: the mean share of attributes within their length range, not in percent."""
    from tessera.operators import metrics

    side = schemas.profile(attr_schema).select("schema_name", "lengths", "options", "answer_types")
    rows = runs.where("metadata IS NOT NULL").join(side, "schema_name")
    made = no_baselines(rows.select("result_id", "model", metrics.lengths(rows, "metadata", columns).alias("length")).dropDuplicates(["result_id"]))
    return made.groupBy("model").agg(F.count("*").alias("n_runs"), F.avg("length").alias("LENGTH"))
