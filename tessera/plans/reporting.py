"""Queries of the cost, error, timing and comparison reports, the ensembles and the joins behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as T
from tessera.operators import ensembles, extractors, matching, metrics, reports
from tessera.plans import sql
from tessera.plans.registry import Registry
from tessera.sources.tables import scan

register = Registry()
METHODS = {"latex": "latex_time", "pdfplumber": "pdfplumber_time", "docling": "docling_time"}
VOTED = ("Form", "License", "Link", "Host", "Access", "Domain", "Tasks", "Authors")
TEST_IDS = f"(SELECT paper_id FROM papers WHERE split = 'test' AND schema_name IN ({', '.join(repr(s) for s in schemas.SCHEMATA)}))"
#: The base name of a model, in SQL.
BASE = "replace(model, '-browsing', '')"


@register(f"""WITH {sql.RUNS}, sums AS (SELECT model, count(*) AS n_runs, coalesce(sum(cost.input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(cost.output_tokens), 0)::BIGINT AS output_tokens,
      round(coalesce(sum(cost.cost), 0), 6) AS stored_cost FROM runs WHERE paper_id IN {TEST_IDS} GROUP BY model)
    SELECT s.model, n_runs, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens, stored_cost, round((p.input * input_tokens + p.output * output_tokens) / 1e6, 6) AS list_cost
    FROM sums s LEFT JOIN model_prices p ON p.model = replace(s.model, '-browsing', '')""")
def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and costs by model on the test papers, as stored and by the price list."""
    runs = matching.in_split(scan(spark, sf_dir, "results").select("result_id", "paper_id", "model", "cost"), matching.split_ids(scan(spark, sf_dir, "papers"), "test"))
    return reports.costs(runs, scan(spark, sf_dir, "model_prices")).withColumns({c: F.round(c, 6) for c in ("stored_cost", "list_cost")})


@register(f"""WITH {sql.RUNS} SELECT result_id, round(coalesce(cost.input_tokens / 1e6 * p.input, -1), 8) AS input_cost, round(coalesce(cost.output_tokens / 1e6 * p.output, -1), 8) AS output_cost,
      round((p.input * cost.input_tokens + p.output * cost.output_tokens) / 1e6, 8) AS list_cost
    FROM runs r LEFT JOIN model_prices p ON p.model = replace(r.model, '-browsing', '')""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run cost by the price list."""
    runs = scan(spark, sf_dir, "results").select("result_id", "model", "cost.input_tokens", "cost.output_tokens").dropDuplicates(["result_id"])
    priced = matching.with_prices(runs, scan(spark, sf_dir, "model_prices"))
    i, o = F.col("input_tokens"), F.col("output_tokens")
    return priced.select("result_id", F.round(T.token_cost(i, F.col("input_price")), 8).alias("input_cost"), F.round(T.token_cost(o, F.col("output_price")), 8).alias("output_cost"), F.round(matching.list_cost(i, o), 8).alias("list_cost"))


@register(f"""WITH {sql.RUNS} SELECT {BASE} AS model, count(*) AS n_runs, count(*) FILTER (coalesce(error, '') <> '') AS n_errors FROM runs
    WHERE {BASE} NOT IN {sql.BASELINES} AND lower(model) NOT LIKE '%human%' GROUP BY 1""")
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by base model over all result sets."""
    return reports.errors(scan(spark, sf_dir, "results"))


@register(f"""WITH {sql.RUNS} SELECT error, count(*) AS n FROM runs WHERE {BASE} NOT IN {sql.BASELINES} AND lower(model) NOT LIKE '%human%' GROUP BY error""")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each message was stored."""
    return reports.error_histogram(scan(spark, sf_dir, "results"))


@register(f"""WITH {sql.RUNS} SELECT CASE WHEN contains(error, 'Expecting value: line') THEN 'JSON Reading Error' ELSE error END AS error, count(*) AS n FROM runs
    WHERE {BASE} NOT IN {sql.BASELINES} AND lower(model) NOT LIKE '%human%' GROUP BY 1""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by class."""
    return reports.error_histogram(scan(spark, sf_dir, "results"), classes=True)


_TIMES = "t AS (SELECT paper_id, method, seconds FROM (" + " UNION ALL ".join(f"SELECT paper_id, '{m}' AS method, {c} AS seconds FROM papers" for m, c in METHODS.items()) + ") WHERE seconds IS NOT NULL AND NOT isnan(seconds))"


@register(f"WITH {_TIMES} SELECT method, count(*) AS n, round(avg(seconds), 8) AS mean, round(median(seconds), 8) AS median, min(seconds) AS min, max(seconds) AS max, round(stddev_samp(seconds), 8) AS std FROM t GROUP BY method")
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, exact median, extremes and deviation of the extraction times of each method."""
    stats = reports.timing_stats(reports.melt_timings(scan(spark, sf_dir, "papers"), METHODS))
    return stats.withColumns({c: F.round(c, 8) for c in ("mean", "median", "std")})


@register("SELECT paper_id, " + ", ".join(f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 0 ELSE {c} END AS {m}" for m, c in METHODS.items()) + " FROM papers WHERE " + " OR ".join(f"({c} IS NOT NULL AND NOT isnan({c}))" for c in METHODS.values()))
def timing_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers by methods, 0 where a time is missing."""
    return reports.timing_pivot(reports.melt_timings(scan(spark, sf_dir, "papers"), METHODS), tuple(METHODS))


_REAL = f"real AS (SELECT * FROM runs WHERE error IS NULL AND metadata IS NOT NULL AND model NOT IN {sql.BASELINES} QUALIFY row_number() OVER (PARTITION BY paper_id, schema_name, shot, model ORDER BY result_id DESC) = 1)"
_TEXTS = [n for n in VOTED if n not in sql.TEXT_LISTS]
_LISTS = [n for n in VOTED if n in sql.TEXT_LISTS]
_CAST = (
    "votes AS (SELECT paper_id, schema_name, shot, model, result_id, attribute, u.value AS value, u.place AS place FROM ("
    + " UNION ALL ".join([f"SELECT paper_id, schema_name, shot, model, result_id, '{n}' AS attribute, {{'value': metadata.\"{n}\"::VARCHAR, 'place': 0}} AS u FROM real" for n in _TEXTS]
    + [f"SELECT paper_id, schema_name, shot, model, result_id, '{n}' AS attribute, unnest([{{'value': metadata.\"{n}\"[i], 'place': i - 1}} for i in generate_series(1, len(metadata.\"{n}\"))]) AS u FROM real" for n in _LISTS])
    + ") WHERE u.value IS NOT NULL)"
)


def _winners(source: str) -> str:
    return f"""counted AS (SELECT paper_id, schema_name, shot, attribute, value, count(*) AS n, min((model, result_id, place)) AS first FROM {source} GROUP BY ALL),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY paper_id, schema_name, shot, attribute ORDER BY n DESC, first) AS rnk, max(n) OVER (PARTITION BY paper_id, schema_name, shot, attribute) AS most FROM counted)
      SELECT paper_id, shot, attribute, string_agg(value, ' | ' ORDER BY rnk) AS winners, count(*) AS n_winners FROM ranked WHERE rnk <= 3 AND n = most GROUP BY paper_id, schema_name, shot, attribute"""


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = scan(spark, sf_dir, "results").where("paper_id IS NOT NULL")
    return ensembles.votes(ensembles.judge_input(results, ["paper_id", "schema_name", "shot"]), ["paper_id", "schema_name", "shot"], VOTED)


def _shown(winners: DataFrame) -> DataFrame:
    return winners.select("paper_id", "shot", "attribute", F.array_join("winners", " | ").alias("winners"), F.size("winners").cast("bigint").alias("n_winners"))


@register(f"WITH {sql.RUNS}, {_REAL}, {_CAST}, {_winners('votes')}")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values most models gave, of each paper and attribute."""
    return _shown(ensembles.majority(_votes(spark, sf_dir), ["paper_id", "schema_name", "shot"]))


@register(f"""WITH {sql.RUNS}, {_REAL}, {_CAST}, grp AS (SELECT DISTINCT attribute, validation_group FROM attr_schema WHERE validation_group IS NOT NULL),
    routed AS (SELECT v.* FROM votes v LEFT JOIN grp g USING (attribute) WHERE CASE WHEN coalesce(g.validation_group = 'ACCESSABILITY', false) THEN contains(lower(model), 'browsing')
      ELSE contains(lower(model), 'pro') OR contains(lower(model), 'deepseek') OR contains(lower(model), 'jury') END), {_winners('routed')}""")
def compose_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among the models that may vote on the attribute."""
    groups = scan(spark, sf_dir, "attr_schema").where("validation_group IS NOT NULL").select("attribute", "validation_group").distinct()
    return _shown(ensembles.compose(_votes(spark, sf_dir), ["paper_id", "schema_name", "shot"], groups))


@register(f"WITH {sql.RUNS}, {_REAL} SELECT paper_id, shot, count(*) AS n_models, min(model) AS first_model, max(result_id) AS last_result FROM real GROUP BY paper_id, schema_name, shot")
def judge_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge reads of each paper, the last run of each real model."""
    got = ensembles.judge_input(scan(spark, sf_dir, "results"), ["paper_id", "schema_name", "shot"])
    return got.groupBy("paper_id", "schema_name", "shot").agg(F.count("*").alias("n_models"), F.min("model").alias("first_model"), F.max("result_id").alias("last_result")).drop("schema_name")


MODELS = ("auralis_lumen-3-large", "boreal_tern-72b-instruct", "cobalt_mesa-mini")
_CELLS = ", ".join(f"min(value) FILTER (model = '{m}') AS \"{m}\"" for m in MODELS)
_VALUES = "vals AS (" + " UNION ALL ".join(f"SELECT paper_id, shot, model, '{n}' AS attribute, metadata.\"{n}\"::VARCHAR AS value FROM runs WHERE result_set = 'results_latex' AND error IS NULL" for n in ("Form", "Unit", "Access", "Host")) + ")"


def _compared(spark: SparkSession, sf_dir: str, diff: bool) -> DataFrame:
    runs = scan(spark, sf_dir, "results").where("result_set = 'results_latex' AND error IS NULL AND metadata IS NOT NULL")
    cast = ensembles.votes(runs, ["paper_id", "shot"], ("Form", "Unit", "Access", "Host"))
    return reports.compare_models(cast, ["paper_id", "shot"], MODELS, diff)


@register(f"WITH {sql.RUNS}, {_VALUES} SELECT paper_id, shot, attribute, {_CELLS} FROM vals WHERE value IS NOT NULL GROUP BY paper_id, shot, attribute")
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes by models."""
    return _compared(spark, sf_dir, False)


@register(f"WITH {sql.RUNS}, {_VALUES}, w AS (SELECT paper_id, shot, attribute, {_CELLS} FROM vals WHERE value IS NOT NULL GROUP BY paper_id, shot, attribute) SELECT * FROM w WHERE NOT (" + " AND ".join(f'"{MODELS[0]}" IS NOT DISTINCT FROM "{m}"' for m in MODELS[1:]) + ")")
def compare_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the attributes on which the models differ."""
    return _compared(spark, sf_dir, True)


@register(f"""WITH {sql.RUNS}, {sql.ONE_GOLD}, side AS (SELECT replace(string_split(metadata."Paper Link", '/')[-1], '.pdf', '') AS id, record_id, metadata."Paper Link" AS link FROM golds WHERE metadata."Paper Link" IS NOT NULL),
    f AS (SELECT * FROM side QUALIFY row_number() OVER (PARTITION BY id ORDER BY record_id) = 1)
    SELECT result_id, f.record_id AS gold_record_id, f.link AS gold_link FROM runs LEFT JOIN f ON f.id = runs.paper_id""")
def substring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run with the first gold record whose link holds its paper id."""
    gold = scan(spark, sf_dir, "gold").select("record_id", F.col("metadata.`Paper Link`").alias("link"))
    return matching.by_link(scan(spark, sf_dir, "results").select("result_id", "paper_id").dropDuplicates(["result_id"]), gold, F.col("link")).drop("paper_id")


_DATASET = "d AS (SELECT row_number() OVER (ORDER BY record_id) AS ordinal, metadata.\"Paper Title\" AS title, 'https://arxiv.org/abs/' || string_split(metadata.\"Paper Link\", '/')[-1] AS link FROM golds)"
_ASK = "q AS (SELECT result_id AS query_id, CASE WHEN result_id % 2 = 0 THEN metadata.\"Paper Title\" ELSE '' END AS title, 'https://arxiv.org/abs/' || paper_id AS link FROM runs WHERE metadata IS NOT NULL)"


def _asked(spark: SparkSession, sf_dir: str, last: bool) -> DataFrame:
    """Runs ask by title if their id is even, else by link; gold records are numbered by their id."""
    gold = scan(spark, sf_dir, "gold").select(F.col("record_id").alias("ordinal"), F.col("metadata.`Paper Title`").alias("title"), F.col("metadata.`Paper Link`").alias("link")).dropDuplicates(["ordinal"])
    runs = scan(spark, sf_dir, "results").where("metadata IS NOT NULL")
    title = F.when(F.col("result_id") % 2 == 0, F.col("metadata.`Paper Title`")).otherwise("")
    asked = runs.select(F.col("result_id").alias("query_id"), title.alias("title"), F.concat(F.lit("https://arxiv.org/abs/"), F.col("paper_id")).alias("link"), F.lit(None).cast("string").alias("record_title")).dropDuplicates(["query_id"])
    return matching.match_record(asked, gold, last=last, fuzzy=False)


def _match_sql(pick: str) -> str:
    return f"""WITH {sql.RUNS}, {sql.ONE_GOLD}, {_DATASET.replace('row_number() OVER (ORDER BY record_id)', 'record_id')}, {_ASK}
      SELECT query_id, {pick}(d.ordinal) AS ordinal, CASE WHEN coalesce(any_value(q.title), '') <> '' THEN 'title' ELSE 'link' END AS how
      FROM q JOIN d ON CASE WHEN coalesce(q.title, '') <> '' THEN q.title = d.title ELSE q.link = d.link END GROUP BY query_id"""


@register(_match_sql("max"))
def match_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record a run means, by title or link; the last wins."""
    return _asked(spark, sf_dir, True)


@register(_match_sql("min"))
def match_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same; the first wins."""
    return _asked(spark, sf_dir, False)


@register()
def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold record whose title is most like that of a run's record, by similarity over 0.8."""
    titles = scan(spark, sf_dir, "results").where("metadata IS NOT NULL").select(F.col("metadata.`Paper Title`").alias("record_title")).distinct().select(F.col("record_title").alias("query_id"), "record_title", F.lit("").alias("title"), F.lit("").alias("link"))
    gold = scan(spark, sf_dir, "gold").groupBy(F.col("metadata.`Paper Title`").alias("title")).agg(F.min("record_id").alias("ordinal")).withColumn("link", F.lit(""))
    return matching.match_record(titles, gold)


@register(f"WITH {sql.RUNS}, {sql.IDS} SELECT result_id, i.schema_name AS lang FROM runs JOIN ids i USING (paper_id)")
def language_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test runs by the language their paper is registered for."""
    ids = matching.split_ids(scan(spark, sf_dir, "papers"), "test")
    return matching.by_language(scan(spark, sf_dir, "results").select("result_id", "paper_id", "schema_name").dropDuplicates(["result_id"]), ids).select("result_id", "lang")


@register(f"""WITH {sql.RUNS} SELECT DISTINCT p.paper_id, m.model, 0 AS shot FROM papers p CROSS JOIN model_prices m
    WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.paper_id = p.paper_id AND r.model = m.model AND r.shot = 0 AND r.error IS NULL)""")
def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: which of all papers by all listed models are still to be run without examples; failed runs are."""
    models = [r[0] for r in scan(spark, sf_dir, "model_prices").select("model").distinct().collect()]  # the price list: models, not data
    work = scan(spark, sf_dir, "papers").select("paper_id", F.explode(F.array(*map(F.lit, models))).alias("model"), F.lit(0).alias("shot")).distinct()
    return matching.skip_existing(work, scan(spark, sf_dir, "results").select("paper_id", "model", "shot", "error"), repeat_on_error=True)


@register(f"""WITH {sql.RUNS}, base AS (SELECT paper_id, shot, model AS b, max(result_id) AS base_result_id FROM runs WHERE NOT is_browsing AND error IS NULL GROUP BY ALL)
    SELECT r.result_id, base_result_id FROM runs r LEFT JOIN base ON base.paper_id = r.paper_id AND base.shot = r.shot AND base.b = replace(r.model, '-browsing', '') WHERE is_browsing""")
def browsing_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every browsing run with the run of its base model that it starts from."""
    runs = scan(spark, sf_dir, "results").select("result_id", "paper_id", "shot", "model", "is_browsing", "error").dropDuplicates(["result_id"])
    return matching.browsing_base(runs.where("is_browsing"), runs).select("result_id", "base_result_id")


@register(f"""WITH {sql.RUNS}, base AS (SELECT paper_id, shot, model AS b, max(result_id) AS id FROM runs WHERE NOT is_browsing AND error IS NULL GROUP BY ALL)
    SELECT r.result_id, round(coalesce(r.cost.cost, 0) + coalesce(x.cost.cost, 0), 8) AS cost, coalesce(r.cost.input_tokens, 0) + coalesce(x.cost.input_tokens, 0) AS input_tokens, coalesce(r.cost.output_tokens, 0) + coalesce(x.cost.output_tokens, 0) AS output_tokens
    FROM runs r JOIN base ON base.paper_id = r.paper_id AND base.shot = r.shot AND base.b = replace(r.model, '-browsing', '') JOIN runs x ON x.result_id = base.id WHERE r.is_browsing""")
def merged_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: the cost of a browsing run together with that of its base run."""
    runs = scan(spark, sf_dir, "results").select("result_id", "paper_id", "shot", "model", "is_browsing", "error", "cost").dropDuplicates(["result_id"])
    pairs = matching.browsing_base(runs.where("is_browsing"), runs).join(runs.select(F.col("result_id").alias("base_result_id"), F.col("cost").alias("base_cost")), "base_result_id")
    merged = extractors.merge_costs("base_cost", "cost")
    return pairs.select("result_id", merged.alias("m")).select("result_id", F.round("m.cost", 8).alias("cost"), "m.input_tokens", "m.output_tokens")


@register("""WITH names AS (SELECT DISTINCT string_split(model, '_')[2] AS name FROM results), listed AS (SELECT row_number() OVER (ORDER BY model) AS ordinal, model FROM model_prices),
    hit AS (SELECT n.name, l.model FROM names n JOIN listed l ON contains(lower(l.model), lower(n.name)) QUALIFY row_number() OVER (PARTITION BY n.name ORDER BY l.ordinal) = 1)
    SELECT name, hit.model FROM names LEFT JOIN hit USING (name)""")
def resolve_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed model that each short name stands for."""
    names = scan(spark, sf_dir, "results").select(F.split("model", "_")[1].alias("name")).distinct()
    models = sorted(r[0] for r in scan(spark, sf_dir, "model_prices").select("model").collect())  # the price list
    listed = spark.createDataFrame(list(enumerate(models)), "ordinal int, model string")
    return matching.resolve_model(names, listed)


@register(f"""WITH {sql.ONE_GOLD}, want AS (SELECT g.record_id, a.attribute, CASE a.attribute {' '.join(f"WHEN '{n}' THEN g.metadata.\"{n}\" IS NULL" for n in (*sql.TEXT_LISTS, *sql.SCALARS, 'Subsets'))}
      WHEN 'Language' THEN g.metadata."Language" IS NULL AND g.metadata.Languages IS NULL END AS no_value, NOT list_contains(coalesce(map_keys(g.annotations_from_paper), []), a.attribute) AS no_note
      FROM golds g JOIN attr_schema a USING (schema_name))
    SELECT record_id, attribute, 'record' AS missing_in FROM want WHERE no_value UNION ALL SELECT record_id, attribute, 'annotations' FROM want WHERE no_note""")
def completeness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the attributes that gold records lack, in themselves or in the annotators' map."""
    from tessera.operators.normalise import audit

    return audit(scan(spark, sf_dir, "gold"), scan(spark, sf_dir, "attr_schema"))


@register(f"WITH {sql.RUNS}, r AS (SELECT * FROM runs WHERE result_set = 'results_latex') SELECT result_id FROM r WHERE NOT (contains(model, 'maverick') AND NOT contains(model, 'human') AND coalesce(paper_id IN (SELECT paper_id FROM papers WHERE split = 'test' AND schema_name = 'en'), false))")
def delete_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: the LaTeX results that remain when one model's on the English test papers go."""
    from tessera.sources.sinks import delete_results as delete

    runs = scan(spark, sf_dir, "results").where("result_set = 'results_latex'").select("result_id", "paper_id", "model").dropDuplicates(["result_id"])
    return delete(runs, "maverick", matching.split_ids(scan(spark, sf_dir, "papers"), "test", ("en",))).select("result_id")




QUERIES, ORACLES = register.queries, register.oracles
