"""Queries of the comparison metrics, the joins with gold records and the leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import matching, metrics, reports
from tessera.plans import sql
from tessera.plans.registry import Registry
from tessera.sources.tables import scan

register = Registry()
VALUES = (*schemas.GROUPS, "AVERAGE")


def _scored(spark: SparkSession, sf_dir: str, annotated: bool = False, results: DataFrame | None = None) -> DataFrame:
    runs = scan(spark, sf_dir, "results") if results is None else results
    return metrics.score(runs, scan(spark, sf_dir, "gold"), scan(spark, sf_dir, "attr_schema"), annotated)


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.split_ids(scan(spark, sf_dir, "papers"), "test")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@register(f"WITH {sql.HITS} SELECT result_id, attribute, validation_group, hit, from_paper FROM hits")
def score_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M4: whether each validated attribute of each run is right."""
    return metrics.attribute_scores(_scored(spark, sf_dir)).select("result_id", "attribute", "validation_group", "hit", "from_paper")


_GROUPS = ", ".join(f'round("{v}", 6) AS "{v}"' for v in VALUES)


@register(f"WITH {sql.HITS}, {sql.scores()} SELECT result_id, paper_id, model, {_GROUPS} FROM scored")
def score_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the score of each group, and the average, of each run."""
    return _rounded(_scored(spark, sf_dir).select("result_id", "paper_id", "model", *VALUES), *VALUES)


@register(f"WITH {sql.HITS}, {sql.scores('from_paper <> 0')} SELECT result_id, paper_id, model, {_GROUPS} FROM scored")
def score_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 and M5 with the annotators' flags: what the paper doesn't hold takes no part."""
    return _rounded(_scored(spark, sf_dir, True).select("result_id", "paper_id", "model", *VALUES), *VALUES)


_OVERLAPS = ", ".join(f"{sql.overlap(f'g.metadata.\"{n}\"', f'r.metadata.\"{n}\"')} AS {n.lower()}" for n in ("Tasks", "Domain", "Authors"))


@register(f"WITH {sql.RUNS}, {sql.GOLD} SELECT r.result_id, {_OVERLAPS} FROM runs r JOIN gold1 g ON g.paper_id = r.paper_id")
def list_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 on three list attributes."""
    pairs = scan(spark, sf_dir, "results").select("result_id", "paper_id", "metadata").join(metrics.first_gold(scan(spark, sf_dir, "gold")), "paper_id")
    agree = lambda n: metrics.list_overlap(schemas.field("gold", n), schemas.field("metadata", n)).alias(n.lower())
    return pairs.select("result_id", *(agree(n) for n in ("Tasks", "Domain", "Authors"))).dropDuplicates(["result_id"])


@register(f"WITH {sql.RUNS}, {sql.GOLD} SELECT r.result_id, {sql.subsets('g.metadata.Subsets', 'r.metadata.Subsets')} AS subsets FROM runs r JOIN gold1 g ON g.paper_id = r.paper_id")
def dict_list_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 on the subsets of a record."""
    pairs = scan(spark, sf_dir, "results").select("result_id", "paper_id", "metadata.Subsets").join(metrics.first_gold(scan(spark, sf_dir, "gold")), "paper_id")
    return pairs.select("result_id", metrics.records_match(F.col("gold.Subsets"), F.col("Subsets")).alias("subsets")).dropDuplicates(["result_id"])


@register(f"""WITH {sql.RUNS}, {sql.GOLD}, pairs AS (
      SELECT r.result_id, [trim(lower(v), '{sql.SPACES}') for v in string_split(coalesce(array_to_string(g.metadata.Tasks, ','), ''), ',')] AS a,
             [trim(lower(v), '{sql.SPACES}') for v in string_split(coalesce(array_to_string(r.metadata.Tasks, ','), ''), ',')] AS b
      FROM runs r JOIN gold1 g ON g.paper_id = r.paper_id)
    SELECT result_id, len(list_intersect(list_distinct(a), list_distinct(b))) = len(a) AS same FROM pairs""")
def csv_set_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 on tasks written as comma lists."""
    pairs = scan(spark, sf_dir, "results").select("result_id", "paper_id", "metadata.Tasks").join(metrics.first_gold(scan(spark, sf_dir, "gold")), "paper_id")
    return pairs.select("result_id", metrics.csv_set_match(F.array_join("gold.Tasks", ","), F.array_join("Tasks", ",")).alias("same")).dropDuplicates(["result_id"])


_WORDS = "len(string_split(coalesce({v}, ''), ' '))"


def _length_sql(attributes: tuple[str, ...]) -> str:
    cases = " ".join(
        f"WHEN '{n}' THEN " + (f'len(coalesce(r.metadata."{n}", []))' if n in (*sql.TEXT_LISTS, "Subsets") else f"CASE WHEN a.options IS NOT NULL AND a.answer_type = 'str' THEN 1 ELSE {_WORDS.format(v=f'r.metadata.\"{n}\"::VARCHAR')} END")
        for n in attributes
        if n != "Language"
    )
    language = "WHEN 'Language' THEN CASE WHEN a.answer_type LIKE 'List%' THEN len(coalesce(r.metadata.Languages, [])) WHEN a.options IS NOT NULL AND a.answer_type = 'str' THEN 1 ELSE 1 END"
    return f"""{sql.RUNS}, lens AS (
      SELECT r.result_id, r.model, a.answer_min, a.answer_max, CASE a.attribute {cases} {language if 'Language' in attributes else ''} END AS n
      FROM runs r JOIN attr_schema a ON a.schema_name = r.schema_name WHERE r.metadata IS NOT NULL AND a.attribute IN ({', '.join(f"'{n}'" for n in attributes)})),
    shares AS (SELECT result_id, model, sum(CASE WHEN n >= answer_min AND (coalesce(answer_max, -1) < 0 OR n <= answer_max) THEN 1 ELSE 0 END)::DOUBLE / count(*) AS share FROM lens GROUP BY ALL)"""


@register(f"WITH {_length_sql((*sql.TEXT_LISTS, *sql.SCALARS, 'Subsets', 'Language'))} SELECT result_id, model, round(share, 6) AS length_forcing FROM shares")
def length_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: the share of attributes within their length range, of each run."""
    side = schemas.profile(scan(spark, sf_dir, "attr_schema")).select("schema_name", "lengths", "options", "answer_types")
    rows = scan(spark, sf_dir, "results").where("metadata IS NOT NULL").select("result_id", "model", "schema_name", "metadata").join(side, "schema_name")
    return rows.select("result_id", "model", F.round(metrics.lengths(rows, "metadata"), 6).alias("length_forcing")).dropDuplicates(["result_id"])


@register(f"""WITH {_length_sql(reports.LENGTH_ATTRIBUTES)}
    SELECT model, count(*) AS n_runs, round(avg(share), 6) AS "LENGTH" FROM shares WHERE model NOT IN {sql.BASELINES} AND lower(model) NOT LIKE '%human%' GROUP BY model""")
def length_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean length compliance on five attributes."""
    runs = scan(spark, sf_dir, "results").select("result_id", "model", "schema_name", "metadata")
    return _rounded(reports.length_report(runs, scan(spark, sf_dir, "attr_schema")), "LENGTH")


def _filled(n: str) -> str:
    v = f'r.metadata."{n}"'
    if n in (*sql.TEXT_LISTS, "Subsets"):
        return f"WHEN '{n}' THEN len(coalesce({v}, [])) > 0"
    if n == "Language":
        return "WHEN 'Language' THEN coalesce(r.metadata.\"Language\", '') <> '' OR len(coalesce(r.metadata.Languages, [])) > 0"
    return f"WHEN '{n}' THEN coalesce({v}::VARCHAR, '') <> ''"


@register(f"""WITH {sql.RUNS} SELECT r.result_id, 1.0::DOUBLE AS key_ratio,
      round(sum(CASE WHEN CASE a.attribute {' '.join(_filled(n) for n in (*sql.TEXT_LISTS, *sql.SCALARS, 'Subsets', 'Language'))} END THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS fill_ratio
    FROM runs r JOIN attr_schema a ON a.schema_name = r.schema_name WHERE r.metadata IS NOT NULL GROUP BY r.result_id""")
def fill_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: the stored ratio (always 1) and the share of attributes that have a value."""
    side = schemas.profile(scan(spark, sf_dir, "attr_schema")).select("schema_name", "columns")
    rows = scan(spark, sf_dir, "results").where("metadata IS NOT NULL").select("result_id", "schema_name", "metadata").join(side, "schema_name")
    return rows.select("result_id", metrics.key_ratio(rows, "metadata").alias("key_ratio"), F.round(metrics.fill_ratio(rows, "metadata"), 6).alias("fill_ratio")).dropDuplicates(["result_id"])


_MEANS = ", ".join(f'round(avg("{v}") * 100, 5) AS "{v}"' for v in VALUES)


@register(f"WITH {sql.HITS}, {sql.scores()} SELECT model, count(*) AS n_runs, {_MEANS} FROM scored WHERE result_set = 'results_latex' AND shot = 0 AND model NOT IN {sql.BASELINES} AND lower(model) NOT LIKE '%human%' GROUP BY model")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean score of each group by model, of the zero-shot LaTeX runs."""
    runs = scan(spark, sf_dir, "results").where("result_set = 'results_latex' AND shot = 0")
    return _rounded(reports.leaderboard(reports.no_baselines(_scored(spark, sf_dir, results=runs))), *VALUES, digits=5)


@register(f"WITH {sql.HITS}, {sql.scores('from_paper <> 0')} SELECT model, count(*) AS n_runs, {_MEANS} FROM scored WHERE NOT contains(model, '-browsing') GROUP BY model")
def leaderboard_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 with the starred average: only attributes that the paper states, without browsing models."""
    return _rounded(reports.leaderboard(reports.browsing(_scored(spark, sf_dir, True), none=True)), *VALUES, digits=5)


@register(f"WITH {sql.HITS} SELECT model, attribute, count(*) AS n, round(avg(hit::INT) * 100, 5) AS accuracy FROM hits GROUP BY ALL")
def leaderboard_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 by attribute, in the long form."""
    return _rounded(reports.by_attribute(metrics.attribute_scores(_scored(spark, sf_dir))), "accuracy", digits=5)


SIX = ("Link", "License", "Tasks", "Domain", "Collection Style", "Volume")


@register(f"WITH {sql.HITS} SELECT model, " + ", ".join(f"round(avg(hit::INT) FILTER (attribute = '{n}') * 100, 5) AS \"{n}\"" for n in SIX) + " FROM hits GROUP BY model")
def leaderboard_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six attributes as columns."""
    long = metrics.attribute_scores(_scored(spark, sf_dir))
    return _rounded(reports.pivot_attributes(long, SIX), *SIX, digits=5)


_LANG_WIDE = ", ".join(f"round(coalesce(100 * sum(s) FILTER (lang = '{x}') / sum(n) FILTER (lang = '{x}'), 0), 5) AS {x}" for x in schemas.SCHEMATA)
_LANG_SUM = " + ".join(f"coalesce(100 * sum(s) FILTER (lang = '{x}') / sum(n) FILTER (lang = '{x}'), 0)" for x in schemas.SCHEMATA)


@register(f"""WITH {sql.HITS}, {sql.scores()}, {sql.IDS},
    sums AS (SELECT model, schema_name AS lang, sum("AVERAGE") AS s, count(*) AS n FROM scored WHERE paper_id IN (SELECT paper_id FROM ids) GROUP BY ALL)
    SELECT model, {_LANG_WIDE}, round(({_LANG_SUM}) / 6, 5) AS "Average", round(100 * sum(s) / sum(n), 5) AS "Weighted_Average" FROM sums GROUP BY model""")
def leaderboard_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average of each language, of all languages and of all runs on test papers; no coverage is asked for."""
    ids = _ids(spark, sf_dir)
    runs = matching.in_split(scan(spark, sf_dir, "results"), ids)
    return _rounded(reports.by_language(_scored(spark, sf_dir, results=runs), ids, complete_only=False), *schemas.SCHEMATA, "Average", "Weighted_Average", digits=5)


@register(f"""WITH {sql.HITS}, {sql.scores()}, {sql.IDS},
    n_ids AS (SELECT schema_name AS lang, count(*) AS n_ids FROM ids GROUP BY ALL),
    one AS (SELECT model, paper_id, schema_name AS lang, avg("AVERAGE") AS v FROM scored WHERE paper_id IN (SELECT paper_id FROM ids) GROUP BY ALL),
    sums AS (SELECT model, lang, sum(v) AS s, count(*) AS n FROM one GROUP BY ALL),
    kept AS (SELECT sums.* FROM sums JOIN n_ids USING (lang) WHERE n = n_ids)
    SELECT model, {_LANG_WIDE}, round(({_LANG_SUM}) / 6, 5) AS "Average", round(100 * sum(s) / sum(n), 5) AS "Weighted_Average" FROM kept GROUP BY model""")
def leaderboard_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the coverage gate in each language, on the mean of a model's runs on a paper."""
    ids = _ids(spark, sf_dir)
    scored = _scored(spark, sf_dir, results=matching.in_split(scan(spark, sf_dir, "results"), ids))
    one = scored.groupBy("model", "paper_id", "schema_name").agg(F.avg("AVERAGE").alias("AVERAGE"))
    return _rounded(reports.by_language(one, ids), *schemas.SCHEMATA, "Average", "Weighted_Average", digits=5)


@register(f"""WITH {sql.RUNS}, {sql.IDS}, n AS (SELECT model, r.schema_name, count(*) AS n_runs FROM runs r WHERE paper_id IN (SELECT paper_id FROM ids) GROUP BY ALL),
    w AS (SELECT schema_name, count(*) AS n_ids FROM ids GROUP BY ALL)
    SELECT model, schema_name, n_runs, coalesce(n_ids, 0) AS n_ids, n_runs = coalesce(n_ids, 0) AS complete FROM n LEFT JOIN w USING (schema_name)""")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs against test papers, by model and schema."""
    ids = _ids(spark, sf_dir)
    runs = matching.in_split(scan(spark, sf_dir, "results").select("result_id", "paper_id", "model", "schema_name").dropDuplicates(["result_id"]), ids)
    return reports.coverage(runs, ids, ("model", "schema_name"))


@register(f"""WITH {sql.HITS} SELECT model, attribute, accuracy, round(avg(raw) OVER (PARTITION BY model), 5) AS row_mean FROM (
    SELECT model, attribute, avg(hit::INT) * 100 AS raw, round(avg(hit::INT) * 100, 5) AS accuracy FROM hits WHERE validation_group = 'CONTENT' GROUP BY ALL)""")
def subset_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes of one group and their unweighted mean."""
    return _rounded(reports.subset_detail(metrics.attribute_scores(_scored(spark, sf_dir)), "CONTENT"), "accuracy", "row_mean", digits=5)


@register(f"""WITH {sql.HITS}, {sql.scores()} SELECT model, g.metadata."Year" AS year, count(*) AS n_runs, round(avg("AVERAGE") * 100, 5) AS "AVERAGE"
    FROM scored JOIN gold1 g USING (paper_id) GROUP BY ALL""")
def score_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean score by the year of the gold record."""
    return _rounded(reports.by_year(_scored(spark, sf_dir), scan(spark, sf_dir, "gold")), "AVERAGE", digits=5)


def _level_sql(base: str, levels: dict[str, str]) -> str:
    cols = ", ".join(f'avg("AVERAGE") FILTER ({c}) AS "{n}"' for n, c in levels.items())
    means = ", ".join(f'round(coalesce(avg("{n}") * 100, 0), 5) AS "{n}"' for n in ["base", *levels])
    return f"""wide AS (SELECT paper_id, model, avg("AVERAGE") FILTER ({base}) AS base, {cols} FROM scored GROUP BY ALL HAVING count(*) FILTER ({base}) > 0)
      SELECT model, count(*) AS n_base, {means} FROM wide GROUP BY model"""


_LATEX = "result_set = 'results_latex' AND shot = 0"
_CONTEXT = {"quarter": "result_set = 'results_context_quarter'", "half": "result_set = 'results_context_half'"}
_SHOTS = {f"shot_{k}": f"result_set = 'results_fewshot' AND shot = {k}" for k in (1, 3, 5)}


def _ablation(spark: SparkSession, sf_dir: str, levels: dict[str, str]) -> DataFrame:
    runs = scan(spark, sf_dir, "results").where(" OR ".join(f"({c})" for c in [_LATEX, *levels.values()]))
    wide = matching.siblings(_scored(spark, sf_dir, results=runs), F.expr(_LATEX), {n: F.expr(c) for n, c in levels.items()})
    return _rounded(reports.ablation(wide, ("base", *levels)), "base", *levels, digits=5)


@register(f"WITH {sql.HITS}, {sql.scores()}, {_level_sql(_LATEX, _CONTEXT)}")
def context_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LaTeX runs beside those on a half and a quarter of the text."""
    return _ablation(spark, sf_dir, _CONTEXT)


@register(f"WITH {sql.HITS}, {sql.scores()}, {_level_sql(_LATEX, _SHOTS)}")
def fewshot_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-shot runs beside those with 1, 3 and 5 examples."""
    return _ablation(spark, sf_dir, _SHOTS)


@register(f"""WITH {sql.HITS}, {sql.scores()}, board AS (SELECT model, {', '.join(f'avg("{v}") * 100 AS "{v}"' for v in VALUES)} FROM scored GROUP BY model),
    long AS (UNPIVOT board ON {', '.join(f'"{v}"' for v in VALUES)} INTO NAME "column" VALUE value),
    ranked AS (SELECT *, max(value) OVER (PARTITION BY "column") AS top, row_number() OVER (PARTITION BY "column" ORDER BY value DESC, model) AS rn FROM long),
    seconds AS (SELECT "column", value AS second FROM ranked WHERE rn = 2)
    SELECT model, "column", round(value, 5) AS value, CASE WHEN abs(value - top) < 1e-8 THEN 'max' WHEN abs(value - second) < 1e-8 THEN 'second' ELSE '' END AS mark FROM ranked JOIN seconds USING ("column")""")
def ranked_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which entries of the leaderboard are the largest and the second largest."""
    board = reports.leaderboard(_scored(spark, sf_dir))
    return _rounded(reports.highlights(_rounded(board, *VALUES, digits=9), "model", VALUES), "value", digits=5)


QUERIES, ORACLES = register.queries, register.oracles
