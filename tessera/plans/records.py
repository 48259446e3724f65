"""Queries of the sources, the record normalisation, the scalar functions, search and the exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import repair
from tessera.functions import text as T
from tessera.operators import matching, normalise, search
from tessera.plans import sql
from tessera.plans.registry import Registry
from tessera.sources import files, sinks
from tessera.sources.tables import scan

register = Registry()
#: Stands for the current year, so that results don't change with the calendar.
YEAR = 2025


def _gold(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    return scan(spark, sf_dir, "gold").select("record_id", *columns).dropDuplicates(["record_id"])


# --- sources -------------------------------------------------------------------------------------------------------


@register(f"WITH {sql.ONE_GOLD} SELECT record_id, g.paper_id, g.schema_name, p.split, metadata.\"Name\" AS name, metadata.\"Year\" AS year FROM golds g LEFT JOIN papers p USING (paper_id)")
def gold_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gold record once, with the split of its paper."""
    rows = _gold(spark, sf_dir, "paper_id", "schema_name", F.col("metadata.Name").alias("name"), F.col("metadata.Year").alias("year"))
    return rows.join(scan(spark, sf_dir, "papers").select("paper_id", "split"), "paper_id", "left")


@register("""WITH firsts AS (SELECT schema_name, validation_group, min(ordinal) AS first_at FROM attr_schema WHERE validation_group IS NOT NULL GROUP BY ALL)
    SELECT a.schema_name, count(*) AS n_columns, string_agg(attribute, ',' ORDER BY ordinal) AS columns, string_agg(attribute, ',' ORDER BY first_at, ordinal) FILTER (a.validation_group IS NOT NULL) AS validation_columns,
      string_agg(attribute, ',' ORDER BY ordinal) FILTER (answer_type = 'List[str]') AS list_columns, string_agg(attribute || ':' || answer_min || '..' || coalesce(answer_max, -1), ',' ORDER BY ordinal) AS lengths
    FROM attr_schema a LEFT JOIN firsts f ON f.schema_name = a.schema_name AND f.validation_group = a.validation_group GROUP BY a.schema_name""")
def schema_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows from each schema: its columns, validated columns, list columns and length ranges."""
    got = schemas.profile(scan(spark, sf_dir, "attr_schema"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    spans = F.transform("columns", lambda c: F.concat(c, F.lit(":"), F.element_at("lengths", c)[0].cast("string"), F.lit(".."), F.element_at("lengths", c)[1].cast("string")))
    return got.select("schema_name", F.size("columns").cast("bigint").alias("n_columns"), joined("columns"), joined("validation_columns"), joined("list_columns"), F.array_join(spans, ",").alias("lengths"))


@register("SELECT attribute, ordinal, answer_type FROM attr_schema WHERE schema_name = 'jp'")
def schema_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes of one schema by its name."""
    return schemas.lookup(scan(spark, sf_dir, "attr_schema"), "jp").select("attribute", "ordinal", "answer_type")


_KEEP = "CASE WHEN attribute = 'Language' AND s <> 'multi' THEN list_concat([s], options[2:]) WHEN attribute = 'Language' THEN [" + ", ".join(f"'{x}'" for x in schemas.MULTI_LANGUAGES) + "] WHEN attribute = 'Script' THEN ['Hiragana', 'Katakana', 'Kanji', 'mixed'] ELSE options END"


@register(f"""SELECT s AS schema_name, (row_number() OVER (PARTITION BY s ORDER BY ordinal) - 1)::INT AS ordinal, attribute, CASE WHEN attribute = 'Language' AND s = 'multi' THEN 'List[str]' ELSE answer_type END AS answer_type,
      CASE WHEN attribute = 'Language' AND s = 'multi' THEN 2 ELSE answer_min END AS answer_min, CASE WHEN attribute = 'Language' AND s = 'multi' THEN 25 ELSE answer_max END AS answer_max, array_to_string({_KEEP}, '|') AS options
    FROM attr_schema, (SELECT unnest(['en', 'jp', 'ru', 'fr', 'multi']) AS s)
    WHERE schema_name = 'ar' AND attribute <> 'Dialect' AND (attribute <> 'Subsets' OR s = 'multi') AND (attribute <> 'Script' OR s = 'jp')""")
def schema_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schemata of the other languages from that of the first."""
    base = scan(spark, sf_dir, "attr_schema")
    made = [schemas.derive(base, s) for s in ("en", "jp", "ru", "fr", "multi")]
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    return out.select("schema_name", "ordinal", "attribute", "answer_type", "answer_min", "answer_max", F.array_join("options", "|").alias("options"))


_CHOSEN = """ranked AS (SELECT paper_id, source, doc_id, text, CASE source WHEN 'latex' THEN 0 WHEN 'pdf_text' THEN 1 END AS rnk FROM documents WHERE paper_id IS NOT NULL),
    best AS (SELECT * FROM ranked WHERE rnk IS NOT NULL AND coalesce(text, '') <> '' QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY rnk, doc_id) = 1)"""


@register("""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY schema_name ORDER BY ordinal, paper_id) AS n FROM papers WHERE ordinal IS NOT NULL), """ + _CHOSEN.replace("ranked AS", "d AS").replace("FROM ranked", "FROM d") + f""", {sql.GOLD}
    SELECT r.schema_name, n, r.paper_id, length(coalesce(text, '')) AS n_chars, g.metadata."Name" AS name FROM ranked r LEFT JOIN best USING (paper_id) LEFT JOIN gold1 g USING (paper_id) WHERE n <= 5""")
def example_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the first five worked examples of each schema."""
    got = matching.examples(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "papers"), scan(spark, sf_dir, "gold"))
    return got.select("schema_name", F.col("n").cast("bigint").alias("n"), "paper_id", F.length("text").cast("bigint").alias("n_chars"), F.col("gold.Name").alias("name"))


@register(f"WITH {sql.RUNS} SELECT result_id, paper_id, model FROM runs WHERE result_set = 'results_latex' AND shot = 0 AND NOT contains(model, '-browsing')")
def result_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zero-shot results of one set, without browsing models."""
    rows = scan(spark, sf_dir, "results").where("result_set = 'results_latex' AND shot = 0")
    return rows.where(~F.col("model").contains(T.BROWSING)).select("result_id", "paper_id", "model").dropDuplicates(["result_id"])


@register(f"WITH {sql.RUNS} SELECT result_id, paper_id, model FROM runs WHERE contains(model, '-browsing')")
def browsing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The browsing results only."""
    return scan(spark, sf_dir, "results").where(F.col("model").contains(T.BROWSING)).select("result_id", "paper_id", "model").dropDuplicates(["result_id"])


@register(f"WITH {sql.RUNS} SELECT result_set, shot, count(*) AS n_runs, count(DISTINCT paper_id) AS n_papers FROM runs GROUP BY ALL")
def multi_set_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-shot and few-shot results of all sets together."""
    rows = scan(spark, sf_dir, "results").select("result_id", "result_set", "shot", "paper_id").distinct()
    return rows.groupBy("result_set", "shot").agg(F.count("*").alias("n_runs"), F.countDistinct("paper_id").alias("n_papers"))


@register(f"WITH {sql.RUNS} SELECT paper_id, count(*) AS n_runs, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM runs WHERE paper_id IS NOT NULL GROUP BY paper_id")
def explorer_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What there is for each paper; the set of models is bounded by the price list, not by the runs."""
    rows = scan(spark, sf_dir, "results").where("paper_id IS NOT NULL").select("result_id", "paper_id", "model").distinct()
    per_model = rows.groupBy("paper_id", "model").agg(F.count("*").alias("n"))
    return per_model.groupBy("paper_id").agg(F.sum("n").alias("n_runs"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


@register("SELECT paper_id, count(*) AS n_files, sum(length(text))::BIGINT AS n_chars FROM documents WHERE source = 'latex' AND paper_id IS NOT NULL GROUP BY paper_id")
def latex_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The LaTeX files of each paper and the length of their concatenation."""
    rows = scan(spark, sf_dir, "documents").where("source = 'latex' AND paper_id IS NOT NULL")
    return rows.groupBy("paper_id").agg(F.count("*").alias("n_files"), F.sum(F.length("text")).alias("n_chars"))


@register("SELECT doc_id, md5(array_to_string(string_split(text, chr(12)), ' ')) AS text_md5 FROM documents WHERE source = 'pdf_text' AND text IS NOT NULL")
def pdf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page texts of each PDF joined by blanks."""
    rows = scan(spark, sf_dir, "documents").where("source = 'pdf_text' AND text IS NOT NULL")
    return rows.select("doc_id", F.md5(F.array_join(F.split("text", "\f", -1), " ").cast("binary")).alias("text_md5"))


@register("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE source = 'docling' AND text IS NOT NULL")
def layout_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown of the layout parser, from its cache."""
    rows = scan(spark, sf_dir, "documents").where("source = 'docling' AND text IS NOT NULL")
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register(f"WITH {_CHOSEN}, all_papers AS (SELECT DISTINCT paper_id FROM documents WHERE paper_id IS NOT NULL) SELECT paper_id, source, doc_id, md5(coalesce(text, '')) AS text_md5 FROM all_papers LEFT JOIN best USING (paper_id)")
def source_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each paper, LaTeX before PDF, empty if there is neither."""
    got = matching.choose_source(scan(spark, sf_dir, "documents"), ("latex", "pdf_text"))
    return got.select("paper_id", "source", "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("""SELECT doc_id, CASE WHEN starts_with(text, '%PDF') THEN 'pdf' WHEN contains(text, '\\document') OR contains(text, '\\begin{document}') THEN 'tex' ELSE 'unknown' END AS file_type FROM documents WHERE text IS NOT NULL""")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of each file by its signature."""
    rows = scan(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", T.file_type(F.encode("text", "UTF-8")).alias("file_type"))


#: A page made of a text: its lines are paragraphs, with a script that holds the end of one.
_HTML = "'<html><head><title>' || doc_id || '</title></head><body><script>var a = \"</p>\";</script><p class=\"x\">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10), '</p><p>') || '</p></body></html>'"
_TEXT_OF = "replace(replace(text, chr(10), ' '), chr(13), chr(13))"


@register(f"SELECT doc_id, md5('Title: ' || doc_id || chr(10) || chr(10) || {_TEXT_OF}) AS text_md5 FROM documents WHERE source = 'landing_page' AND text IS NOT NULL")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title and paragraphs of a page, without scripts, entities decoded."""
    rows = scan(spark, sf_dir, "documents").where("source = 'landing_page' AND text IS NOT NULL")
    html = F.expr(_HTML.replace("chr(10)", "'\\n'").replace("|| doc_id ||", "|| cast(doc_id AS string) ||"))
    return rows.select("doc_id", F.md5(T.page_text(html).cast("binary")).alias("text_md5"))


@register()
def timed_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of reading a text, timed on every chosen source; the seconds are those of this run."""
    texts = matching.choose_source(scan(spark, sf_dir, "documents"), ("latex", "pdf_text"))
    return files.timed_extraction(texts, {"whole": str, "stripped": str.strip})


# --- search --------------------------------------------------------------------------------------------------------

_WHEN = "CASE WHEN ordinal % 3 = 0 THEN NULL ELSE month(published) END"


@register(f"""SELECT paper_id, 'submittedDate:[' || strftime(date_trunc(CASE WHEN ordinal % 3 = 0 THEN 'year' ELSE 'month' END, published), '%Y%m%d') || '0000 TO '
      || strftime(date_trunc(CASE WHEN ordinal % 3 = 0 THEN 'year' ELSE 'month' END, published) + CASE WHEN ordinal % 3 = 0 THEN INTERVAL 12 MONTH ELSE INTERVAL 1 MONTH END, '%Y%m%d') || '0000]' AS clause FROM papers WHERE published IS NOT NULL AND ordinal IS NOT NULL""")
def date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date clause for the month, or every third time the year, of each paper."""
    rows = scan(spark, sf_dir, "papers").where("published IS NOT NULL AND ordinal IS NOT NULL")
    month = F.when(F.col("ordinal") % 3 == 0, F.lit(None).cast("int")).otherwise(F.month("published"))
    return rows.select("paper_id", T.date_query(F.year("published"), month).alias("clause"))


@register("""SELECT paper_id, '(' || array_to_string(['ti:' || w for w in string_split(title, ' ')], ' AND ') || ') AND ((cat:cs.' || upper(schema_name) || '))' AS query FROM papers WHERE title IS NOT NULL""")
def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query text that asks for the words of each title in one category, at any time."""
    rows = scan(spark, sf_dir, "papers").where("title IS NOT NULL")
    kinds = F.array(F.concat(F.lit("cs."), F.upper("schema_name")))
    return rows.select("paper_id", T.search_query(F.split("title", " ", -1), kinds, F.lit("")).alias("query"))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "papers").select("paper_id", "title", "published", F.col("schema_name").alias("category"))


@register("SELECT paper_id, title FROM papers WHERE contains(lower(title), 'dataset') AND schema_name IN ('ar', 'en') AND published BETWEEN TIMESTAMP '2020-01-01' AND TIMESTAMP '2021-01-01' ORDER BY length(title), paper_id LIMIT 10")
def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search on the table of papers."""
    return search.search(_catalogue(spark, sf_dir), ["dataset"], ["ar", "en"], year=2020).select("paper_id", "title")


@register("SELECT paper_id, title FROM papers WHERE contains(lower(title), 'resource') AND schema_name IN ('ar', 'en', 'fr') ORDER BY published DESC NULLS LAST, paper_id LIMIT 10")
def default_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten latest."""
    return search.search(_catalogue(spark, sf_dir), ["resource"], ["ar", "en", "fr"], sort_by="submitted").select("paper_id", "title")


@register("SELECT paper_id, title FROM papers WHERE contains(lower(title), 'noisy') AND contains(lower(title), 'dataset') ORDER BY length(title), paper_id LIMIT 5")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five papers with all the terms in the title."""
    return search.search(_catalogue(spark, sf_dir), ["noisy", "dataset"], limit=5).select("paper_id", "title")


@register(f"WITH {sql.ONE_GOLD} SELECT record_id, p.paper_id, p.title FROM golds JOIN papers p ON p.paper_id = trim(string_split(string_split(metadata.\"Paper Link\", '/')[-1], 'v')[1])")
def paper_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paper that a link names."""
    rows = _gold(spark, sf_dir, T.identifier_id(F.col("metadata.`Paper Link`")).alias("paper_id"))
    return rows.join(scan(spark, sf_dir, "papers").select("paper_id", "title"), "paper_id").select("record_id", "paper_id", "title")


@register("SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def relevance_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers for which a model answered yes, in any case and wording; a missing answer is no."""
    k = F.col("doc_id") % 3
    answer = F.when(k == 0, "Yes, it does.").when(k == 1, "No.")
    return search.relevant(scan(spark, sf_dir, "documents").select("doc_id", answer.alias("answer")), F.col("answer")).select("doc_id")


# --- splits --------------------------------------------------------------------------------------------------------


@register("SELECT schema_name, paper_id, ordinal FROM papers WHERE split = 'valid' AND schema_name IN ('ar', 'en', 'jp', 'fr', 'ru', 'multi')")
def split_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of a split over all schemata."""
    return matching.split_ids(scan(spark, sf_dir, "papers"), "valid")


@register(f"WITH {sql.RUNS} SELECT result_id FROM runs WHERE paper_id IN (SELECT paper_id FROM papers WHERE split = 'valid')")
def split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of a split's papers."""
    return matching.in_split(scan(spark, sf_dir, "results").select("result_id", "paper_id").distinct(), matching.split_ids(scan(spark, sf_dir, "papers"), "valid")).select("result_id")


@register(f"WITH {sql.RUNS} SELECT result_id FROM runs WHERE model NOT IN {sql.BASELINES} AND NOT contains(lower(model), 'human')")
def baseline_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of models that read the paper."""
    from tessera.operators.reports import no_baselines

    return no_baselines(scan(spark, sf_dir, "results").select("result_id", "model").distinct()).select("result_id")


@register(f"WITH {sql.RUNS} SELECT r.result_id, p.schema_name FROM runs r JOIN papers p USING (paper_id) WHERE p.split = 'test' AND p.schema_name IN ('ar', 'en', 'jp', 'fr', 'ru', 'multi')")
def schema_of_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of each result by its paper."""
    rows = scan(spark, sf_dir, "results").select("result_id", "paper_id", "schema_name").dropDuplicates(["result_id"])
    return matching.schema_of(rows, scan(spark, sf_dir, "papers")).select("result_id", "schema_name")


@register("SELECT DISTINCT path, string_split(path, '/')[2] AS second, string_split(path, '/')[-1] AS last FROM raw_results")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of paths."""
    return scan(spark, sf_dir, "raw_results").select("path", T.path_part(F.col("path"), 1).alias("second"), T.last_part(F.col("path")).alias("last")).distinct()


# --- strings -------------------------------------------------------------------------------------------------------

#: Links with versions, suffixes and other forms made of a record's id, in SQL that both engines read.
_LINK = "CASE CAST(record_id % 7 AS INT) WHEN 0 THEN link WHEN 1 THEN concat(link, 'v1') WHEN 2 THEN concat(link, 'v12') WHEN 3 THEN concat(link, 'v5') WHEN 4 THEN concat(link, 'v2.pdf') WHEN 5 THEN concat('arxiv:', paper_id, 'v3') ELSE concat(replace(link, '/pdf/', '/abs/'), '?a=1') END"
_LINKS = f"links AS (SELECT record_id, paper_id, metadata.\"Name\" AS name, metadata.Link AS url, metadata.\"HF Link\" AS hub, {_LINK.replace('link', 'metadata.\"Paper Link\"')} AS link FROM golds)"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gold(spark, sf_dir, "paper_id", F.col("metadata.Name").alias("name"), F.col("metadata.Link").alias("url"), F.col("metadata.`HF Link`").alias("hub"), F.col("metadata.`Paper Link`").alias("link"))
    return rows.withColumn("link", F.expr(_LINK))


_BARE = "replace(replace(replace(replace(link, 'v1', ''), 'v2', ''), 'v3', ''), 'v4', '')"
_FIXED = f"'https://arxiv.org/abs/' || string_split(CASE WHEN ends_with({_BARE}, '.pdf') THEN replace({_BARE}, '.pdf', '') ELSE {_BARE} END, '/')[-1]"


@register(f"WITH {sql.ONE_GOLD}, {_LINKS} SELECT record_id, {_FIXED} AS fixed, string_split({_FIXED}, '/')[-1] AS id FROM links")
def arxiv_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """links to the abstract page, and their ids."""
    return _links(spark, sf_dir).select("record_id", T.arxiv_link(F.col("link")).alias("fixed"), T.arxiv_id(F.col("link")).alias("id"))


@register(f"""WITH {sql.ONE_GOLD}, {_LINKS}, t AS (SELECT record_id, link, CASE WHEN starts_with(link, 'http') THEN string_split(string_split(link, '?')[1], '/')[-1] ELSE link END AS tail FROM links)
    SELECT record_id, trim(string_split(CASE WHEN starts_with(tail, 'arxiv:') THEN tail[7:] ELSE tail END, 'v')[1]) AS id, replace(replace(replace(link, 'v1', ''), 'v2', ''), 'v3', '') AS versionless FROM t""")
def paper_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the id in a link or name, and without a version."""
    return _links(spark, sf_dir).select("record_id", T.identifier_id(F.col("link")).alias("id"), T.versionless_id(F.col("link")).alias("versionless"))


@register(f"""WITH {sql.ONE_GOLD}, {_LINKS} SELECT record_id, replace(trim(url), 'huggingface', 'hf') AS url, CASE WHEN record_id % 5 = 0 THEN 'given' ELSE coalesce(url, '') END AS repository,
      CASE WHEN contains(hub, 'hf') OR contains(hub, 'huggingface') THEN 'hub' WHEN contains(hub, 'github') THEN 'git' ELSE 'page' END AS kind FROM links""")
def repository_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned links, the repository of a record and where its description is read from."""
    rows = _links(spark, sf_dir)
    wrapped = F.concat(F.lit(" \\url{"), F.col("url"), F.lit("} "))
    given = F.when(F.col("record_id") % 5 == 0, "given").otherwise("")
    return rows.select("record_id", T.clean_url(wrapped).alias("url"), T.repository_link(given, F.col("url"), F.col("hub")).alias("repository"), T.repository_kind(F.col("hub")).alias("kind"))


@register("SELECT doc_id, sha1(text)[1:5] AS hash, strftime(extracted_at, '%Y') || month(extracted_at) || '.' || sha1(text)[1:5] AS id FROM documents WHERE text IS NOT NULL")
def synthetic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of a text and the id made of it."""
    rows = scan(spark, sf_dir, "documents").where("text IS NOT NULL")
    content = F.col("text").cast("binary")
    return rows.select("doc_id", T.content_hash(content).alias("hash"), T.synthetic_id(content, F.year("extracted_at"), F.month("extracted_at")).alias("id"))


@register("SELECT paper_id, replace(replace(title, chr(13) || chr(10), ' '), ':', '') AS title FROM papers")
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """titles without colons and line ends."""
    return scan(spark, sf_dir, "papers").select("paper_id", T.clean_title(F.col("title")).alias("title"))


@register("SELECT doc_id, len(string_split(text, ' ')) AS n_words, length(CASE WHEN len(string_split(text, ' ')) * 1.6 > 500 THEN text[1:2000] ELSE text END) AS n_chars, md5(CASE WHEN len(string_split(text, ' ')) * 1.6 > 500 THEN text[1:2000] ELSE text END) AS text_md5 FROM documents WHERE text IS NOT NULL")
def token_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts of more than an estimated 500 tokens trimmed to 2,000 characters."""
    rows = scan(spark, sf_dir, "documents").where("text IS NOT NULL")
    trimmed = T.trim_tokens(F.col("text"), 500, 2000)
    return rows.select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("n_words"), F.length(trimmed).cast("bigint").alias("n_chars"), F.md5(trimmed.cast("binary")).alias("text_md5"))


@register("SELECT doc_id, md5(text[1:length(text) // 2]) AS half, md5(text[1:length(text) // 4]) AS quarter FROM documents WHERE length(text) > 3")
def context_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first half and the first quarter of each text."""
    rows = scan(spark, sf_dir, "documents").where("length(text) > 3")
    return rows.select("doc_id", *(F.md5(T.cut_context(F.col("text"), part).cast("binary")).alias(part) for part in ("half", "quarter")))


@register("SELECT DISTINCT model, CASE WHEN starts_with(model, 'auralis_lumen-3-large') THEN 'Lumen 3' WHEN contains(model, 'everline_sparrow') THEN 'Sparrow' ELSE replace(model, '-browsing', '') END || CASE WHEN contains(model, '-browsing') THEN ' Browsing' ELSE '' END AS display, replace(replace(model, '-browsing', ''), '_', '/') AS listed FROM results WHERE model IS NOT NULL")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """display names, and names decoded from paths."""
    shown = T.display_model(F.col("model"), {"auralis_lumen-3-large": "Lumen 3", "everline_sparrow": "Sparrow"}, ("everline_sparrow",))
    return scan(spark, sf_dir, "results").where("model IS NOT NULL").select("model", shown.alias("display"), T.path_to_model(F.col("model")).alias("listed")).distinct()


@register("SELECT DISTINCT replace(replace(model, '-browsing', ''), '_', '/') AS model, replace(model, '-browsing', '') || CASE WHEN is_browsing THEN '-browsing' ELSE '' END AS path FROM results WHERE model IS NOT NULL AND is_browsing IS NOT NULL")
def model_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names encoded for paths."""
    listed = T.path_to_model(F.col("model"))
    return scan(spark, sf_dir, "results").where("model IS NOT NULL AND is_browsing IS NOT NULL").select(listed.alias("model"), T.model_to_path(listed, F.col("is_browsing")).alias("path")).distinct()


_BIB = "'@article{' || replace(name, ' ', '_') || ',' || chr(10) || '  title = {' || title || '},' || chr(10) || '  author = {' || authors || '},' || chr(10) || '  year = {' || year || '},' || chr(10) || '  archivePrefix = {arXiv},' || chr(10) || '  journal={arXiv preprint arXiv: ' || id || '},' || chr(10) || '  primaryClass = {cs.AI},' || chr(10) || '  eprint = {' || id || '},' || chr(10) || '  url = {' || link || '}' || chr(10) || '}'"


@register(f"""WITH {sql.ONE_GOLD}, b AS (SELECT record_id, metadata."Name" AS name, metadata."Paper Title" AS title, array_to_string(metadata.Authors, ' and ') AS authors, metadata."Year"::VARCHAR AS year, metadata."Paper Link" AS link,
      string_split(string_split(metadata."Paper Link", '/pdf/')[-1], 'v')[1] AS id FROM golds)
    SELECT record_id, {_BIB} AS bibtex, replace(replace(name, ' ', '_'), '_', ' ') || ' \\cite{{' || replace(name, ' ', '_') || '}}' AS cite FROM b WHERE name IS NOT NULL AND title IS NOT NULL AND authors IS NOT NULL AND year IS NOT NULL AND link IS NOT NULL""")
def bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bibliography of the gold records."""
    m = lambda n: schemas.field("metadata", n)
    rows = _gold(spark, sf_dir, "metadata").where(m("Name").isNotNull() & m("Paper Title").isNotNull() & m("Authors").isNotNull() & m("Year").isNotNull() & m("Paper Link").isNotNull())
    return rows.select("record_id", T.bibtex(m("Name"), m("Paper Title"), m("Authors"), m("Year"), T.bibtex_id(m("Paper Link")), m("Paper Link")).alias("bibtex"), T.citation(m("Name")).alias("cite"))


@register(f"""WITH {_CHOSEN}, s AS (SELECT schema_name, string_agg(attribute, ', ' ORDER BY ordinal) AS schema_text FROM attr_schema GROUP BY 1)
    SELECT p.paper_id, md5('Input Schema: ' || schema_text || chr(10) || 'Paper Text: ' || coalesce(text, '') || chr(10) || 'Output JSON:') AS prompt_md5 FROM papers p JOIN s USING (schema_name) JOIN best USING (paper_id)""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each paper with a text."""
    texts = matching.choose_source(scan(spark, sf_dir, "documents"), ("latex", "pdf_text")).where("text <> ''")
    names = schemas.profile(scan(spark, sf_dir, "attr_schema")).select("schema_name", F.array_join("columns", ", ").alias("schema_text"))
    rows = scan(spark, sf_dir, "papers").select("paper_id", "schema_name").join(names, "schema_name").join(texts.select("paper_id", "text"), "paper_id")
    return rows.select("paper_id", F.md5(T.prompt(F.col("schema_text"), F.col("text")).cast("binary")).alias("prompt_md5"))


@register("SELECT doc_id, md5(regexp_replace(replace(text, '\\%', chr(1)), '%[^\\n]*', '', 'g')) AS text_md5 FROM documents WHERE source = 'latex' AND text IS NOT NULL")
def latex_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LaTeX without comments."""
    rows = scan(spark, sf_dir, "documents").where("source = 'latex' AND text IS NOT NULL")
    return rows.select("doc_id", F.md5(F.replace(T.strip_comments(F.col("text")), F.lit("\\%"), F.lit("\x01")).cast("binary")).alias("text_md5"))


# --- normalisation -------------------------------------------------------------------------------------------------

_RAW = {
    "Name": "Name", "Year": "concat(' ', CAST(Year AS {text}), ' ')", "Volume": "CASE WHEN record_id % 4 = 0 THEN 'many' ELSE CAST(CAST(Volume AS BIGINT) AS {text}) END", "Tokenized": "CASE WHEN record_id % 3 = 0 THEN 'TRUE' ELSE lower(CAST(Tokenized AS {text})) END",
    "Form": "CASE WHEN record_id % 6 = 0 THEN '' ELSE Form END", "License": "License", "Access": "CASE WHEN record_id % 5 = 0 THEN concat(Access, 'x') ELSE Access END", "Unit": "Unit",
}
_KINDS = {"Name": "text", "Year": "number", "Volume": "number", "Tokenized": "flag", "Form": "text", "License": "text", "Access": "text", "Unit": "text"}
#: What each attribute is without a value.
_DEFAULTS = {"str": "''", "url": "''", "int": "'0'", "float": "'0.0'", "date[year]": f"'{YEAR}'", "bool": "'false'"}


def _raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold records as free-form maps of texts: numbers with blanks or as words, flags in capitals, some options misspelt or empty."""
    rows = _gold(spark, sf_dir, "schema_name", "metadata").where("metadata IS NOT NULL").select("record_id", "schema_name", "metadata.*")
    value = lambda e: F.expr(e.replace("{text}", "STRING"))
    pairs = [x for n, e in _RAW.items() for x in (F.lit(n), value(e))]
    pairs += [x for n in ("Tasks", "Collection Style", "Domain") for x in (F.lit(n), F.to_json(F.col(f"`{n}`")))]
    return rows.select("record_id", "schema_name", F.create_map(*pairs).alias("raw"))


_LONG_SQL = (
    f"{sql.ONE_GOLD}, rec AS (SELECT record_id, schema_name, unnest(metadata) FROM golds WHERE metadata IS NOT NULL), long AS (SELECT record_id, schema_name, attribute, raw FROM ("
    + " UNION ALL ".join(f"SELECT record_id, schema_name, '{n}' AS attribute, {e.replace('{text}', 'VARCHAR')} AS raw FROM rec" for n, e in _RAW.items())
    + ")), typed AS (SELECT l.record_id, a.attribute, a.answer_type, a.options, coalesce(l.raw, CASE a.answer_type "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _DEFAULTS.items())
    + " END) AS raw FROM long l JOIN attr_schema a USING (schema_name, attribute))"
)


def _scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = normalise.to_long(_raw_records(spark, sf_dir), scan(spark, sf_dir, "attr_schema"), ["record_id"])
    return long.where(F.col("attribute").isin(*_RAW))


@register(f"WITH {_LONG_SQL} SELECT record_id, attribute, raw FROM typed")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values replaced by the default of their type."""
    return normalise.fill_missing(_scalars(spark, sf_dir), YEAR).select("record_id", "attribute", "raw")


_CAST_SQL = f"""cast_values AS (SELECT record_id, attribute, options, CASE WHEN answer_type IN ('str', 'url') THEN raw END AS text,
      CASE WHEN answer_type = 'date[year]' THEN coalesce(try_cast(trim(raw) AS BIGINT)::DOUBLE, {YEAR}) WHEN answer_type = 'float' THEN coalesce(try_cast(trim(raw) AS DOUBLE), 0) END AS number,
      CASE WHEN answer_type = 'bool' THEN CASE lower(raw) WHEN 'true' THEN true WHEN 'false' THEN false END END AS flag FROM typed)"""


@register(f"WITH {_LONG_SQL}, {_CAST_SQL} SELECT record_id, attribute, text, number, flag FROM cast_values")
def cast_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the declared types; what can't be cast gets the default."""
    cast = normalise.cast_values(normalise.fill_missing(_scalars(spark, sf_dir), YEAR), YEAR)
    return cast.select("record_id", "attribute", "text", "number", "flag")


@register(f"""WITH {_LONG_SQL}, {_CAST_SQL} SELECT record_id, attribute, CASE WHEN options IS NULL THEN text WHEN text = '' THEN options[-1] WHEN list_contains(options, text) THEN text END AS text, number, flag FROM cast_values""")
def fix_options_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N3 and N5 as far as SQL goes: exact options, and the last one for empty values."""
    cast = normalise.cast_values(normalise.fill_missing(_scalars(spark, sf_dir), YEAR), YEAR)
    return normalise.fix_options(cast, ["record_id"], best=False).select("record_id", "attribute", "text", "number", "flag")


@register()
def best_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record normalised, with the most similar option where none is exact."""
    done = normalise.postprocess(_raw_records(spark, sf_dir), scan(spark, sf_dir, "attr_schema"), ["record_id"], YEAR)
    return done.select("record_id", "attribute", "text", "number", "flag", F.array_join("items", " | ").alias("items"))


_EMPTY = f"""SELECT s.schema_name, attribute, CASE WHEN answer_type LIKE '%List%' AND options IS NOT NULL THEN options[{{at}}] WHEN answer_type LIKE '%List%' THEN '' WHEN options IS NOT NULL AND answer_type IN ('str', 'url') THEN options[{{at}}]
      WHEN answer_type IN ('str', 'url') THEN '' WHEN answer_type = 'float' THEN '0.0' WHEN answer_type = 'int' THEN '0.0' WHEN answer_type = 'date[year]' THEN '{YEAR}.0' WHEN answer_type = 'bool' THEN 'false' END AS value FROM (SELECT DISTINCT schema_name FROM attr_schema) s JOIN attr_schema a USING (schema_name)"""


def _empty(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    attr = scan(spark, sf_dir, "attr_schema")
    none = attr.select("schema_name").distinct().withColumn("raw", F.create_map().cast("map<string,string>")).withColumn("id", F.lit(0))
    long = normalise.postprocess(none, attr, ["id"], YEAR, method)
    return long.select("schema_name", "attribute", F.coalesce("text", F.col("number").cast("string"), F.col("flag").cast("string"), F.array_join("items", " | ")).alias("value"))


@register(_EMPTY.format(at=-1))
def postprocess_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of nothing, by schema: defaults, and the last option of closed attributes."""
    return _empty(spark, sf_dir, "last")


@register(_EMPTY.format(at=1))
def baseline_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N5 and the first-option baseline."""
    return _empty(spark, sf_dir, "first")


@register("""WITH b AS (SELECT DISTINCT file_id, body FROM raw_results), c AS (SELECT file_id, replace(replace(replace(body, '```json', ''), '```', ''), '\\', '') AS t FROM b),
    o AS (SELECT file_id, CASE WHEN starts_with(t, '"') AND ends_with(t, '"') THEN t[2:greatest(length(t) - 1, 1)] ELSE t END AS t FROM c),
    q AS (SELECT file_id, array_to_string([CASE WHEN i % 2 = 1 THEN replace(string_split(t, '"')[i], '''', '"') ELSE string_split(t, '"')[i] END for i in generate_series(1, len(string_split(t, '"')))], '"') AS t FROM o)
    SELECT file_id, md5(t) AS text_md5 FROM q""")
def quote_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences, backslashes and outer quotes gone, single quotes doubled."""
    rows = scan(spark, sf_dir, "raw_results").select("file_id", "body").distinct()
    return rows.select("file_id", F.md5(repair.repair_json(repair.strip_fences(F.col("body"))).cast("binary")).alias("text_md5"))


@register("""WITH m AS (SELECT result_id, any_value(config.model_name) AS name, any_value(config.few_shot) AS shot FROM results WHERE config.model_name IS NOT NULL AND config.few_shot IS NOT NULL GROUP BY result_id) SELECT result_id, name AS model, shot AS few_shot FROM m""")
def read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced, single-quoted answers read back as JSON."""
    rows = scan(spark, sf_dir, "results").where("config.model_name IS NOT NULL AND config.few_shot IS NOT NULL").select("result_id", "config.model_name", "config.few_shot").dropDuplicates(["result_id"])
    answer = F.format_string("```json\n{'model': '%s', \"few_shot\": %d}\n```", "model_name", "few_shot")
    return rows.select("result_id", F.from_json(repair.read_json(answer), "model string, few_shot int").alias("r")).select("result_id", "r.model", "r.few_shot")


@register(f"WITH {sql.RUNS} SELECT result_id, coalesce(nullif(CASE WHEN result_id % 2 = 0 THEN '' ELSE metadata.\"Paper Link\" END, ''), 'https://arxiv.org/abs/' || paper_id) AS link, replace(model, '_', '/') AS added_by FROM runs WHERE metadata IS NOT NULL")
def link_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty paper links filled with the article's address, and who added the record."""
    rows = scan(spark, sf_dir, "results").where("metadata IS NOT NULL")
    emptied = rows.select("result_id", "paper_id", "model", F.col("metadata").withField("`Paper Link`", F.when(F.col("result_id") % 2 == 0, "").otherwise(schemas.field("metadata", "Paper Link"))).alias("metadata"))
    filled = normalise.backfill(emptied, "metadata", F.concat(F.lit("https://arxiv.org/abs/"), F.col("paper_id")))
    return filled.select("result_id", schemas.field("metadata", "Paper Link").alias("link"), F.replace("model", F.lit("_"), F.lit("/")).alias("added_by")).dropDuplicates(["result_id"])


# --- exports -------------------------------------------------------------------------------------------------------


def _lit(x: str) -> str:
    e = f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    return f"CASE WHEN {x} IS NULL THEN 'None' WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {e} || '\"' ELSE '''' || replace({e}, '''', '\\''') || '''' END"


def _num(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) AND abs({x}) < 1e16 THEN {x}::BIGINT::VARCHAR || '.0' ELSE {x}::VARCHAR END"


def _flat(n: str) -> str:
    v = f'g.metadata."{n}"'
    if n in sql.TEXT_LISTS:
        return f"'[' || array_to_string([{_lit('v')} for v in {v}], ', ') || ']'"
    if n == "Language":
        return f"coalesce({v}, '[' || array_to_string([{_lit('v')} for v in g.metadata.Languages], ', ') || ']')"
    if n == "Subsets":
        record = " || ', ' || ".join([f"'''{k}'': ' || {_lit(f's.\"{k}\"')}" if k != "Volume" else f"'''Volume'': ' || coalesce({_num('s.Volume')}, 'None')" for k in ("Name", "Volume", "Unit", "Dialect", "Language")])
        return f"'[' || array_to_string(['{{' || {record} || '}}' for s in {v}], ', ') || ']'"
    if n == "Volume":
        return _num(v)
    if n in ("Tokenized", "Test Split"):
        return f"CASE {v} WHEN true THEN 'True' WHEN false THEN 'False' END"
    return f"{v}::VARCHAR"


@register(f"WITH {sql.ONE_GOLD} SELECT g.schema_name AS category, p.split, " + ", ".join(f'{_flat(n)} AS "{n}"' for n in sinks.EXPORTED) + ", " + ", ".join(f"g.annotations_from_paper['{n}'] AS \"{n}_exist\"" for n in sinks.EXPORTED) + " FROM golds g LEFT JOIN papers p USING (paper_id)")
def export_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold records as 66 flat columns, lists as Python prints them."""
    return sinks.export_flat(scan(spark, sf_dir, "gold"), scan(spark, sf_dir, "papers"))


@register(f"WITH {sql.ONE_GOLD} SELECT record_id, metadata.Volume AS volume, 0::BIGINT AS n_other FROM golds WHERE metadata IS NOT NULL")
def volume_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: sizes with thousands separators read as numbers, and the new empty list."""
    rows = _gold(spark, sf_dir, "metadata").where("metadata IS NOT NULL").select("record_id", F.col("metadata.Volume").alias("_v"))
    written = rows.select("record_id", F.concat(F.format_number(F.floor("_v"), 0), F.substr(F.format_string("%.6f", F.col("_v") - F.floor("_v")), F.lit(2))).alias("Volume"))
    return sinks.rewrite_gold(written).select("record_id", F.col("Volume").alias("volume"), F.size("Other Tasks").cast("bigint").alias("n_other"))


@register("SELECT range::BIGINT AS id, true AS has_text, true AS is_json FROM range(200)")
def generated_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up worked examples, the same in each run."""
    made = sinks.generate_examples(spark, 200, scan(spark, sf_dir, "attr_schema"))
    return made.select("id", F.col("text").startswith("\\begin{abstract}").alias("has_text"), F.try_parse_json("record").isNotNull().alias("is_json"))


QUERIES, ORACLES = register.queries, register.oracles
