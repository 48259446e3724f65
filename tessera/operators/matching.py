"""Joins of results with gold records, the registry, prices and sibling runs.

Theta joins of the record world (an id inside a link, a name inside another) are
equality joins on a normalised key; the containing form is kept only against
tables whose size doesn't grow with the data, and says so.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as T
from tessera.functions.similarity import first_alike
from tessera.session import cut_lineage


def split_ids(papers: DataFrame, split: str, schemata: tuple[str, ...] = schemas.SCHEMATA) -> DataFrame:
    """``(schema_name, paper_id, ordinal)`` of the papers of a split in the given schemata; null splits belong to none."""
    return papers.where((F.col("split") == split) & F.col("schema_name").isin(*schemata)).select("schema_name", "paper_id", "ordinal")


def in_split(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose paper is registered: a semi-join, so nothing is duplicated."""
    return df.join(ids.select("paper_id").distinct(), "paper_id", "left_semi")


def schema_of(df: DataFrame, papers: DataFrame, split: str = "test") -> DataFrame:
    """``df`` with the schema of its paper in ``split``; papers registered in none are dropped (the strict form raises, see :func:`unregistered`)."""
    return df.drop("schema_name").join(split_ids(papers, split).select("paper_id", "schema_name"), "paper_id")


def unregistered(df: DataFrame, papers: DataFrame, split: str = "test") -> DataFrame:
    """The papers of ``df`` that :func:`schema_of` would drop."""
    return df.select("paper_id").distinct().join(split_ids(papers, split).select("paper_id"), "paper_id", "left_anti")


def by_language(results: DataFrame, ids: DataFrame) -> DataFrame:
    """Every result under the language its paper is registered for."""
    return results.drop("schema_name").join(ids.select("paper_id", F.col("schema_name").alias("lang")), "paper_id")


def by_link(results: DataFrame, gold: DataFrame, link: Column) -> DataFrame:
    """Results with the gold record whose link holds their paper id, by equality of the normalised ids.

    The first record (least ``record_id``) of each id is taken. ``gold`` gets the columns ``gold_record_id`` and ``gold_link``.
    """
    side = gold.select(T.arxiv_id(link).alias("paper_id"), F.struct("record_id", link.alias("link")).alias("r")).where("paper_id IS NOT NULL")
    first = side.groupBy("paper_id").agg(F.min("r").alias("r")).select("paper_id", F.col("r.record_id").alias("gold_record_id"), F.col("r.link").alias("gold_link"))
    return results.join(first, "paper_id", "left")


def link_contains(ids: DataFrame, links: DataFrame, paper_id: str = "paper_id", link: str = "link") -> DataFrame:
    """The containing form of :func:`by_link`: which ids stand anywhere in which links.

    Digits-dot-digits runs of a link are its only candidates, so it stays an equality join (with ``contains`` as the check).
    """
    made = links.withColumn("_run", F.explode(F.array_distinct(F.regexp_extract_all(F.col(link), F.lit(r"(\d+\.\d+)"), 1))))
    cut = ids.withColumn("_run", F.regexp_extract(F.col(paper_id), r"(\d+\.\d+)", 1))
    return cut.join(made, "_run").where(F.contains(F.col(link), F.col(paper_id))).drop("_run")


#: Texts and options that meet in one task at most, and the first tier of options and how much larger each tier is than the last.
TEXTS, OPTIONS, TIER, GROWTH = 2000, 2048, 1024, 8


def similar_candidates(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float = 0.8) -> DataFrame:
    """All pairs of texts whose similarity may exceed ``threshold``, which takes fewer than ``(1 - t) (|a| + |b|)`` edits. It compares each text with each."""
    size = F.length(a) + F.length(b)
    close = (2 * F.least(F.length(a), F.length(b)) > threshold * size) & (F.levenshtein(a, b) < (1 - threshold) * size)
    return left.crossJoin(right).where(close)


def _bands(length: Column, step: float, around: bool) -> Column:
    """The band of a text by its length, and those of the lengths that may be similar to it; ``step`` is the most that these may differ by."""
    place = F.log(step, F.greatest(length, F.lit(1)))
    if not around:
        return F.when(length == 0, -1).otherwise(F.floor(place).cast("int"))
    return F.when(length == 0, F.array(F.lit(-1))).otherwise(F.sequence(F.greatest(F.floor(place - 1 - 1e-9), F.lit(0)).cast("int"), F.floor(place + 1 + 1e-9).cast("int")))


def first_similar(texts: DataFrame, options: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(text, place)``: for each ``(text)`` the least ``place`` of the options ``(place, option)`` with a similarity over ``threshold``; texts without one are left out.

    Options come in tiers, the first places before the others, and a text that has an option in one tier meets none of the
    next, so the work follows how far down its option is. Texts without any meet all options of a length that allows it.
    """
    spark, step = texts.sparkSession, (2 - threshold) / threshold
    options = cut_lineage(options.where("option IS NOT NULL").groupBy("option").agg(F.min("place").alias("place")))
    waiting = cut_lineage(texts.where("text IS NOT NULL").select("text").distinct())
    n_options, n_waiting, found, tier, upto = options.count(), waiting.count(), [], TIER, TIER
    shares = []
    while upto < n_options:
        shares.append(upto / n_options)
        tier *= GROWTH
        upto += tier
    # where a tier ends may be any place, so the quantiles need not be exact
    ends = options.agg(F.percentile_approx("place", F.array(*map(F.lit, shares)), F.lit(1_000_000))).head()[0] if shares else []
    low = None

    def run(_: tuple, asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        offered = offered.sort_values("place")
        at = first_alike(asked["text"].tolist(), offered["option"].tolist(), threshold)
        return pd.DataFrame({"text": asked["text"].to_numpy()[at >= 0], "place": offered["place"].to_numpy()[at[at >= 0]]})

    for high in [*ends, None]:
        if not n_waiting:
            break
        part = options if low is None else options.where(F.col("place") > low)
        part = part if high is None else part.where(F.col("place") <= high)
        low, n_part = high, part.count()
        if not n_part:
            continue
        rows, columns = -(-n_waiting // TEXTS), -(-n_part // OPTIONS)
        one, every = lambda c, n, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        cells = ["row", "column", "band"]
        asked = waiting.select("text", one("text", rows, 1).alias("row"), _bands(F.length("text"), step, False).alias("band")).select("*", every(columns).alias("column"))
        offered = part.select("place", "option", one("option", columns, 2).alias("column"), F.explode(_bands(F.length("option"), step, True)).alias("band")).select("*", every(rows).alias("row"))
        # so many tasks as there are cells: the cells are small, but not the work in them
        tasks = max(3 * rows * columns, int(spark.conf.get("spark.sql.shuffle.partitions")))
        side = lambda df: df.repartition(tasks, *cells).groupBy(*cells)
        met = side(asked).cogroup(side(offered)).applyInPandas(run, f"text string, place {dict(options.dtypes)['place']}")
        hits = cut_lineage(met.groupBy("text").agg(F.min("place").alias("place")))
        found.append(hits)
        waiting = cut_lineage(waiting.join(hits, "text", "left_anti"))
        n_waiting = waiting.count()
    out = spark.createDataFrame([], f"text string, place {dict(options.dtypes)['place']}")
    for hits in found:
        out = out.unionByName(hits)
    return out


def match_record(queries: DataFrame, dataset: DataFrame, key: str = "query_id", threshold: float = 0.8, last: bool = True, fuzzy: bool = True) -> DataFrame:
    """For each query ``(key, title, link, record_title)`` the record of ``dataset`` ``(ordinal, title, link)`` it means: ``(key, ordinal, how)``.

    A query with a title is matched by equality of titles only, else one with a link by equality with the normalised
    link, else by similarity of ``record_title`` over ``threshold``. Of several, the last
    ordinal wins (``last``), or the first. Queries without a match are left out.
    """
    given = F.coalesce(F.col("title"), F.lit("")) != ""
    linked = ~given & (F.coalesce(F.col("link"), F.lit("")) != "")
    gold = dataset.select("ordinal", F.col("title").alias("g_title"), T.arxiv_link(F.col("link")).alias("g_link"))
    found = queries.where(given).join(gold, F.col("title") == F.col("g_title")).select(key, "ordinal", F.lit("title").alias("how"))
    found = found.unionByName(queries.where(linked).join(gold, F.col("link") == F.col("g_link")).select(key, "ordinal", F.lit("link").alias("how")))
    if fuzzy:
        asked = queries.where(~given & ~linked).select(key, "record_title")
        place = -F.col("ordinal") if last else F.col("ordinal")
        near = first_similar(asked.select(F.col("record_title").alias("text")), gold.select(place.alias("place"), F.col("g_title").alias("option")), threshold)
        near = near.select(F.col("text").alias("record_title"), (-F.col("place") if last else F.col("place")).alias("ordinal"))
        found = found.unionByName(asked.join(near, "record_title").select(key, "ordinal", F.lit("similar").alias("how")))
    pick = F.max_by if last else F.min_by
    return found.groupBy(key).agg(pick(F.struct("ordinal", "how"), F.col("ordinal")).alias("m")).select(key, "m.ordinal", "m.how")


def with_prices(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Runs with the list price of their model, browsing variants at that of the base model; null where none is listed."""
    side = prices.select(F.col("model").alias("_base"), F.col("input").alias("input_price"), F.col("output").alias("output_price"))
    return runs.withColumn("_base", T.base_model(F.col("model"))).join(side, "_base", "left").drop("_base")


def list_cost(input_tokens: Column, output_tokens: Column) -> Column:
    return (F.col("input_price") * input_tokens + F.col("output_price") * output_tokens) / F.lit(1e6)


def resolve_model(names: DataFrame, listed: DataFrame, name: str = "name") -> DataFrame:
    """For each short name the first listed model (least ``ordinal``) that contains it without regard to case; null if none.

    ``listed`` ``(ordinal, model)`` is the provider's list: models, not rows of data. Two names have fixed aliases.
    """
    distinct = names.select(name).distinct()
    hit = distinct.join(listed, F.contains(F.lower(F.col("model")), F.lower(F.col(name))), "left").groupBy(name).agg(F.min_by("model", "ordinal").alias("_hit"))
    alias = F.lit(None).cast("string")
    for short, full in T.PROVIDER_ALIASES.items():
        alias = F.when(F.col(name) == short, full).otherwise(alias)
    return hit.select(name, F.coalesce(alias, F.col("_hit")).alias("model"))


def siblings(scored: DataFrame, base: Column, levels: dict[str, Column], value: str = "AVERAGE", by: tuple[str, ...] = ("paper_id", "model")) -> DataFrame:
    """The score of every base run beside those of its siblings on the same paper and model.

    ``levels`` gives the condition of each sibling set. It is one pass with conditional aggregates instead of a join for
    each set: ``(by, base, level...)``, only where a base run exists, null where a sibling is missing. Repeated siblings average.
    """
    kept = scored.where(base | F.coalesce(_any(list(levels.values())), F.lit(False)))
    wide = kept.groupBy(*by).agg(F.avg(F.when(base, F.col(value))).alias("base"), *(F.avg(F.when(c, F.col(value))).alias(n) for n, c in levels.items()), F.count_if(base).alias("_n"))
    return wide.where("_n > 0").drop("_n")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def skip_existing(work: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("paper_id", "model", "shot"), repeat_on_error: bool = False, overwrite: bool = False, never: tuple[str, ...] = ("jury", "composer")) -> DataFrame:
    """The work still to do: without what has a stored result. Judges are always done again, failed runs with ``repeat_on_error``."""
    if overwrite:
        return work
    done = results.where(F.col("error").isNull()) if repeat_on_error else results
    done = done.select(*keys).where(~F.col("model").isin(*never)).distinct()
    return work.join(done, list(keys), "left_anti")


def browsing_base(work: DataFrame, results: DataFrame) -> DataFrame:
    """Every browsing run to do with the stored record of its base model on the same paper and shot; null if there is none."""
    base = results.where(~F.col("is_browsing") & F.col("error").isNull()).groupBy("paper_id", "shot", F.col("model").alias("_base")).agg(F.max("result_id").alias("base_result_id"))
    return work.withColumn("_base", T.base_model(F.col("model"))).join(base, ["paper_id", "shot", "_base"], "left").drop("_base")


def choose_source(documents: DataFrame, order: tuple[str, ...], by: str = "paper_id") -> DataFrame:
    """For each paper its first non-empty text in the order of preference of ``source``, then of ``doc_id``: ``(paper_id, source, doc_id, text)``.

    Texts meet only their running best in the partial aggregate, so a paper with a third of all texts sends one a task.
    A paper with none of these sources, or only empty ones, has an empty text.
    """
    rank = F.lit(None).cast("int")
    for i, source in enumerate(order):
        rank = F.when(F.col("source") == source, i).otherwise(rank)
    usable = rank.isNotNull() & (F.coalesce(F.col("text"), F.lit("")) != "")
    best = F.min_by(F.struct("source", "doc_id", "text"), F.when(usable, F.struct(rank, F.col("doc_id"))))
    return documents.where(F.col(by).isNotNull()).groupBy(by).agg(best.alias("b"), F.count_if(usable).alias("n")).select(by, *(F.when(F.col("n") > 0, F.col(f"b.{c}")).alias(c) for c in ("source", "doc_id")), F.coalesce(F.when(F.col("n") > 0, F.col("b.text")), F.lit("")).alias("text"))


def examples(documents: DataFrame, papers: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` worked examples of each schema, by ordinal: the LaTeX of a paper, else its PDF text, and its gold record.

    An example without a text has an empty one. ``row_number`` below ``k`` lets Spark keep only ``k`` rows of a task before the shuffle.
    """
    from tessera.operators.metrics import first_gold

    ranked = papers.where("ordinal IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("schema_name").orderBy("ordinal", "paper_id"))).where(F.col("n") <= k)
    texts = choose_source(documents.join(ranked.select("paper_id"), "paper_id", "left_semi"), ("latex", "pdf_text"))
    made = ranked.select("schema_name", "n", "paper_id").join(texts.select("paper_id", "text"), "paper_id", "left").join(first_gold(gold).select("paper_id", "gold"), "paper_id", "left")
    return made.select("schema_name", "n", "paper_id", F.coalesce("text", F.lit("")).alias("text"), "gold")
