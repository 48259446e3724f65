"""Writers: results, texts, flat exports, bibliographies and benchmark files.

Spark's committer publishes a file only when its task has succeeded, so a failed
run leaves no partial result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tessera import schemas
from tessera.functions import text as T
from tessera.operators.normalise import clean_volume

#: Attributes of the flat export, in order (fixed values).
EXPORTED = (
    "Name", "Subsets", "HF Link", "Link", "License", "Year", "Language", "Dialect", "Domain", "Form", "Collection Style", "Description", "Volume", "Unit", "Ethical Risks", "Provider",
    "Derived From", "Paper Title", "Paper Link", "Script", "Tokenized", "Host", "Access", "Cost", "Test Split", "Tasks", "Venue Title", "Venue Type", "Venue Name", "Authors", "Affiliations", "Abstract",
)


def write_results(results: DataFrame, folder: str, form: str = "parquet", mode: str = "append") -> None:
    """Result documents partitioned by result set, shots and model, so a report on some of them reads no others."""
    results.write.mode(mode).partitionBy("result_set", "shot", "model").format(form).save(folder)


def write_texts(texts: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """``(paper_id, text)`` as a table."""
    texts.select("paper_id", "text").write.mode(mode).parquet(folder)


def write_bench(stats: DataFrame, detail: DataFrame, folder: str) -> None:
    """The summary as JSON and CSV, the timings as CSV; the summary is a report and fits one file."""
    stats.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    stats.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/summary_table")
    detail.write.mode("overwrite").option("header", True).csv(f"{folder}/detailed_times")


def write_bibliography(entries: DataFrame, folder: str, entry: str = "bibtex") -> None:
    entries.select(entry).write.mode("append").text(folder)


def _python_record(x: Column, fields: list) -> Column:
    parts = [F.concat(F.lit(f"'{f.name}': "), F.coalesce(T.python_float(x[f.name]), F.lit("None")) if f.dataType.simpleString() == "double" else T.python_text(x[f.name])) for f in fields]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def flat_column(df: DataFrame, record: str, name: str) -> Column:
    """One attribute as the flat export writes it: lists as Python prints them, all else as text; null stays null."""
    kind = next(f.dataType for f in schemas.record_fields(df, record) if f.name == name)
    value = schemas.field(record, name)
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StructType):
            return T.python_list(value, lambda x: _python_record(x, list(kind.elementType.fields)))
        return T.python_list(value)
    if kind.simpleString() == "double":
        return T.python_float(value)
    if kind.simpleString() == "boolean":
        return F.initcap(value.cast("string"))
    return value.cast("string")


def export_flat(gold: DataFrame, papers: DataFrame) -> DataFrame:
    """66 columns: ``category``, ``split``, 32 attributes and for each whether the paper states it. Repeated records count once."""
    splits = papers.select("paper_id", "split")
    rows = gold.select("record_id", "paper_id", "schema_name", "metadata", "annotations_from_paper").join(splits, "paper_id", "left")
    listed = T.python_list(schemas.field("metadata", "Languages"))
    value = lambda n: F.coalesce(flat_column(rows, "metadata", n), listed) if n == "Language" else flat_column(rows, "metadata", n)
    flat = rows.select("record_id", F.col("schema_name").alias("category"), "split", *(value(n).alias(n) for n in EXPORTED), *(F.try_element_at("annotations_from_paper", F.lit(n)).alias(f"{n}_exist") for n in EXPORTED))
    return flat.dropDuplicates(["record_id"]).drop("record_id")


def delete_results(results: DataFrame, model: str, ids: DataFrame) -> DataFrame:
    """The results that remain when those of models containing ``model`` on the papers ``ids`` go; human ones stay."""
    doomed = ids.select("paper_id").distinct().withColumn("_gone", F.lit(True))
    marked = results.join(doomed, "paper_id", "left")
    gone = F.col("model").contains(model) & ~F.col("model").contains("human") & F.col("_gone").isNotNull()
    return marked.where(~F.coalesce(gone, F.lit(False))).drop("_gone")


def rewrite_gold(records: DataFrame, volume: str = "Volume") -> DataFrame:
    """``Volume`` as a number without thousands separators, and an empty list of other tasks."""
    return records.withColumn(volume, clean_volume(F.col(volume).cast("string"))).withColumn("Other Tasks", F.array().cast("array<string>"))


def generate_examples(spark, n: int, attr_schema: DataFrame, schema_name: str = "multi", seed: int = 0) -> DataFrame:
    """``n`` made-up worked examples ``(id, text, record)``: options chosen by a hash of the id, so the same in each run.

    Options that suit no text (images, hours, other) are left out.
    """
    usable = attr_schema.where((F.col("schema_name") == schema_name) & F.col("options").isNotNull()).select("attribute", F.filter("options", lambda o: ~o.isin("images", "hours", "other")).alias("options"))
    picked = spark.range(n).join(usable.where(F.size("options") > 0))
    made = picked.select("id", "attribute", F.element_at("options", (F.pmod(F.xxhash64("id", "attribute", F.lit(seed)), F.size("options").cast("bigint")) + 1).cast("int")).alias("v"))
    wide = made.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "v")))).alias("m"))
    volume = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(9001)) + 1000
    get = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("text"))
    text = F.format_string("\\begin{abstract}\nA %s dataset of %s items, released with %s access.\n\\end{abstract}", get("Form"), volume.cast("string"), get("Access"))
    return wide.select("id", text.alias("text"), F.to_json(F.struct(F.col("m.Form").alias("Form"), F.col("m.Access").alias("Access"), volume.cast("double").alias("Volume"))).alias("record"))
