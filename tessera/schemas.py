"""The attribute schema as data: a small table ``attr_schema`` says which attributes a record has, of which type, with which options.

``attr_schema(schema_name, ordinal, attribute, answer_type, answer_min, answer_max, options, validation_group)``
is a dimension: its rows are attributes of schemata, not records, so it doesn't grow with the data. Joins with it
carry no hint; Spark broadcasts it when its measured size is below the threshold and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Schemata in report order (fixed values).
SCHEMATA = ("ar", "en", "jp", "fr", "ru", "multi")
#: Groups of validated attributes; the spelling is that of the stored results (fixed values).
GROUPS = ("CONTENT", "ACCESSABILITY", "DIVERSITY", "EVALUATION")
#: Models that read no paper (fixed values).
BASELINES = ("human", "dummy", "jury", "composer", "baseline-first", "baseline-last", "baseline-random")
#: Script options of jp (fixed values).
JP_SCRIPTS = ("Hiragana", "Katakana", "Kanji", "mixed")
#: Language options of multi (fixed values).
MULTI_LANGUAGES = (
    "Arabic", "English", "French", "Spanish", "German", "Greek", "Bulgarian", "Russian", "Turkish", "Vietnamese", "Thai", "Chinese", "Simplified Chinese",
    "Hindi", "Swahili", "Urdu", "Bengali", "Finnish", "Japanese", "Korean", "Telugu", "Indonesian", "Italian", "Polish", "Portuguese",
)

SUBSET = "struct<Name: string, Volume: double, Unit: string, Dialect: string, Language: string>"
#: The superset record: fields in order with their Spark types (fixed values).
RECORD_FIELDS = {
    "Name": "string", "Subsets": f"array<{SUBSET}>", "Link": "string", "HF Link": "string", "License": "string", "Year": "int", "Language": "string", "Languages": "array<string>",
    "Dialect": "string", "Domain": "array<string>", "Form": "string", "Collection Style": "array<string>", "Description": "string", "Volume": "double", "Unit": "string",
    "Ethical Risks": "string", "Provider": "array<string>", "Derived From": "array<string>", "Paper Title": "string", "Paper Link": "string", "Script": "string", "Tokenized": "boolean",
    "Host": "string", "Access": "string", "Cost": "string", "Test Split": "boolean", "Tasks": "array<string>", "Venue Title": "string", "Venue Type": "string", "Venue Name": "string",
    "Authors": "array<string>", "Affiliations": "array<string>", "Abstract": "string",
}
RECORD_DDL = "struct<" + ", ".join(f"`{name}`: {kind}" for name, kind in RECORD_FIELDS.items()) + ">"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field(record: str, name: str) -> Column:
    return F.col(f"{record}.{quoted(name)}")


def _ordered(when: Column | None, value: Column, key: Column) -> Column:
    """The values of a group as an array in the order of ``key``; one row for each attribute, so it is bounded."""
    item = F.struct(key.alias("k"), value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(F.when(when, item) if when is not None else item)), lambda x: x["v"])


def profile(attr_schema: DataFrame) -> DataFrame:
    """One row for each schema: its columns, types, length ranges, options and validation groups.

    Validation columns are grouped by the first appearance of their group; list columns are those of type ``List[str]``;
    a missing upper bound is -1. A null ordinal sorts first; an empty table gives an empty table.
    """
    grouped = F.col("validation_group").isNotNull()
    first = attr_schema.where(grouped).groupBy("schema_name", "validation_group").agg(F.min("ordinal").alias("group_at"))
    rows = attr_schema.join(first, ["schema_name", "validation_group"], "left")
    at, name = F.col("ordinal"), F.col("attribute")
    pairs = lambda when, value: F.map_from_entries(_ordered(when, F.struct(name, value), at))
    return rows.groupBy("schema_name").agg(
        _ordered(None, name, at).alias("columns"),
        _ordered(grouped, name, F.struct("group_at", "ordinal")).alias("validation_columns"),
        _ordered(F.col("answer_type") == "List[str]", name, at).alias("list_columns"),
        pairs(F.lit(True), F.col("answer_type")).alias("answer_types"),
        pairs(F.lit(True), F.array(F.col("answer_min"), F.coalesce("answer_max", F.lit(-1)))).alias("lengths"),
        pairs(F.col("options").isNotNull(), F.col("options")).alias("options"),
        pairs(grouped, F.col("validation_group")).alias("groups"),
    )


def lookup(attr_schema: DataFrame, schema_name: str) -> DataFrame:
    """The attributes of one schema, in order."""
    return attr_schema.where(F.col("schema_name") == schema_name).orderBy("ordinal")


def derive(base: DataFrame, schema_name: str) -> DataFrame:
    """The schema of another language from that of ``ar``: which attributes it keeps and which options change.

    ``Dialect`` goes; ``Subsets`` stays for multi only, ``Script`` for jp only, with its own options; the first option
    of ``Language`` is the language itself, and in multi it is a list of 2 to 25 languages. Ordinals are renumbered.
    """
    keep = {"multi": ("Subsets",), "jp": ("Script",)}.get(schema_name, ())
    dropped = [a for a in ("Dialect", "Subsets", "Script") if a not in keep]
    rows = base.where((F.col("schema_name") == "ar") & ~F.col("attribute").isin(dropped)).withColumn("schema_name", F.lit(schema_name))
    language, script = F.col("attribute") == "Language", F.col("attribute") == "Script"
    texts = lambda values: F.array(*map(F.lit, values))
    if schema_name == "multi":
        changed = {
            "options": F.when(language, texts(MULTI_LANGUAGES)).otherwise(F.col("options")),
            "answer_type": F.when(language, "List[str]").otherwise(F.replace(F.col("answer_type"), F.lit("Dialect"), F.lit("Language"))),
            "answer_min": F.when(language, 2).otherwise(F.col("answer_min")),
            "answer_max": F.when(language, 25).otherwise(F.col("answer_max")),
        }
    else:
        own = F.concat(F.array(F.lit(schema_name)), F.slice("options", 2, F.greatest(F.size("options") - 1, F.lit(0))))
        changed = {"options": F.when(language & F.col("options").isNotNull(), own).when(script, texts(JP_SCRIPTS)).otherwise(F.col("options"))}
    place = rows.agg(F.array_sort(F.collect_list("ordinal")).alias("at"))
    return rows.withColumns(changed).crossJoin(place).withColumn("ordinal", (F.array_position("at", F.col("ordinal")) - 1).cast("int")).drop("at")


def record_schema() -> StructType:
    """The superset record as a Spark type."""
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(RECORD_DDL)


def result_schema() -> StructType:
    """A stored result document as a Spark type."""
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(
        f"metadata {RECORD_DDL}, validation struct<CONTENT: double, ACCESSABILITY: double, DIVERSITY: double, EVALUATION: double, AVERAGE: double>, length_forcing double, "
        "cost struct<cost: double, input_tokens: bigint, output_tokens: bigint>, config struct<model_name: string, few_shot: int, month: int, year: string, keywords: array<string>, link: string>, ratio_filling double, error string"
    )


def is_text_list(kind: object) -> bool:
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType)


def record_fields(df: DataFrame, record: str) -> list[StructField]:
    kind = df.schema[record].dataType
    if not isinstance(kind, StructType):
        raise TypeError(f"{record} is not a struct")
    return list(kind.fields)
