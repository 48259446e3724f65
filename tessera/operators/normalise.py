"""Free-form records into typed, closed-vocabulary ones: fill, cast, repair options.

The input is a map from attribute to the text of its JSON value (strings without
quotes). Everything runs on the long form, one row for each record and attribute of
its schema, with the value in the column of its kind: ``text``, ``number``,
``flag`` or ``items``.

Only values that are no option go to Python, once each: exact matches are
resolved natively first, the misses are made distinct, compared in Arrow batches and
joined back.

Defined results of the edge cases: a missing or null attribute gets the default of
its type; a value that can't be cast gets the default too; text that is no list
gives an empty list; a flag that is neither true nor false is null, and
:func:`bad_flags` lists it (the strict form raises); an attribute outside the
schema is not kept; null elements of a list become empty text; empty tables give an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions.similarity import closest_udf

METHODS = ("first", "last", "random")


def kind_of(answer_type: Column) -> Column:
    """``list``, ``str``, ``int``, ``float``, ``date``, ``url`` or ``bool``, tested in this order by what the name contains."""
    out = F.lit(None).cast("string")
    for part, kind in reversed((("List", "list"), ("str", "str"), ("int", "int"), ("float", "float"), ("date", "date"), ("url", "url"), ("bool", "bool"))):
        out = F.when(answer_type.contains(part), kind).otherwise(out)
    return out


def to_long(records: DataFrame, attr_schema: DataFrame, key: list[str], raw: str = "raw") -> DataFrame:
    """One row for each record and attribute of its schema: ``(key, schema_name, ordinal, attribute, kind, options, raw)``."""
    side = attr_schema.select("schema_name", "ordinal", "attribute", kind_of(F.col("answer_type")).alias("kind"), "answer_type", "options")
    return records.select(*key, "schema_name", F.col(raw).alias("_raw")).join(side, "schema_name").select(*key, "schema_name", "ordinal", "attribute", "kind", "answer_type", "options", F.try_element_at("_raw", F.col("attribute")).alias("raw"))


def fill_missing(long: DataFrame, year: int) -> DataFrame:
    """Missing values replaced by the default of their type; ``year`` stands for the current one."""
    kind = F.col("kind")
    default = F.when(kind == "list", "[]").when(kind.isin("str", "url"), "").when(kind == "int", "0").when(kind == "float", "0.0").when(kind == "date", str(year)).when(kind == "bool", "false")
    return long.withColumn("raw", F.coalesce("raw", default))


def cast_values(long: DataFrame, year: int) -> DataFrame:
    """The values in the columns ``text``, ``number``, ``flag`` and ``items``, each null where the kind is another.

    A text of digits with blanks around it is a whole number, one with a point is not; casts never raise.
    """
    kind, raw = F.col("kind"), F.col("raw")
    trimmed = F.regexp_replace(raw, r"^\s+|\s+$", "")
    written = F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("bigint").cast("double"))
    real = F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed.try_cast("double"))
    number = F.when(kind == "int", F.coalesce(written, F.lit(0.0))).when(kind == "date", F.coalesce(written, F.lit(float(year)))).when(kind == "float", F.coalesce(real, F.lit(0.0)))
    lowered = F.lower(raw)
    parsed = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    items = F.transform(F.coalesce(parsed, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")))
    return long.withColumns(
        {
            "text": F.when(kind.isin("str", "url"), raw),
            "number": number,
            "flag": F.when(kind == "bool", F.when(lowered == "true", True).when(lowered == "false", False)),
            "items": F.when(kind == "list", items),
        }
    )


def bad_flags(cast: DataFrame) -> DataFrame:
    """The values that a flag can't be read from."""
    return cast.where((F.col("kind") == "bool") & F.col("flag").isNull())


def pick_choice(options: Column, method: str = "last", seed: Column | None = None) -> Column:
    """The first or last option, or one chosen by a hash of ``seed``, so that it is the same in each run."""
    if method == "first":
        return options[0]
    if method == "random":
        return F.element_at(options, (F.pmod(F.xxhash64(seed if seed is not None else F.lit(0)), F.size(options).cast("bigint")) + 1).cast("int"))
    return F.element_at(options, -1)


def fix_options(cast: DataFrame, key: list[str], method: str = "last", best: bool = True) -> DataFrame:
    """Closed attributes coerced to their options: exact, or picked where empty, or the most similar (null if none is).

    Lists are coerced element by element (repeats stay) and an empty one gets a picked option; flags are left alone.
    With ``best=False`` values without an exact option become null, and nothing leaves the JVM.
    """
    closed = F.col("options").isNotNull() & F.col("kind").isin("list", "str", "url")
    seed = F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.col("attribute"))
    pick = pick_choice(F.col("options"), method, seed)
    given = F.when(F.col("kind") == "list", F.col("items")).otherwise(F.array("text"))
    empty = F.when(F.col("kind") == "list", F.size("items") == 0).otherwise(F.col("text") == "")
    typed = cast.withColumns({"_given": F.when(closed, F.when(empty, F.array(pick)).otherwise(given))})
    if best:
        value = F.explode(F.filter("_given", lambda v: ~F.array_contains("options", v)))
        misses = typed.where("_given IS NOT NULL").select("schema_name", "attribute", "options", value.alias("_v")).distinct()
        found = misses.repartition("_v").select("schema_name", "attribute", "_v", closest_udf("_v", "options").alias("_to"))
        open_rows = F.col("_given").isNotNull() & F.exists("_given", lambda v: ~F.array_contains("options", v))
        rest = typed.where(open_rows).select(*key, "schema_name", "attribute", "options", F.posexplode("_given").alias("_at", "_v"))
        made = rest.join(found, ["schema_name", "attribute", "_v"], "left").groupBy(*key, "schema_name", "attribute").agg(F.collect_list(F.struct("_at", F.when(F.array_contains("options", F.col("_v")), F.col("_v")).otherwise(F.col("_to")).alias("v"))).alias("_m"))
        typed = typed.join(made, [*key, "schema_name", "attribute"], "left")
        fixed = F.when(F.col("_m").isNotNull(), F.transform(F.array_sort("_m"), lambda x: x["v"])).otherwise(F.col("_given"))
    else:
        fixed = F.transform("_given", lambda v: F.when(F.array_contains("options", v), v))
    typed = typed.withColumn("_fixed", fixed)
    out = typed.withColumns({"items": F.when(closed & (F.col("kind") == "list"), F.col("_fixed")).otherwise(F.col("items")), "text": F.when(closed & (F.col("kind") != "list"), F.col("_fixed")[0]).otherwise(F.col("text"))})
    return out.drop("_given", "_fixed", "_m")


def postprocess(records: DataFrame, attr_schema: DataFrame, key: list[str], year: int, method: str = "last", raw: str = "raw") -> DataFrame:
    """Filled, cast and repaired values of every record, in the long form."""
    return fix_options(cast_values(fill_missing(to_long(records, attr_schema, key, raw), year), year), key, method)


def _records(texts: Column, kind: str) -> Column:
    return F.transform(texts, lambda x: F.from_json(x, kind))


def widen(long: DataFrame, key: list[str]) -> DataFrame:
    """The long form as one superset record a row: ``(key, schema_name, metadata)``; attributes outside the schema are null."""
    value = F.struct("text", "number", "flag", "items")
    wide = long.groupBy(*key, "schema_name").agg(F.map_from_entries(F.collect_list(F.struct("attribute", value))).alias("m"))
    at = lambda name: F.try_element_at("m", F.lit(name))
    columns = []
    for name, kind in schemas.RECORD_FIELDS.items():
        v = at("Language" if name == "Languages" else name)
        if kind == "array<string>":
            c = v["items"]
        elif kind.startswith("array"):
            c = _records(v["items"], kind[6:-1])
        elif kind == "boolean":
            c = v["flag"]
        elif kind in ("int", "double"):
            c = v["number"].cast(kind)
        else:
            c = v["text"]
        columns.append(c.alias(name))
    return wide.select(*key, "schema_name", F.struct(*columns).alias("metadata"))


def backfill(df: DataFrame, record: str, article_url: Column) -> DataFrame:
    """An empty or missing paper link filled with the article's address."""
    return df.withColumn(record, F.when(F.col(record).isNotNull(), F.col(record).withField("`Paper Link`", F.coalesce(F.nullif(schemas.field(record, "Paper Link"), F.lit("")), article_url))))


def clean_volume(text: Column) -> Column:
    """A size written with thousands separators as a number; null if it is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def audit(gold: DataFrame, attr_schema: DataFrame) -> DataFrame:
    """The attributes of its schema that a gold record lacks in itself or in its map of annotations: ``(record_id, attribute, missing_in)``.

    A record lacks an attribute whose value is null; a null map lacks them all.
    """
    fields = [f.name for f in schemas.record_fields(gold, "metadata")]
    there = F.filter(F.array(*(F.when(schemas.field("metadata", n).isNotNull(), F.lit("Language" if n == "Languages" else n)) for n in fields)), lambda x: x.isNotNull())
    rows = gold.select("record_id", "schema_name", there.alias("has"), F.coalesce(F.map_keys("annotations_from_paper"), F.array().cast("array<string>")).alias("noted")).dropDuplicates(["record_id"])
    made = rows.join(attr_schema.select("schema_name", "attribute"), "schema_name")
    lack = F.array_compact(F.array(F.when(~F.array_contains("has", F.col("attribute")), "record"), F.when(~F.array_contains("noted", F.col("attribute")), "annotations")))
    return made.select("record_id", "attribute", F.explode(lack).alias("missing_in"))


def first_by(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row of each group, the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
