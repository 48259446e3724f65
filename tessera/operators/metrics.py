"""Comparison of predicted records with gold records, attribute by attribute.

A run is scored in one narrow pass after it has met its gold record: the hits of
all its validated attributes are one array of small structs, and group scores are
higher-order functions over it, so nothing is exploded or shuffled for them.

Defined results of the edge cases: a null list counts as an empty one and null
elements are left out; two null scalars are equal, null and empty text are not;
numbers are compared as doubles (``1 = 1.0``); a run without a record, or whose
paper has no gold record, scores 0 everywhere; an attribute outside the schema of
a run is not scored; a schema without a group has null for its score; empty tables
give an empty result; extra columns are ignored. Repeated runs (same
``result_id``) count once; the gold record of a paper is the one with the least
``record_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tessera import schemas
from tessera.functions import text as T
from tessera.functions.text import strip, word_count

#: The field of a record that holds an attribute in the schemata in which it is a list (fixed values).
LIST_FORM = {"Language": "Languages"}


def as_set(texts: Column) -> Column:
    """Lower-cased, stripped, distinct elements."""
    known = F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda v: v.isNotNull())
    return F.array_distinct(F.transform(known, lambda v: strip(F.lower(v))))


def list_overlap(a: Column, b: Column, max_diff: int = 1) -> Column:
    """Whether two lists agree: both empty, or something in common and at most ``max_diff`` elements in one alone."""
    x, y = as_set(a), as_set(b)
    both = F.size(F.array_intersect(x, y))
    return ((F.size(x) == 0) & (F.size(y) == 0)) | ((both > 0) & (F.size(x) + F.size(y) - 2 * both <= max_diff))


def records_match(a: Column, b: Column) -> Column:
    """Whether two lists of records are equally long and each of the first is among the second (not the other way)."""
    x, y = F.coalesce(a, F.array()), F.coalesce(b, F.array())
    return (F.size(x) == F.size(y)) & F.forall(x, lambda s: F.exists(y, lambda u: u.eqNullSafe(s)))


def csv_set_match(a: Column, b: Column) -> Column:
    """Whether all parts of the comma list ``a`` are different and among those of ``b``; null is the empty text."""
    parts = lambda c: F.transform(F.split(c, ",", -1), lambda v: strip(F.lower(v)))
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.size(F.array_intersect(parts(a), parts(b))) == F.size(parts(a))


def hit(gold: Column, pred: Column, kind: object) -> Column:
    """Whether one attribute is right, by the rule of its type."""
    if schemas.is_text_list(kind):
        return list_overlap(gold, pred)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return records_match(gold, pred)
    return gold.eqNullSafe(pred)


def narrow(df: DataFrame, record: str, attributes: list[str]) -> Column:
    """The record with these attributes only, so that no other is read or shuffled; null where the record is."""
    wanted = {*attributes, *(LIST_FORM[a] for a in attributes if a in LIST_FORM)}
    names = [f.name for f in schemas.record_fields(df, record) if f.name in wanted]
    return F.when(F.col(record).isNotNull(), F.struct(*(schemas.field(record, n).alias(n) for n in names)))


def first_gold(gold: DataFrame, attributes: list[str] | None = None) -> DataFrame:
    """One gold record for each paper, ``(paper_id, gold, from_paper)``: that of the least ``record_id``.

    A partial minimum runs before the shuffle, so a paper with a third of all records sends one row a task.
    """
    record = F.col("metadata") if attributes is None else narrow(gold, "metadata", attributes)
    picked = F.struct(record.alias("metadata"), F.col("annotations_from_paper"))
    return gold.where("paper_id IS NOT NULL").groupBy("paper_id").agg(F.min_by(picked, F.col("record_id")).alias("g")).select("paper_id", F.col("g.metadata").alias("gold"), F.col("g.annotations_from_paper").alias("from_paper"))


def _set_sql(path: str) -> str:
    known = f"filter(coalesce({path}, cast(array() AS array<string>)), v -> v IS NOT NULL)"
    return f"array_distinct(transform({known}, v -> trim(BOTH '{T.SPACES}' FROM lower(v))))"


def validated(attr_schema: DataFrame) -> list[str]:
    """The attributes that any schema validates: names of the declared schema, of which there are a few dozen."""
    return sorted(r[0] for r in attr_schema.where("validation_group IS NOT NULL").select("attribute").distinct().collect())


def hits(pairs: DataFrame, attributes: list[str], gold: str = "gold", pred: str = "metadata", answer_types: str = "answer_types", groups: str = "groups", from_paper: str | None = "from_paper") -> DataFrame:
    """``pairs`` with ``hits``: for each validated attribute of the schema its group, whether it is right and whether the paper holds it.

    Sets are made once for each side and list, in a projection of their own, and compared in the next.
    """
    fields = {f.name: f.dataType for f in schemas.record_fields(pairs, pred)}
    named = [n for n in attributes if n in fields and n not in LIST_FORM.values()]
    lists = [n for n in [*named, *(LIST_FORM[n] for n in named if LIST_FORM.get(n) in fields)] if schemas.is_text_list(fields[n])]
    at = lambda record, n: f"{record}.{schemas.quoted(n)}"
    sets = {f"_{side}{i}": F.expr(_set_sql(at(record, n))) for i, n in enumerate(lists) for side, record in (("x", gold), ("y", pred))}
    common = {f"_c{i}": F.expr(f"size(array_intersect(_x{i}, _y{i}))") for i in range(len(lists))}
    items = []
    for n in named:
        agree = {m: f"((size(_x{i}) = 0 AND size(_y{i}) = 0) OR (_c{i} > 0 AND size(_x{i}) + size(_y{i}) - 2 * _c{i} <= 1))" for i, m in enumerate(lists)}
        x, y = at(gold, n), at(pred, n)
        if n in agree:
            right = agree[n]
        elif isinstance(fields[n], ArrayType):
            right = f"(size(coalesce({x}, array())) = size(coalesce({y}, array())) AND forall(coalesce({x}, array()), s -> exists(coalesce({y}, array()), u -> u <=> s)))"
        else:
            right = f"({x} <=> {y})"
        if LIST_FORM.get(n) in agree:
            right = f"if(coalesce(try_element_at({answer_types}, '{n}'), '') LIKE 'List%', {agree[LIST_FORM[n]]}, {right})"
        flag = f"coalesce(try_element_at({from_paper}, '{n}'), 1)" if from_paper else "1"
        items.append(f"named_struct('attribute', '{n}', 'grp', try_element_at({groups}, '{n}'), 'hit', coalesce({gold} IS NOT NULL AND {pred} IS NOT NULL AND {right}, false), 'from_paper', {flag})")
    made = pairs.withColumns(sets).withColumns(common) if lists else pairs
    out = made.withColumn("hits", F.expr(f"filter(array({', '.join(items)}), h -> h.grp IS NOT NULL)"))
    return out.drop(*sets, *common)


def _share(found: Column, of: Column) -> Column:
    return F.try_divide(F.size(found).cast("double"), of.cast("double"))


def _of_group(items: Column, group: str) -> Column:
    return F.filter(items, lambda h: h["grp"] == group)


def group_scores(scored: DataFrame, annotated: bool = False, groups: tuple[str, ...] = schemas.GROUPS) -> DataFrame:
    """``scored`` with a score for each group, and ``AVERAGE``.

    A group's score divides by its full size; ``AVERAGE`` by the attributes that take part, so it isn't the mean of the
    groups. With ``annotated``, attributes that the paper doesn't hold take no part; null if none does.
    """
    part = F.filter("hits", lambda h: h["from_paper"] != 0) if annotated else F.col("hits")
    right = F.filter(part, lambda h: h["hit"])
    columns = {g: _share(_of_group(right, g), F.nullif(F.size(_of_group(F.col("hits"), g)), F.lit(0))) for g in groups}
    return scored.withColumns({**columns, "AVERAGE": _share(right, F.nullif(F.size(part), F.lit(0)))})


def match(runs: DataFrame, gold: DataFrame, attr_schema: DataFrame, attributes: list[str] | None = None) -> DataFrame:
    """Every run with the gold record of its paper and the profile of its schema.

    Many runs of one paper make a skewed join; adaptive execution splits the runs, the gold side has one row for each paper.
    """
    side = schemas.profile(attr_schema).select("schema_name", "answer_types", "groups")
    return runs.join(first_gold(gold, attributes), "paper_id", "left").join(side, "schema_name")


RUN_COLUMNS = ["result_id", "paper_id", "schema_name", "result_set", "shot", "model", "is_browsing"]


def score(results: DataFrame, gold: DataFrame, attr_schema: DataFrame, annotated: bool = False) -> DataFrame:
    """One row for each run: its key columns, ``hits``, the score of each group and ``AVERAGE``.

    Records are shuffled once, to meet their gold record; repeated rows are dropped after that, when a row is only its hits.
    """
    attributes = validated(attr_schema)
    pairs = match(results.select(*RUN_COLUMNS, narrow(results, "metadata", attributes).alias("metadata")), gold, attr_schema, attributes)
    scored = hits(pairs, attributes).select(*RUN_COLUMNS, "hits")
    return group_scores(scored.dropDuplicates(["result_id"]), annotated)


def attribute_scores(scored: DataFrame) -> DataFrame:
    """The long form: one row for each run and validated attribute."""
    return scored.select(*RUN_COLUMNS, F.explode("hits").alias("h")).select(*RUN_COLUMNS, F.col("h.attribute").alias("attribute"), F.col("h.grp").alias("validation_group"), F.col("h.hit").alias("hit"), F.col("h.from_paper").alias("from_paper"))


def lengths(df: DataFrame, record: str, columns: tuple[str, ...] | None = None, ranges: str = "lengths", options: str = "options", answer_types: str = "answer_types") -> Column:
    """The share of attributes whose length lies in its range: elements of a list, 1 for a closed text, else words.

    ``columns`` restricts it; the share is of the attributes that the schema has. Values are counted as they would be
    printed, so a number or a flag has one word, and so has a missing value.
    """
    fields = {f.name: f.dataType for f in schemas.record_fields(df, record)}
    checks = []
    for name, kind in fields.items():
        if name in LIST_FORM.values() or (columns is not None and name not in columns):
            continue
        value = schemas.field(record, name)
        n = F.size(F.coalesce(value, F.array())) if isinstance(kind, ArrayType) else word_count(F.coalesce(value.cast("string"), F.lit("")))
        if (other := LIST_FORM.get(name)) in fields:
            n = F.when(F.try_element_at(answer_types, F.lit(name)).startswith("List"), F.size(F.coalesce(schemas.field(record, other), F.array()))).otherwise(n)
        if not isinstance(kind, ArrayType):
            closed = F.try_element_at(options, F.lit(name)).isNotNull() & (F.try_element_at(answer_types, F.lit(name)) == "str")
            n = F.when(closed, 1).otherwise(n)
        span = F.try_element_at(ranges, F.lit(name))
        checks.append(F.when(span.isNotNull(), F.when((n >= span[0]) & ((span[1] < 0) | (n <= span[1])), 1).otherwise(0)))
    made = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(made, F.lit(0), lambda a, x: a + x).cast("double"), F.size(made).cast("double"))


def fill_ratio(df: DataFrame, record: str, columns: str = "columns") -> Column:
    """The share of a schema's attributes with a value: neither null, empty text nor empty list.

    The stored ``ratio_filling`` counts names instead of values and is therefore always 1; see :func:`key_ratio`.
    """
    full = []
    for f in schemas.record_fields(df, record):
        if f.name in LIST_FORM.values():
            continue
        value = schemas.field(record, f.name)
        filled = F.size(F.coalesce(value, F.array())) > 0 if isinstance(f.dataType, ArrayType) else value.isNotNull() & (value.cast("string") != "")
        if (other := LIST_FORM.get(f.name)) and other in {x.name for x in schemas.record_fields(df, record)}:
            filled = filled | (F.size(F.coalesce(schemas.field(record, other), F.array())) > 0)
        full.append(F.when(F.array_contains(columns, f.name), F.coalesce(filled, F.lit(False)).cast("int")))
    made = F.filter(F.array(*full), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(made, F.lit(0), lambda a, x: a + x).cast("double"), F.size(made).cast("double"))


def key_ratio(df: DataFrame, record: str) -> Column:
    """The stored form of the fill ratio: the share of attribute *names* that aren't empty; 1 for every record."""
    return F.when(F.col(record).isNotNull(), F.lit(sum(f.name != "" for f in schemas.record_fields(df, record)) / max(1, len(schemas.record_fields(df, record)))))
