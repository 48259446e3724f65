"""Deeply nested records into related flat tables, in a single pass.

A depth-first visitor reads every JSON body once and emits rows that carry the
tag of their table (``entity``), their own key, the key of their parent and
their payload. :func:`flat_tables` applies the schema of each tag;
:func:`write_tables` writes the emission partitioned by the tag, so a table is
read back without touching the others.

The key of a row is ``(file_id, run_pos, entity, path)``: the path holds the places of
a subset and of all the subsets around it (``2.0.1``), so it is unique at any depth; ``pos`` is
its last part and ``parent_pos`` the one before. The parent of a row is the ``run`` with the same
``(file_id, run_pos)``, or, for a subset inside a subset, the one whose path is its own without the last part.

Defined results of the edge cases: a null, blank or broken body gives no rows;
so do missing, null and key-less objects; null elements and blank strings give
no row but keep their number; a lone value counts as a list of one, an object
of objects as the list of its values; a string that holds JSON counts as what it
holds; unknown fields stay in the column ``payload`` of the typed table; a number written
as a string is that number, and one that cannot be read is null but stays in ``payload``;
an empty table gives an empty
table. Bodies nested deeper than the parser allows count as broken.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

EMITTED = "file_id long, run_pos int, entity string, parent_pos int, pos int, path string, payload string"
KEY = ["file_id", "run_pos", "entity", "parent_pos", "pos"]

#: Parts of a run that are single objects, and the lists inside them with the tag of their elements.
SINGLE = ("metadata", "validation", "cost", "config")
LISTS = {"metadata": (("Authors", "author"), ("Affiliations", "affiliation")), "config": (("keywords", "keyword"),)}
NESTED_LIST, NESTED_TAG = "Subsets", "subset"
RUN_KEYS = frozenset((*SINGLE, "error", "length_forcing", "ratio_filling"))
ELEMENT_KEYS = frozenset(("Name", "Volume", "Unit", "Dialect", "Language", "Subsets"))

#: The schema of each tag's payload.
SCHEMAS = {
    "run": "length_forcing double, ratio_filling double, error string",
    "metadata": "Name string, Link string, `HF Link` string, License string, Year string, Language string, Dialect string, Form string, Description string, Volume string, Unit string, `Ethical Risks` string, `Paper Title` string, `Paper Link` string, Script string, Tokenized string, Host string, Access string, Cost string, `Test Split` string, `Venue Title` string, `Venue Type` string, `Venue Name` string, Abstract string, "
    "Languages array<string>, Domain array<string>, `Collection Style` array<string>, Provider array<string>, `Derived From` array<string>, Tasks array<string>",
    "validation": "CONTENT double, ACCESSABILITY double, DIVERSITY double, EVALUATION double, AVERAGE double",
    "cost": "cost double, input_tokens long, output_tokens long",
    "config": "model_name string, few_shot int, month int, year string, link string",
    "author": "value string",
    "affiliation": "value string",
    "keyword": "value string",
    "subset": "Name string, Volume double, Unit string, Dialect string, Language string",
}


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def parse(text: str | None) -> tuple[bool, object]:
    """Whether ``text`` is valid JSON, and what it holds."""
    if text is None or not text.strip():
        return False, None
    try:
        return True, unwrap(json.loads(text, parse_constant=_no_constant))
    except (ValueError, RecursionError):
        return False, None


def unwrap(value: object) -> object:
    """What a string holds, if it holds a JSON object, list or string."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            value = json.loads(value, parse_constant=_no_constant)
        except (ValueError, RecursionError):
            break
    return value


def elements(value: object, own_keys: frozenset[str]) -> list:
    """A list field's elements: a lone value is a list of one, an object of objects the list of its values."""
    value = unwrap(value)
    if value is None:
        return []
    if isinstance(value, list):
        return [unwrap(x) for x in value]
    if isinstance(value, dict):
        if not value:
            return []
        inner = [unwrap(x) for x in value.values()]
        if not own_keys & value.keys() and all(x is None or isinstance(x, dict) for x in inner) and any(inner):
            return inner
    return [value]


def _runs(body: object) -> list:
    if isinstance(body, dict) and not RUN_KEYS & body.keys():
        if "runs" in body:
            return elements(body["runs"], RUN_KEYS)
        held = [x for x in map(unwrap, body.values()) if isinstance(x, (list, dict))]
        for x in held:  # another wrapper: the one part that holds runs
            inner = elements(x, RUN_KEYS)
            if inner and all(y is None or isinstance(y, dict) and RUN_KEYS & y.keys() for y in inner) and any(inner):
                return elements(body, RUN_KEYS) if len(held) > 1 and len(held) == len(body) and isinstance(x, dict) else inner
    return elements(body, RUN_KEYS)


def _absent(x: object) -> bool:
    return x is None or isinstance(x, dict) and not x or isinstance(x, str) and not x.strip()


def _scalar(x: object) -> object:
    return x if x is None or isinstance(x, (str, bool, int, float)) else json.dumps(x, ensure_ascii=False)


def visit(body: object) -> Iterator[tuple[int, str, int, int, str, object]]:
    """Depth-first: ``(run_pos, entity, parent_pos, pos, path, payload)`` of every flat row below ``body``."""

    def nested(run_pos: int, top: object) -> Iterator[tuple[int, str, int, int, str, object]]:
        # the subsets still to visit, the next on top: any depth of them is one stack
        todo = [(x, -1, pos, str(pos)) for pos, x in enumerate(elements(top, ELEMENT_KEYS))][::-1]
        while todo:
            x, parent, pos, path = todo.pop()
            if _absent(x):
                continue
            yield run_pos, NESTED_TAG, parent, pos, path, {k: _scalar(v) for k, v in x.items() if k != NESTED_LIST} if isinstance(x, dict) else {"Name": _scalar(x)}
            if isinstance(x, dict) and NESTED_LIST in x:
                todo += [(y, pos, p, f"{path}.{p}") for p, y in enumerate(elements(x[NESTED_LIST], ELEMENT_KEYS))][::-1]

    for run_pos, run in enumerate(_runs(body)):
        if not isinstance(run, dict) or not run:
            continue
        yield run_pos, "run", -1, 0, "0", {k: _scalar(v) for k, v in run.items() if k not in SINGLE}
        for tag in SINGLE:
            part = unwrap(run.get(tag))
            if not isinstance(part, dict) or not part:
                continue
            lists = LISTS.get(tag, ())
            inner = {name for name, _ in lists} | ({NESTED_LIST} if tag == "metadata" else set())
            yield run_pos, tag, -1, 0, "0", {k: _scalar(v) for k, v in part.items() if k not in inner}
            for name, element_tag in lists:
                for pos, x in enumerate(elements(part.get(name), frozenset())):
                    if not _absent(x):
                        yield run_pos, element_tag, -1, pos, str(pos), {"value": _scalar(x)}
            if tag == "metadata":
                yield from nested(run_pos, part.get(NESTED_LIST))


def emit(df: DataFrame, id_column: str = "file_id", body_column: str = "body", payload: bool = True) -> DataFrame:
    """The tagged rows of all bodies of ``df``; narrow, one pass, no shuffle.

    Other columns of ``df`` are not read, so their names may clash with anything.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch[id_column], batch[body_column]):
                ok, body = parse(text if isinstance(text, str) else None)
                if ok:
                    rows += ((key, *x[:5], json.dumps(x[5], ensure_ascii=False) if payload else None) for x in visit(body))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in EMITTED.split(", ")])

    return df.where(F.col(id_column).isNotNull()).select(id_column, body_column).mapInPandas(run, EMITTED)


def flatten(df: DataFrame, id_column: str = "file_id", body_column: str = "body") -> DataFrame:
    """The keys of all flat rows. Repeated bodies of one file count once.

    The repeats are dropped after the emission, where the rows are small and
    are combined before they are shuffled: bodies themselves never move.
    """
    return emit(df, id_column, body_column, payload=False).select(KEY).distinct()


def flat_tables(df: DataFrame, id_column: str = "file_id", body_column: str = "body") -> dict[str, DataFrame]:
    """One typed table for each tag, with the key of every row and of its parent."""
    rows = emit(df, id_column, body_column)
    return {tag: typed(rows, tag) for tag in SCHEMAS}


def typed(rows: DataFrame, tag: str) -> DataFrame:
    """The table of ``tag`` from emitted rows (or from a written emission, which prunes to one partition)."""
    one = rows.where(F.col("entity") == tag).groupBy(*KEY, "path").agg(F.min("payload").alias("payload"))
    keys = ["file_id", "run_pos", "parent_pos", "pos", "path"]
    fields = StructType.fromDDL(SCHEMAS[tag]).fields
    texts = StructType([StructField(f.name, StringType()) for f in fields])
    read = one.select(*keys, F.from_json("payload", texts).alias("_p"), "payload")
    return read.select(*keys, *(_cast(F.col(f"_p.`{f.name}`"), f.dataType.simpleString()).alias(f.name) for f in fields), "payload")


def _cast(text: Column, to: str) -> Column:
    """``text`` as ``to``, null where it cannot be; a lone value is a list of one."""
    if to == "string":
        return text
    if to == "array<string>":
        many = F.when(F.ltrim(text).startswith("["), F.from_json(text, to))
        return F.coalesce(many, F.when(F.trim(text) != "", F.array(text)))
    number = F.trim(text).try_cast("double")
    if to == "double":
        return number
    # whole numbers are read exactly, "3.0" and "3e2" by way of a double
    return F.coalesce(F.trim(text).try_cast(to), F.when(number == F.floor(number), number.try_cast(to)))


def write_tables(df: DataFrame, path: str, id_column: str = "file_id", body_column: str = "body") -> None:
    """Write the emission once, partitioned by tag."""
    emit(df, id_column, body_column).write.partitionBy("entity").mode("overwrite").parquet(path)
