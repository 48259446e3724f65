"""Repair of JSON that a model wrote: fences, quotes, stray backslashes. All of it runs inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_fences(text: Column) -> Column:
    """Without the marks of a fenced block."""
    return reduce(lambda x, mark: F.replace(x, F.lit(mark), F.lit("")), ("```json", "```"), text)


def strip_outer_quotes(text: Column) -> Column:
    """Without the double quotes at both ends; one at one end stays, a lone one leaves nothing."""
    both = text.startswith('"') & text.endswith('"')
    return F.when(both, F.substr(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))).otherwise(text)


def double_quotes(text: Column) -> Column:
    """Every single quote outside double quotes becomes a double quote; those inside stay.

    The stretches between double quotes lie outside and inside by turns, so the even ones are outside.
    """
    parts = F.split(text, '"', -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit("'"), F.lit('"'))).otherwise(p)), '"')


def repair_json(text: Column) -> Column:
    """The text with all backslashes and outer quotes gone and its single quotes doubled."""
    return double_quotes(strip_outer_quotes(F.replace(text, F.lit("\\"), F.lit(""))))


def read_json(text: Column) -> Column:
    """The repaired JSON of a model's answer; null if it still isn't JSON."""
    repaired = repair_json(strip_fences(text))
    return F.when(F.try_parse_json(repaired).isNotNull(), repaired)


def json_error(text: Column) -> Column:
    """The error a failed reading is stored with; null where :func:`read_json` succeeds. Its wording names no position."""
    return F.when(text.isNotNull() & read_json(text).isNull(), "Expecting value: line")
