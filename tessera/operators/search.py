"""Search over a table of papers: the same parts as the query text, as predicates that reach the scan."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories, number of hits and order of the default search (fixed values).
DEFAULT_CATEGORIES, DEFAULT_HITS = ("cs.AI", "cs.LG", "cs.CL"), 10


def window(year: int | None, month: int | None = None) -> tuple[datetime.datetime, datetime.datetime] | None:
    """The first moment of a year or month and of the one after it; none without a year."""
    if year is None:
        return None
    if month is not None and not 1 <= month <= 12:
        raise ValueError("Month must be between 1 and 12")
    after = (year + 1, 1) if month in (None, 12) else (year, month + 1)
    return datetime.datetime(year, month or 1, 1), datetime.datetime(*after, 1)


def in_window(when: Column, year: int | None, month: int | None = None) -> Column:
    """Whether a time lies in it; both ends count."""
    span = window(year, month)
    return F.lit(True) if span is None else when.between(F.lit(span[0]), F.lit(span[1]))


def has_terms(title: Column, keywords: list[str]) -> Column:
    """Whether a title holds every keyword, without regard to case."""
    out = F.lit(True)
    for word in keywords:
        out = out & F.lower(title).contains(word.lower())
    return out


def search(papers: DataFrame, keywords: list[str], categories: list[str] | None = None, month: int | None = None, year: int | None = None, sort_by: str = "relevance", limit: int = DEFAULT_HITS) -> DataFrame:
    """The first ``limit`` papers with all keywords in the title, in any of the categories, published in the window.

    ``papers`` has ``paper_id, title, published, category``. ``relevance`` prefers titles of which the keywords are the
    larger part, ``submitted`` the latest; ties go to the lesser id. Sort and limit run as a top-k, so no task sorts all hits.
    """
    found = papers.where(has_terms(F.col("title"), keywords) & in_window(F.col("published"), year, month))
    if categories:
        found = found.where(F.col("category").isin(*categories))
    order = [F.length("title").asc(), F.col("paper_id")] if sort_by == "relevance" else [F.col("published").desc_nulls_last(), F.col("paper_id")]
    return found.orderBy(*order).limit(limit)


def relevant(papers: DataFrame, answer: Column) -> DataFrame:
    """The papers for which a yes-or-no predicate (of a model, say) answered yes."""
    from tessera.functions.text import says_yes

    return papers.where(says_yes(answer))


def listing(hits: DataFrame) -> str:
    """Hits as numbered text. They are the ``limit`` rows of a search."""
    rows = hits.collect()
    if not rows:
        return "No results found."
    return "\n".join(f"{i}. {r['title']}\n   {r['paper_id']}  {r['published']:%Y-%m-%d}" for i, r in enumerate(rows, 1))
