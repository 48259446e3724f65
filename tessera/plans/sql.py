"""Pieces of SQL that several of the independent checks share; they are written for DuckDB, not derived from the queries."""

from __future__ import annotations

#: One row for each result, and the gold record of least id for each paper.
RUNS = "runs AS (SELECT DISTINCT ON (result_id) * FROM results)"
GOLD = "gold1 AS (SELECT * FROM gold WHERE paper_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY record_id) = 1)"
ONE_GOLD = "golds AS (SELECT DISTINCT ON (record_id) * FROM gold)"
TEXT_LISTS = ("Domain", "Collection Style", "Provider", "Derived From", "Tasks", "Authors", "Affiliations")
SCALARS = (
    "Name", "Link", "HF Link", "License", "Year", "Dialect", "Form", "Description", "Volume", "Unit", "Ethical Risks", "Paper Title", "Paper Link", "Script",
    "Tokenized", "Host", "Access", "Cost", "Test Split", "Venue Title", "Venue Type", "Venue Name", "Abstract",
)
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BASELINES = "('human', 'dummy', 'jury', 'composer', 'baseline-first', 'baseline-last', 'baseline-random')"


def set_of(x: str) -> str:
    return f"list_distinct([trim(lower(v), '{SPACES}') for v in coalesce({x}, []::VARCHAR[]) if v IS NOT NULL])"


def overlap(a: str, b: str) -> str:
    x, y = set_of(a), set_of(b)
    n = f"len(list_intersect({x}, {y}))"
    return f"((len({x}) = 0 AND len({y}) = 0) OR ({n} > 0 AND len({x}) + len({y}) - 2 * {n} <= 1))"


def subsets(a: str, b: str) -> str:
    return f"(len(coalesce({a}, [])) = len(coalesce({b}, [])) AND len([s for s in coalesce({a}, []) if list_contains(coalesce({b}, []), s)]) = len(coalesce({a}, [])))"


def right(g: str = "g.metadata", p: str = "r.metadata") -> str:
    """Whether attribute ``a.attribute`` of a prediction equals that of the gold record."""
    cases = [f"WHEN '{n}' THEN {overlap(f'{g}.\"{n}\"', f'{p}.\"{n}\"')}" for n in TEXT_LISTS]
    cases += [f"WHEN '{n}' THEN {g}.\"{n}\" IS NOT DISTINCT FROM {p}.\"{n}\"" for n in SCALARS]
    cases += [
        f"WHEN 'Language' THEN CASE WHEN a.answer_type LIKE 'List%' THEN {overlap(f'{g}.Languages', f'{p}.Languages')} ELSE {g}.\"Language\" IS NOT DISTINCT FROM {p}.\"Language\" END",
        f"WHEN 'Subsets' THEN {subsets(f'{g}.Subsets', f'{p}.Subsets')}",
    ]
    return f"coalesce({g} IS NOT NULL AND {p} IS NOT NULL AND CASE a.attribute {' '.join(cases)} END, false)"


HITS = f"""
    {RUNS}, {GOLD},
    hits AS (
      SELECT r.result_id, r.paper_id, r.schema_name, r.result_set, r.shot, r.model, r.is_browsing, a.attribute, a.validation_group,
             {right()} AS hit, coalesce(g.annotations_from_paper[a.attribute], 1) AS from_paper
      FROM runs r JOIN attr_schema a ON a.schema_name = r.schema_name LEFT JOIN gold1 g ON g.paper_id = r.paper_id
      WHERE a.validation_group IS NOT NULL)"""


def _group(name: str, condition: str = "true") -> str:
    return f"round(sum(CASE WHEN validation_group = '{name}' AND hit AND {condition} THEN 1 ELSE 0 END)::DOUBLE / nullif(count(*) FILTER (validation_group = '{name}'), 0), 9) AS \"{name}\""


def scores(condition: str = "true") -> str:
    """A scored row for each run, as a table expression over ``hits``."""
    groups = ", ".join(_group(g, condition) for g in ("CONTENT", "ACCESSABILITY", "DIVERSITY", "EVALUATION"))
    return f"""scored AS (
      SELECT result_id, paper_id, schema_name, result_set, shot, model, is_browsing, {groups},
             round(sum(CASE WHEN hit AND {condition} THEN 1 ELSE 0 END)::DOUBLE / nullif(count(*) FILTER ({condition}), 0), 9) AS "AVERAGE"
      FROM hits GROUP BY ALL)"""


IDS = "ids AS (SELECT schema_name, paper_id, ordinal FROM papers WHERE split = 'test' AND schema_name IN ('ar', 'en', 'jp', 'fr', 'ru', 'multi'))"
