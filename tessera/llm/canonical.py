"""Freely typed values mapped to a reference list, by a partition-based pigeonhole join in SQL.

Every typed value and every reference text gets a compact form: one case, no
accents, no lead-in ("licensed under"), no year, volume or page, abbreviations
written out. Equal forms, or equal bags of word stems, match at once. What is
left is joined by the pigeonhole principle: a reference form for which ``k`` edits
are allowed is cut into ``k + 1`` segments, of which an equal one must stand in any
text within ``k`` edits, at most ``k`` places off; so an equality join on (length,
segment number, substring) finds every candidate, and the built-in ``levenshtein``
verifies it. An anti-join reports what has no match, as entry 0.

Names that no spelling rule reaches ("opinion mining" for "sentiment analysis")
are learned from the table itself: where other records of the same paper hold a
listed entry, the unmatched name is taken for it if at least ``SUPPORT`` papers say
so, they are at least ``SHARE`` of the papers that could, and no other entry comes near.
Names learned so, and those a caller gives, are reference texts of a second pass of the same join, so
their misspelt forms match as well.

The work is done on distinct values, so a value that fills a third of all rows is
resolved once, and evidence is counted by paper, so a paper with a third of all rows is one witness.
The reference list is a dimension table; no side is broadcast by a
hint, Spark decides by the size it measures.

Numbers must agree exactly, as another version of a licence is another licence.

Defined results of the edge cases: null and blank values have no row; a value
that equals a listed text has no row in :func:`resolve` (nothing was to be
mapped); if two entries are equally near the value counts as unmatched; empty
tables give an empty result; values may be of any length, but only those at most
``k`` longer or shorter than a reference form can match it by edits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Abbreviated words of titles (fixed values).
ABBREVIATIONS = {
    "conf": "conference", "wksp": "workshop", "symp": "symposium", "trans": "transactions", "j": "journal", "intl": "international", "int": "international",
    "res": "resources", "lang": "language", "annot": "annotation", "tech": "technology", "proc": "processing", "sys": "systems", "eval": "evaluation", "doc": "documentation", "eng": "engineering",
}
#: Edits allowed, by field: (least length of the form, edits), the longest first.
DEFAULT_EDITS = [(14, 3), (11, 2), (8, 1)]
#: Evidence that a learned name needs: papers, their share of all that could say so, and the most of it that another entry may have.
SUPPORT, SHARE, RIVAL = 2, 0.6, 0.5
EDITS = {"License": [(18, 3), (12, 2), (9, 1)], "Host": [(9, 4), (7, 3)], "Venue Title": [(16, 4), (10, 2)], "Tasks": [(14, 4), (11, 3), (9, 2)]}

_ACCENTS = ("éèêëàâäáãîïíìôöóòõûùüúçñ", "eeeeaaaaaiiiiooooouuuucn")


def _replace(expression: str, *rules: tuple[str, str]) -> str:
    for pattern, by in rules:
        expression = f"regexp_replace({expression}, r'{pattern}', '{by}')"
    return expression


def form_sql(field: str, value: str) -> str:
    """SQL for the spaced form of a value: words of one writing, without what surrounds the name."""
    clean = "trim(" + _replace(f"translate(lower({value}), '{_ACCENTS[0]}', '{_ACCENTS[1]}')", (r'["“”„«»*]', " "), (r"[\s ​﻿_]+", " ")) + ")"
    clean = "trim(" + _replace(clean, (r"[\s;,.:]+$", ""), (r"^[\s;,.:]+", "")) + ")"
    if field == "License":
        text = _replace(
            clean,
            (r"^https?://[^/]+/([a-z-]+)/([0-9.]+)/?$", "cc $1 $2"),
            (r"^((released|licensed|published|available|distributed)[ -])?under[ -](the[ -])?", ""),
            (r"^licen[cs]e ?: ?", ""), (r"^the ", ""),
            (r"pas d.utilisation commerciale", "noncommercial"), (r"partage dans les memes conditions", "sharealike"), (r"pas de modification", "noderivatives"),
            (r"\bthree\b", "3"), (r"\btwo\b", "2"), (r"\bclauses\b", "clause"), (r"[^a-z0-9.]+", " "), (r"v(?=\d)", " "), (r"(\d+)\.0\b", "$1"), (r"\.(?!\d)", " "),
            (r"\bcc ?by ?", "cc by "), (r"(?<=cc by )nc ?", "nc "), (r"(?<=cc by nc )(sa|nd) ?", "$1 "), (r"(?<=cc by )(sa|nd) ?", "$1 "), (r"\bcc ?0\b", "cc zero"),
            (r"\bcc\b", "creative commons"), (r"\bby\b", "attribution"), (r"\bnc\b", "noncommercial"), (r"\bsa\b", "sharealike"), (r"\bnd\b", "noderivatives"),
        )
    elif field == "Host":
        text = _replace(clean, (r"^https?://(?:(?:www|data)\.)?([a-z0-9-]+)\.[a-z]+.*$", "$1"), (r"\.example$", ""), (r"[-_]+", " "), (r"^(hosted )?(at|on) ", ""), (r"^the ", ""), (r" (repository|portal)$", ""), (r"[^a-z0-9]+", " "))
    elif field == "Venue Title":
        text = _replace(clean, (r"[-_]", " "), (r"^proc(eedings|\.)? of the (\d+(st|nd|rd|th)|\d\d\d\d) ", ""), (r" ?\([a-z]+ ?\d*\)", ""), (r",? pp\..*$", ""), (r"[, ]*(19|20)\d\d$", ""), (r"[’`\x27]\d\d$", ""), (r"[^a-z0-9]+", " "))
        for short, full in ABBREVIATIONS.items():
            text = _replace(text, (rf"\b{short}\b", full))
    elif field == "Tasks":
        text = _replace(clean, (r" ?\((main|[a-z][a-z][a-z]?)\)$", ""), (r" ?- ?benchmark$", ""), (r" tasks?$", ""), (r"&", " and "), (r"[^a-z0-9]+", " "))
    else:
        text = _replace(clean, (r"[^\p{{L}}\p{{N}}]+", " "))  # doubled for str.format
    return f"trim(regexp_replace({text}, ' +', ' '))"


#: The bag of word stems of a spaced form, and its compact form.
_STOP = "'on', 'of', 'the', 'for', 'in', 'and', 'a', 'de', 'by', 'to'"
_BAG = f"array_join(array_sort(transform(filter(split(form, ' '), w -> w NOT IN ({_STOP})), w -> regexp_replace(regexp_replace(w, 'ies$', 'y'), '(?<=[a-z][a-z][a-z])s$', ''))), ' ')"
_COMPACT = "regexp_replace(regexp_replace(form, r'\\b(on|of|the|for)\\b', ''), ' ', '')"


def _forms(source: str, value: str) -> str:
    cases = " ".join(f"WHEN '{f}' THEN {form_sql(f, value)}" for f in EDITS)
    return f"""
      SELECT *, {_BAG} AS bag, {_COMPACT} AS compact, concat_ws(' ', regexp_extract_all(form, r'([0-9]+(?:[.][0-9]+)?)')) AS numbers
      FROM (SELECT *, CASE field {cases} ELSE {form_sql('', value)} END AS form FROM {source})"""


def _allowed(column: str) -> str:
    """SQL for the edits allowed for a form of the field, by its length."""
    steps = lambda rows: "CASE " + " ".join(f"WHEN length({column}) >= {n} THEN {k}" for n, k in rows) + " ELSE 0 END"
    return "CASE field " + " ".join(f"WHEN '{f}' THEN {steps(rows)}" for f, rows in EDITS.items()) + f" ELSE {steps(DEFAULT_EDITS)} END"


def typed_values(gold: DataFrame) -> DataFrame:
    """``(record_id, field, pos, value)`` of every typed value; repeated records count once."""
    return gold.sparkSession.sql(
        """
        SELECT DISTINCT record_id, field, pos, value FROM (
          SELECT record_id, t.field, 0 AS pos, t.value
          FROM (SELECT record_id, explode(array(struct('License' AS field, metadata.License AS value), struct('Host' AS field, metadata.Host AS value),
                       struct('Venue Title' AS field, metadata.`Venue Title` AS value))) AS t FROM {gold})
          UNION ALL
          SELECT record_id, 'Tasks' AS field, t.pos, t.col AS value FROM {gold} LATERAL VIEW posexplode(metadata.Tasks) t AS pos, col
        ) WHERE trim(regexp_replace(value, r'[\\s ]+', ' ')) <> ''""",
        gold=gold,
    )


def _join(typed: DataFrame, ref: DataFrame) -> DataFrame:
    """``(field, value, canonical_id)`` of the typed forms that match one of the reference forms, and only one entry."""
    from tessera.session import cut_lineage

    spark = typed.sparkSession
    # equal compact forms, then equal bags of stems
    exact = spark.sql(
        """
        SELECT field, value, min(canonical_id) AS canonical_id, min(rank) AS rank FROM (
          SELECT t.field, t.value, r.canonical_id, CASE WHEN t.compact = r.compact THEN 0 ELSE 1 END AS rank
          FROM (SELECT *, explode(array(compact, concat('bag ', bag))) AS key FROM {typed}) t
          JOIN (SELECT *, explode(array(compact, concat('bag ', bag))) AS key FROM {ref}) r
          ON t.field = r.field AND t.key = r.key AND t.numbers = r.numbers
          WHERE t.compact = r.compact OR t.bag = r.bag
        ) GROUP BY field, value HAVING count(DISTINCT canonical_id) = 1 OR min(rank) = 0""",
        typed=typed,
        ref=ref,
    )
    exact = cut_lineage(exact)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: the forms are few bytes, the work on them is not
    left = spark.sql(
        f"SELECT /*+ REPARTITION({tasks}) */ DISTINCT t.field, t.value, t.compact, t.numbers, length(t.compact) AS size FROM {{typed}} t LEFT ANTI JOIN {{exact}} e ON t.field = e.field AND t.value = e.value",
        typed=typed,
        exact=exact,
    )
    segments = spark.sql(
        """
        SELECT field, canonical_id, compact, numbers, k, length(compact) AS len, seg,
               substring(compact, floor(seg * length(compact) / (k + 1)) + 1, floor((seg + 1) * length(compact) / (k + 1)) - floor(seg * length(compact) / (k + 1))) AS part
        FROM (SELECT *, explode(sequence(0, k)) AS seg FROM (SELECT DISTINCT field, canonical_id, compact, numbers, """
        + _allowed("compact")
        + " AS k FROM {ref}) WHERE k > 0)",
        ref=ref,
    )
    # which segments a text of each size is looked up by
    lengths = spark.sql(
        "SELECT DISTINCT field, len, k, seg, floor(seg * len / (k + 1)) + 1 AS start, length(part) AS width, explode(sequence(len - k, len + k)) AS size FROM {segments}", segments=segments
    )
    # every substring that could be an equal segment: of the segment's width, at most k places off
    parts = spark.sql(
        """
        SELECT DISTINCT field, value, compact, numbers, len, seg, substring(compact, at, width) AS part FROM (
          SELECT t.*, l.len, l.seg, l.width, explode(sequence(greatest(1, l.start - l.k), greatest(1, l.start + l.k))) AS at
          FROM {left} t JOIN {lengths} l ON t.field = l.field AND t.size = l.size
        ) WHERE at + width - 1 <= size""",
        left=left,
        lengths=lengths,
    )
    near = spark.sql(
        """
        SELECT DISTINCT p.field, p.value, s.canonical_id, levenshtein(p.compact, s.compact) AS edits
        FROM {parts} p JOIN {segments} s ON p.field = s.field AND p.len = s.len AND p.seg = s.seg AND p.part = s.part AND p.numbers = s.numbers
        WHERE levenshtein(p.compact, s.compact) <= s.k""",
        parts=parts,
        segments=segments,
    )
    best = spark.sql(
        """
        SELECT field, value, min(canonical_id) AS canonical_id FROM (SELECT *, min(edits) OVER (PARTITION BY field, value) AS least FROM {near})
        WHERE edits = least GROUP BY field, value HAVING count(DISTINCT canonical_id) = 1""",
        near=near,
    )
    return cut_lineage(spark.sql("SELECT field, value, canonical_id FROM {exact} UNION ALL SELECT field, value, canonical_id FROM {best}", exact=exact, best=best))


def learn_names(rows: DataFrame, forms: DataFrame, hits: DataFrame) -> DataFrame:
    """``(field, canonical_id, form, bag, compact, numbers)``: unmatched forms that other records of the same papers explain.

    ``rows`` has ``(paper_id, record_id, field, value)``. A witness is a paper where another record holds an entry that the
    records with the form don't. Forms and entries are made distinct by paper first; a paper has at most as many entries as the list.
    """
    return rows.sparkSession.sql(
        """
        WITH known AS (SELECT DISTINCT r.paper_id, r.record_id, r.field, h.canonical_id FROM {rows} r JOIN {hits} h ON r.field = h.field AND r.value = h.value WHERE r.paper_id IS NOT NULL),
        open AS (SELECT DISTINCT r.paper_id, r.record_id, r.field, f.compact FROM {rows} r JOIN {forms} f ON r.field = f.field AND r.value = f.value
                 LEFT ANTI JOIN {hits} h ON r.field = h.field AND r.value = h.value WHERE r.paper_id IS NOT NULL AND f.compact <> ''),
        own AS (SELECT DISTINCT o.paper_id, o.field, o.compact, k.canonical_id FROM open o JOIN known k ON o.record_id = k.record_id AND o.field = k.field),
        said AS (SELECT o.paper_id, o.field, o.compact, k.canonical_id FROM (SELECT DISTINCT paper_id, field, compact FROM open) o
                 JOIN (SELECT DISTINCT paper_id, field, canonical_id FROM known) k ON o.paper_id = k.paper_id AND o.field = k.field
                 LEFT ANTI JOIN own w ON w.paper_id = o.paper_id AND w.field = o.field AND w.compact = o.compact AND w.canonical_id = k.canonical_id),
        able AS (SELECT field, compact, count(DISTINCT paper_id) AS papers FROM said GROUP BY field, compact),
        sums AS (SELECT field, compact, canonical_id, count(*) AS n FROM said GROUP BY field, compact, canonical_id),
        best AS (SELECT s.field, s.compact, max_by(s.canonical_id, struct(s.n, -s.canonical_id)) AS canonical_id, max(s.n) AS most, sum(s.n) AS total, any_value(a.papers) AS papers,
                        slice(array_sort(collect_list(-s.n)), 2, 1) AS second
                 FROM sums s JOIN able a ON s.field = a.field AND s.compact = a.compact GROUP BY s.field, s.compact)
        SELECT b.field, b.canonical_id, min(f.form) AS form, min(f.bag) AS bag, b.compact, min(f.numbers) AS numbers
        FROM best b JOIN {forms} f ON b.field = f.field AND b.compact = f.compact
        WHERE b.most >= """
        + f"{SUPPORT} AND b.most >= {SHARE} * b.papers AND coalesce(-get(b.second, 0), 0) < {RIVAL} * b.most GROUP BY b.field, b.canonical_id, b.compact",
        rows=rows,
        forms=forms,
        hits=hits,
    )


def resolve_values(rows: DataFrame, reference: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """``(field, value, canonical_id)`` of the distinct values of ``rows`` ``(paper_id, record_id, field, value)``; 0 where no entry is meant.

    ``aliases`` gives other names of listed texts; there are none by default.
    """
    from tessera.session import cut_lineage

    spark = rows.sparkSession
    extra = spark.createDataFrame([(c, a) for c, names in (aliases or {}).items() for a in names] or [("", "")], "canonical string, alias string")
    ref = spark.sql(
        """
        SELECT DISTINCT field, canonical_id, form, bag, compact, numbers FROM (
        """
        + _forms("(SELECT field, canonical_id, explode(array(name, replace(lower(name), 'license', 'licence'), replace(lower(name), 'licence', 'license'), CASE WHEN canonical LIKE 'CC %' THEN concat(name, ' International') ELSE name END)) AS name FROM (SELECT field, canonical_id, canonical, explode(array_compact(flatten(array(array(canonical, short_form), aliases)))) AS name FROM (SELECT r.*, coalesce(x.aliases, array()) AS aliases FROM {reference} r LEFT JOIN (SELECT canonical, collect_list(alias) AS aliases FROM {extra} GROUP BY canonical) x USING (canonical))))", "name")
        + ") WHERE form <> ''",
        reference=reference,
        extra=extra,
    )
    ref = cut_lineage(ref)
    values = spark.sql("SELECT DISTINCT field, value FROM {rows}", rows=rows)
    typed = cut_lineage(spark.sql(_forms("{values}", "value"), values=values))
    hits = _join(typed, ref)
    names = cut_lineage(learn_names(rows, typed, hits))
    left = spark.sql("SELECT t.* FROM {typed} t LEFT ANTI JOIN {hits} h ON t.field = h.field AND t.value = h.value", typed=typed, hits=hits)
    more = _join(cut_lineage(left), names)
    return spark.sql(
        """
        SELECT t.field, t.value, coalesce(h.canonical_id, 0) AS canonical_id FROM {typed} t
        LEFT JOIN (SELECT * FROM {hits} UNION ALL SELECT * FROM {more}) h ON t.field = h.field AND t.value = h.value""",
        typed=typed,
        hits=hits,
        more=more,
    )


def resolve(gold: DataFrame, reference: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """``(record_id, field, pos, canonical_id)`` of every typed value that isn't a listed text already."""
    from tessera.session import cut_lineage

    spark = gold.sparkSession
    typed = typed_values(gold)
    papers = spark.sql("SELECT DISTINCT record_id, paper_id FROM {gold}", gold=gold)
    rows = cut_lineage(spark.sql("SELECT t.*, p.paper_id FROM {typed} t LEFT JOIN {papers} p USING (record_id)", typed=typed, papers=papers))
    found = resolve_values(rows, reference, aliases)
    return spark.sql(
        """
        SELECT DISTINCT r.record_id, r.field, r.pos, m.canonical_id FROM {rows} r JOIN {found} m ON r.field = m.field AND r.value = m.value
        LEFT ANTI JOIN {reference} c ON r.field = c.field AND r.value = c.canonical""",
        rows=rows,
        found=found,
        reference=reference,
    )
