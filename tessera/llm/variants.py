"""Variant spellings of persons and organisations, by merge-and-rematch resolution.

A typed string is read into a form: what it is blocked by (the given name, or the
kind of organisation) and the skeleton of its own name, one writing for spellings
that differ by case, accents, order, titles, footnotes or transliteration. Equal
forms are one record from the start. Then rounds of blocking, merging and
rematching follow:

* every form enters the blocks of its skeleton with up to two letters left out (a
  skeleton of over ``LONGEST`` letters those of its ends and its middle, of which two
  slips leave one whole), and the blocks of the papers it stands on;
* in each block it is compared with every other form of the block, once, by the
  built-in ``levenshtein``; so a block with many forms costs their number squared;
* matched records merge, the poorer into the nearest richer: the union of their forms,
  papers and counts is the new record, whose weight counts in the next round;
* rounds go on until none merges.

Names with initials only match every full name with that surname and initial. Where
there is one, they join it; where there are several, each string joins those that
stand on one of its papers, so one such string may name two persons without
merging them.

Everything is joined and counted on distinct strings; a string that fills a third of
all rows is one row. Only the list of the most connected given names (at most
``LEXICON`` tokens) is brought to the driver.

Defined results of the edge cases: null and blank strings are left out, also inside
lists; repeated records and strings count once; strings are compared exactly as
typed, so two that differ only in white space are a pair; strings without any Latin
letter are equal only to themselves up to case and white space; empty tables give no
pairs; texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import names
from tessera.session import cut_lineage

LEXICON, LONGEST, PART = 500, 24, 8
PARSED = "kind string, name string, n long, grp string, initial string, sk string"


def occurrences(gold: DataFrame) -> DataFrame:
    """``(kind, name, paper_id)`` of every typed string, once."""
    person = gold.select(F.lit("person").alias("kind"), F.explode("metadata.Authors").alias("name"), "paper_id")
    places = F.concat(F.coalesce("metadata.Affiliations", F.array().cast("array<string>")), F.coalesce("metadata.Provider", F.array().cast("array<string>")))
    organisation = gold.select(F.lit("organisation").alias("kind"), F.explode(places).alias("name"), "paper_id")
    both = person.unionByName(organisation)
    return both.where(F.col("name").isNotNull() & (F.regexp_replace("name", r"[\s ​]+", "") != "")).distinct()


def lexicon(strings: DataFrame) -> frozenset[str]:
    """The tokens that stand before most different names: given names, at most ``LEXICON`` of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["name"]:
                head, tail, comma = names.person_tokens(name)
                if not comma and len(head) == 2 and not head[0].isupper():
                    rows.append((head[0].lower().replace("-", ""), head[1].lower()))
            yield pd.DataFrame(rows, columns=["token", "partner"])

    pairs = strings.where("kind = 'person'").select("name").mapInPandas(run, "token string, partner string").where("length(token) > 1")
    counted = pairs.groupBy("token").agg(F.countDistinct("partner").alias("n")).orderBy(F.desc("n"), "token").limit(LEXICON).collect()
    most = max((r.n for r in counted), default=0)
    return frozenset(r.token for r in counted if r.n >= max(8, most / 10))


def parse(strings: DataFrame, known: frozenset[str]) -> DataFrame:
    """The form of every string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grp, initial, sk = [], [], []
            for kind, name in zip(batch["kind"], batch["name"]):
                g, i, s = names.person(name, known) if kind == "person" else (lambda x: (x[0], "", x[1]))(names.organisation(name))
                if not s:
                    g, i, s = "=", "", " ".join(name.casefold().split())
                elif kind != "person":
                    g = g or "-"
                grp.append(g)
                initial.append(i)
                sk.append(s)
            yield batch.assign(grp=grp, initial=initial, sk=sk)

    return strings.mapInPandas(run, PARSED)


def _without_one(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def block_keys(sk: Column) -> Column:
    """Keys of which two skeletons within two edits share one: ``sk`` with none, one or two letters left out, or, of long ones, its parts.

    Two edits leave the first ``PART`` letters whole, or the last, or the next to the first, which then stand at most one place off.
    Skeletons near the border have both kinds of keys.
    """
    ones = _without_one(sk)
    twos = F.when(F.length(sk) >= 8, F.flatten(F.transform(ones, _without_one))).otherwise(F.array().cast("array<string>"))
    near = F.array_distinct(F.concat(F.array(sk), ones, twos))
    whole = F.when((F.length(sk) < 5) | (F.length(sk) > LONGEST), F.array(sk)).otherwise(near)
    ends = [F.concat(F.lit("<"), F.left(sk, F.lit(PART))), F.concat(F.lit(">"), F.right(sk, F.lit(PART)))]
    middle = [F.concat(F.lit("="), F.substring(sk, PART + 1 + off, PART)) for off in (-1, 0, 1)]
    parts = F.when(F.length(sk) > LONGEST - 2, F.array(*ends, *middle)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(whole, parts))


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` by ``b`` on block keys. A skeleton has up to hundreds of keys, which the planner's sizes leave out, so neither side is sent through the driver."""
    return a.hint("merge").join(b.hint("merge"), "key")


def candidates(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """``(f, a, b, c)``: forms with initials only ``(f, initial, sk)`` and the records ``(initial, sk, c)`` that share a block with them."""
    keyed = lambda df, *cols: df.select(*cols, F.explode(F.transform(block_keys(F.col("sk")), lambda k: F.xxhash64("initial", k))).alias("key"))
    return _met(keyed(wanted, "f", F.col("sk").alias("a")), keyed(records, F.col("sk").alias("b"), "c")).select("f", "a", "b", "c").distinct()


def _letters(c: Column) -> Column:
    return F.array_sort(F.split(c, ""))


def _slip(a: Column, b: Column) -> Column:
    d, short = F.levenshtein(a, b), F.least(F.length(a), F.length(b))
    room = F.when(short >= 8, 2).when(short >= 5, 1).otherwise(0)
    return (d <= room) | ((d <= room + 2) & (short >= 7) & (_letters(a) == _letters(b)))


def _close(a: Column, b: Column, on_paper: Column) -> Column:
    """Whether :func:`_same` can hold at any weights."""
    return _slip(a, b) | on_paper & (F.levenshtein(a, b) <= F.floor(F.least(F.length(a), F.length(b)) * 0.34))


def _same(a: Column, b: Column, on_paper: Column, weight: Column, hub_weight: Column) -> Column:
    """Whether two skeletons of one group are spellings of one name."""
    d, short = F.levenshtein(a, b), F.least(F.length(a), F.length(b))
    slip = _slip(a, b)
    rare = (weight <= 2) | (weight * 5 <= hub_weight) | (d <= 1) & (weight * 3 <= hub_weight)
    return F.when(on_paper, slip | (d <= F.floor(short * 0.34))).otherwise(slip & rare)


def _components(parents: DataFrame) -> DataFrame:
    """``(c, root)`` of clusters that point to a richer one, by pointer doubling."""
    state = cut_lineage(parents.select("c", F.col("parent").alias("root")))
    while True:
        up = state.select(F.col("c").alias("root"), F.col("root").alias("above"))
        nxt = cut_lineage(state.join(up, "root", "left").select("c", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        state = nxt.select("c", "root")
        if not nxt.where("moved").limit(1).count():
            return state


def resolve_full(forms: DataFrame, form_papers: DataFrame) -> DataFrame:
    """``(f, c)``: the record of every form with a group, merged and rematched until nothing changes."""
    near = forms.select("f", "sk", F.lit(False).alias("on_paper"), F.explode(F.transform(block_keys(F.col("sk")), lambda k: F.xxhash64("kind", "grp", k))).alias("key"))
    paper = form_papers.join(forms, "f").select("f", "sk", F.lit(True).alias("on_paper"), F.xxhash64("kind", "grp", F.lit("paper"), "paper_id").alias("key"))
    both = near.unionByName(paper)
    # a block of one form can match nothing, now or later
    shared = both.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    blocks = cut_lineage(_met(both, shared))
    members = cut_lineage(forms.select("f", "n", F.col("f").alias("c")))
    # every two forms of a block that are near enough to be one name at some weight; which merge is told by the weights of each round
    a, b = blocks.select("key", "on_paper", F.col("f").alias("fa"), F.col("sk").alias("ska")), blocks.select("key", F.col("f").alias("fb"), F.col("sk").alias("skb"))
    near = a.join(b, "key").where(F.col("fa") < F.col("fb")).where(_close(F.col("ska"), F.col("skb"), F.col("on_paper")))
    edges = cut_lineage(near.groupBy("fa", "fb", "ska", "skb").agg(F.max("on_paper").alias("on_paper")))
    while True:
        weights = members.groupBy("c").agg(F.sum("n").alias("w"))
        held = cut_lineage(members.join(weights, "c").select("f", "c", "w"))
        side = lambda x: held.select(F.col("f").alias("f" + x), F.struct("w", "c").alias("r" + x))
        pairs = edges.join(side("a"), "fa").join(side("b"), "fb").where("ra.c != rb.c").select("ska", "skb", "on_paper", F.least("ra", "rb").alias("low"), F.greatest("ra", "rb").alias("h"))
        good = pairs.where(_same(F.col("ska"), F.col("skb"), F.col("on_paper"), F.col("low.w"), F.col("h.w")))
        parents = good.groupBy(F.col("low.c").alias("c")).agg(F.min(F.struct(F.levenshtein("ska", "skb").alias("d"), (-F.col("h.w")).alias("v"), F.col("h.c").alias("parent"))).alias("p")).select("c", "p.parent")
        parents = cut_lineage(parents)
        if not parents.limit(1).count():
            break
        moved = _components(parents)
        members = cut_lineage(members.join(moved, "c", "left").select("f", "n", F.coalesce("root", "c").alias("c")))
    return members.select("f", "c")


def memberships(gold: DataFrame) -> DataFrame:
    """``(kind, name, entity)``: which entities each typed string names."""
    seen = cut_lineage(occurrences(gold))
    strings = cut_lineage(seen.groupBy("kind", "name").agg(F.count("*").alias("n")))
    parsed = parse(strings, lexicon(strings)).withColumn("f", F.xxhash64("kind", "grp", F.when(F.col("grp") == "", F.col("initial")).otherwise(""), "sk"))
    parsed = cut_lineage(parsed)
    full, short = parsed.where("grp <> ''"), parsed.where("grp = ''")
    forms = full.groupBy("f", "kind", "grp", "sk").agg(F.sum("n").alias("n"), F.min("initial").alias("initial"))
    where = seen.join(full.select("kind", "name", "f"), ["kind", "name"]).select("f", "paper_id").where(F.col("paper_id").isNotNull()).distinct()
    records = cut_lineage(resolve_full(cut_lineage(forms), cut_lineage(where)))
    of_full = full.join(records, "f").select("kind", "name", F.concat(F.lit("e"), F.col("c").cast("string")).alias("entity"))

    # initials: every full name with that surname (or one close to it) and initial
    entity_forms = full.where("kind = 'person'").select("f", "initial", "sk").distinct().join(records, "f").select("initial", "sk", "c").distinct()
    found = candidates(short.select("f", "initial", "sk").distinct(), entity_forms)
    d, least = F.levenshtein("a", "b"), F.least(F.length("a"), F.length("b"))
    ranked = found.where((d <= F.when(least >= 8, 2).when(least >= 5, 1).otherwise(0)) | ((d <= 4) & (least >= 8) & (_letters(F.col("a")) == _letters(F.col("b"))))).groupBy("f", "c").agg(F.min(d).alias("d"))
    ranked = cut_lineage(ranked)
    nearest = ranked.groupBy("f").agg(F.min("d").alias("d")).join(ranked, ["f", "d"]).groupBy("f").agg(F.count("*").alias("m"), F.min("c").alias("c"))
    alone = nearest.where("m = 1")
    sure = short.join(alone, "f").select("kind", "name", "c")
    entity_papers = where.join(records, "f").select("c", "paper_id").distinct()
    at = seen.join(short.select("kind", "name", "f"), ["kind", "name"])
    shown = at.join(ranked, "f").join(entity_papers, ["c", "paper_id"]).select("kind", "name", "paper_id", "c").distinct()
    shown = cut_lineage(shown)
    on_papers = shown.select("kind", "name", "c").distinct()
    # a string seen beside another entity on each of its papers does not join the nearest one
    firm = sure.join(at.join(shown.select("kind", "name", "paper_id").distinct(), ["kind", "name", "paper_id"], "left_anti").select("kind", "name").distinct(), ["kind", "name"], "left_semi").unionByName(sure.join(on_papers, ["kind", "name", "c"], "left_semi"))
    joined = firm.unionByName(on_papers).distinct().select("kind", "name", F.concat(F.lit("e"), F.col("c").cast("string")).alias("entity"))
    # the rest: equal forms without a full name are one; of several full names, only strings on one paper are
    rest = at.join(joined.select("kind", "name").distinct(), ["kind", "name"], "left_anti").join(nearest.select("f", "m"), "f", "left")
    alike = F.concat(F.lit("i"), F.col("f").cast("string"), F.when(F.col("m").isNotNull(), F.concat(F.lit("|"), F.coalesce("paper_id", F.lit("")))).otherwise(""))
    return of_full.unionByName(joined).unionByName(rest.select("kind", "name", alike.alias("entity")).distinct())


def links(gold: DataFrame) -> DataFrame:
    """``(kind, name_a, name_b)``: every two strings that name one entity, in code point order."""
    held = cut_lineage(memberships(gold))
    other = held.select("kind", F.col("name").alias("name_b"), "entity")
    return held.withColumnRenamed("name", "name_a").join(other, ["kind", "entity"]).where("name_a < name_b").select("kind", "name_a", "name_b").distinct()
