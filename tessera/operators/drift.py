"""Schemas that drift between the files of a feed: find each change, unify the records.

Every file is profiled in one pass: for each field the types of its values and
a value sketch, which holds a hash of the value of each of the ``SKETCH``
records with the smallest key hashes. As the sample is coordinated by the key,
two files that repeat the same keys keep the same ones, so their sketches can be
compared key by key. Between a file and the one before it a maximum-weight
bipartite matching over sketches, types and names decides which fields are the
same; what stays unmatched was added or removed.

Only profiles are shuffled, never bodies. Their size is bounded by the number
of fields of a file and ``SKETCH``, and the files of a feed are ordered by a
window over ids alone, so a feed that holds a third of all files is no hot spot
for the comparison, which is distributed by file.

Defined results of the edge cases: the first file of a feed has no changes; a
file whose body is null, blank or entirely broken has no fields, and takes no
part (the next file is compared with the one before it); broken lines, lines
that are not objects, and files without id, feed or time are skipped; null and
empty values tell nothing of a type or a value; ties of ``written_at`` (none
are expected) are broken by the file id; repeated files count once; an empty
table has no changes. Lists count as lists of objects if any element is one.
"""

from __future__ import annotations

import difflib
import heapq
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage, written

#: Records of a file whose values its sketches hold.
SKETCH = 512
#: Least share of agreeing shared records, and least number of them, for two fields to be the same.
AGREE, LEAST = 0.6, 2
KEY_FIELD = "Paper Link"
NESTED = "Subsets"
#: Fields that the elements of the nested list are known by.
NESTED_KEYS = frozenset(("name", "volume", "unit", "dialect", "language"))

#: The sketch of a field is packed: 64-bit hashes, and for each record the number of its atoms in 32 bits.
PROFILE = "file_id long, field string, nested boolean, kind string, keys binary, whole binary, sizes binary, atoms binary"
CHANGES = "file_id long, field string, change string"
LINKS = "file_id long, prev_file_id long, nested boolean, field string, prev_field string, change string"


def kind(value: object) -> str | None:
    """The type of a value; None for what tells nothing (null, an empty list)."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    held = [x for x in value if x is not None]
    if not held:
        return None
    return "list of objects" if any(isinstance(x, dict) for x in held) else "list of strings"


_NUMBER = re.compile(r"[+-]?\d{1,3}(,\d{3})+(\.\d+)?|[+-]?\d+(\.\d+)?([eE][+-]?\d+)?")


def _atom(text: str) -> str | None:
    text = text.strip()
    if _NUMBER.fullmatch(text):
        return repr(float(text.replace(",", "")))
    return text.casefold() or None


def atoms(value: object) -> set[str]:
    """What a value says, whatever its type: scalars in one writing, of objects keys and values,
    of strings the parts between separators."""
    if value is None:
        return set()
    if isinstance(value, bool):
        return {str(value).casefold()}
    if isinstance(value, (int, float)):
        return {repr(float(value))}
    if isinstance(value, str):
        if _NUMBER.fullmatch(value.strip()):
            return {_atom(value)}
        parts = (y for x in re.split(r"[;:]|,\s", value) for y in (x.split() if re.match(r"\s*[\d.,]+ \S", x) else [x]))
        return {a for y in parts if (a := _atom(y))}
    if isinstance(value, dict):
        return {a for k, v in value.items() for x in (k, v) for a in atoms(x)}
    return {a for x in value for a in atoms(x)}


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def records(body: str | None) -> Iterator[dict]:
    """The records of a body: one array, one object, or one object a line; broken lines are skipped."""
    if not body or not body.strip():
        return
    try:
        whole = json.loads(body)
    except (ValueError, RecursionError):
        for line in body.splitlines():
            try:
                x = json.loads(line)
            except (ValueError, RecursionError):
                continue
            yield from (y for y in (x if isinstance(x, list) else [x]) if isinstance(y, dict))
        return
    yield from (x for x in (whole if isinstance(whole, list) else [whole]) if isinstance(x, dict))


def _is_nested_list(name: str, value: object) -> bool:
    if not isinstance(value, list):
        return False
    held = [x for x in value if isinstance(x, dict)]
    return bool(held) and (name.casefold() == NESTED.casefold() or any(NESTED_KEYS & {k.casefold() for k in x} for x in held))


def profile(body: str | None, key_field: str = KEY_FIELD) -> list[tuple]:
    """``(field, nested, kind, keys, whole, sizes, atoms)`` of every field of one body; the kind is the type of most of its values."""
    kinds: dict[tuple[str, bool], Counter] = defaultdict(Counter)
    kept: dict[tuple[str, bool], dict[int, set[str]]] = defaultdict(dict)
    sample: list[int] = []  # the largest of the kept key hashes first
    held: set[int] = set()

    def see(name: str, inner: bool, key: int | None, value: object) -> None:
        kinds[name, inner][kind(value) or ""] += 1
        if key is not None and (a := atoms(value)):
            kept[name, inner][key] = a

    for record in records(body):
        paper = record.get(key_field)
        key = None
        if isinstance(paper, str) and paper.strip():
            key = _hash(paper.strip())
            if key not in held:
                if len(sample) < SKETCH:
                    heapq.heappush(sample, -key)
                    held.add(key)
                elif -sample[0] > key:
                    out = -heapq.heapreplace(sample, -key)
                    held.remove(out)
                    held.add(key)
                    for values in kept.values():
                        values.pop(out, None)
                else:
                    key = None
        for name, value in record.items():
            if name == key_field:
                kinds[name, False][kind(value) or ""] += 1
                continue
            see(name, False, key, value)
            if _is_nested_list(name, value):
                inner_values: dict[str, list] = defaultdict(list)
                for pos, x in enumerate(value):
                    if isinstance(x, dict):
                        for k, v in x.items():
                            kinds[k, True][kind(v) or ""] += 1
                            inner_values[k] += (f"{pos}:{a}" for a in atoms(v))
                if key is not None:
                    for k, v in inner_values.items():
                        if v:
                            kept[k, True][key] = set(v)
    out = []
    for (name, inner), c in kinds.items():
        values = kept.get((name, inner), {})
        told = [sorted(map(_hash, a)) for a in values.values()]
        whole = [x[0] if len(x) == 1 else _hash(repr(x)) for x in told]
        pack = lambda numbers, kind_: np.array(numbers, dtype=kind_).tobytes()
        out.append((name, inner, main_kind(c), pack(list(values), "int64"), pack(whole, "int64"), pack(list(map(len, told)), "int32"), pack([h for x in told for h in x], "int64")))
    return out


def profiles(files: DataFrame, key_field: str = KEY_FIELD) -> DataFrame:
    """The profile of every field of every file; narrow, one pass over the bodies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(file_id, *x) for file_id, body in zip(batch["file_id"], batch["body"]) for x in profile(body if isinstance(body, str) else None, key_field)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PROFILE.split(", ")])

    return files.select("file_id", "body").mapInPandas(run, PROFILE)


def main_kind(kinds: dict[str, int]) -> str | None:
    """The type that most values of a field have, of those that tell one."""
    told = [(n, k) for k, n in kinds.items() if k]
    return max(told)[1] if told else None


class Values:
    """The sketch of one field: record keys, one hash for each record's whole value, and the hashes of its atoms."""

    def __init__(self, keys: bytes, whole: bytes, sizes: bytes, told: bytes) -> None:
        self.keys, self.whole, self.packed = np.frombuffer(keys, "int64"), np.frombuffer(whole, "int64"), (sizes, told)
        self.sets: list[frozenset] | None = None

    def __len__(self) -> int:
        return len(self.keys)

    def told(self, i: int) -> frozenset:
        """The atoms of record ``i``, unpacked when first asked for."""
        if self.sets is None:
            cuts = np.cumsum(np.frombuffer(self.packed[0], "int32"))[:-1]
            self.sets = [frozenset(x.tolist()) for x in np.split(np.frombuffer(self.packed[1], "int64"), cuts)]
        return self.sets[i]


def agreement(a: Values, b: Values, kind_a: str | None, kind_b: str | None) -> tuple[float, int]:
    """Mean likeness of two fields over the records both sketches hold, and their number.

    The same type: the values must be equal. Another type: the lesser set of
    atoms must lie within the greater; only then are atoms looked at.
    """
    shared, at_a, at_b = np.intersect1d(a.keys, b.keys, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0, 0
    if kind_a == kind_b and kind_a not in ("object", "list of objects"):
        return float((a.whole[at_a] == b.whole[at_b]).mean()), len(shared)
    total = 0.0
    for i, j in zip(at_a, at_b):
        x, y = a.told(i), b.told(j)
        total += len(x & y) / min(len(x), len(y))
    return total / len(shared), len(shared)


def assign(weights: list[list[float]]) -> list[int]:
    """Maximum-weight bipartite matching (shortest augmenting paths); the column of each row, -1 for none.

    Pairs of weight 0 are never matched.
    """
    if not weights or not weights[0]:
        return [-1] * len(weights)
    n, m = len(weights), len(weights[0])
    size = max(n, m)
    cost = [[-(weights[i][j] if i < n and j < m else 0.0) for j in range(size)] for i in range(size)]
    u, v, match = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        least, used, way = [float("inf")] * (size + 1), [False] * (size + 1), [0] * (size + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, size + 1):
                if not used[j]:
                    reduced = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(size + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, size + 1):
        i = match[j] - 1
        if i < n and j - 1 < m and weights[i][j - 1] > 0:
            out[i] = j - 1
    return out


def _weight(old: tuple, new: tuple) -> float:
    """How likely ``new`` is the same field as ``old``; 0 if it is not."""
    (name_a, kind_a, vals_a), (name_b, kind_b, vals_b) = old, new
    share, n = agreement(vals_a, vals_b, kind_a, kind_b)
    if name_a == name_b:
        # the same name is the same field, unless its values moved to another
        return 1.2 + share if n < LEAST or share >= AGREE else 0.3
    if n == 0:
        # no values to compare: only another writing of the same name
        same = re.sub(r"[\W_]", "", name_a.casefold()) == re.sub(r"[\W_]", "", name_b.casefold())
        return 0.2 if same and (kind_a == kind_b or None in (kind_a, kind_b)) else 0.0
    if share < AGREE:
        return 0.0
    likeness = difflib.SequenceMatcher(None, name_a.casefold(), name_b.casefold()).ratio()
    if (n < LEAST and likeness < 0.5 and min(len(vals_a), len(vals_b)) > n):
        return 0.0
    return share + 0.3 * likeness + (0.1 if kind_a == kind_b else 0.0)


def compare(old: list[tuple], new: list[tuple]) -> list[tuple[str | None, str | None, str | None, str | None]]:
    """``(old name, new name, old kind, new kind)`` of every field of either file; None where it has no partner."""
    by_old, by_new = {x[0]: x for x in old}, {x[0]: x for x in new}
    pairs: list[tuple] = []
    for a in sorted(by_old.keys() & by_new.keys()):
        share, n = agreement(by_old[a][2], by_new[a][2], by_old[a][1], by_new[a][1])
        if n < LEAST or share >= AGREE:
            pairs.append((by_old.pop(a), by_new.pop(a)))
    left, right = sorted(by_old.values(), key=lambda x: x[0]), sorted(by_new.values(), key=lambda x: x[0])
    chosen = assign([[_weight(x, y) for y in right] for x in left])
    pairs += ((x, right[j] if j >= 0 else None) for x, j in zip(left, chosen))
    pairs += ((None, y) for j, y in enumerate(right) if j not in set(chosen))
    return [(x and x[0], y and y[0], x and x[1], y and y[1]) for x, y in pairs]


def _between(key: tuple, part: list[tuple]) -> list[tuple]:
    """The links of one pair of files, ``key`` being ``(target, prev_file_id, nested)``."""
    sides: dict[bool, list[tuple]] = {True: [], False: []}
    for current, field, kind_, *packed in part:
        sides[bool(current)].append((field, kind_, Values(*packed)))
    if not sides[False] or not sides[True]:
        return []
    rows = []
    for a, b, kind_a, kind_b in compare(sides[False], sides[True]):
        if a is None:
            found = ["added"]
        elif b is None:
            found = ["removed"]
        else:
            found = ["renamed"] * (a != b) + ["retyped"] * (None not in (kind_a, kind_b) and kind_a != kind_b) or ["same"]
        rows += ((*key, b, a, c) for c in found)
    return rows


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of all pairs of files of a partition, whose rows come sorted by pair: one stream, without a call for each pair."""
    key, part = None, []
    for batch in batches:
        rows: list[tuple] = []
        for row in zip(*(batch[c] for c in ("target", "prev_file_id", "nested", "current", "field", "kind", "keys", "whole", "sizes", "atoms"))):
            if row[:3] != key:
                rows += _between(key, part) if part else []
                key, part = row[:3], []
            part.append(row[3:])
        yield _as_links(rows)
    yield _as_links(_between(key, part) if part else [])


def _as_links(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["file_id", "prev_file_id", "nested", "field", "prev_field", "change"])


def _dated_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("file_id").isNotNull() & F.col("feed").isNotNull() & F.col("written_at").isNotNull())


def links(files: DataFrame, key_field: str = KEY_FIELD) -> DataFrame:
    """Every field of a file beside the field of the earlier file that it continues, with the kind of change.

    The lists' inner fields (``nested``) are compared with the latest earlier
    file of the feed in which the nested list held objects.
    """
    usable = _dated_files(files)
    # rows of one file are copies: one of each field is kept, which are small rows; bodies are read and profiled once
    prof = written(profiles(usable, key_field).dropDuplicates(["file_id", "nested", "field"]))
    heads = usable.select("file_id", "feed", "written_at").distinct()
    has = prof.groupBy("file_id").agg(F.max("nested").alias("has_nested"), F.min("nested").alias("_n"))
    order = Window.partitionBy("feed").orderBy("written_at", "file_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    steps = (
        heads.join(has, "file_id")
        .withColumn("prev_flat", F.lag("file_id").over(order))
        .withColumn("prev_nested", F.last(F.when(F.col("has_nested"), F.col("file_id")), ignorenulls=True).over(before))
        .select("file_id", F.explode(F.array(F.struct(F.lit(False).alias("nested"), F.col("prev_flat").alias("prev_file_id")), F.struct(F.lit(True).alias("nested"), F.when(F.col("has_nested"), F.col("prev_nested")).alias("prev_file_id")))).alias("_s"))
        .select("file_id", "_s.*")
        .where(F.col("prev_file_id").isNotNull())
    )
    roles = steps.select(F.col("file_id").alias("of"), "nested", F.lit(True).alias("current"), F.col("file_id").alias("target"), "prev_file_id").unionByName(
        steps.select(F.col("prev_file_id").alias("of"), "nested", F.lit(False).alias("current"), F.col("file_id").alias("target"), "prev_file_id")
    )
    sides = prof.withColumnRenamed("file_id", "of").join(roles, ["of", "nested"])
    together = sides.repartition(F.col("target")).sortWithinPartitions("target", "nested", "prev_file_id")
    return together.mapInPandas(_pairs, LINKS)


def reported_name(nested: Column, name: Column) -> Column:
    return F.when(nested, F.concat(F.lit(f"{NESTED}."), name)).otherwise(name)


def changes(files: DataFrame, key_field: str = KEY_FIELD) -> DataFrame:
    """One row for each change: ``(file_id, field, change)``; the name is the earlier one, for ``added`` the new one."""
    found = links(files, key_field).where(F.col("change") != "same")
    return found.select("file_id", reported_name(F.col("nested"), F.coalesce("prev_field", "field")).alias("field"), "change")


#: Columns of the unified table and the type each value is brought to.
UNIFIED = {
    "Name": "string", "License": "string", "Year": "int", "Language": "list", "Dialect": "list", "Domain": "list", "Script": "list",
    "Volume": "double", "Unit": "string", "Tokenized": "boolean", "Subsets": "subsets",
}
#: The same of the elements of the nested list.
INNER = {"Name": "string", "Volume": "double", "Unit": "string", "Dialect": "string", "Language": "string"}
_SQL = {"list": "array<string>", "subsets": "array<struct<Name:string,Volume:double,Unit:string,Dialect:string,Language:string,other:map<string,string>>>"}


def roots(found: DataFrame) -> DataFrame:
    """``(file_id, nested, field, root)``: the name under which each field first came in its feed.

    Pointer doubling over the links: a chain of n files takes log2(n) rounds.
    """
    nodes = (
        found.where(F.col("field").isNotNull())
        .groupBy("file_id", "nested", "field")
        .agg(F.min("prev_field").alias("up_field"), F.min(F.when(F.col("prev_field").isNotNull(), F.col("prev_file_id"))).alias("up_file"))
    )
    # the first file of a chain is only ever named as the earlier side
    first = found.where(F.col("prev_field").isNotNull()).select(F.col("prev_file_id").alias("file_id"), "nested", F.col("prev_field").alias("field")).distinct()
    first = first.join(nodes, ["file_id", "nested", "field"], "left_anti").withColumn("up_field", F.lit(None).cast("string")).withColumn("up_file", F.lit(None).cast("long"))
    state = cut_lineage(nodes.unionByName(first).select("file_id", "nested", "field", F.coalesce("up_file", "file_id").alias("up_file"), F.coalesce("up_field", "field").alias("up_field")))
    while True:
        up = state.select(F.col("file_id").alias("up_file"), "nested", F.col("field").alias("up_field"), F.col("up_file").alias("n_file"), F.col("up_field").alias("n_field"))
        joined = state.join(up, ["up_file", "nested", "up_field"], "left")
        nxt = cut_lineage(joined.select("file_id", "nested", "field", F.coalesce("n_file", "up_file").alias("up_file"), F.coalesce("n_field", "up_field").alias("up_field"), (F.col("n_file") != F.col("up_file")).alias("moved")))
        state = nxt.drop("moved")
        if not nxt.where("moved").limit(1).count():
            break
    return state.select("file_id", "nested", "field", F.col("up_field").alias("root"))


def standard_names(found: DataFrame, root: DataFrame, known: tuple[str, ...] = tuple(UNIFIED), inner: tuple[str, ...] = tuple(INNER)) -> DataFrame:
    """``(file_id, nested, field, name)``: the root, or, where a feed began under another name, the known name it is most often renamed from or to."""
    pairs = found.where(F.col("change") == "renamed")
    both = pairs.select("nested", F.col("prev_field").alias("root"), F.col("field").alias("name")).unionByName(pairs.select("nested", F.col("field").alias("root"), F.col("prev_field").alias("name")))
    is_known = lambda c: F.when(F.col("nested"), F.col(c).isin(*inner)).otherwise(F.col(c).isin(*known))
    best = (
        both.where(is_known("name") & ~is_known("root"))
        .groupBy("nested", "root", "name").count()
        .groupBy("nested", "root").agg(F.max_by("name", F.struct("count", "name")).alias("name"))
    )
    return root.join(best, ["nested", "root"], "left").select("file_id", "nested", "field", F.coalesce("name", "root").alias("name"))


def _coerce(value: object, to: str) -> tuple[object, bool]:
    """A value brought to a type, and whether nothing of it was lost."""
    if value is None:
        return None, True
    if isinstance(value, dict):
        if len(value) != 1:
            return _coerce(value.get("label", next(iter(value.values()), None)), to)[0], False
        value = next(iter(value.values()))
    if to == "list":
        items = value if isinstance(value, list) else re.split(r",\s", value) if isinstance(value, str) else [value]
        flat = [x for x in items if not isinstance(x, (dict, list))]
        return [str(x) for x in flat if x is not None and str(x).strip()], len(flat) == len(items)
    if isinstance(value, list):
        return (_coerce(value[0], to)[0], len(value) == 1) if value else (None, True)
    try:
        if to == "double":
            return float(str(value).replace(",", "")), True
        if to == "int":
            number = float(str(value).replace(",", ""))
            return int(number), number == int(number)
        if to == "boolean":
            got = {"true": True, "false": False}.get(str(value).strip().casefold())
            return got, got is not None
    except (ValueError, OverflowError):
        return None, False
    return str(value), True


def _placed(record: dict, to: dict[str, str], types: dict[str, str]) -> tuple[list, dict[str, str]]:
    """The values of the known columns, and the JSON of everything that has no place in them or doesn't fit one."""
    held: dict[str, tuple[str, object]] = {}
    rest: dict[str, object] = {}
    for k, v in record.items():
        name = to.get(k, k)
        if name in types and (name not in held or held[name][1] is None):
            held[name] = (k, v)
        elif v is not None or name not in types:
            rest[k] = v
    wide = []
    for name, kind_ in types.items():
        k, v = held.get(name, (name, None))
        got, whole = (_subsets(v, to) if kind_ == "subsets" else _coerce(v, kind_))
        wide.append(got)
        if not whole:
            rest[k] = v
    return wide, {k: json.dumps(v, ensure_ascii=False) for k, v in rest.items()}


def _subsets(value: object, to: dict[str, str]) -> tuple[list[dict] | None, bool]:
    if value is None:
        return None, True
    whole = True
    if isinstance(value, str):
        parts = [x for x in value.split(";") if x.strip()]
        whole = all(":" in x for x in parts)
        value = dict(x.split(":", 1) for x in parts if ":" in x)
    if isinstance(value, dict):
        value = [{"Name": k.strip(), **(v if isinstance(v, dict) else dict(zip(("Volume", "Unit"), str(v).split(None, 1))))} for k, v in value.items()]
    out = []
    for x in value if isinstance(value, list) else [value]:
        x = {"Name": x} if isinstance(x, str) else x
        if isinstance(x, dict):
            wide, rest = _placed(x, {k[len(NESTED) + 1 :]: v for k, v in to.items() if k.startswith(f"{NESTED}.")}, INNER)
            out.append({**dict(zip(INNER, wide)), "other": rest})
        else:
            whole = whole and x is None
    return out, whole


def unify(files: DataFrame, key_field: str = KEY_FIELD) -> DataFrame:
    """One row for each record of every file, with the same columns and types whatever the file's layout was.

    Renamed fields, and renamed fields inside ``Subsets``, go by the links found between the files. Nothing is lost: fields outside
    ``UNIFIED``, a second field for a taken column, and values that the column's type can't hold as a whole (several elements
    for one value, an object for its label, text for a number) are kept as JSON text in the map ``other``, that of the record or of the subset. A
    repeated file counts once. A broken or null body has no records.
    """
    found = cut_lineage(links(files, key_field))
    named = standard_names(found, roots(found)).where("field <> name")
    full = F.when(F.col("nested"), F.concat(F.lit(f"{NESTED}."), "field")).otherwise(F.col("field"))
    names = named.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct(full, "name"))).alias("names"))  # fields of one file
    one = _dated_files(files).dropDuplicates(["file_id"]).select("file_id", "feed", "written_at", "body")
    fields = ", ".join(f"`{n}` {_SQL.get(t, t)}" for n, t in UNIFIED.items())
    schema = f"file_id long, feed string, written_at timestamp, record_pos int, `{key_field}` string, {fields}, other map<string,string>"
    columns = ["file_id", "feed", "written_at", "record_pos", key_field, *UNIFIED, "other"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, feed, at, body, names_ in zip(batch["file_id"], batch["feed"], batch["written_at"], batch["body"], batch["names"]):
                to = dict(names_) if names_ is not None else {}
                for pos, record in enumerate(records(body if isinstance(body, str) else None)):
                    paper = record.get(key_field)
                    wide, rest = _placed({k: v for k, v in record.items() if k != key_field}, to, UNIFIED)
                    rows.append((file_id, feed, at, pos, None if paper is None else str(paper), *wide, rest))
            out = pd.DataFrame(rows, columns=columns, dtype=object)
            yield out.astype({"file_id": "int64", "record_pos": "int32"}) if rows else out

    return one.join(names, "file_id", "left").mapInPandas(run, schema)
