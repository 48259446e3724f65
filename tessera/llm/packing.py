"""Filling containers of a fixed capacity with texts, by swap-based local search.

Sizes are tokens of a public tokenizer. A text longer than a container is cut
into whole containers and a rest; nothing else is ever split. All remaining items
are spread by a hash over shards of about ``SHARD`` items, so no task depends on
the size of the corpus and none can be hot. A shard is packed tightest-fit first;
then local search works on its underfull bins: an item moves, one item is
exchanged for one, or one for two, whenever that raises the sum of squared
fills, which drains the emptiest bins until they can be dropped. The bins that
stay underfull are opened again, and their items spread over fewer shards, until
one shard is left or ``ROUNDS`` are over.

Only ids and sizes are shuffled, never texts.

Defined results of the edge cases: null and empty texts, and null sizes, have no tokens and take
no room: they have one row each, with neither container nor place; a text of
exactly the capacity fills a container alone; repeated texts are items of their
own; ties are broken by id and piece, so the result is the same in each run; an
empty table gives an empty table. Rows whose id is null are left out, as no place
could be given to them.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokenizer
from tessera.session import written

CAPACITY, SHARD, ROUNDS = 2048, 4000, 4
#: A bin filled to this share is closed between the rounds.
CLOSED = 0.995


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Tightest-fit packing of ``sizes`` (largest first): the item numbers of each bin."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect.bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > sizes[i]:
            bisect.insort(rooms, (room - sizes[i], b))
    return bins


def _gain(fill_a: int, fill_b: int, d: int) -> int:
    """By how much moving ``d`` tokens from b to a raises the sum of squared fills."""
    return (fill_a + d) ** 2 + (fill_b - d) ** 2 - fill_a**2 - fill_b**2


def _best_exchange(a: list[int], b: list[int], room: int, sizes: list[int]) -> tuple[int, list[int], list[int]]:
    """``(d, out of a, out of b)`` that brings most tokens ``d <= room`` from b into a."""
    best: tuple[int, list[int], list[int]] = (0, [], [])
    in_b = sorted((sizes[i], i) for i in b)

    def most(limit: int, out: list[int], given: int, used: int | None = None) -> None:
        nonlocal best
        at = bisect.bisect_right(in_b, (limit, 1 << 60)) - 1
        while at >= 0 and in_b[at][1] == used:
            at -= 1
        if at >= 0:
            d = in_b[at][0] - given
            extra = [used] if used is not None else []
            d += sizes[used] if used is not None else 0
            if d > best[0]:
                best = (d, out, [*extra, in_b[at][1]])

    most(room, [], 0)  # a move
    for i in a:
        if best[0] == room:
            break
        most(room + sizes[i], [i], sizes[i])  # one for one
        for size, k in in_b:  # two out of b for one of a
            if size >= room + sizes[i]:
                break
            most(room + sizes[i] - size, [i], sizes[i], k)
    for x in range(len(a)):  # one out of b for two of a
        if best[0] == room:
            break
        for y in range(x + 1, len(a)):
            given = sizes[a[x]] + sizes[a[y]]
            most(room + given, [a[x], a[y]], given)
    return best


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Exchanges between underfull bins until none raises the squared fill; emptied bins are dropped."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    open_bins = [k for k in range(len(bins)) if fill[k] < capacity]
    moved = True
    while moved and len(open_bins) > 1:
        moved = False
        open_bins.sort(key=lambda k: (-fill[k], k))
        for source in reversed(open_bins):  # the emptiest gives first
            for target in open_bins:
                if target == source or fill[target] < fill[source] or not bins[source]:
                    break  # only fuller bins, which come first, receive
                room = capacity - fill[target]
                if not room:
                    continue
                d, out, into = _best_exchange(bins[target], bins[source], room, sizes)
                if d > 0 and _gain(fill[target], fill[source], d) > 0:
                    bins[target] = [i for i in bins[target] if i not in out] + into
                    bins[source] = [i for i in bins[source] if i not in into] + out
                    fill[target] += d
                    fill[source] -= d
                    moved = True
        open_bins = [k for k in open_bins if bins[k] and fill[k] < capacity]
    return [b for b in bins if b]


def pack_sizes(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The bins of one shard: tightest fit, then local search."""
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def pieces(sizes: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id") -> DataFrame:
    """``(id, piece, start, size)``: each text, or, where it is longer than a container, its pieces."""
    n = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.lit(capacity))).cast("int")
    return (
        sizes.where(F.col(id_column).isNotNull()).withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
        .select(id_column, "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
        .select(id_column, "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece").cast("long") * capacity).alias("size"))
    )


def _shard_packer(turn: int, capacity: int, id_column: str):
    columns = [id_column, "piece", "start", "size"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([id_column, "piece"], ignore_index=True)
        held = pdf["size"].tolist()
        where, place, fill = [""] * len(held), [0] * len(held), [0] * len(held)
        for k, b in enumerate(pack_sizes(held, capacity)):
            total = sum(held[i] for i in b)
            for p, i in enumerate(b):
                where[i], place[i], fill[i] = f"{turn}-{key[0]}-{k}", p, total
        return pdf[columns].assign(container=where, place=place, fill=fill)

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id", shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """``(id, piece, start, size, container, place)`` from ``(id, n_tokens)``."""
    kind = sizes.schema[id_column].dataType.simpleString()
    items = written(pieces(sizes, capacity, id_column))
    columns = [id_column, "piece", "start", "size"]
    done = items.where(F.col("size") == capacity).select(*columns, F.concat_ws("-", F.lit("full"), id_column, "piece").alias("container"), F.lit(0).alias("place"))
    empty = items.where(F.col("size") == 0).select(*columns, F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("place"))
    out = done.unionByName(empty)
    left = items.where((F.col("size") > 0) & (F.col("size") < capacity))
    schema = f"`{id_column}` {kind}, piece int, start long, size long, container string, place int, fill long"
    for turn in range(rounds):
        n = left.count()
        if not n:
            break
        shards = max(1, round(n / shard))

        spread = left.withColumn("_shard", F.pmod(F.xxhash64(F.lit(turn), id_column, "piece"), F.lit(shards)))
        spread = spread.repartition(min(shards, 10_000), "_shard")  # a fixed number: rows are few, the work is not
        placed = written(spread.groupBy("_shard").applyInPandas(_shard_packer(turn, capacity, id_column), schema))
        last = shards == 1 or turn == rounds - 1
        closed = placed if last else placed.where(F.col("fill") >= CLOSED * capacity)
        out = out.unionByName(closed.drop("fill"))
        if last:
            break
        left = placed.where(F.col("fill") < CLOSED * capacity).select(columns)
    return out


def pack_texts(df: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", folder: str = tokenizer.FOLDER) -> DataFrame:
    """:func:`pack` of the texts of ``df``, measured in tokens."""
    return pack(tokenizer.count_tokens(df, id_column, text_column, folder), capacity, id_column)
