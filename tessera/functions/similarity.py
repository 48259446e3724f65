"""Similarity of strings by matching blocks, for the few values that no exact rule resolves.

Python workers see *distinct* values only, in Arrow batches: callers resolve
exact matches natively first and join the result back.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Letters are counted in so many buckets; those that share one only let more pairs through.
BUCKETS = 64
#: One text is held against so many options at once, when the texts left are fewer than one for so many options.
BLOCK, FEW = 512, 2


def closest(text: str, options: list[str]) -> str | None:
    """The first of the options most like ``text`` without regard to case; none if none has a character in common."""
    matcher, best, least = SequenceMatcher(None, text.lower(), ""), None, 0.0
    for option in options:
        matcher.set_seq2(option.lower())
        if matcher.real_quick_ratio() > least and (ratio := matcher.ratio()) > least:
            best, least = option, ratio
    return best


def ratio(a: str | None, b: str | None) -> float:
    """Similarity of two titles, with regard to case; 0 if the second is missing."""
    return 0.0 if b is None else SequenceMatcher(None, a or "", b).ratio()


def _codes(texts: list[str], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as rows of places in ``known`` (its length where a text has ended), and how many letters of each bucket they hold."""
    rows = np.full((len(texts), max(map(len, texts))), len(known), dtype=np.int32)
    counts = np.zeros((len(texts), BUCKETS), dtype=np.int32)
    for i, text in enumerate(texts):
        found = np.searchsorted(known, _points(text))
        rows[i, : len(found)] = found
        counts[i] = np.bincount(found % BUCKETS, minlength=BUCKETS)
    return rows, counts


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def common_letters(rows: np.ndarray, pattern: np.ndarray, n_known: int) -> np.ndarray:
    """The length of the longest common subsequence of ``pattern`` and each of the rows, 64 letters of the pattern at a time in one word of bits."""
    words = range(-(-len(pattern) // 64))
    at = np.zeros((len(words), n_known + 1), dtype=np.uint64)
    for i, c in enumerate(pattern):
        at[i // 64, c] |= np.uint64(1 << i % 64)
    held = [np.full(len(rows), ~np.uint64(0)) for _ in words]
    for column in rows.T:
        carry = None
        for w in words:
            met = held[w] & at[w][column]
            total = held[w] + met
            over = total < held[w]
            if carry is not None:
                total = total + carry
                over |= total < carry
            held[w], carry = total | held[w] & ~met, over.astype(np.uint64)
    # a bit that stands beyond the pattern's end never meets a letter and stays set
    return sum((np.bitwise_count(~h).astype(np.int64) for h in held), np.zeros(len(rows), dtype=np.int64))


def first_alike(texts: list[str], options: list[str], threshold: float) -> np.ndarray:
    """For each text the place of the first of the options with a :func:`ratio` over ``threshold``, -1 where there is none.

    The letters that two texts share in their order, and those they share in any order, are at least those of the matching
    blocks, so only pairs that have enough of both are compared by blocks. A text is compared no further once it has an option.
    One option is held against all texts that are left, or, when these are few, one text against many options.
    """
    best = np.full(len(texts), -1, dtype=np.int64)
    if not texts or not options:
        return best
    known = np.unique(_points("".join([*texts, *options])))
    sides = _codes(texts, known), _codes(options, known)
    left, matcher, place = np.arange(len(texts)), SequenceMatcher(None, "", ""), 0

    def near(one: int, of: int, others: np.ndarray) -> np.ndarray:
        """Those of the others, which are of the other side, that may be similar to text or option ``one`` of side ``of``."""
        (rows, counts), (theirs, their_counts) = sides[of], sides[1 - of]
        code = rows[one, : counts[one].sum()]
        held = their_counts[others]
        enough = threshold * (held.sum(axis=1) + len(code)) / 2 - 1e-6
        kept = np.minimum(held, counts[one]).sum(axis=1) > enough
        kept[kept] = common_letters(theirs[others[kept]], code, len(known)) > enough[kept]
        return others[kept]

    while place < len(options) and len(left) * FEW >= len(options) - place:
        matcher.set_seq2(options[place])
        for i in near(place, 1, left):
            matcher.set_seq1(texts[i])
            if matcher.ratio() > threshold:
                best[i] = place
        left, place = left[best[left] < 0], place + 1
    for i in left:
        for start in range(place, len(options), BLOCK):
            block = np.arange(start, min(start + BLOCK, len(options)))
            best[i] = next((k for k in near(i, 0, block) if ratio(texts[i], options[k]) > threshold), -1)
            if best[i] >= 0:
                break
    return best


@F.pandas_udf(StringType())
def closest_udf(texts: pd.Series, options: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or o is None else closest(t, list(o)) for t, o in zip(texts, options)], dtype=object)


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype=float)
