"""Byte-level BPE encoding with a public vocabulary, by a contiguous rank array.

A text is cut into words by the vocabulary's pattern; each word is encoded on
its own. A word that is a token has its id at once. Any other short word is held
as two parallel arrays: the boundaries of its parts and, beside each, the rank of
the merge of that part with the next. The least rank is found by a scan, its
boundary deleted, the two neighbouring ranks refreshed, until no merge is left.
Words over ``SHORT`` bytes (rare: unspaced scripts, junk) hold the same state in
a heap over a linked list, so their time is n log n and not quadratic.

Words repeat, so each Python worker keeps the ids of words, and of chunks between
spaces, that it has met, up to ``CACHE`` of each; what doesn't fit is encoded
again, with the same result. The
whole operator is one narrow stage: nothing is shuffled, and a text is encoded in
full, whatever its length.

Defined results of the edge cases: null and empty texts give an empty list; blank
texts give the tokens of their blanks; a repeated text gives the same ids;
characters outside the vocabulary don't exist, as every byte is a token; the
strings of special tokens are ordinary text. Other columns are not read. A row
whose id is null keeps its null id. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every function below.
FOLDER = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The word pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT, CACHE = 256, 250_000
_NONE = 1 << 62


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by scans of the contiguous rank array."""
    at = list(range(len(word) + 1))  # part i is word[at[i]:at[i + 1]]
    get = ranks.get
    rank = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]  # of the merge of parts i and i + 1
    while rank:
        least = min(rank)
        if least == _NONE:
            break
        i = rank.index(least)
        del at[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[at[i] : at[i + 2]], _NONE)
        if i:
            rank[i - 1] = get(word[at[i - 1] : at[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(at, at[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in the same order (least rank, leftmost first), by a heap over linked parts."""
    n = len(word)
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or nxt[nxt[i]] != end:
            continue  # one of the two parts has changed since
        j = nxt[i]
        alive[j] = False
        nxt[i] = end
        if end < n:
            prev[end] = i
            if (r := get(word[i : nxt[end]])) is not None:
                heapq.heappush(heap, (r, i, nxt[end]))
        p = prev[i]
        if p >= 0 and (r := get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : nxt[i]]])
        i = nxt[i]
    return out


class Words(dict):
    """Packed ids by word; a word not met before is encoded when it is asked for."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else merge_short(data, self.ranks) if len(data) <= SHORT else merge_long(data, self.ranks)
        packed = array("i", ids).tobytes()
        if len(self) < CACHE and len(data) <= SHORT:
            self[word] = packed
        return packed


class Chunks(dict):
    """Packed ids by chunk: a stretch of words between two spaces.

    A space before a character that is no white space always begins a word of
    the pattern, whatever stands around it, so a text may be cut there first; most
    chunks have been met before and need no pattern at all.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        import regex

        self.words, self.find = Words(ranks).__getitem__, regex.compile(PATTERN).findall

    def __missing__(self, chunk: str) -> bytes:
        packed = b"".join(map(self.words, self.find(chunk)))
        if len(self) < CACHE and len(chunk) <= 64:
            self[chunk] = packed
        return packed


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def packer(path: str):
    """``pack(text) -> bytes``, the ids as 32-bit integers; one for each Python worker."""
    of = Chunks(read_ranks(path)).__getitem__
    uneven, cut = re.compile(r" \s").search, re.compile(r"(?= \S)").split

    def pack(text: str | None) -> bytes:
        if not text:
            return b""
        if uneven(text):
            return b"".join(map(of, filter(None, cut(text))))
        first, *rest = text.split(" ")
        return (of(first) if first else b"") + b"".join(map(of, map(" ".__add__, rest)))

    return pack


def encode_text(text: str | None, path: str) -> list[int]:
    """The ids of one text."""
    return array("i", packer(path)(text)).tolist()


def encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, ids)``: the token ids of every text, without special tokens."""
    path = os.path.join(folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = packer(path)
        for batch in batches:
            packed = list(map(pack, batch.column(1).to_pylist()))
            ends = array("i", accumulate((len(x) // 4 for x in packed), initial=0))
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
            ids = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)]), values)
            yield pa.record_batch([batch.column(0), ids], names=[id_column, "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, n_tokens)``: the lengths of the same ids, which then never leave the worker."""
    path = os.path.join(folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = packer(path)
        for batch in batches:
            n = pa.array([len(pack(x)) // 4 for x in batch.column(1).to_pylist()], type=pa.int64())
            yield pa.record_batch([batch.column(0), n], names=[id_column, "n_tokens"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {kind}, n_tokens long")
