"""Problems 6 and 7: ids against the public tokenizer, the two merges against each other, and containers that waste little."""

import os
import random

import pytest
from tessera.llm import packing, tokenizer

PATH = os.path.join(tokenizer.FOLDER, tokenizer.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file here")


@needs_vocabulary
def test_merges_agree():
    ranks, rng = tokenizer.read_ranks(PATH), random.Random(1)
    for n in (2, 3, 17, 255, 256, 257, 700):
        for letters in (b"ab", b"etaoin ", bytes(range(256))):
            word = bytes(rng.choice(letters) for _ in range(n))
            assert tokenizer.merge_short(word, ranks) == tokenizer.merge_long(word, ranks)


@needs_vocabulary
def test_ids_against_tiktoken(spark):
    import tiktoken

    reference = tiktoken.Encoding("x", pat_str=tokenizer.PATTERN, mergeable_ranks=tokenizer.read_ranks(PATH), special_tokens={})
    texts = ["Hello world", "  two  spaces \n\n x", "x" * 3000, "naïve Ünïcode 日本語テキスト ع", "a" + " " * 50 + "b", "I'll don't 'S", " nbsp \t\r\n", "<|endoftext|>", "", None]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokenizer.encode(df).collect()}
    assert got == {i: reference.encode(t or "", disallowed_special=()) for i, t in enumerate(texts)}
    assert tokenizer.encode(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in tokenizer.count_tokens(df).collect()} == {i: len(x) for i, x in got.items()}


def test_containers(spark):
    rng = random.Random(2)
    sizes = [rng.randrange(1, 1500) for _ in range(600)] + [0, 2048, 2049, 10_000, None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(None, 5)], "doc_id long, n_tokens long")
    rows = packing.pack(df, shard=200).collect()
    fill, places, whole = {}, set(), {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + (r["size"] or 0)
        if r.container is None:
            assert not r["size"]
            continue
        fill[r.container] = fill.get(r.container, 0) + r["size"]
        assert (r.container, r.place) not in places
        places.add((r.container, r.place))
    assert max(fill.values()) <= packing.CAPACITY and whole == {i: n or 0 for i, n in enumerate(sizes)}
    assert len(fill) <= 1.02 * sum(n or 0 for n in sizes) / packing.CAPACITY + 2
    assert {r.doc_id for r in rows if r.piece > 0} == {602, 603}  # only what is longer than a container is split
    assert packing.pack(df.limit(0)).count() == 0


def test_local_search_never_loses():
    rng = random.Random(3)
    for _ in range(20):
        sizes = [rng.randrange(1, 100) for _ in range(60)]
        bins = packing.pack_sizes(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(60)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= len(packing.best_fit(sizes, 100))
