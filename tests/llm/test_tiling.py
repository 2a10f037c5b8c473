"""Longest matches and tiles of repetitive texts against brute force, in bounded memory."""

import tracemalloc

import numpy as np
import pytest

from strandframe.llm import decontam
from tests.llm.test_operators import documents, greedy


def longest(doc, item, least):
    found = []
    for i in range(len(doc)):
        for j in range(len(item)):
            if i and j and doc[i - 1] == item[j - 1]:
                continue
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                n += 1
            if n >= least:
                found.append((n, i, j))
    return sorted(found)


@pytest.mark.parametrize("letters", ["a", "ab", "abc"])
def test_matches_of_repetitive_texts(letters):
    rng = np.random.default_rng(len(letters))
    for least in (2, 4):
        for _ in range(15):
            doc, item = (["".join(x) for x in rng.choice(list(letters), rng.integers(least, 40))] for _ in range(2))
            doc = [w if rng.random() < 0.9 else "other" for w in doc]
            index = decontam.Items([(1, " ".join(item))], decontam.Tiling(least=least, coverage=0.01))
            ids = np.array([index.word.get(w, 0) for w in doc], np.uint64)
            windows = [tuple(w) for w in index.windows.tolist()]
            at = np.array([i for i in range(len(doc) - least + 1) if tuple(ids[i : i + least].tolist()) in windows], np.int64)
            kinds = np.array([windows.index(tuple(ids[i : i + least].tolist())) for i in at], np.int64)
            seeds = np.repeat(np.arange(len(windows)), index.ends - index.starts)
            if len(at):
                got = sorted(zip(*(x.tolist() for x in index.matches(ids, kinds, at, 0, seeds, index.place)), strict=True))
                assert got == longest(doc, item, least)
            found = index.find(" ".join(doc))
            tiles = greedy(doc, item, least)
            assert [(f[1], f[3]) for f in found] == ([(sum(n for n, *_ in tiles), len(tiles))] if tiles else [])


def test_a_word_repeated_is_no_square():
    """20,000 equal words against 200 items of such words, by their tiles and under 200 MB."""
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(["la"] * int(rng.integers(100, 400)) + ["end"] * (k % 3))) for k in range(200)]
    tracemalloc.start()
    got = decontam.Items(rows, decontam.Tiling()).find(" ".join(["la"] * 20_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    assert [(n, c) for n, c, *_ in got] == [(k, t.split().count("la")) for k, t in rows] and all(f[3] == 1 for f in got)


def test_blocks_bound_items(spark):
    bench = spark.createDataFrame([(k, "word " * 10) for k in range(10)] + [(10, None), (11, "x " * 5000)], "item_id long, text string")
    found = list(decontam.blocks(bench, decontam.Tiling(block=4, letters=120), "item_id", "text"))
    assert sum(map(len, found)) == 12 and max(map(len, found)) <= 4
    docs = documents(spark, [(1, "word " * 10, "s"), (2, "x " * 5000, "s"), (3, "x", "s")])
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench, decontam.Tiling(block=4, letters=120)).collect()}
    assert got == {(1, k) for k in range(10)} | {(2, 11)}
