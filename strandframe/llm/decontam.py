"""Operator 9, benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, ship

TOKENS = re.compile(r"\w+")


@dataclass(frozen=True)
class Tiling:
    """least: tokens of the shortest tile, and of a seed. coverage: share of a test item's tokens under tiles
    from which a document counts as contaminated. block, letters: items that one pass over the documents looks for, and
    characters of their texts from which a pass takes no more of them."""

    least: int = 4
    coverage: float = 0.5
    block: int = 20_000
    letters: int = 16 << 20


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def rolling(ids: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """Karp-Rabin hash, modulo 2**64, of each window of `width` ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(width):
        value = value * np.uint64(base) + ids[k : k + n]
    return value


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [low, high) one after the other, and which range each is of."""
    n = high - low
    which = np.repeat(np.arange(len(low)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n), which


def tile(n: np.ndarray, i: np.ndarray, j: np.ndarray, least: int, sizes: tuple[int, int]) -> list[tuple[int, int, int]]:
    """Greedy tiling of matches (length, place in the document, place in the item): the longest one that is free is marked,
    again and again; what is left of one that is partly marked counts as a shorter match. Ties: first in the item, then in
    the document. It ends where the item has no room for a tile."""
    doc, item = np.zeros(sizes[0], bool), np.zeros(sizes[1], bool)
    order, at, rest, tiles = np.lexsort((i, j, -n)), 0, [], []
    room = sizes[1]
    while at < len(order) or rest:
        if at < len(order):
            k = order[at]
            one = -int(n[k]), int(j[k]), int(i[k])
        if at == len(order) or rest and rest[0] < one:
            m, y, x = heapq.heappop(rest)
        else:
            (m, y, x), at = one, at + 1
        m = -m
        taken = doc[x : x + m] | item[y : y + m]
        if not taken.any():
            tiles.append((m, x, y))
            doc[x : x + m] = item[y : y + m] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[True], item, [True]]).astype(np.int8)))
            room = int(np.diff(edges)[::2].max(initial=0))
            if room < least:
                break
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(rest, (a - b, y + a, x + a))
    return tiles


class Items:
    """A block of test items. Windows of `least` tokens that are equal are one class, found by its hash; seeds are sorted by class."""

    def __init__(self, rows: list[tuple[int, str]], how: Tiling):
        self.how, self.word = how, {}
        self.names, self.ids = [name for name, _ in rows], []
        for _, text in rows:
            self.ids.append(np.array([self.word.setdefault(w, len(self.word) + 1) for w in TOKENS.findall((text or "").lower())], np.uint64))
        self.sizes = [len(x) for x in self.ids]
        width = [max(0, n - how.least + 1) for n in self.sizes]
        owner, place = np.repeat(np.arange(len(width)), width), np.concatenate([np.empty(0, np.int64), *map(np.arange, width)]).astype(np.int64)
        windows = np.concatenate([np.empty((0, how.least), np.uint64), *(np.lib.stride_tricks.sliding_window_view(x, how.least) for x, n in zip(self.ids, width, strict=True) if n)])
        for self.base in BASES:  # equal hashes have to mean equal windows among the items; the next base if they don't
            hashes = np.concatenate([np.empty(0, np.uint64), *(rolling(x, how.least, self.base) for x in self.ids)])
            order = np.argsort(hashes, kind="stable")
            self.hashes, first, of = np.unique(hashes, return_index=True, return_inverse=True)
            if (windows == windows[first][of]).all():
                break
        else:
            raise RuntimeError("no base tells the windows of this block apart")
        self.owner, self.place, self.windows = owner[order], place[order], windows[first]
        self.starts = np.searchsorted(hashes[order], self.hashes)
        self.ends = np.append(self.starts[1:], len(order))

    def matches(self, ids: np.ndarray, kinds: np.ndarray, at: np.ndarray, own: int, kind: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """(length, i, j) of each longest match. kinds, at: windows of the document, of classes of the items. kind, place: the item's.

        A match starts where equal windows follow on different tokens and ends where different ones follow on them. Only
        these pairs are made, so what repeats a word for long costs no square. On a diagonal starts and ends take turns.
        """
        least, item, ends = self.how.least, self.ids[own], []
        for step in (-1, least):
            side = lambda x, p, edge: np.where((p + step >= 0) & (p + step < len(x)), x[np.clip(p + step, 0, len(x) - 1)], np.uint64(edge))
            ours, theirs = side(ids, at, (1 << 64) - 1), side(item, place, (1 << 64) - 2)
            order = np.lexsort((ours, kinds))
            k, o, p = kinds[order], ours[order], at[order]
            low, high = np.searchsorted(k, kind, "left"), np.searchsorted(k, kind, "right")
            # of the windows of a class those that follow on the item's token stand together; ranks make the pair one number
            seen, rank = np.unique(np.concatenate([o, theirs]), return_inverse=True)
            both, wanted = k * len(seen) + rank[: len(o)], kind * len(seen) + rank[len(o) :]
            a, b = np.searchsorted(both, wanted, "left"), np.searchsorted(both, wanted, "right")
            x, j = spread(np.concatenate([low, b]), np.concatenate([a, high]))
            i, j = p[x], np.concatenate([place, place])[j]
            order = np.lexsort((i, i - j))
            ends.append((i[order], j[order]))
        (i, j), (last, _) = ends
        return last - i + least, i, j

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, covered, size, tiles, longest) of each item of which the text covers enough."""
        least, get = self.how.least, self.word.get
        words = TOKENS.findall(text.lower())
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        if len(ids) < least or not len(self.hashes):
            return []
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        at = np.flatnonzero(known[least:] - known[:-least] == least)
        if not len(at):
            return []
        h = rolling(ids, least, self.base)[at]
        kinds = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = self.hashes[kinds] == h
        at, kinds = at[same], kinds[same]
        same = (ids[at[:, None] + np.arange(least)] == self.windows[kinds]).all(axis=1)
        at, kinds = at[same], kinds[same]
        if not len(at):
            return []
        present = np.unique(kinds)
        seeds, kind = spread(self.starts[present], self.ends[present])
        kind, owner = present[kind], self.owner[seeds]
        order = np.argsort(owner, kind="stable")
        seeds, kind, owner = seeds[order], kind[order], owner[order]
        bounds, out = np.flatnonzero(np.diff(owner, prepend=-1)), []
        for a, b in zip(bounds, [*bounds[1:], len(owner)], strict=True):
            own, place = int(owner[a]), self.place[seeds[a:b]]
            size = self.sizes[own]
            under = np.zeros(size + 1, np.int64)
            np.add.at(under, place, 1)
            np.add.at(under, place + least, -1)
            if np.count_nonzero(np.cumsum(under)) < self.how.coverage * size:
                continue
            some = np.isin(kinds, kind[a:b])
            tiles = tile(*self.matches(ids, kinds[some], at[some], own, kind[a:b], place), least, (len(ids), size))
            covered = sum(x[0] for x in tiles)
            if covered >= self.how.coverage * size:
                out.append((self.names[own], covered, size, len(tiles), max(x[0] for x in tiles)))
        return out


def blocks(benchmark: DataFrame, how: Tiling, item_id: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    """The items, some at a time: bounded in number and, but for the last one of a block, in length."""
    block, letters = [], 0
    for row in benchmark.select(F.col(item_id).cast("long"), F.col(item_text).cast("string")).toLocalIterator():
        block.append(tuple(row))
        letters += len(row[1] or "")
        if len(block) >= how.block or letters >= how.letters:
            yield block
            block, letters = [], 0
    if block:
        yield block


def contaminated(
    docs: DataFrame, benchmark: DataFrame, how: Tiling = Tiling(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and test item of which it holds enough: doc_id, item_id, covered, item_tokens,
    coverage, tiles, longest.

    Tokens are runs of word characters of the lower-cased text, so case, blanks and punctuation don't count.
    Shared seeds of `how.least` tokens, found by rolling Karp-Rabin hashes and compared in full, name the
    pairs; on these greedy string tiling marks the longest matches that don't overlap, in any order, and
    coverage is the share of the item's tokens under tiles.

    The items are the query set: they go in blocks, bounded in number and characters, past all documents, each block an
    index that travels to the executors. Memory grows with a document's longest matches, not with pairs of windows. Null texts count as empty; items of fewer than `how.least` tokens have no
    seed and match nothing. Repeated documents and items each give rows. Other columns play no part.
    Documents are read in whole; no text is shuffled.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    schema = "doc_id long, item_id long, covered int, item_tokens int, coverage double, tiles int, longest int"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in schema.split(", ")]
    found = None
    for block in blocks(benchmark, how, item_id, item_text):
        sent = ship(spark, Items(block, how))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    out += [(key, name, covered, size, covered / size, n, longest) for name, covered, size, n, longest in sent().find(body.as_py())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def _holds(load):
    """A column function: whether a text covers enough of any item of a block."""

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(load().find(t or ""))).astype(bool)

    return holds


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, how: Tiling = Tiling(), text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` that have no row in `contaminated`, with all their columns. Rows are judged where they are read, one
    block of items after the other; nothing is joined or shuffled. Null and empty texts hold nothing and stay, repeated rows
    and rows without an id are judged each by its text, columns may have any names, and without items all rows stay."""
    spark = prepare(docs.sparkSession)
    for block in blocks(benchmark, how, item_id, item_text):
        holds = _holds(ship(spark, Items(block, how)))
        docs = docs.where(~holds(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return docs
