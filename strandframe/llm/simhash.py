"""Operator 3, SimHash near-dedup with a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, attach, cut, prepare, release, settled, ship, within, without
from .graph import components


@dataclass(frozen=True)
class SimHash:
    """words: words of a shingle. radius: differing bits up to which two fingerprints link. seed: of XXH64.
    low: lowest bits that aren't part of the fingerprint but have to agree (they number several fingerprints of a text).
    fan: children of an index node. chunk: codes of whole buckets that one tree is built over, at least.
    split: codes of a bucket beyond which it is dealt out anew by its other bits."""

    words: int = 3
    radius: int = 3
    seed: int = 42
    low: int = 0
    fan: int = 8
    chunk: int = 8192
    split: int = 20_000


# -- fingerprints -----------------------------------------------------------------------------------


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included. bytes.lower and bytes.split work on ASCII alone."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    grams = zip(*(tokens[i:] for i in range(words)), strict=False) if len(tokens) >= words else [tokens]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), map(b" ".join, grams)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number; 0 for none."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[a : a + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255  # sums of 255 bits fit in a byte
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, how: SimHash, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, code) for every row; a null text counts as empty and has code 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [majority(shingle_hashes((x.as_py() or "").encode("utf-8", "surrogatepass"), how.words, how.seed)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], names=["doc_id", "code"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, code long")


# -- the index --------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence: neighbours in it differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Codes in Gray order under a tree whose nodes hold the bits on which all codes below agree.

    A node keeps only the bits that its parent doesn't have yet, so on the way down the differences to a
    query add up without counting a bit twice, and a node whose sum exceeds the radius is dropped with all
    that is below. `codes` have to be distinct.
    """

    def __init__(self, codes: np.ndarray, fan: int):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes, self.fan = codes[self.order], fan
        mask, value = np.full(len(codes), ~np.uint64(0)), self.codes
        levels = [(mask, value)]
        while len(value) > 1:
            starts = np.arange(0, len(value), fan)
            size = np.diff([*starts, len(value)])
            differ = np.bitwise_or.reduceat(value ^ np.repeat(value[starts], size), starts)
            mask = np.bitwise_and.reduceat(mask, starts) & ~differ
            value = value[starts] & mask
            levels.append((mask, value))
        self.levels = []  # from the root down: bits new at this node, their values
        above = np.zeros(1, np.uint64)
        for depth, (mask, value) in enumerate(reversed(levels)):
            own = mask & ~(np.repeat(above, fan)[: len(mask)] if depth else above)
            self.levels.append((own, value & own))
            above = mask

    def links(self, queries: np.ndarray, radius: int, same: np.uint64 = np.uint64(0)) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of the query, place in `self.codes`) within the radius. A difference in the bits `same` is beyond it."""
        q, node, off = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for depth, (mask, value) in enumerate(self.levels):
            if depth:
                wide = np.minimum(self.fan, len(mask) - node * self.fan)
                first = node * self.fan
                q, off = np.repeat(q, wide), np.repeat(off, wide)
                node = np.repeat(first, wide) + np.arange(len(q)) - np.repeat(np.cumsum(wide) - wide, wide)
            differ = (queries[q] & mask[node]) ^ value[node]
            off = off + np.bitwise_count(differ)
            near = (off <= radius) & ((differ & same) == 0)
            q, node, off = q[near], node[near], off[near]
        return q, node


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the members of linked groups the smallest label of them, in place."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label[:] = label[label]


def turned(codes: np.ndarray, by: int) -> np.ndarray:
    """Codes whose bits are rotated, so that those from place `by` down are the highest; differences stay."""
    up = np.uint64((64 - by) % 64)
    return (codes << up) | (codes >> np.uint64(by % 64)) if up else codes


def chunk_links(codes: np.ndarray, top: int, same: int, how: SimHash, step: int = 512) -> Iterator[tuple[GrayIndex, int, np.ndarray, np.ndarray]]:
    """The tree over the distinct `codes` of some buckets, whose bits below `top` come first in it, and block by block of its
    order: (tree, first query, numbers of queries, places) of all pairs within the radius that agree on `same`."""
    index = GrayIndex(turned(codes, top), how.fan)
    held = turned(np.array([same & (1 << 64) - 1], np.uint64), top)[0]
    for start in range(0, len(codes), step):
        yield index, start, *index.links(index.codes[start : start + step], how.radius, held)


def linked(codes: np.ndarray, top: int, same: int, how: SimHash) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links of some buckets connect: each code that has one, with the first of its component."""
    label, order = np.arange(len(codes)), np.arange(len(codes))
    for index, start, q, place in chunk_links(codes, top, same, how):
        order = index.order
        other = q + start != place
        if other.any():
            _unite(label, q[other] + start, place[other])
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return codes[order[moved]], codes[order[label[moved]]]


# -- buckets ----------------------------------------------------------------------------------------


def _cuts(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, parts)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def routes(how: SimHash) -> list[tuple[int, int, int]]:
    """(bits a bucket agrees on, place below which they lie, route that this one is part of or -1), by number.

    The fingerprint is cut into radius + 1 blocks: codes within the radius agree on one of them, so they share one of
    its buckets. Behind these come, for buckets that are too large, the cuts of the other bits into radius + 1 parts,
    of which again one has to agree.
    """
    low, blocks = list(range(how.low)), _cuts(list(range(how.low, 64)), how.radius + 1)
    wide = [(_mask(low + b), b[-1] + 1, -1) for b in blocks]
    fine = [(_mask(low + b + part), b[-1] + 1, k) for k, b in enumerate(blocks) for part in _cuts([x for o in blocks if o is not b for x in o], how.radius + 1)]
    return wide + fine


def _route(codes: DataFrame, how: SimHash) -> DataFrame:
    """`codes` with (route, key) for each bucket of each code; a key is the hash of the route and the bits that agree.

    A bucket of over `split` codes is dealt out by its route's finer cuts; nothing is lost.
    """
    plan = routes(how)
    key = lambda n: F.struct(F.lit(n).alias("route"), F.xxhash64(F.lit(n), F.col("code").bitwiseAND(F.lit(plan[n][0]))).alias("key"))
    wide = [n for n, (_, _, of) in enumerate(plan) if of < 0]
    keyed = codes.withColumn("r", F.explode(F.array(*map(key, wide)))).select(*codes.columns, "r.*")
    large = cut(keyed.groupBy("key").count().where(F.col("count") > how.split).select("key"))
    if not (count := large.count()):
        return keyed
    large = large.withColumn("large", F.lit(True))
    marked = keyed.join(F.broadcast(large) if count <= BROADCAST_ROWS else large, "key", "left")
    again = F.array(F.struct("route", "key"))
    for n in wide:
        again = F.when(F.col("large") & (F.col("route") == n), F.array(*(key(m) for m, (_, _, of) in enumerate(plan) if of == n))).otherwise(again)
    return marked.withColumn("r", F.explode(again)).select(*codes.columns, "r.*")


def _chunks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(route, columns from the third on) of some whole buckets of one route, of a partition sorted by (route, key, ...)."""
    held: list[list[np.ndarray]] = []
    rows = 0

    def parts(columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
        at = np.flatnonzero(np.diff(columns[0], prepend=-1))
        for a, b in zip(at, [*at[1:], len(columns[0])], strict=True):
            yield int(columns[0][a]), [c[a:b] for c in columns[2:]]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        rows += batch.num_rows
        if rows < least or (held[0][0][0] == held[-1][0][-1] and held[0][1][0] == held[-1][1][-1]):
            continue  # a bucket over several batches is put together once
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))[-1] + 1
        yield from parts([c[:last] for c in columns])
        held = [[c[last:] for c in columns]]
        rows = len(held[0][0])
    if held:
        yield from parts([np.concatenate(x) for x in zip(*held, strict=True)])


def _search(batches: Iterator[pa.RecordBatch], how: SimHash) -> Iterator[pa.RecordBatch]:
    plan = routes(how)
    for route, (code,) in _chunks(batches, how.chunk):
        same, top, _ = plan[route]
        a, b = (x.view(np.int64) for x in linked(np.unique(code.view(np.uint64)), top, same, how))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def code_links(codes: DataFrame, how: SimHash) -> DataFrame:
    """`codes(code)`, distinct, to edges (a, b) with the components of all pairs within the radius."""
    laid = _route(codes, how).select("route", "key", "code").repartition("key").sortWithinPartitions("route", "key")
    return laid.mapInArrow(partial(_search, how=how), "a long, b long").distinct()


# -- the operator -----------------------------------------------------------------------------------


def simhash_groups(docs: DataFrame, how: SimHash = SimHash(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at `how.radius` or fewer differing bits; component_id is the smallest doc_id that
    links reach. Equal fingerprints are one code from the start, so thousands of copies cost one entry.
    Codes are dealt out by wide blocks of their bits, on one of which two codes within the radius agree; Gray-order
    trees over what each task holds find all links, and connected components run over these.

    Null and empty texts have fingerprint zero and link like any other. Null ids take part in links but
    never are a component_id, unless there is no other id. Repeated rows come out as often as they go in.
    Other columns of `docs` play no part; empty tables give empty results.
    """
    prepare(docs.sparkSession)
    prints = cut(fingerprints(docs, how, doc_id, text))
    codes = cut(prints.groupBy("code").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")))
    roots = components(code_links(codes.select("code"), how))
    placed = codes.join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table = cut(placed.join(named, "root").select("code", "component_id", "group_size"))
    total = table.agg(F.sum("group_size")).first()[0] or 0
    joined = attach(prints, table, "code", "group_size", total)
    return joined.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


# -- near duplicates by similarity ------------------------------------------------------------------


@dataclass(frozen=True)
class Similar:
    """words, least: near duplicates have a Jaccard similarity of at least `least` on shingles of `words` words.
    prints, radius: fingerprints per text, over its distinct words, and bits in which two of the same number may
    differ. part: texts of a bucket of prefixes that meet the others in one task. first, then: likeliest partners
    that a text is compared with in the first two rounds of what fingerprints leave apart; the third has no bound."""

    words: int = 5
    least: float = 0.8
    prints: int = 4
    radius: int = 4
    part: int = 256
    first: int = 2
    then: int = 32


#: Low bits of a code that hold the number of its fingerprint.
NUMBER = 3
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[1]
    h = (h ^ (h >> np.uint64(27))) * MIX[2]
    return h ^ (h >> np.uint64(31))


def _hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64)


def _bytes(text: pa.StringScalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass").lower()


def word_codes(text: bytes, how: Similar) -> list[int]:
    """`prints` fingerprints over the distinct words, each with its number in the low bits; none for a text without words.
    Words of up to three letters, which most texts share, are left out unless there are no others."""
    words = set(text.split())
    words = [w for w in words if len(w) > 3] or list(words)
    base = _hashes(words)
    codes = [majority(_mixed(base + np.uint64((k + 1) * int(MIX[0]) & (1 << 64) - 1))) & -(1 << NUMBER) | k for k in range(how.prints)] if words else []
    return codes


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of all words for a text with fewer, none for a text without any."""
    h = _hashes(text.split())
    if not len(h):
        return h
    width = min(words, len(h))
    value = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        value = value * MIX[0] + h[k : len(h) - width + 1 + k]
    return np.unique(_mixed(value))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")


def _hubs(batches: Iterator[pa.RecordBatch], how: SimHash) -> Iterator[pa.RecordBatch]:
    """(code, weight, hub): for each code the text of the neighbour, or itself, that has most texts within the radius."""
    plan = routes(how)
    for route, (code, n, first) in _chunks(batches, how.chunk):
        same, top, _ = plan[route]
        code = code.view(np.uint64)
        weight, parts = np.zeros(len(code), np.int64), []
        for index, start, q, place in chunk_links(code, top, same, how):
            weight[start : start + 512] = np.bincount(q, n[index.order[place]], minlength=min(512, len(code) - start))
        for index, start, q, place in chunk_links(code, top, same, how):
            by = np.lexsort((index.codes[place], -weight[place], q))
            q, place = q[by], place[by]
            best = np.flatnonzero(np.diff(q, prepend=-1))
            own, hub = index.order[q[best] + start], index.order[place[best]]
            other = own != hub
            parts.append((code[own[other]].view(np.int64), weight[place[best]][other], first[hub[other]]))
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["code", "weight", "hub"])


def candidates(rows: DataFrame, how: Similar) -> DataFrame:
    """(a, b): for each text that has some within the radius of one of its codes, the one that most texts are near to.

    At most one candidate a text, whatever the size of a group. Equal codes are one entry of the tree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [word_codes(_bytes(x), how) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int64()))], names=["id", "codes"])

    coded = cut(rows.mapInArrow(run, "id long, codes array<long>")).select("id", F.explode("codes").alias("code"))
    codes = cut(coded.groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    tree = SimHash(radius=how.radius, low=NUMBER)
    laid = _route(codes, tree).select("route", "key", "code", "n", "first").repartition("key").sortWithinPartitions("route", "key")
    found = laid.mapInArrow(partial(_hubs, how=tree), "code long, weight long, hub long").groupBy("code").agg(F.max(F.struct("weight", "hub")).alias("to"))
    # a code of several texts without a better neighbour leads to the first of them
    table = codes.join(found, "code", "left").where("to is not null or n > 1").select("code", "n", F.coalesce("to", F.struct(F.col("n").alias("weight"), F.col("first").alias("hub"))).alias("to"))
    table = cut(table)
    total = table.agg(F.sum("n")).first()[0] or 0
    met = attach(coded, table, "code", "n", total).where("to is not null and to.hub <> id")
    return met.groupBy("id").agg(F.max("to").alias("to")).select(F.least("id", "to.hub").alias("a"), F.greatest("id", "to.hub").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, how: Similar) -> DataFrame:
    """(a, b, similarity) of the pairs whose similarity, from the whole `sets(id, s)`, is high enough.

    The sides are dealt out by id; of an id that many pairs name the adaptive plan splits the pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                value.append(both / max(1, len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value, pa.float64())], names=["a", "b", "similarity"])

    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("x")), sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return met.mapInArrow(run, "a long, b long, similarity double").where(F.col("similarity") >= how.least)


def sets_of(rows: DataFrame, pairs: DataFrame, how: Similar) -> DataFrame:
    """(id, s): the shingles of the texts that `pairs(a, b)` name, as bytes, written."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(_bytes(x), how.words).tobytes() for x in batch.column(1)], pa.binary())], names=["id", "s"])

    return cut(within(rows, ids, "id").mapInArrow(run, "id long, s binary"))


# -- what the fingerprints miss ---------------------------------------------------------------------

#: Texts that the order of shingles is taken from, and shingles at its end. Any order gives all pairs; a good one gives small buckets.
ORDER_TEXTS, ORDER_SHINGLES = 4_000, 100_000
#: Bits of a text's parity bitmap: about as many as it has shingles, but not fewer or more than these.
LEAST_BITS, MOST_BITS = 256, 1 << 14


def frequent_shingles(rows: DataFrame, how: Similar) -> np.ndarray:
    """The shingles that most of some texts of `rows(id, text)` have, the most frequent last."""
    parts = max(1, rows.count() // ORDER_TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.empty(0, np.uint64), *(shingles(_bytes(x), how.words) for x in batch.column(0))]
            key, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == 0).select("text").mapInArrow(run, "key long, n long")
    counted = some.groupBy("key").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(ORDER_SHINGLES)
    return np.array([r["key"] for r in counted.collect()][::-1], np.int64).view(np.uint64)


def prefix(of: np.ndarray, frequent: np.ndarray, place: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set in the order of hashes, `frequent` ones last: so many that two sets with a similarity
    of `least` have one of them in common. `frequent` is sorted, `place` says where each comes in the order."""
    n = len(of)
    if not n:
        return of
    at = np.searchsorted(frequent, of)
    common = np.zeros(n, bool) if not len(frequent) else frequent[np.minimum(at, len(frequent) - 1)] == of
    ordered = np.concatenate([of[~common], of[common][np.argsort(place[at[common]])]])
    return ordered[: n - int(np.ceil(least * n - 1e-9)) + 1]


def parity(of: np.ndarray) -> np.ndarray:
    """A bit for each residue of the shingles, set if an odd number has it: two bitmaps differ in no more bits than the
    sets differ in shingles. Their number is a power of two; halves laid over each other are the bitmap of half as many."""
    wide = min(MOST_BITS, max(LEAST_BITS, 1 << int(len(of) - 1).bit_length()))
    odd = np.bincount((of % np.uint64(wide)).astype(np.int64), minlength=wide) & 1
    return np.packbits(odd.astype(bool))


def differing(bits: np.ndarray, q: np.ndarray, t: np.ndarray, words: int = 1 << 20) -> np.ndarray:
    """Bits in which the bitmaps of each pair differ, over the shorter length of the two. `bits`: an array of bytes objects."""
    wide = np.array([len(x) for x in bits])
    least, off = np.minimum(wide[q], wide[t]), np.zeros(len(q), np.int64)
    for w in np.unique(least):
        some = np.flatnonzero(least == w)
        rows, at = np.unique(np.concatenate([q[some], t[some]]), return_inverse=True)
        flat = np.zeros((len(rows), w // 8), np.uint64)
        for k, x in enumerate(bits[rows]):
            x = np.frombuffer(x, np.uint64)
            while len(x) > w // 8:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            flat[k] = x
        x, y = at[: len(some)], at[len(some) :]
        step = max(1, words * 8 // int(w))
        for i in range(0, len(some), step):
            off[some[i : i + step]] = np.bitwise_count(flat[x[i : i + step]] ^ flat[y[i : i + step]]).sum(axis=1, dtype=np.int64)
    return off


#: Bits of a mark below the size: those of the shingle that comes before an entry's own in its prefix, 0 for none. Sizes from
#: MOST on count as MOST there.
BEFORE, MOST = 40, (1 << 23) - 1


def marks(of: np.ndarray, size: int) -> np.ndarray:
    """A mark for each shingle of a prefix: the size of the set, then the shingle before it."""
    last = np.concatenate([np.zeros(1, np.uint64), of[:-1] >> np.uint64(64 - BEFORE) | np.uint64(1)])[: len(of)]
    return (np.uint64(min(size, MOST) << BEFORE) | last).view(np.int64)


def profiles(rows: DataFrame, how: Similar) -> DataFrame:
    """(id, size, bits, prefix, marks) of each text that has words."""
    frequent = frequent_shingles(rows, how)
    by_hash = np.argsort(frequent)
    order = ship(rows.sparkSession, (frequent[by_hash], by_hash))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(_bytes(x), how.words) for x in batch.column(1)]
            firsts = [prefix(x, *order(), how.least) for x in sets]
            columns = [
                batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([parity(x).tobytes() for x in sets], pa.binary()),
                pa.array([x.view(np.int64) for x in firsts], pa.list_(pa.int64())), pa.array([marks(x, len(y)) for x, y in zip(firsts, sets, strict=True)], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "bits", "prefix", "marks"])

    return cut(rows.mapInArrow(run, "id long, size long, bits binary, prefix array<long>, marks array<long>").where("size > 0"))


def _shared(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The entries (key, id, mark) of a partition sorted by (key, mark) whose key has another of a size that can be similar;
    the nearest sizes are those next to an entry."""
    before = None  # the last entry, and whether the one before it is near

    def out(key, mark, ids):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(mark)], names=["key", "id", "mark"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, mark, ids = (c.to_numpy() for c in batch.columns)
        if before:
            key, mark, ids = (np.concatenate(x) for x in zip(before[0], (key, mark, ids), strict=True))
        size = mark >> BEFORE
        near = (key[1:] == key[:-1]) & ((size[:-1] >= least * size[1:] - 1e-9) | (size[:-1] == MOST))
        keep = np.append(near, False)
        keep[1:] |= near
        if before:
            keep[0] |= before[1]
        # the last one waits for what comes
        yield out(key[:-1][keep[:-1]], mark[:-1][keep[:-1]], ids[:-1][keep[:-1]])
        before = (key[-1:], mark[-1:], ids[-1:]), bool(keep[-1])
    if before and before[1]:
        yield out(*before[0])


def _nearest(batches: Iterator[pa.RecordBatch], how: Similar, most: int | None, pairs: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """(x, y, more): partners of other labels of each query of a part of a bucket, all that sizes and bitmaps don't
    prove to be less similar than `least`, or the `most` nearest; `more` says whether there are others.

    Rows are (key, part, id, label, query, home, last, size, bits): each text is a target in one part of its bucket, and a
    query in all parts, unless it is of the bucket's most frequent label, which it then needn't ask. Two texts that have
    the shingle before the bucket's in common, `last`, have met in that one's bucket and don't here.
    """
    share = (1 - how.least) / (1 + how.least)

    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, part, ids, label, query, home, last, size, bits = columns
        new = (np.diff(key, prepend=key[:1] - 1) != 0) | (np.diff(part, prepend=part[:1] - 1) != 0)
        starts = np.flatnonzero(new)
        width = np.diff([*starts, len(key)])
        first, wide = np.repeat(starts, width), np.repeat(width, width)
        asks = np.flatnonzero(query)
        done = np.cumsum(wide[asks])
        cuts = np.searchsorted(done, np.arange(pairs, done[-1] + pairs, pairs)) if len(asks) else []
        for a, b in zip([0, *cuts], [*cuts, len(asks)], strict=True):
            some = asks[a:b]
            n = wide[some]
            q = np.repeat(some, n)
            t = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[some], n)
            ok = home[t] & (label[q] != label[t])
            ok &= np.minimum(size[q], size[t]) >= how.least * np.maximum(size[q], size[t]) - 1e-9
            q, t = q[ok], t[ok]
            off = differing(bits, q, t)
            near = off <= share * (size[q] + size[t]) + 1e-9
            q, t, off = q[near], t[near], off[near]
            if not len(q):
                continue
            more = head = np.zeros(len(q), bool)
            if most is not None:
                by = np.lexsort((ids[t], off, q))
                q, t = q[by], t[by]
                at = np.flatnonzero(np.diff(q, prepend=-1))
                count = np.diff([*at, len(q)])
                rank = np.arange(len(q)) - np.repeat(at, count)
                more = np.repeat(count > most, count)[rank < most]
                q, t, head = q[rank < most], t[rank < most], rank[rank < most] == 0
            new = (last[q] != last[t]) | (last[q] == 0) | (more & head)
            q, t, more = q[new], t[new], more[new]
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(ids[t]), pa.array(more)], names=["x", "y", "more"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        ends = held[0][0][0], held[0][1][0]
        if (held[-1][0][-1], held[-1][1][-1]) == ends:
            continue  # a part over several batches is put together once
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))[-1] + 1
        yield from found([c[:last] for c in columns])
        held = [[c[last:] for c in columns]]
    if held:
        yield from found([np.concatenate(x) for x in zip(*held, strict=True)])


def partners(shared: DataFrame, profile: DataFrame, groups: DataFrame, how: Similar, most: int | None, again: DataFrame | None) -> DataFrame:
    """(x, y, more): what `_nearest` finds in the buckets `shared(key, id, mark)`, with the roots of `groups(node, root)` as labels.

    again: ids that had more partners than they were compared with; from the second round on only pairs with one of them
    are asked for. Buckets of one label ask nothing. A bucket goes in parts of about `how.part` targets, so none overloads
    a task; what is sent to all its parts are only texts outside its most frequent label.
    """
    groups = groups.withColumnsRenamed({"node": "id", "root": "label"})
    entries = shared.join(groups, "id", "left").select("key", "id", F.col("mark").bitwiseAND(F.lit((1 << BEFORE) - 1)).alias("last"), F.coalesce("label", "id").alias("label"))
    entries = entries.withColumn("ask", F.lit(True)) if again is None else entries.join(again.withColumn("ask", F.lit(True)), "id", "left").fillna(False, ["ask"])
    entries = cut(entries)
    counted = entries.groupBy("key", "label").agg(F.count("*").alias("n"), F.max("ask").alias("ask"))
    counted = counted.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.max("ask").alias("ask"), F.max(F.struct("n", "label", "ask")).alias("top"))
    open_ = counted.where("labels > 1 and ask").select("key", F.ceil(F.col("n") / how.part).cast("int").alias("parts"), F.col("top.label").alias("top"), F.col("top.ask").alias("all"))
    met = entries.join(open_, "key").withColumn("query", (F.col("label") != F.col("top")) & (F.col("ask") | F.col("all")))
    met = met.withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    where = F.when(F.col("query"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    dealt = met.select("key", "id", "last", "label", "query", "own", F.explode(where).alias("part"))
    laid = dealt.join(profile.select("id", "size", "bits"), "id").select("key", "part", "id", "label", "query", (F.col("own") == F.col("part")).alias("home"), "last", "size", "bits")
    laid = laid.repartition("key", "part").sortWithinPartitions("key", "part")
    return laid.mapInArrow(partial(_nearest, how=how, most=most), "x long, y long, more boolean")


def prefix_buckets(profile: DataFrame, how: Similar) -> DataFrame:
    """(key, id, mark): the entries of prefixes that meet others, written."""
    entries = profile.select(F.explode(F.arrays_zip("prefix", "marks")).alias("entry"), "id").select(F.col("entry.prefix").alias("key"), F.col("entry.marks").alias("mark"), "id")
    entries = entries.repartition("key").sortWithinPartitions("key", "mark")
    return cut(entries.mapInArrow(partial(_shared, least=how.least), "key long, id long, mark long"))


def similar_groups(docs: DataFrame, how: Similar = Similar(), doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity): pairs of ids with at least `how.least`, which connect all that such pairs connect; and
    (node, root): each id that has such a pair with the smallest it reaches.

    First each text meets the one that SimHash and the Gray-order tree say most texts are near to. What that leaves apart
    meets by prefixes: two so similar texts share one of the first fifth of their shingles, in any one order of all
    shingles. There texts of different components are compared, the likeliest partners first, as one link makes the
    others of two components needless; the last round compares every pair that is left. Whole texts confirm all links.
    """
    spark = prepare(docs.sparkSession)
    rows = _rows(docs, doc_id, text)
    pairs = cut(candidates(rows, how))
    links = settled(confirmed(pairs, sets_of(rows, pairs, how), how))
    groups = settled(components(links.select("a", "b")))
    release(spark)
    profile = profiles(rows, how)
    shared, again = prefix_buckets(profile, how), None
    release(spark)
    for most in (how.first, how.then, None):
        met = partners(shared, profile, groups, how, most, again)
        met = cut(met.groupBy("x", "y").agg(F.max("more").alias("more")))
        new = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        new = cut(new.join(pairs, ["a", "b"], "left_anti"))
        found = settled(confirmed(new, sets_of(rows, new, how), how))
        links, pairs = links.union(found), pairs.union(new)
        groups = settled(components(groups.toDF("a", "b").union(found.select("a", "b"))))
        again = cut(met.where("more").select(F.col("x").alias("id")).distinct())
        release(spark)
        if not again.limit(1).count():
            break
    return links, groups


def similar_links(docs: DataFrame, how: Similar = Similar(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, similarity): every pair of ids with at least `how.least`, by prefixes alone; empty texts and null ids have none.

    These are as many as there are, the square of a group's size. What needs only groups takes `similar_groups`.
    """
    spark = prepare(docs.sparkSession)
    rows = _rows(docs, doc_id, text)
    profile = profiles(rows, how)
    met = partners(prefix_buckets(profile, how), profile, spark.createDataFrame([], "node long, root long"), how, None, None)
    pairs = cut(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return confirmed(pairs, sets_of(rows, pairs, how), how)


def drop_near_copies(docs: DataFrame, how: Similar = Similar(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` but those that are linked to a smaller id, directly or over others, with all their columns.

    Links are pairs of texts with a similarity of `how.least` on shingles of `how.words` words: see `similar_groups`.
    Null, empty and blank texts have no shingles and are like no other. Rows without an id take no part and stay. Rows that
    share an id are so many documents, and of linked ones among them, too, one stays. An empty table gives an empty one.
    """
    key = F.col(doc_id).cast("long")
    ids = docs.agg(F.count(key).alias("n"), F.count_distinct(key).alias("ids")).first()
    if ids["n"] == ids["ids"]:
        roots = similar_groups(docs, how, doc_id, text)[1]
        return without(docs, roots.where("node <> root").select(F.col("node").alias(doc_id)).distinct(), doc_id)
    # ids don't tell rows apart: numbers that are written with the rows do
    numbered = cut(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")))
    own = numbered.select("number", F.col("row").getField(doc_id).cast("long").alias("id"), F.col("row").getField(text).alias("text")).where("id is not null")
    roots = similar_groups(own, how, "number", "text")[1].withColumnsRenamed({"node": "number"})
    named = roots.join(own.select("number", "id"), "number").withColumn("rank", F.struct("id", "number"))
    stays = named.groupBy("root").agg(F.min("rank").alias("first")).select(F.col("first.number").alias("number"))
    gone = named.select("number").join(stays, "number", "left_anti")
    return without(numbered, gone, "number").select("row.*")
