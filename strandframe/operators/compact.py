"""Unambiguous paths of k-mers up to k = 31, compacted within parts of the sequences before the parts meet.

Sequences are cut into stretches of (k-1)-mers (cores) of one bucket, that of their least m-mer on either strand; a stretch
keeps one base on each side. So all occurrences of a core meet in its bucket, where paths are followed in numbers. What
goes on into another bucket is a piece with an open end; the k-mer there is its key, and the other bucket has exactly one
end of the same key: a piece, or a mark that the core there ends the path. Pieces go to the bucket of one of their open
keys, another choice each round, until so few are left that one task joins them all. Letters travel as two bits.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import coded as C
from strandframe.operators.lineage import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Buckets of cores and of keys; pieces that are joined in one task; stretches that a task holds; letters worked on at once.
BUCKETS, TOGETHER, HELD, LETTERS = 4096, 300_000, 1_000_000, 4_000_000
DONE, ODD = -1, -2
#: Of a stretch: a base before it, a base behind it, cores that are taken out. Of a piece: open on the left, on the right,
#: more than one continuation on the left, on the right; a mark.
BEFORE, BEHIND, OUT = 1, 2, 4
LEFT, RIGHT, AMB_LEFT, AMB_RIGHT, MARK = 1, 2, 4, 8, 16
ROWS = "bucket int, n long, lens binary, flags binary, body binary"
ONES = np.array([bin(i).count("1") for i in range(16)], np.uint8)
LETTER = np.array([max(i.bit_length() - 1, 0) for i in range(16)], np.uint8)


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions of consecutive stretches."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


def packed(x: np.ndarray) -> bytes:
    y = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    y[: len(x)] = x
    y = y.reshape(-1, 4)
    return (y[:, 0] << 6 | y[:, 1] << 4 | y[:, 2] << 2 | y[:, 3]).tobytes()


def to_rows(x, starts, lens, flags, bucket) -> pa.RecordBatch:
    """A row for each bucket, of texts at `starts` of the letters x."""
    order = np.argsort(bucket, kind="stable")
    starts, lens, flags, bucket = starts[order], lens[order], flags[order].astype(np.uint8), bucket[order]
    body, ends = x[spread(starts, lens)], np.concatenate([[0], np.cumsum(lens)])
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else [0]
    rows = [(bucket[a], c - a, lens[a:c].astype(np.uint32).tobytes(), flags[a:c].tobytes(), packed(body[ends[a] : ends[c]])) for a, c in zip(cuts, cuts[1:])]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "n", "lens", "flags", "body"])


def from_rows(rows: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, starts, lens, flags); each row's letters begin at a byte of their own."""
    data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    x = (data[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel()
    lens = np.frombuffer(b"".join(r[0] for r in rows), np.uint32).astype(np.int64)
    flags = np.frombuffer(b"".join(r[1] for r in rows), np.uint8)
    counts, sizes = np.array([len(r[1]) for r in rows]), np.array([len(r[2]) for r in rows])
    total, first = np.cumsum(lens) - lens, np.cumsum(counts) - counts
    return x, total + np.repeat(4 * (np.cumsum(sizes) - sizes) - total[first], counts), lens, flags


def ranked(nxt: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes of each path in order, where paths begin, their lengths), each path on one strand; cycles are left out.

    Nodes are 2 i and, on the other strand, 2 i + 1; nxt has the next one or -1, and holds on both strands."""
    m = len(nxt)
    back = nxt.reshape(-1, 2)[:, ::-1].ravel()
    back = np.where(back >= 0, back ^ 1, -1)
    to, d = np.where(back >= 0, back, np.arange(m)), (back >= 0).astype(np.int64)
    todo = np.flatnonzero(back >= 0)
    for _ in range(m.bit_length() + 1):
        todo = todo[back[to[todo]] >= 0]
        if not len(todo):
            break
        t = to[todo]
        d[todo], to[todo] = d[todo] + d[t], to[t]
    kept = alive & (to < to.reshape(-1, 2)[:, ::-1].ravel())
    kept[todo[back[to[todo]] >= 0]] = False
    nodes = np.flatnonzero(kept)
    heads = nodes[d[nodes] == 0]
    n = d[heads ^ 1] + 1
    begin = np.cumsum(n) - n
    place = np.zeros(m, np.int64)
    place[heads] = begin
    laid = np.zeros(len(nodes), np.int64)
    laid[place[to[nodes]] + d[nodes]] = nodes
    return laid, begin, n


def stretches(k: int):
    """Rows of stretches from columns seq and out (whether its cores are taken out)."""
    c = k - 1
    m = max(1, min(9, c // 2))
    w = c - m + 1

    def cores_of(texts, out):
        x, ends = C.letters(texts)
        h = C.rolled(x, m).astype(np.uint32) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        p = 1
        while 2 * p <= w:
            h, p = np.minimum(h[: len(h) - p], h[p:]), 2 * p
        h = np.minimum(h[: len(h) - (w - p)], h[w - p :])
        h = (h * np.uint32(2246822519) >> np.uint32(20)).astype(np.int16)  # 12 bits
        n = np.diff(ends) - c + 1
        at = spread(ends[:-1], n)
        bucket, first = h[at], np.zeros(len(at), bool)
        first[np.cumsum(n) - n] = True
        new = first.copy()
        new[1:] |= bucket[1:] != bucket[:-1]
        a = np.flatnonzero(new)
        e = np.append(a[1:], len(at))
        before = ~first[a] & (not out)
        behind = np.append(before[1:], False)
        return x, at[a] - before, e - a + c - 1 + before + behind, before * BEFORE + behind * BEHIND + out * OUT, bucket[a]

    def joined(held):
        base = np.cumsum([0, *(len(h[0]) for h in held)])
        return to_rows(np.concatenate([h[0] for h in held]), *(np.concatenate([h[i] + base[j] if i == 1 else h[i] for j, h in enumerate(held)]) for i in range(1, 5)))

    def run(batches):
        held, size, odd = [], 0, False
        for b in batches:
            for out in (False, True):
                texts = pc.unique(b.column(0).filter(pc.equal(b.column(1), out)).drop_null())
                texts = texts.filter(pc.greater_equal(pc.binary_length(texts), c if out else k))
                if not len(texts):
                    continue
                if pc.any(pc.match_substring_regex(texts, "[^ACGT]")).as_py():
                    odd = True
                    continue
                held.append(cores_of(texts, out))
                size += len(held[-1][1])
            if size >= HELD:
                yield joined(held)
                held, size = [], 0
        if held:
            yield joined(held)
        if odd:
            yield to_rows(np.zeros(1, np.uint8), np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.uint8), np.array([ODD]))

    return run


def compacted(x, starts, lens, flags, k: int):
    """(letters, starts, lens, flags) of the pieces and marks of whole buckets."""
    c = k - 1
    before, behind, out = flags & BEFORE > 0, flags & BEHIND > 0, flags & OUT > 0
    n = lens - before - behind - c + 1
    at = spread(starts + before, n)
    last = np.cumsum(n) - 1
    first = last - n + 1
    f, r = (s[at] for s in C.strands(x, c))
    flip, canon = r < f, np.minimum(f, r)
    # the bases on the sides, as bits, and whether the core there is in another bucket
    hidden = np.repeat(out, n)
    has_l, has_r, far_l, far_r = ~hidden, ~hidden, np.zeros(len(at), bool), np.zeros(len(at), bool)
    has_l[first], has_r[last] = before, behind
    far_l[first], far_r[last] = before, behind
    lb, rb = x[at - 1], x[np.minimum(at + c, len(x) - 1)]
    one = lambda has, base: has.astype(np.uint16) << base
    near = np.where(flip, one(has_r, 3 - rb), one(has_l, lb)) | np.where(flip, one(has_l, 3 - lb), one(has_r, rb)) << 4
    near |= one(np.where(flip, far_r, far_l), 8) | one(np.where(flip, far_l, far_r), 9) | one(hidden, 10)
    order = np.argsort(canon)
    laid = canon[order]
    new = np.append(True, laid[1:] != laid[:-1])
    begin = np.flatnonzero(new)
    ids = np.empty(len(at), np.int64)
    ids[order] = np.cumsum(new) - 1
    sets = np.bitwise_or.reduceat(near[order], begin)
    low, high = laid[begin], np.maximum(f, r)[order[begin]]
    nl, nr, no = ONES[sets & 15], ONES[sets >> 4 & 15], (low == high) | (sets >> 10 & 1 > 0)
    good, hard = (nl == 1) & (nr == 1) & ~no, ((nl > 1) | (nr > 1)) & ~no

    node, m = 2 * ids + flip, 2 * len(begin)
    inside = ~hidden
    inside[last] = False
    j = np.flatnonzero(inside)
    a, b = node[j], node[j + 1]
    ga, gb = good[a >> 1], good[b >> 1]
    nxt, amb = np.full(m, -1, np.int64), np.zeros(m, bool)
    link = ga & gb & (a >> 1 != b >> 1)
    nxt[a[link]], nxt[b[link] ^ 1] = b[link], a[link] ^ 1
    amb[a[ga & ~gb & hard[b >> 1]]] = True
    amb[b[gb & ~ga & hard[a >> 1]] ^ 1] = True
    path, begins, size = ranked(nxt, np.repeat(good, 2))

    heads, tails = path[begins], path[begins + size - 1]
    left = lambda v: np.where(v & 1, 3 - LETTER[sets[v >> 1] >> 4 & 15], LETTER[sets[v >> 1] & 15])
    lens2 = size + k
    starts2 = np.cumsum(lens2) - lens2
    text = np.zeros(lens2.sum(), np.uint8)
    text[starts2] = left(heads)
    number = np.where(heads & 1, high[heads >> 1], low[heads >> 1])
    for i in range(c):
        text[starts2 + 1 + i] = number >> 2 * (c - 1 - i) & 3
    text[spread(starts2 + k, size)] = 3 - left(path ^ 1)
    far = lambda v, right: sets[v >> 1] >> (8 + (v & 1 ^ right)).astype(np.uint16) & 1
    flags2 = far(heads, 0) * LEFT | far(tails, 1) * RIGHT | amb[heads ^ 1] * AMB_LEFT | amb[tails] * AMB_RIGHT

    # marks of the other cores next to another bucket
    bad = ~good[ids] & ~hidden
    i, j = np.flatnonzero(bad & far_l), np.flatnonzero(bad & far_r)
    keys = np.minimum(*C.strands(x, k))[np.concatenate([at[i] - 1, at[j]])] if len(i) + len(j) else np.zeros(0, np.int64)
    whose = ids[np.concatenate([i, j])]
    order = np.lexsort((whose, keys))
    order = order[np.append(True, (np.diff(keys[order]) != 0) | (np.diff(whose[order]) != 0))[: len(order)]]  # two cores may mark one key
    keys, hard_too = keys[order], hard[whose[order]]
    marks = (keys[:, None] >> 2 * np.arange(k - 1, -1, -1) & 3).astype(np.uint8).ravel()
    size = np.full(len(keys), k, np.int64)
    return (
        np.concatenate([text, marks]), np.concatenate([starts2, len(text) + np.cumsum(size) - size]), np.concatenate([lens2, size]),
        np.concatenate([flags2, MARK | LEFT | hard_too * AMB_LEFT]).astype(np.uint8),
    )


def keys_of(x, starts, k: int) -> np.ndarray:
    """The canonical numbers of the k-mers at `starts`."""
    f = r = np.zeros(len(starts), np.int64)
    for i in range(k):
        v = x[starts + i].astype(np.int64)
        f, r = f << 2 | v, r | 3 - v << 2 * i
    return np.minimum(f, r)


def joined(x, starts, lens, flags, k: int):
    """The same, with the pieces joined whose open ends meet here."""
    rec = np.concatenate([np.flatnonzero(flags & LEFT), np.flatnonzero(flags & RIGHT)])
    side = np.repeat(np.array([0, 1]), [np.count_nonzero(flags & LEFT), np.count_nonzero(flags & RIGHT)])
    keys = keys_of(x, np.where(side == 0, starts[rec], starts[rec] + lens[rec] - k), k)
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    p, q = order[same], order[same + 1]
    i, si, j, sj = rec[p], side[p], rec[q], side[q]
    flags, mark = flags.copy(), flags & MARK > 0
    gone = np.zeros(len(flags), bool)
    gone[i[mark[i]]] = gone[j[mark[j]]] = True
    for u, su, v in ((i, si, j), (j, sj, i)):
        met = ~mark[u] & mark[v]
        for s in (0, 1):
            t = met & (su == s)
            flags[u[t]] = flags[u[t]] & ~np.uint8(LEFT << s) | (flags[v[t]] & AMB_LEFT) << s
    both = ~mark[i] & ~mark[j]
    gone[i[both & (i == j)]] = True  # a cycle
    link = both & (i != j)
    a, b = 2 * i[link] + (si[link] == 0), 2 * j[link] + (sj[link] == 1)
    nxt = np.full(2 * len(flags), -1, np.int64)
    nxt[a], nxt[b ^ 1] = b, a ^ 1
    path, begins, size = ranked(nxt, np.repeat(~gone & ~mark, 2))

    again = np.ones(len(path), np.int64)
    again[begins] = 0
    skip, n, flip = again * k, lens[path >> 1], path & 1
    part = n - skip
    ends = np.cumsum(part)
    # a flipped piece is read from its end
    step = np.repeat(1 - 2 * flip, part)
    text = x[np.repeat(starts[path >> 1] + np.where(flip, n - 1 - skip, skip), part) + step * (np.arange(len(step)) - np.repeat(ends - part, part))]
    text = np.where(step < 0, 3 - text, text)
    lens2 = np.add.reduceat(part, begins) if len(begins) else np.zeros(0, np.int64)
    heads, tails = path[begins], path[begins + size - 1]
    of = lambda v, right: flags[v >> 1] >> (v & 1 ^ right).astype(np.uint8) & (LEFT | AMB_LEFT)  # noqa: E731  one side's, as on the left
    stay = np.flatnonzero(mark & ~gone)
    return (
        np.concatenate([text, x[spread(starts[stay], lens[stay])]]), np.cumsum(ends2 := np.concatenate([lens2, lens[stay]])) - ends2, ends2,
        np.concatenate([of(heads, 0) | of(tails, 1) << 1, flags[stay]]).astype(np.uint8),
    )


def routed(x, starts, lens, flags, k: int, salt: int) -> np.ndarray:
    """The bucket of one of a piece's open keys."""

    def mixed(at):
        v = keys_of(x, at, k).astype(np.uint64) + np.uint64(salt)
        for f in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
            v = (v ^ v >> np.uint64(29)) * np.uint64(f)
        return v >> np.uint64(20)

    left, right, none = mixed(starts), mixed(starts + lens - k), np.uint64(1 << 62)
    least = np.minimum(np.where(flags & LEFT, left, none), np.where(flags & RIGHT, right, none))
    return np.where(flags & (LEFT | RIGHT), (least % np.uint64(BUCKETS)).astype(np.int64), DONE).astype(np.int16)


def by_buckets(work, k: int, salt: int, whole: bool = False):
    """mapInArrow over rows in order of buckets: `work` on whole buckets, or on all rows at once."""

    def done(rows):
        made = work(*from_rows(rows), k)
        return to_rows(*made, routed(*made, k, salt))

    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            for bucket, _, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket < 0:
                    yield to_rows(np.zeros(1, np.uint8), np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.uint8), np.array([bucket]))
                    continue
                if bucket != last and size >= LETTERS and not whole:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + 4 * len(row[2]), bucket
        if held:
            yield done(held)

    return run


def decoded(batches):
    for b in batches:
        columns = [c.to_pylist() for c in b.columns[2:]]
        for i in range(0, b.num_rows, 64):
            x, starts, lens, flags = from_rows(list(zip(*(c[i : i + 64] for c in columns), strict=True)))
            data = np.frombuffer(b"ACGT", np.uint8)[x[spread(starts, lens)]]
            ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
            seq = pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([seq, pa.array(flags & AMB_LEFT > 0), pa.array(flags & AMB_RIGHT > 0)], ["seq", "amb_left", "amb_right"])


def paths(seqs: DataFrame, k: int, out: DataFrame | None = None) -> DataFrame | None:
    """(seq, amb_left, amb_right): the paths of the k-mers of all sequences, each on one of its strands, and whether a core
    with more than one continuation follows. Both tables have one column of text; cores of `out`, which is plain, aren't
    passed. None if a sequence has other letters than A, C, G and T: those have no numbers."""
    if not 3 <= k <= C.LONGEST:
        return None
    rows = seqs.toDF("seq").withColumn("out", F.lit(False))
    if out is not None:
        rows = rows.unionByName(out.toDF("seq").withColumn("out", F.lit(True)))
    parts = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df, n: df.repartition(n, "bucket").sortWithinPartitions("bucket")
    state = cut(deal(rows.mapInArrow(stretches(k), ROWS), parts).mapInArrow(by_buckets(compacted, k, 0), ROWS))
    if state.where(F.col("bucket") == ODD).limit(1).count():
        return None
    done, salt = [], 0
    while True:
        done.append(state.where(F.col("bucket") == DONE))
        left = state.where("bucket >= 0").agg(F.sum("n")).first()[0]
        if not left:
            break
        salt, whole = salt + 1, left <= TOGETHER
        state = cut(deal(state.where("bucket >= 0"), 1 if whole else parts).mapInArrow(by_buckets(joined, k, salt, whole), ROWS))
    all_done = done[0]
    for d in done[1:]:
        all_done = all_done.unionByName(d)
    return all_done.mapInArrow(decoded, "seq string, amb_left boolean, amb_right boolean")
