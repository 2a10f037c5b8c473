"""Operator 6, LM scoring: a hidden Markov language model trained by Baum-Welch over the whole corpus."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, ship
from .quality import held_out

#: The end of a document, counted as a token. It holds a blank, so no word is equal to it.
END = b" end"
BUFFER_TOKENS = 300_000
CHUNK = 64


@dataclass(frozen=True)
class HiddenMarkov:
    """states, rounds: of Baum-Welch. own: most frequent tokens with emissions of their own; all others emit
    through one of `classes` classes by their ending, and share it by their counts. carried: tokens whose
    counts travel to the executors; the counts of the others are joined. folds, held: rows that teach nothing."""

    states: int = 4
    rounds: int = 3
    own: int = 8_000
    classes: int = 512
    carried: int = 60_000
    folds: int = 5
    held: int = 1
    seed: int = 7


def tokens_of(text: str) -> list[bytes]:
    """Words of the whole text and one end. bytes.lower and bytes.split work on ASCII alone."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def class_of(token: bytes, classes: int) -> int:
    return (zlib.crc32(token[-3:]) + min(len(token), 12)) % classes


# -- counts -----------------------------------------------------------------------------------------


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, c) over the training rows of `rows(held_out, text)`; counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "c"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(tokens_of(text.as_py() or ""))
            if len(counts) > 400_000:
                yield out()
                counts.clear()
        if counts:
            yield out()

    counted = rows.where("not held_out").select("text").mapInArrow(run, "token binary, c long")
    return counted.groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What an executor needs to turn text into symbols. Bounded by `how.carried` and `how.classes`."""

    how: HiddenMarkov
    total: int
    distinct: int
    carried: dict[bytes, tuple[int, int]]  # symbol, count
    share: np.ndarray  # log10 of the denominator of a token's share in its class

    @property
    def symbols(self) -> int:
        return self.how.own + self.how.classes


def vocabulary(counts: DataFrame, how: HiddenMarkov) -> Vocabulary:
    """The corpus totals cover all tokens; what is carried is bounded by parameters."""
    # the least count of a carried token, from a histogram of at most a thousand bins; single counts have their own bins,
    # so no more than `how.carried` tokens are collected, however many tasks there are
    bins = counts.groupBy(F.floor(F.log2("c") * 16).alias("bin")).agg(F.min("c").alias("c"), F.count("*").alias("n"), F.sum("c").alias("mass")).orderBy(F.col("bin").desc()).collect()
    total, distinct, least, n = sum(r["mass"] for r in bins), sum(r["n"] for r in bins), None, 0
    for r in bins:
        n += r["n"]
        if n > how.carried:
            break
        least = r["c"]
    top = [] if least is None else sorted(counts.where(F.col("c") >= least).collect(), key=lambda r: (-r["c"], bytes(r["token"])))
    carried = {bytes(r["token"]): (k if k < how.own else how.own + class_of(bytes(r["token"]), how.classes), r["c"]) for k, r in enumerate(top)}
    own = {t for t, (s, _) in carried.items() if s < how.own}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, kinds = np.zeros(how.classes, np.int64), np.zeros(how.classes, np.int64)
        for batch in batches:
            rest = [(class_of(t, how.classes), c) for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t not in own]
            if rest:
                k, c = np.array(rest).T
                mass += np.bincount(k, c, how.classes).astype(np.int64)
                kinds += np.bincount(k, minlength=how.classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(how.classes)), pa.array(mass), pa.array(kinds)], names=["k", "mass", "kinds"])

    share = np.full(how.classes, math.log10(0.5))
    for r in counts.mapInArrow(run, "k long, mass long, kinds long").groupBy("k").agg(F.sum("mass"), F.sum("kinds")).collect():
        share[r[0]] = math.log10(r[1] + 0.5 * (r[2] + 1))
    return Vocabulary(how, total, distinct, carried, share)


# -- symbols ----------------------------------------------------------------------------------------

ENCODED = "row long, doc_id long, n_tokens long, n_known long, base double, plain double, codes binary, rare array<long>, rare_n array<int>"


def encode(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """Each text as symbols, with the sums that its carried tokens give.

    base: log10 of their counts, less all denominators of the unigram model. plain: the same for the shares
    in classes. rare: hashes of the tokens that aren't carried, whose counts are joined later. `row` numbers
    the rows of this table, so that rows with equal or null ids stay apart.
    """
    load = ship(rows.sparkSession, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load()
        how, share, seen = words.how, words.share.tolist(), words.carried
        base_cost = math.log10(words.total + 0.5 * (words.distinct + 1))
        table = {t: (s, math.log10(c + 0.5), 0.0 if s < how.own else math.log10(c + 0.5) - share[s - how.own]) for t, (s, c) in seen.items()}
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = tokens_of(text.as_py() or "")
                found = [table.get(t) for t in tokens]
                codes, rare, base, plain = [], [], 0.0, 0.0
                for t, f in zip(tokens, found, strict=True):
                    if f is None:
                        k = class_of(t, how.classes)
                        codes.append(how.own + k)
                        plain -= share[k]
                        rare.append(xxhash.xxh64_intdigest(t, 42))
                    else:
                        codes.append(f[0])
                        base += f[1]
                        plain += f[2]
                kinds_of, n = np.unique(np.array(rare, np.uint64).view(np.int64), return_counts=True)
                out.append((row, key, len(tokens), len(tokens) - len(rare), base - base_cost * len(tokens), plain, np.array(codes, np.uint16).tobytes(), kinds_of, n.astype(np.int32)))
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ENCODED.split(", ")])

    return rows.select("doc_id", "text").mapInArrow(run, ENCODED)


# -- the model --------------------------------------------------------------------------------------


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # K; K x K; symbols x K, each column summing to 1

    @staticmethod
    def first(weights: np.ndarray, how: HiddenMarkov) -> Model:
        """States that lean to different symbols at random, and tend to stay."""
        k, random = how.states, np.random.default_rng(how.seed)
        emit = weights[:, None] * np.exp(random.normal(0, 1, (len(weights), k)))
        move = np.full((k, k), 0.1 / max(1, k - 1)) + (0.9 - 0.1 / max(1, k - 1)) * np.eye(k)
        return Model(np.full(k, 1 / k), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def run(self, texts: list[np.ndarray], counts: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """Natural log likelihood of each text by the scaled forward recursion; with `counts` also the expected
        starts, moves and emissions (Baum-Welch).

        Texts are cut into chunks that go side by side: each chunk's product of matrices is computed, the
        chunks of a text are chained, and the states inside follow from where each chunk starts and ends. That is
        the same recursion in another order, exact for texts of any length.
        """
        k, move = len(self.start), self.move
        sizes = np.array([len(t) for t in texts], np.int64)
        x = np.concatenate(texts).astype(np.int64)
        pieces = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(np.cumsum(sizes) - sizes, pieces) + number * CHUNK
        size = np.minimum(CHUNK, np.repeat(sizes, pieces) - number * CHUNK)
        order = np.argsort(-size, kind="stable")  # chunks that are still going on are always in front
        begin, size, head = begin[order], size[order], number[order] == 0
        n = len(order)
        live = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size.max()))]
        emit = self.emit[x]
        product, scale = np.repeat(np.eye(k)[None], n, axis=0), np.zeros(n)
        for t, m in enumerate(live):
            step = product[:m].reshape(-1, k) @ move
            step = step.reshape(m, k, k)
            if t == 0:
                step[head[:m]] = np.eye(k)
            step *= emit[begin[:m] + t][:, None, :]
            product[:m] = step
            if t % 12 == 11 or t == len(live) - 1:
                top = product.reshape(n, -1).max(axis=1)
                product /= top[:, None, None]
                scale += np.log(top)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)  # of chunk i of the original order
        first = np.cumsum(pieces) - pieces
        enter, likelihood = np.empty((n, k)), np.zeros(len(texts))
        rank = np.argsort(-pieces, kind="stable")
        at = np.repeat(self.start[None], len(texts), axis=0)
        turns = [int(np.searchsorted(-pieces[rank], -c, "left")) for c in range(int(pieces.max()))]
        for c, m in enumerate(turns):
            who = rank[:m]
            where = place[first[who] + c]
            enter[where] = at[who]
            after = np.einsum("ij,ijk->ik", at[who], product[where])
            total = after.sum(axis=1)
            likelihood[who] += np.log(total) + scale[where]
            at[who] = after / total[:, None]
        if not counts:
            return likelihood, []
        leave = np.ones((n, k))
        back = np.ones((len(texts), k))
        for c in range(len(turns) - 1, -1, -1):
            who = rank[: turns[c]]
            where = place[first[who] + c]
            leave[where] = back[who]
            before = np.einsum("ijk,ik->ij", product[where], back[who])
            back[who] = before / before.sum(axis=1, keepdims=True)
        forward = np.empty((len(live), n, k))
        at = enter
        for t, m in enumerate(live):
            now = at[:m] @ move
            if t == 0:
                now[head[:m]] = at[:m][head[:m]]
            now *= emit[begin[:m] + t]
            now /= now.sum(axis=1, keepdims=True)
            forward[t, :m] = now
            at = now
        starts, moves, gamma, later = np.zeros(k), np.zeros((k, k)), np.empty((len(x), k)), leave
        for t in range(len(live) - 1, -1, -1):
            m = live[t]
            both = forward[t, :m] * later[:m]
            both /= both.sum(axis=1, keepdims=True)
            gamma[begin[:m] + t] = both
            right = emit[begin[:m] + t] * later[:m]
            left = forward[t - 1, :m] if t else enter[:m]
            if t == 0:
                starts += both[head[:m]].sum(axis=0)
                left, right = left[~head[:m]], right[~head[:m]]
            moves += (left / ((left @ move) * right).sum(axis=1, keepdims=True)).T @ right
            if t:
                later[:m] = right @ move.T
                later[:m] /= later[:m].sum(axis=1, keepdims=True)
        emissions = np.stack([np.bincount(x, gamma[:, s], len(self.emit)) for s in range(k)], axis=1)
        return likelihood, [starts, moves * move, emissions]

    def better(self, flat: np.ndarray, weights: np.ndarray) -> Model:
        """The model of the expected counts, with a little of the unigram mixed in so nothing is impossible."""
        k = len(self.start)
        starts, moves, emissions = flat[:k] + 0.1, flat[k : k + k * k].reshape(k, k) + 0.1, flat[k + k * k :].reshape(-1, k)
        emissions = emissions + weights[:, None] / weights.sum() * (1 + 0.01 * emissions.sum(axis=0))
        return Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))


def _buffers(batches: Iterator[pa.RecordBatch], codes: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches put together until they hold enough symbols to fill the vectors."""
    held, texts, n = [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            held.append(part)
            texts += [np.frombuffer(x.as_py(), np.uint16) for x in part.column(codes)]
            n += sum(map(len, texts[-part.num_rows :]))
            if n >= BUFFER_TOKENS or len(texts) >= 8192:
                yield held, texts
                held, texts, n = [], [], 0
    if texts:
        yield held, texts


SLOT = 512


def expected(encoded: DataFrame, model: Model) -> np.ndarray:
    """Baum-Welch counts over all rows: summed in each task, then by slots of the flat vector across tasks.

    What comes to the driver is one vector of the model's size, whatever the corpus."""
    k = len(model.start)
    size = k + k * k + model.emit.size
    load = ship(encoded.sparkSession, model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(-(-size // SLOT) * SLOT)
        seen = False
        for _, texts in _buffers(batches, 0):
            flat[:size] += np.concatenate([c.ravel() for c in load().run(texts, True)[1]])
            seen = True
        if seen:
            slots = [x.tobytes() for x in flat.reshape(-1, SLOT)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(slots), dtype=np.int32)), pa.array(slots, pa.binary())], names=["slot", "v"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[slot] = sums.get(slot, 0) + np.frombuffer(v.as_py())
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slot", "v"])

    flat = np.zeros(-(-size // SLOT) * SLOT)
    for row in encoded.select("codes").mapInArrow(count, "slot int, v binary").repartition("slot").mapInArrow(total, "slot int, v binary").collect():
        flat[row["slot"] * SLOT : (row["slot"] + 1) * SLOT] = np.frombuffer(row["v"])
    return flat[:size]


def train(encoded: DataFrame, words: Vocabulary) -> Model:
    how = words.how
    weights = np.full(words.symbols, 0.5)
    for symbol, count in words.carried.values():
        if symbol < how.own:
            weights[symbol] += count
    weights[how.own :] = 10**words.share
    model = Model.first(weights, how)
    for _ in range(how.rounds):
        model = model.better(expected(encoded, model), weights)
    return model


# -- the operator -----------------------------------------------------------------------------------


def lm_scores(docs: DataFrame, how: HiddenMarkov = HiddenMarkov(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that aren't held out. base_score is the smoothed unigram's log10 probability of the
    text. score is that of a hidden Markov model: hidden states emit frequent tokens, and classes of the
    others, within which a token has its share of the counts (one unknown token per class included); the
    forward recursion sums over all state sequences of the whole text.

    A null or empty text is one end token. A null id counts as the empty id when rows are held out. Repeated
    rows come out, and teach, as often as they go in. An empty table gives an empty result. Other columns play
    no part. Counts cover all training tokens; those of tokens beyond `how.carried`, none of which can be
    frequent, are joined by hash (64 bits) and never gathered anywhere.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id"), how.folds, how.held))
    counts = cut(token_counts(rows))
    words = vocabulary(counts, how)
    encoded = cut(encode(rows, words))
    model = train(encoded.where(~held_out(F.col("doc_id"), how.folds, how.held)), words)
    load = ship(docs.sparkSession, model)
    kept = ["row", "doc_id", "n_tokens", "n_known", "base", "plain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in _buffers(batches, len(kept)):
            table = pa.Table.from_batches(held).combine_chunks()
            chain = pa.array(load().run(texts, False)[0] / math.log(10))
            yield from table.drop_columns(["codes"]).append_column("chain", chain).to_batches()

    scored = encoded.select(*kept, "codes").mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, plain double, chain double")
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row", F.col("r.rare").alias("h"), F.col("r.rare_n").alias("k"))
    known = rare.join(counts.select(F.xxhash64("token").alias("h"), "c"), "h")
    half = math.log10(0.5)
    sums = known.groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * (F.log10(F.col("c") + 0.5) - half)).alias("gain"))
    joined = scored.join(sums, "row", "left").withColumns({"more": F.coalesce("more", F.lit(0)), "gain": F.coalesce("gain", F.lit(0.0))})
    rest = F.col("gain") + half * (F.col("n_tokens") - F.col("n_known"))
    return joined.select(
        "doc_id",
        held_out(F.col("doc_id"), how.folds, how.held).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.col("more")).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + rest).alias("base_score"),
        (F.col("chain") + F.col("plain") + rest).alias("score"),
    )
