"""Operator 8, toxicity by weak supervision: many noisy voters, a generative label model, a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, ship
from .quality import held_out, labelled

WORDS = re.compile(r"[^\W\d_]+")

# Common English insults and abuse, each a voter of its own.
LEXICON = (
    "idiot", "moron", "stupid", "dumb", "loser", "pathetic", "worthless", "trash", "scum", "disgusting", "clown", "jerk", "fool", "ugly", "hate", "kill", "filth", "vermin", "garbage", "imbecile", "creep", "coward", "liar", "freak", "pig",
)
# Patterns of abuse, each a voter.
PATTERNS = (
    r"\byou(?:'re| are)? (?:all |just |such )?(?:an? )?(?:idiot|moron|fool|loser|clown|jerk|liar|freak|pig)s?\b",
    r"\bshut up\b",
    r"\bgo (?:away and )?die\b",
    r"\bnobody (?:likes|wants) you\b",
    r"(?:\b[A-Z]{4,}\b\W+){4,}",
    r"[!?]{4,}",
    r"\b(?:1d10t|st[u*]pid|m0ron|l0ser|tr[a4]sh)\b",
)


@dataclass(frozen=True)
class WeakSupervision:
    """sample: bound on the labelled rows that suggest and orient voters, and on the documents, whose labels aren't looked
    at, that the label model and the classifier learn from (those with the smallest hash of their id). induced: voters
    taken from words and word beginnings that labelled rows suggest. often: share of toxic rows that such a voter fires on,
    at least. features: of the linear classifier. cuts: lengths of
    word beginnings. folds, held: rows that teach nothing. sure: how often a given label is taken to be right. least:
    documents that a feature must explain to get a weight. kinds: of abuse in the label model."""

    sample: int = 8_000
    induced: int = 200
    often: float = 0.02
    features: int = 20_000
    cuts: tuple[int, ...] = (4, 5, 6, 7, 8)
    folds: int = 5
    held: int = 0
    rounds: int = 25
    kinds: int = 6
    sure: float = 0.98
    least: float = 2.0
    lexicon: tuple[str, ...] = field(default=LEXICON)
    patterns: tuple[str, ...] = field(default=PATTERNS)


def features_of(words: set[str], cuts: tuple[int, ...]) -> set[str]:
    """The distinct words, and their beginnings with a trailing `-`."""
    return words | {w[:n] + "-" for n in cuts for w in words if len(w) > n}


# -- label model ------------------------------------------------------------------------------------


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class LabelModel:
    """Voters fire or not. P(fires | class) of each, and the class prior, by expectation maximisation.

    The toxic class is a mixture of `kinds`, as abuse in one language has other voters than in another. Voters that agree
    beyond what the kinds explain count for less: a voter's weight is one over one plus the sum of its positive
    correlations, within kinds, with the others. A given label is the vote of one more voter, of a fixed reliability,
    that abstains on most rows; nan says that it does. Without labels, another model `before` says which class is which
    and how large, and counts as the rows it has seen.
    """

    def __init__(self, votes: np.ndarray, labels: np.ndarray, sure: float, rounds: int, kinds: int = 1, before: LabelModel | None = None):
        """votes: rows by voters, 0 or 1. labels: 0, 1 or nan."""
        given = ~np.isnan(labels)
        self.anchor = np.where(given, math.log(sure / (1 - sure)) * (2 * np.nan_to_num(labels) - 1), 0.0)
        self.weight = np.ones(votes.shape[1])
        if before is None:
            p = np.where(given, sigmoid(self.anchor), 0.5)
            of = np.hstack([(1 - p)[:, None], p[:, None] * self.apart(votes, labels == 1, kinds)])
            size, seen = np.zeros(kinds + 1), np.zeros((kinds + 1, votes.shape[1]))
        else:
            size, seen, of = before.size, before.seen, before.kinds(votes, 0.0)
        for step in range(rounds):
            self.size, self.seen = of.sum(axis=0), of.T @ votes
            self.fires = np.clip((self.seen + seen + 0.05) / (self.size + size + 1)[:, None], 1e-6, 1 - 1e-6)
            total = self.size + size if before is None else before.size
            self.share = np.clip(total / max(total.sum(), 1e-9), 1e-4, 1 - 1e-4)
            if step % 8 == 0:
                rest = votes - of @ self.fires
                spread = np.sqrt((rest**2).sum(axis=0)) + 1e-9
                relation = np.clip(rest.T @ rest / np.outer(spread, spread), 0, 1)
                relation[relation < 0.05] = 0
                np.fill_diagonal(relation, 0)
                silent = votes.sum(axis=0) == 0  # says nothing, and of others nothing either
                relation[silent] = relation[:, silent] = 0
                self.weight = 1 / (1 + relation.sum(axis=1))
            of = self.kinds(votes, self.anchor)
        self.prior = float(self.share[1:].sum())

    @staticmethod
    def apart(votes: np.ndarray, toxic: np.ndarray, kinds: int) -> np.ndarray:
        """First guess of the kind of each row: that of the voter that most toxic rows without a kind yet have."""
        of, left = np.full((len(votes), kinds), 1 / kinds), toxic.copy()
        for k in range(kinds if kinds > 1 else 0):
            if not (count := left @ votes).any():
                break
            mine = left & (votes[:, count.argmax()] > 0)
            of[mine] = np.eye(kinds)[k]
            left &= ~mine
        return of

    def kinds(self, votes: np.ndarray, anchor: np.ndarray | float) -> np.ndarray:
        """Posterior of the clean class and of each kind of the toxic one."""
        yes, no = self.weight * np.log(self.fires), self.weight * np.log1p(-self.fires)
        z = np.log(self.share) + no.sum(axis=1) + votes @ (yes - no).T
        z[:, 1:] += np.reshape(anchor, (-1, 1))
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Of the rows that the model was fitted to."""
        return 1 - self.kinds(votes, self.anchor)[:, 0]


# -- linear classifier ------------------------------------------------------------------------------


def logistic(rows: np.ndarray, columns: np.ndarray, n: int, d: int, target: np.ndarray, least: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features in coordinate form, with soft targets; projected Adam steps.

    Weights are not negative, so a document can't make up for abuse by length, and each costs `least`
    documents' worth of loss, so a word that few documents share gets none.
    """
    w, b, m, v = np.zeros(d), math.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)), np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        score = np.bincount(rows, w[columns], n) + b
        error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - target) / n
        grad = np.append(np.bincount(columns, error[rows], d) + least / n * (0.5 + 0.1 * w), error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = np.maximum(w - step[:d], 0), b - step[d]
    return w, float(b)


@dataclass(frozen=True)
class Toxicity:
    """weights by feature, and a bias; the score is logistic. Bounded by the number of features."""

    weights: dict[str, float]
    bias: float
    cuts: tuple[int, ...]

    def score(self, text: str) -> float:
        words, get, total = set(WORDS.findall(text.lower())), self.weights.get, self.bias
        for w in words:
            total += get(w, 0.0)
        for n in self.cuts:
            for w in {w[:n] for w in words if len(w) > n}:
                total += get(w + "-", 0.0)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, total))))


def unlike(ranked: list[str], fired: dict[str, set[int]], chosen: list[str], most: int) -> list[str]:
    """The first of the ranked voters that don't mostly fire where a chosen one does, which a beginning of the same word would."""
    new = []
    for f in ranked:
        if len(new) == most:
            break
        if all(2 * len(fired[f] & fired[g]) <= len(fired[f] | fired[g]) for g in chosen):
            new.append(f)
            chosen = [*chosen, f]
    return new


def train(documents: pa.Array, matched: np.ndarray, labels: np.ndarray, plain: np.ndarray, how: WeakSupervision) -> Toxicity:
    """documents: lists of the distinct words of each row, which stay in Arrow: only one row's features are out at a time.
    matched: rows by patterns. labels: 0, 1 or nan. plain: the rows that teach by their votes, whether labelled or not.

    Labels suggest voters, say which class is which and how large it is. The label model is fitted to the votes of the
    plain rows without labels, and the classifier learns its posteriors of these.
    """
    known = ~np.isnan(labels)
    if not known.any() or labels[known].min() == labels[known].max():
        return Toxicity({}, 20.0 if known.any() and labels[known].max() == 1 else -20.0, how.cuts)
    features = lambda i: features_of(set(documents[i].as_py()), how.cuts)
    bad, good, n1, n0 = Counter(), Counter(), int(labels[known].sum()), int((1 - labels[known]).sum())
    for i in np.flatnonzero(labels == 1):
        bad.update(features(i))
    bad = Counter({f: k for f, k in bad.items() if k >= 3})
    for i in np.flatnonzero(labels == 0):
        good.update(features(i) & bad.keys())
    odds = {f: math.log((k + 0.5) / (n1 + 1)) - math.log((good[f] + 0.5) / (n0 + 1)) for f, k in bad.items()}
    ranked = sorted((f for f, z in odds.items() if z > 2.5 and bad[f] >= how.often * n1), key=lambda f: (-odds[f] * math.sqrt(bad[f]), -len(f), f))
    fired: dict[str, set[int]] = {f: set() for f in (*ranked, *how.lexicon)}
    for i in np.flatnonzero(labels == 1):
        for f in features(i) & fired.keys():
            fired[f].add(i)
    suggested = unlike(ranked, fired, list(how.lexicon), how.induced)
    voters = {f: k for k, f in enumerate(dict.fromkeys([*how.lexicon, *suggested]))}
    votes, n = np.zeros((len(labels), len(voters))), int(plain.sum())
    for i in range(len(labels)):
        for f in features(i) & voters.keys():
            votes[i, voters[f]] = 1
    silent = (votes.sum(axis=1, keepdims=True) + matched.sum(axis=1, keepdims=True) == 0).astype(float)  # a voter for clean
    votes = np.hstack([votes, matched, silent])
    first = LabelModel(votes[known], labels[known], how.sure, how.rounds, how.kinds)
    votes = votes[plain]
    target = LabelModel(votes, np.full(n, np.nan), how.sure, how.rounds, how.kinds, first).posterior(votes)
    # features that speak for toxicity in the rows that the model takes to be toxic, by how much they tell
    rows = np.flatnonzero(plain)
    bad, good, n1 = Counter(), Counter(), target.sum()
    for i, p in zip(rows, target, strict=True):
        if p > 0.01:
            for f in features(i):
                bad[f] += p
    bad = {f: k for f, k in bad.items() if k >= 2}
    for i, p in zip(rows, target, strict=True):
        for f in features(i) & bad.keys():
            good[f] += 1 - p
    odds = {f: math.log((k + 0.5) / (n1 + 1)) - math.log((good[f] + 0.5) / (n - n1 + 1)) for f, k in bad.items()}
    tell = {f: z * math.sqrt(bad[f]) for f, z in odds.items() if z > 1}
    chosen = {f: k for k, f in enumerate(sorted(tell, key=lambda f: (-tell[f], f))[: how.features])}
    columns = [np.fromiter((chosen[f] for f in features(i) & chosen.keys()), np.int64) for i in rows]
    width = [len(c) for c in columns]
    if not sum(width):
        return Toxicity({}, math.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)), how.cuts)
    w, b = logistic(np.repeat(np.arange(n), width), np.concatenate(columns), n, len(chosen), target, how.least)
    return Toxicity({f: float(w[k]) for f, k in chosen.items() if w[k] > 1e-3}, b, how.cuts)


def fit(docs: DataFrame, labels: DataFrame, how: WeakSupervision = WeakSupervision(), doc_id: str = "doc_id", text: str = "text") -> Toxicity:
    """Learn from bounded samples of rows that aren't held out: labelled ones, and any, whose labels aren't looked at.
    `labels(doc_id, label)`, one row per id."""
    patterns, folds = [re.compile(p) for p in how.patterns], ~held_out(F.col("doc_id"), how.folds, how.held)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    first = lambda df, *more: df.where(folds).orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.sample).select("doc_id", *more)
    known = first(labels, F.col("label").cast("double"), F.lit(False).alias("plain"))
    other = first(rows.select("doc_id").where("doc_id is not null").distinct(), F.lit(None).cast("double").alias("label"), F.lit(True).alias("plain"))
    sample = cut(known.union(other).groupBy("doc_id").agg(F.max("label").alias("label"), F.max("plain").alias("plain")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = [x.as_py() or "" for x in batch.column(3)]
            words = [sorted(set(WORDS.findall(t.lower()))) for t in body]
            hits = [[int(p.search(t) is not None) for p in patterns] for t in body]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.int8()))], names=["doc_id", "label", "plain", "words", "hits"])

    # twice `how.sample` rows bound the broadcast; of rows that share an id one teaches, so they bound what comes to the driver
    taught = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("plain").alias("plain"), F.min("text").alias("text"))
    table = taught.mapInArrow(run, "doc_id long, label double, plain boolean, words array<string>, hits array<tinyint>").toArrow().sort_by("doc_id")
    hits = np.array(table["hits"].to_pylist(), float).reshape(-1, len(patterns))
    given = np.array([np.nan if x is None else x for x in table["label"].to_pylist()], float)
    return train(table["words"].combine_chunks(), hits, given, np.array(table["plain"].to_pylist(), bool), how)


def toxicity_scores(docs: DataFrame, labels: DataFrame, how: WeakSupervision = WeakSupervision(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Lexicon, pattern and suggested voters vote on a bounded sample of documents; without looking at labels a
    generative model estimates how often each voter is right and which repeat each other, and gives each row
    a posterior; a linear classifier over words and word beginnings learns the posteriors and scores every
    whole text. Labels, on a bounded sample of their own, suggest voters and say which class is which and how large.
    Held-out rows take no part in the fit.

    Null and empty texts have no features and the score of the bias. A null id is in the fold of the empty
    id and can't have a label. Repeated rows come out as often as they go in. Without labels of both classes
    all documents score as the one class there is, and as clean where there is none. Other columns play no part.
    """
    spark = prepare(docs.sparkSession)
    model = fit(docs, labelled(labels, label), how, doc_id, text)
    sent = ship(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([sent().score(x.as_py() or "") for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id"), how.folds, how.held).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, how: WeakSupervision = WeakSupervision(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of `docs` that `toxicity_scores` doesn't predict to be toxic, with all their columns. Rows are judged where
    they are read; nothing is joined or shuffled. Null and empty texts have the score of the bias, repeated rows and rows
    without an id are judged each by its text, columns may have any names, and without labels all rows stay."""
    load = ship(prepare(docs.sparkSession), fit(docs, labelled(labels, label), how, doc_id, text))

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: load().score(t or "") >= 0.5).astype(bool)

    return docs.where(~toxic(F.coalesce(F.col(text).cast("string"), F.lit(""))))
