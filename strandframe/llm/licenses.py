"""Operator 5, licence scans: a trained paragraph classifier, confirmed by templates. DataFrame functions only."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER, UPPER, ascii_lower, cut, prepare
from .licence_texts import COMMON, HELD, PLAIN, TEMPLATES, UNKNOWN

TOKEN = r"[a-z0-9]+"
NONE, UNSURE = "none", "unknown"


#: A line of 50 to 120 characters that ends no sentence goes on in the next line, if that has a letter or digit.
WRAPPED = r"(?md)^([^\n]{49,119}[^\x09-\x0D\x20.!?:;])[ \t\r]*\n(?=[^\n]*[A-Za-z0-9])"


@dataclass(frozen=True)
class Scan:
    """dropped: shares of words left out of training copies. copies: of each notice. sparse: penalty on the absolute
    weights, which makes most of them zero. sure: probability of its best family below which a licence is of an
    unknown one. alike: share of grams that confirms a template. digits: of probabilities."""

    dropped: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3)
    copies: int = 6
    steps: int = 200
    sparse: float = 3e-4
    sure: float = 0.6
    alike: float = 0.5
    digits: int = 9
    seed: int = 5


def grams(text: str) -> list[str]:
    """Distinct words and pairs of neighbouring words."""
    words = re.findall(TOKEN, text.translate(str.maketrans(UPPER, LOWER)))
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


def telling(gram: str) -> list[str]:
    """The words of a gram that aren't common; grams without any are no features."""
    return [w for w in gram.split() if w not in COMMON]


@dataclass(frozen=True)
class Classifier:
    """Grams with a weight other than zero. A text without any word of `cover` is never likelier a licence than not."""

    classes: tuple[str, ...]
    vocabulary: tuple[str, ...]
    weights: np.ndarray  # grams by classes, divided by the temperature, rounded so that sums don't depend on their order
    bias: np.ndarray
    cover: tuple[str, ...]


@lru_cache(maxsize=4)
def train(how: Scan = Scan()) -> Classifier:
    """Multinomial logistic regression on binary grams with an absolute penalty, by accelerated proximal gradient steps.

    It learns from copies of the notices, whole, with words left out, and among prose; then one temperature, chosen
    on `HELD`, whose wordings it didn't see, calibrates its probabilities.
    """
    random = np.random.default_rng(how.seed)
    notices = [(t, k) for k, ts in TEMPLATES.items() for t in ts] + [(t, UNSURE) for t in UNKNOWN] + [(t, NONE) for t in PLAIN]
    classes = (NONE, UNSURE, *TEMPLATES)
    rows = []
    for text, kind in notices:
        words = text.split()
        for i in range(how.copies):
            share = how.dropped[i % len(how.dropped)]
            left = [w for w in words if random.random() >= share] or words
            # prose around a notice: a paragraph is seldom a notice alone
            around = " ".join(random.choice(PLAIN, i // 2 + 1)) if i % 2 else ""
            rows.append((grams(" ".join([*left, around])), classes.index(kind)))
    rows += [([], 0)] * 20
    vocabulary = sorted(g for g, n in Counter(g for r, _ in rows for g in r).items() if n >= 2 and telling(g))
    # what no notice says can only speak for prose
    said = {g for t, k in notices if k != NONE for g in grams(t)}
    prose = np.array([g not in said for g in vocabulary])
    place = {g: k for k, g in enumerate(vocabulary)}

    def matrix(found):
        x = np.zeros((len(found), len(vocabulary)))
        for i, gs in enumerate(found):
            x[i, [place[g] for g in gs if g in place]] = 1
        return x

    x, y = matrix([r for r, _ in rows]), np.eye(len(classes))[[k for _, k in rows]]
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    step = 2 * len(x) / (np.linalg.norm(np.hstack([x, np.ones((len(x), 1))]), 2) ** 2)
    ahead, ahead_b, pace = w, b, 1.0
    for _ in range(how.steps):
        e = softmax(x @ ahead + ahead_b) - y
        moved = ahead - step * (x.T @ e / len(x))
        moved = np.sign(moved) * np.maximum(np.abs(moved) - step * how.sparse, 0)
        moved[prose, 1:] = 0
        moved[prose, 0] = np.maximum(moved[prose, 0], 0)
        moved_b = ahead_b - step * e.mean(axis=0)
        quicker = (1 + (1 + 4 * pace**2) ** 0.5) / 2
        ahead, ahead_b = moved + (pace - 1) / quicker * (moved - w), moved_b + (pace - 1) / quicker * (moved_b - b)
        w, b, pace = moved, moved_b, quicker
    z, target = matrix([grams(t) for _, t in HELD]) @ w + b, np.eye(len(classes))[[classes.index(k) for k, _ in HELD]]
    loss = lambda t: -np.log((softmax(z / t) * target).sum(axis=1) + 1e-12).mean()
    heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    # on a grid of 2**-20 sums are exact in any order
    w, b = np.round(w / heat * 2**20) / 2**20, np.round(b / heat * 2**20) / 2**20
    some = np.flatnonzero(np.abs(w).any(axis=1))
    vocabulary, w = tuple(vocabulary[i] for i in some), w[some]
    if softmax(b[None])[0, 0] < 0.5:
        raise ValueError("texts without any feature must be no licence")
    speaking = [g for g, row in zip(vocabulary, w, strict=True) if (row > row[0]).any()]
    cover = {telling(g)[0] for g in speaking if len(telling(g)) == 1}
    for g in speaking:
        if not cover.intersection(telling(g)):
            cover.add(telling(g)[-1])
    return Classifier(classes, vocabulary, w, b, tuple(sorted(cover)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def word_column(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0))


def gram_column(text: Column) -> Column:
    """`grams` of a text column."""
    words = word_column(text)
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    # zip_with pads the shorter list: the last word pairs with nothing and stays a word
    return F.array_distinct(F.concat(words, pairs))


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, paragraph, body): the lines of each text that have a letter or digit, wrapped ones joined by a blank, numbered from 0."""
    whole = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), WRAPPED, "$1 ")
    lines = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.posexplode(F.split(whole, "\n")).alias("paragraph", "body"))
    return lines.where(F.col("body").rlike("[A-Za-z0-9]"))


MARK = "concat_ws(':', coalesce(string(doc_id), 'null'), string(paragraph), string(line))"


def licenses(docs: DataFrame, how: Scan = Scan(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph that is a licence notice: doc_id, paragraph, family, probability, template, similarity, confirmed.

    A paragraph is a line; lines that were wrapped (`WRAPPED`) are joined. Paragraphs without a word of the model's
    `cover` can't be licences and go first. Of the others, the distinct words and word pairs meet the trained weights in a broadcast join (the
    weights are as many as the notices give, some thousand rows at most); their sums per paragraph give the
    probabilities. Paragraphs that are likelier no licence are left out; where no family has `how.sure`, the
    family is `unknown`. Then the grams of each found paragraph meet those of its family's templates:
    similarity is the share they have in common, of the smaller of the two; `how.alike` confirms.

    Null and empty texts give no rows. Rows with equal ids are one document: their lines of the same number
    are told apart by their text. Equal lines of one number and id come out once. Other columns play no part.
    The sums of a paragraph are finished in the task that read it; only sums are shuffled.
    """
    spark = prepare(docs.sparkSession)
    model = train(how)
    names = [f"z{k}" for k in range(len(model.classes))]
    schema = "gram string, " + ", ".join(f"{n} double" for n in names)
    likely = F.arrays_overlap(word_column(F.col("body")), F.array(*map(F.lit, model.cover)))
    weights = spark.createDataFrame([(g, *map(float, w)) for g, w in zip(model.vocabulary, model.weights, strict=True)], schema)
    key = ["doc_id", "paragraph", "line"]
    lines = paragraphs(docs, doc_id, text).withColumn("line", F.xxhash64("body"))
    # `row` keeps rows with equal ids apart; it is used within this one aggregation only
    exploded = lines.where(likely).withColumn("row", F.monotonically_increasing_id()).select("row", *key, F.explode(gram_column(F.col("body"))).alias("gram"))
    summed = exploded.join(F.broadcast(weights), "gram").groupBy("row", *key).agg(*(F.sum(n).alias(n) for n in names))
    scores = [F.col(n) + float(b) for n, b in zip(names, model.bias, strict=True)]
    top = F.greatest(*scores)
    total = sum((F.exp(z - top) for z in scores[1:]), F.exp(scores[0] - top))
    families = list(zip(model.classes, scores, strict=True))[2:]
    best = F.greatest(*(F.struct(z.alias("z"), F.lit(k).alias("family")) for k, z in families))
    judged = summed.select(*key, (F.exp(scores[0] - top) / total).alias("none"), best.alias("best"), top.alias("top"), total.alias("total"))
    share = F.exp(F.col("best.z") - F.col("top")) / F.col("total")
    sure = share >= how.sure
    found = judged.where("none < 0.5").select(*key, F.when(sure, F.col("best.family")).otherwise(F.lit(UNSURE)).alias("family"), F.round(F.when(sure, share).otherwise(1 - F.col("none")), how.digits).alias("probability"))
    found = cut(found.dropDuplicates(key).withColumn("mark", F.expr(MARK)))
    return confirm(lines, found, how).select("doc_id", "paragraph", "family", "probability", "template", "similarity", "confirmed")


def confirm(lines: DataFrame, found: DataFrame, how: Scan) -> DataFrame:
    """`found` with the template of its family that has most in common with the paragraph."""
    spark = lines.sparkSession
    table = [(k, f"{k}-{i}", g, len(gs)) for k, ts in TEMPLATES.items() for i, t in enumerate(ts) for gs in [grams(t)] for g in gs]
    templates = spark.createDataFrame(table, "family string, template string, gram string, size int")
    # a row for each mark and no hot one; broadcast only where it was counted to be small
    named = found.select("mark", "family")
    named = F.broadcast(named) if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else named
    texts = lines.select(F.expr(MARK).alias("mark"), "body").join(named, "mark").dropDuplicates(["mark"])
    own = texts.select("mark", "family", gram_column(F.col("body")).alias("own"))
    shared = own.select("mark", "family", F.size("own").alias("own_size"), F.explode("own").alias("gram")).join(F.broadcast(templates), ["family", "gram"])
    alike = shared.groupBy("mark", "template").agg((F.count("*") / F.least(F.max("own_size"), F.max("size"))).alias("similarity"))
    best = alike.groupBy("mark").agg(F.max(F.struct("similarity", "template")).alias("best"))
    joined = found.join(best, "mark", "left").withColumns({"template": F.col("best.template"), "similarity": F.col("best.similarity")})
    return joined.withColumn("confirmed", F.coalesce(F.col("similarity") >= how.alike, F.lit(False)))
